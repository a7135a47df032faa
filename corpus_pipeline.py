"""The corpus pipeline: reject poor documents, keep one of each near-duplicate group, mask secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last
return the columns of `docs`. A secret's stretch becomes `[secret]`; a document that the mix takes twice is
two rows; the last stage returns each row's token count and the digests of its ids and of the decoded text.

Null and empty texts are kept by the first four stages (nothing is against them, they are no copies, hold no secrets, and have no words to take: a mix takes
them as often as its layout says) and have no tokens. Of texts that tie in a group, the one with the least doc_id stays. Rows that repeat in full count as one document for near-duplicates and
stay or go together; rows with a null doc_id are no copies of anything. An empty table gives no rows from any stage. Columns of any other name pass through the first four stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matloom.llm import bpe, mixing, neardup, quality, secrets
from matloom.plans.materialize import cut
from matloom.sources.tables import let_workers_import, table

TOKENIZER = "word_bpe_49k.json"
#: The near-duplicate stage's threshold; the 0.85 of `op8_neardup` is that query's contract alone.
SIMILAR = 0.8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Less the documents that the classifier rejects, which is trained on this stage's own input."""
    let_workers_import(spark)
    return quality.keep(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near-duplicates."""
    let_workers_import(spark)
    return neardup.keep_one(docs, SIMILAR)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's stretch as `[secret]`; n_chars follows the new text."""
    let_workers_import(spark)
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    let_workers_import(spark)
    return mixing.emit(mixing.mix(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    import public_tokenizers

    let_workers_import(spark)
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), digests=True)


STAGES = [("quality", good), ("near-duplicates", distinct), ("secrets", masked), ("mixing", mixed), ("encoding", encoded)]
#: The learned classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
