"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom.llm import audit, bpe, licenses, media, mixing, nearest, neardup, pii, quality, secrets, sharding, trie, warc
from matloom.sources.tables import table as read

TOKENIZER = "word_bpe_49k.json"


def op1_mixing(spark, sf_dir):
    mixed = mixing.shares(read(spark, sf_dir, "documents"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_licenses(spark, sf_dir):
    """Documents have no paths: a file stands below its source, its language and a directory for each digit of its doc_id but the last, so that every directory may hold licence files for those below it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    digits = F.expr("CASE WHEN doc_id >= 10 THEN regexp_replace(string(doc_id div 10), '(.)', '/$1') ELSE '' END")
    return licenses.scan(read(spark, sf_dir, "documents"), F.concat(part("source"), F.lit("/"), part("lang"), F.coalesce(digits, F.lit("")), F.lit("/"), part("doc_id")))


def op5_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digests=True)


def op2_nearest(spark, sf_dir):
    return nearest.among(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=20, every=20)


def op3_pii(spark, sf_dir):
    return pii.scan(read(spark, sf_dir, "documents"))


def op6_media(spark, sf_dir):
    return media.of_texts(read(spark, sf_dir, "documents"), digests=True)


def op7_warc(spark, sf_dir):
    return warc.read(warc.archive(spark, read(spark, sf_dir, "pages")))


def op8_neardup(spark, sf_dir):
    return neardup.classes(read(spark, sf_dir, "documents"), 0.85)


def op9_secrets(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.score(read(spark, sf_dir, "documents"))


def op11_sharding(spark, sf_dir):
    return sharding.of_texts(read(spark, sf_dir, "documents"), shards=24)


def op12_trie(spark, sf_dir):
    return trie.trie(read(spark, sf_dir, "conversations"), heads=5, most=8)


def op13_audit(spark, sf_dir):
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_nearest, op3_pii, op4_licenses, op5_bpe, op6_media, op7_warc, op8_neardup, op9_secrets, op10_quality, op11_sharding, op12_trie, op13_audit)
}
ORACLES = {
    "op1_mixing": mixing.MIX_SQL,
    "op2_nearest": nearest.NEAREST_SQL,
    "op4_licenses": licenses.SCAN_SQL,
    "op11_sharding": sharding.sql(24),
    "op12_trie": trie.sql(5, 8),
    "op13_audit": audit.AUDIT_SQL,
}
