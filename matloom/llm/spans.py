"""Shared by the operators that mark stretches of a text: rows out, digests, and replacing marked stretches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matloom.plans.names import quoted

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def schema(kinds: list[str]) -> T.StructType:
    return T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in kinds], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scan(docs: DataFrame, kinds: list[str], find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256, spans. `find` runs once in a worker and gives what maps a text to (base spans, all spans)."""
    out = schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = find()
        for batch in batches:
            counts, shas, every = [[] for _ in kinds], [], []
            for text in batch.column(1):
                base, full = spans_of(text.as_py() or "")
                for k, c in zip(kinds, counts):
                    c.append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(full))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(every, pa.string())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def redact(docs: DataFrame, find: Callable, mark: Callable[[str], str]) -> DataFrame:
    """`docs` with each marked stretch of `text` replaced, overlapping ones as one; n_chars, where there is such a column, follows the new text. Only texts go to the workers."""

    def clean(spans_of: Callable, text: str | None) -> str | None:
        """The new text, or None where nothing is marked."""
        spans = sorted(spans_of(text)[1], key=lambda s: s[1]) if text else []
        parts, done = [], 0
        for kind, a, b in spans:
            if a >= done:
                parts += [text[done:a], mark(kind)]
            done = max(done, b)
        return "".join([*parts, text[done:]]) if spans else None

    @F.arrow_udf("string")
    def changed(texts: pa.Array) -> pa.Array:
        spans_of = find()
        return pa.array([clean(spans_of, t.as_py()) for t in texts], pa.string())

    # The row travels as one column, so that no name of its own is taken.
    held = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), changed(docs["text"]).alias("changed"))
    new = {"text": F.coalesce("changed", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed").isNull(), F.col("row.n_chars")).otherwise(F.length("changed")).cast(docs.schema["n_chars"].dataType)
    return held.select(*[new.get(c, F.col("row." + quoted(c))).alias(c) for c in docs.columns])
