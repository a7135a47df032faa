"""Joins whose broadcast side is checked first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be broadcast: some MB as a hash table. A plan may hold several, and a driver keeps those of earlier plans
#: until its heap is collected (six of 500,000 rows took it from 506 to 1,208 MB, six of 100,000 to 720). The near-duplicates of 0.5 GB of documents have
#: twenty such joins of up to 70,000 rows.
BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (read from files, of narrow rows) with a broadcast hint if it has at most `rows` rows.

    Joins with it carry the hint "merge" on their other side, which holds where this one is not given: without any, Spark would go by the bytes of files, which may
    hold many rows, or by a guess made of them, as after an explode (512 MiB of bands of documents, taken for less than 10).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of a table of hashes: sixteen for each key, within these bounds (8 KB to 8 MB to each executor).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def maybe_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose `key` is in `keys` (one column, read from files), and a few others, which a join drops. What is then shuffled grows with `keys`, not with `df`."""
    return split_among(df, key, keys)[0]


def split_among(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of maybe_among(), and all others, whose `key` surely is not in `keys`.

    Hashes of the keys are bits of one array of bounded length, sent to all tasks; where there are more keys than it has room for, more other rows are among the first.
    """
    at = F.xxhash64(F.col(keys.columns[0]))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    word, bit = (lambda h: F.shiftright(F.pmod(h, F.lit(bits)), 6)), (lambda h: F.pmod(h, F.lit(64)).cast("int"))
    some = keys.where(F.col(keys.columns[0]).isNotNull()).select(word(at).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(at)).alias("set"))
    every = some.union(df.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))).groupBy("word").agg(F.bit_or("set").alias("set"))
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias(words := f"_words_{uuid.uuid4().hex}"))
    h = F.xxhash64(F.col(key))
    held = F.getbit(F.element_at(words, (word(h) + 1).cast("int")), bit(h)) == 1
    return tuple(df.join(F.broadcast(table), some).drop(words) for some in (held, ~held))
