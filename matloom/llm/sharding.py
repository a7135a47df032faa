"""Sharding by a keyed permutation of global row numbers.

Rows are numbered from 0 in the order of their ids (nulls first, ties by the hash of the row). A balanced Feistel network over the least even
number of bits that holds the number of rows permutes the numbers; a result beyond the last row walks the cycle, that is, it is
permuted again until it is a row's. The permuted place p stands in shard p % shards at slot p // shards, so that counts differ by one at most, slots have no
gaps, and both follow from the row's number, the number of rows, the shards and the seed alone (`place_of`; `row_of` is its inverse).

Row numbers come from a range partitioning of narrow rows and the counts of the ranges before, so no task sees more than its range; rows that are the same
throughout stand in any order, and are spread over ranges by where they were read.
Nulls: a null id sorts first, a null text has no bytes. Groups of equal texts are dealt out like other rows. Empty tables give no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.llm.sums import crc32_sql
from matloom.plans.names import quoted
from matloom.plans.prefix import running

ROUNDS, WORD32 = 4, np.uint64(0xFFFFFFFF)
#: The multipliers of murmur3's 32-bit finaliser.
MIX = (0x85EBCA6B, 0xC2B2AE35)


def _stirred(x: np.ndarray) -> np.ndarray:
    """A 32-bit mix of each number below 2 ** 32."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(MIX[0])) & WORD32
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(MIX[1])) & WORD32
    return x ^ (x >> np.uint64(16))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 32-bit key a round, from the seed."""
    at = np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(rounds) * np.uint64(seed % (1 << 32))
    return _stirred(at & WORD32).tolist()


def half_bits(n: int) -> int:
    """Bits of each half: twice as many hold the numbers below n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    h, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> h, x & mask
    for key in keys:
        left, right = right, left ^ (_stirred(right ^ np.uint64(key)) & mask)
    return (left << h) | right


def _unfeistel(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    h, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> h, x & mask
    for key in reversed(keys):
        left, right = right ^ (_stirred(left ^ np.uint64(key)) & mask), left
    return (left << h) | right


def _walked(x: np.ndarray, n: int, step) -> np.ndarray:
    x = step(np.asarray(x).astype(np.uint64))
    while len(far := np.flatnonzero(x >= np.uint64(n))):
        x[far] = step(x[far])
    return x.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The places of row numbers below n. n may be 2 ** 62 at most."""
    bits, keys = half_bits(n), round_keys(seed)
    return _walked(rows, n, lambda x: _feistel(x, bits, keys))


def unpermuted(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row numbers of places below n."""
    bits, keys = half_bits(n), round_keys(seed)
    return _walked(places, n, lambda x: _unfeistel(x, bits, keys))


def place_of(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permuted(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_of(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number at a slot of a shard."""
    return int(unpermuted(np.array([slot * shards + shard]), n, seed)[0])


def numbered(rows: DataFrame, id: str, tie: Column) -> DataFrame:
    """row (a struct of the columns of `rows`) and number: its place in the order of (id, tie), from 0. `rows` is written once, so it should be narrow."""
    held = rows.select(F.struct(*[rows[quoted(c)] for c in rows.columns]).alias("row"), rows[quoted(id)].alias("id"), tie.alias("tie"), F.lit(1).cast("long").alias("one"))
    # Rows that are the same in all are spread by where they were read.
    return running(held.withColumn("read", F.monotonically_increasing_id()), ["id", "tie", "read"], {"one": "number"}).select("row", "number")


def dealt(rows: DataFrame, shards: int, id: str = "doc_id", seed: int = 0) -> DataFrame:
    """row (a struct of the columns of `rows`), number, shard and slot of every row. Ties of ids go by the hash of the columns."""
    if shards < 1:
        raise ValueError("there is one shard at least")
    rows = numbered(rows, id, F.xxhash64(*[F.to_json(F.struct(rows[quoted(c)])) if "map<" in t else rows[quoted(c)] for c, t in rows.dtypes]))
    n = rows.count()

    @F.arrow_udf("long")
    def place(number: pa.Array) -> pa.Array:
        return pa.array(permuted(number.to_numpy(zero_copy_only=False), n, seed), pa.int64())

    p = F.col("p")
    return rows.select("row", "number", place("number").alias("p")).select("row", "number", (p % shards).cast("int").alias("shard"), F.expr(f"p div {int(shards)}").alias("slot"))


def of_texts(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size (bytes of the text and eight more), text_crc32, law, shard, slot, grown_shard and number of every document (doc_id, text). Texts are read once, for their sizes and sums."""
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    row = F.col("row")
    return dealt(narrow, shards, seed=seed).select(row["doc_id"].alias("doc_id"), row["size"].alias("size"), row["text_crc32"].alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "number")


def write(docs: DataFrame, path: str, shards: int, seed: int = 0, rows_a_file: int = 100_000) -> None:
    """Writes every document, with its columns, below path/shard=<n>/, in the order of slots, in files of `rows_a_file` rows; a shard is dealt over many tasks.

    Here whole rows are written once for their numbers; ids should be unique for the order not to depend on their other columns.
    """
    placed = dealt(docs, shards, seed=seed)
    part = F.expr(f"slot div {int(rows_a_file)}")
    taken = {c.lower() for c in docs.columns} & {"shard", "slot"}
    if taken:
        raise ValueError(f"the documents have columns named {sorted(taken)}, which the files need")
    out = placed.repartition("shard", part).sortWithinPartitions("shard", "slot").select("row.*", "slot", "shard")
    out.write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path)


def sql(shards: int = 24, seed: int = 0) -> str:
    """The same rows in DuckDB."""
    keys = ", ".join(f"{k}::UBIGINT" for k in round_keys(seed))
    low = "4294967295::UBIGINT"
    # One value a step: lists of one element stand for the names of parts of an expression.
    stir = "xor(right_, k)"
    for line in (
        "xor(x, x >> 16)",
        f"(x * {MIX[0]}::UBIGINT) & {low}",
        "xor(x, x >> 13)",
        f"(x * {MIX[1]}::UBIGINT) & {low}",
        "xor(x, x >> 16)",
    ):
        stir = f"list_transform([{stir}], lambda x: {line})[1]"
    feistel = f"list_reduce([{{v}}, {keys}], lambda s, k: list_transform([s & mask], lambda right_: (right_ << h) | xor(s >> h, {stir} & mask))[1])"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
m AS (SELECT doc_id, octet_length(b) + 8 AS size, b FROM d),
r AS (SELECT *, (row_number() OVER (ORDER BY doc_id NULLS FIRST, size, b) - 1)::UBIGINT AS number FROM m),
c AS (SELECT n, h, ((1::UBIGINT << h) - 1)::UBIGINT AS mask FROM (SELECT n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2)::UBIGINT AS h FROM (SELECT count(*)::UBIGINT AS n FROM m))),
w AS (SELECT number, {feistel.format(v="number")} AS p FROM r, c
    UNION ALL SELECT number, {feistel.format(v="p")} FROM w, c WHERE p >= n)
SELECT doc_id, size::BIGINT AS size, {crc32_sql('b')} AS text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, (p // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, r.number::BIGINT AS number
FROM r JOIN w USING (number), c WHERE p < n
"""
