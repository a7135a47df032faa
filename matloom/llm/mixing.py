"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the mix by weight, stopped at `cap` times its own
size; what a stopped source leaves is shared anew among the others by weight. Within a
source every document has the same expected number of copies, target / source size. Its
prefix sum is laid out, one offset per source is added, and a document is emitted once
for each integer boundary that its stretch crosses.

The layout goes by size class and, within one, by `spread` strata of the id, so that
a source of any size is laid out by many tasks: each stratum numbers its own rows, and
strata are offset by the counts before them. Laying out by size keeps the words taken
near the target, as the copies are even over every size.

Nulls: a null text has size 0; a null source is a source of its own, after the others;
null ids sort first. Empty tables give no rows. Rows repeated in full share the copies of
their places in the layout. Other columns, whatever their names, travel in `row`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.plans.materialize import cut
from matloom.plans.names import quoted

WORD = r"[^\x20\x09-\x0D]+"
#: A stratum of the layout: source (null or not, name), size class, part of the class.
KEY = ["s_null", "src", "cls", "part"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _laid_out(rows: DataFrame, spread: int) -> DataFrame:
    """row, size, tie and the stratum, from row (doc_id, source), size and tie."""
    return rows.select(
        "row",
        "size",
        "tie",
        F.col("row.source").isNull().alias("s_null"),
        F.coalesce(F.col("row.source"), F.lit("")).alias("src"),
        F.expr("length(bin(size)) * 32 + pmod(shiftright(size, cast(greatest(length(bin(size)) - 6, 0) as int)), 32)").cast("int").alias("cls"),
        F.pmod(F.coalesce(F.col("row.doc_id"), F.lit(0)), F.lit(spread)).cast("int").alias("part"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(s_null, src, source_size, target) from one row per source: the table of sources, a few bytes each, is ranked in one task."""
    each = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy("s_null", "src")
    by_need = Window.orderBy("need", "s_null", "src")
    ranked = sizes.withColumn("w", F.element_at(each, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("need", F.col("cap") / F.col("w"))
    ranked = ranked.withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("full", (F.col("whole") - before) / onward * F.col("w") >= F.col("cap"))
    left = F.col("whole") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0.0))).over(everything)
    open_w = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * left / F.nullif(open_w, F.lit(0.0))))
    return ranked.select("s_null", "src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, spread: int = 64) -> DataFrame:
    """row (the document), size, source_size, target, copies, taken: one row per row of `docs`.

    Copies are worked out on narrow rows (doc_id, source, size, hash of the text); documents are then dealt once, to be
    hashed against them, and never sorted. Only where rows repeat in full are those numbered, to share their places' copies.
    """
    text = docs["text"]
    narrow = cut(docs.select(F.struct("doc_id", "source").alias("row"), word_count(text).alias("size"), F.xxhash64(text).alias("tie")), "sizes")
    placed = _mixed(_laid_out(narrow, spread), F.col("tie"), weights, share, cap, seed)
    same = [F.coalesce(F.col("row.doc_id"), F.lit(0)).alias("_id"), F.xxhash64(F.col("row.doc_id").isNull(), F.col("row.source").isNull(), "row.source", "tie").alias("_key")]
    found = placed.groupBy(*same, "size", "source_size", "target").agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies"))
    found = cut(found, "copies")
    whole = docs.select(
        F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"], F.lit(0)).alias("_id"), F.xxhash64(docs["doc_id"].isNull(), docs["source"].isNull(), docs["source"], F.xxhash64(text)).alias("_key")
    )
    out = lambda df, copies: df.select("row", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
    joined = whole.join(found.where("_rows = 1").hint("shuffle_hash"), ["_id", "_key"])
    result = out(joined, F.col("_copies"))
    repeated = found.where("_rows > 1")
    if repeated.limit(1).count():
        nth = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(0)))
        rows = whole.join(repeated.hint("shuffle_hash"), ["_id", "_key"]).withColumn("_nth", nth)
        result = result.union(out(rows, F.expr("_copies div _rows + if(_nth <= _copies % _rows, 1, 0)")))
    return result


def shares(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, spread: int = 64) -> DataFrame:
    """The same without the documents: texts are read once, for their sizes; row holds doc_id and source. Rows with equal ids and sizes, which mix() orders by their texts, are not told apart."""
    sizes = cut(docs.select(F.struct("doc_id", "source").alias("row"), word_count(F.col("text")).alias("size"), F.lit(0).alias("tie")), "sizes")
    return _mixed(_laid_out(sizes, spread), F.col("tie"), weights, share, cap, seed)


def _before(strata: DataFrame) -> DataFrame:
    """`first`: rows of the source in earlier strata, in two steps, so that no task holds more than a source's classes or a class's parts."""
    classes = strata.groupBy("s_null", "src", "cls").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("s_null", "src").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("s_null", "src", "cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("s_null", "src", "cls", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    return strata.withColumn("beside", F.coalesce(F.sum("n").over(beside), F.lit(0))).join(classes.hint("merge"), ["s_null", "src", "cls"]).withColumn("first", F.col("above") + F.col("beside"))


def _mixed(rows: DataFrame, tie: Column, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    strata = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(strata.groupBy("s_null", "src").agg(F.sum("words").alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("s_null"), "-").otherwise("+"), F.col("src"))), 1, 6), 16, 10).cast("double") / F.lit(16777216.0)
    strata = (
        _before(strata)
        .join(targets, ["s_null", "src"])
        .select(*KEY, "first", "source_size", "target", offset.alias("u"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    )
    place = Window.partitionBy(*KEY).orderBy("size", F.col("row.doc_id"), tie)
    at = (F.col("first") + F.col("place")).cast("double")
    crossed = F.floor(F.col("rate") * at + F.col("u")) - F.floor(F.col("rate") * (at - 1.0) + F.col("u"))
    return (
        rows.withColumn("place", F.row_number().over(place))
        .join(strata.hint("merge"), KEY)
        .withColumn("copies", F.greatest(F.lit(0), F.least(crossed, F.floor(F.lit(float(cap))))).cast("long"))
        .select("row", "size", "tie", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixed.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")


#: The same rows in DuckDB.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS s_null, coalesce(source, '') AS src,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
k AS (SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 6, 0)::INT) % 32 AS cls,
    ((coalesce(doc_id, 0) % 64) + 64) % 64 AS part FROM d),
s AS (SELECT s_null, src, sum(size)::BIGINT AS source_size FROM k GROUP BY ALL),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY s_null, src) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM s),
f AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / w, s_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, s_null, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w >= cap AS "full" FROM r),
t AS (SELECT *, CASE WHEN "full" THEN cap ELSE least(cap, w * (whole - sum(CASE WHEN "full" THEN cap ELSE 0.0 END) OVER ())
    / nullif(sum(CASE WHEN "full" THEN 0.0 ELSE w END) OVER (), 0.0)) END AS target,
    ('0x' || substr(md5('0:' || CASE WHEN s_null THEN '-' ELSE '+' END || src), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY s_null, src ORDER BY cls, part, size, doc_id NULLS FIRST)::DOUBLE AS pos FROM k),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, u, pos
    FROM p JOIN t USING (s_null, src))
SELECT doc_id, size, source_size, target,
    greatest(0, least(floor(rate * pos + u) - floor(rate * (pos - 1.0) + u), 2))::BIGINT * size AS taken FROM c
"""
