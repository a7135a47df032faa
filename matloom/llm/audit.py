"""How filters of documents interact: what each removes in every order, what it alone removes, and its share of all removals.

The word statistics are relational: documents are dealt by (doc_id, hash of the text), words are exploded and counted by
(document, word), those by document for its words and distinct words. The other filters' flags are joined to them from an outer side, so that documents
without words stay, and each part's documents are counted by the 32 sets of filters that they fail. All orders are sums over those 32 columns.

A document dealt out is a row of the table; rows with the same id and text are counted as often as they stand, and are spread by where
they are read, so that no id is one task's. Words are counted within the partition that holds their document. What filter E asks for, the smallest id of each text, is joined back by
(text, id), which no group of copies makes hot.

Nulls: a null text or language is the empty one; a null id is never larger than another, nor smaller; labels of ids that stand twice count where either holds. A null label is none.
Empty tables give no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.plans.materialize import cut

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SETS = 1 << len(FILTERS)
#: Parts of the rows of one id and text, by where they are read.
SPREAD = 64


def words(docs: DataFrame) -> DataFrame:
    """id, x, words, distinct of every document (id, text); x is the text's hash."""
    dealt = docs.select("id", "text", F.xxhash64("text").alias("x"), (F.spark_partition_id() % SPREAD).alias("read")).repartition("id", "x", "read")
    # A null before each document's words tells how often its row stands in the group, whose counts are that many times the document's own.
    each = dealt.select("id", "x", "read", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    by_word = each.groupBy("id", "x", "read", "word").agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    by_doc = by_word.groupBy("id", "x", "read").agg((F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)) / rows).cast("long").alias("words"), F.count("word").alias("distinct"))
    return by_doc.groupBy("id", "x").agg(F.max("words").alias("words"), F.max("distinct").alias("distinct"))


def flags(docs: DataFrame) -> DataFrame:
    """id, x, part, rows, c, d, e of every document (id, text, part); equal rows of the three are one with its number of `rows`."""
    text = F.col("text")
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    marked = docs.select("id", F.xxhash64(text).alias("x"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("same"), "part", (upper * 100 > F.length(text) * 3).alias("c"), text.rlike("[#$%&*|]").alias("d"))
    each = cut(marked.groupBy("id", "x", "same", "part").agg(F.count(F.lit(1)).alias("rows"), F.max("c").alias("c"), F.max("d").alias("d")), "flags")
    first = each.groupBy("same").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    return each.join(first, ["same", "id"], "left").select("id", "x", "part", "rows", "c", "d", (F.col("id").isNotNull() & F.col("first").isNull()).alias("e"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for each of the 32 sets of filters failed (bit 0 is A), the numbers of documents, of good and of toxic ones: n_0 to n_31, good_0 .., toxic_0 .."""
    kept = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.coalesce(docs["lang"], F.lit("")).alias("part"))
    known = labels.select(labels["doc_id"].cast("long").alias("id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic")).groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    f, w = flags(kept).alias("f"), words(kept).alias("w")
    both = f.join(w, F.col("f.id").eqNullSafe(F.col("w.id")) & (F.col("f.x") == F.col("w.x")), "left").join(known.alias("k"), F.col("f.id") == F.col("k.id"), "left")
    total, distinct = F.coalesce("w.words", F.lit(0)), F.coalesce("w.distinct", F.lit(0))
    failed = [total < 200, distinct * 100 < total * 50, F.col("f.c"), F.col("f.d"), F.col("f.e")]
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failed)), F.lit(0))
    rows = both.select("f.part", "f.rows", bits.alias("set"), F.col("k.good").alias("good"), F.col("k.toxic").alias("toxic"))
    here = lambda m, c: F.sum(F.when(c & (F.col("set") == m), F.col("rows")).otherwise(0))
    conditions = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    return rows.groupBy("part").agg(*[here(m, c).alias(f"{name}_{m}") for name, c in conditions.items() for m in range(SETS)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each part, all 120 orders of the filters and each step of them."""
    by_part = counted(docs, labels).select("part", *[F.array(*[f"{name}_{m}" for m in range(SETS)]).alias(name) for name in ("n", "good", "toxic")])
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = by_part.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    bit = lambda letter: F.expr(f"shiftleft(1, instr('{FILTERS}', {letter}) - 1)")
    steps = steps.withColumn("own", bit("filter")).withColumn("before", F.expr(f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (a, i) -> a + shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1))"))
    total = lambda of, when, times="": F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (a, m) -> a + if({when}, {of}[m]{times}, 0L))")
    here, earlier = "m & own <> 0", "m & before <> 0"
    # Of all orders, a filter comes first of a set's in one of as many parts as the set has filters.
    return steps.select(
        "part", "filter_order", "step", "filter",
        total("n", "m & (own | before) = 0").alias("kept"),
        total("n", f"{here} AND NOT ({earlier})").alias("removed"),
        total("n", f"{here} AND {earlier}").alias("redundant"),
        total("n", "m = own").alias("unique_fails"),
        total("good", f"{here} AND NOT ({earlier})").alias("good_lost"),
        total("toxic", f"{here} AND NOT ({earlier})").alias("toxic_lost"),
        total("n", here, " * (120 div bit_count(m))").alias("shapley"),
    )


#: The same rows in DuckDB: every order is walked as it stands.
AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS failed,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
c AS (SELECT g.*, s.*, contains(failed, x) AS fails, len(list_filter(string_split(failed, ''), lambda y: y <> '' AND contains(before, y))) > 0 AS gone FROM g, s),
r AS (SELECT part, filter_order, step::INT AS step, x,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = x), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step, x AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
