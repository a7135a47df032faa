"""What near-duplicates shuffle of the documents grows with the rows that are wanted."""

from pyspark.sql import functions as F

from matloom.llm import neardup
from matloom.plans.joins import maybe_among
from matloom.plans.materialize import cut


def test_all_wanted_rows_and_few_others_stay(spark):
    rows = spark.range(-5000, 15_000).withColumnRenamed("id", "doc_id").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    keys = cut(spark.range(-5000, 15_000, 40).select(F.col("id").alias("node")).union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "keys")
    got = [r[0] for r in maybe_among(rows, "doc_id", keys).collect()]
    assert len(got) == len(set(got)) and set(range(-5000, 15_000, 40)) <= set(got) and len(got) < 1000
    assert maybe_among(rows, "doc_id", keys.limit(0)).count() == 0


def test_texts_are_dropped_before_they_are_shuffled(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two three four five"), F.col("id")).alias("text"))
    wanted = cut(docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("node")), "wanted")
    sets = neardup.full_sets(docs, wanted, docs)
    assert sorted(r[0] for r in sets.collect()) == list(range(0, 3000, 50))
    plan = sets._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # Above a shuffle (further up in the text) stands the join with the wanted rows, below it the one with their bits.
    assert 0 < plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning") < plan.index("BroadcastNestedLoopJoin")


def test_documents_that_surely_stay_are_not_shuffled(spark, monkeypatch):
    docs = cut(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")), "docs")
    monkeypatch.setattr(neardup, "classes", lambda d, threshold: d.select("doc_id", (F.col("doc_id") % 50 != 0).alias("kept")))
    monkeypatch.setattr(neardup, "broadcast_if_small", lambda df: df.hint("merge"))
    kept = neardup.keep_one(docs)
    assert sorted(r[0] for r in kept.collect()) == [i for i in range(3000) if i % 50]
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    plan = plan[plan.index("SortMergeJoin") :]
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastNestedLoopJoin")


def test_differences_are_shuffled_by_their_pair(spark, monkeypatch):
    """Twice, to their places and to their blocks; not with their component and their hub's blocks as well."""
    checked = cut(spark.createDataFrame([(1, n, n < 4, 10, 10, bytes(4), bytes(8)) for n in (2, 3, 4, 5)], neardup.CHECKED), "checked")
    component = cut(spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long"), "component")
    monkeypatch.setattr(neardup, "broadcast_if_small", lambda df: df.hint("merge"))
    links = neardup.cross_links(checked, component, 0.8)
    assert {frozenset(r) for r in links.collect()} == {frozenset((1, 4)), frozenset((1, 5))}
    plan = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 1
