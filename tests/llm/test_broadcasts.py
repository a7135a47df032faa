"""Nothing whose size grows with the documents is broadcast, whatever Spark takes it for."""

from pyspark.sql import functions as F

from matloom.llm import mixing, neardup
from matloom.plans import components as plans
from matloom.plans import joins
from matloom.plans.materialize import cut


def watched(monkeypatch, module):
    """Names and plans of the tables that the module writes."""
    seen = []

    def look(df, name="cut", instead_of=None):
        got = cut(df, name, instead_of)
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return got

    monkeypatch.setattr(module, "cut", look)
    return seen


def documents(spark):
    """Two near copies of each text, and some texts in buckets of three."""
    n = F.col("id")
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.expr("id div 2"), i), F.lit(1_000_000)).cast("string")))
    return spark.range(400).select(n.alias("doc_id"), F.concat_ws(" ", words, F.when(n % 2 == 1, F.concat(F.lit("odd"), n))).alias("text"), F.concat(F.lit("s"), n % 3).alias("source"))


def test_bands_and_pairs_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "broadcast_if_small", lambda df: joins.broadcast_if_small(df, 0))
    seen = watched(monkeypatch, neardup)
    got = neardup.classes(cut(documents(spark), "docs"), 0.8)
    assert got.where("kept").count() == 200 and {"members", "likely", "sets", "checked"} <= {name for name, _ in seen}
    for name, plan in [*seen, ("classes", got._jdf.queryExecution().executedPlan().toString())]:
        assert "BroadcastHashJoin" not in plan, name


def test_components_by_rounds_broadcast_nothing(spark, monkeypatch):
    monkeypatch.setattr(plans, "FLUSH", 5)
    seen = watched(monkeypatch, plans)
    got = plans.components(spark.range(60).repartition(4).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(61)}
    assert len(seen) > 1 and all("BroadcastHashJoin" not in plan for _, plan in seen)


def test_the_mix_does_not_broadcast_its_rows(spark, monkeypatch):
    seen = dict(())
    monkeypatch.setattr(mixing, "cut", lambda df, name: seen.setdefault(name, df) and cut(df, name))
    assert mixing.mix(cut(documents(spark), "docs")).count() == 400
    plan = seen["copies"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2
