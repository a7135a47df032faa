"""Shards, the trie of conversations and the audit of filters against plain versions of their own."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from matloom.llm import audit, sharding, trie

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 4097, 70_001])
def test_permutation_is_one_and_has_its_inverse(n):
    p = sharding.permuted(np.arange(n), n, seed=3)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.unpermuted(p, n, seed=3) == np.arange(n)).all()
    shard, slot = sharding.place_of(n - 1, n, 7, 3)
    assert sharding.row_of(shard, slot, n, 7, 3) == n - 1


def test_permutation_shuffles():
    n = 100_000
    p = sharding.permuted(np.arange(n), n)
    assert abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.02 and abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.02
    of_a_run = np.bincount(p[:24_000] % 24, minlength=24)
    assert ((of_a_run - 1000) ** 2 / 1000).sum() < 60  # chi-squared of 23 degrees
    assert (sharding.permuted(np.arange(1000), 1000, 1) != sharding.permuted(np.arange(1000), 1000, 2)).mean() > 0.99


def test_shards_of_odd_rows(spark, odd, none):
    rows = sharding.of_texts(odd, 5).collect()
    assert len(rows) == 12 and sharding.of_texts(none, 5).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["slot"]) == sharding.place_of(r["number"], 12, 5)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    again = sharding.of_texts(odd.repartition(7), 5).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in rows)


def test_shards_keep_other_columns_and_are_written(spark, odd, tmp_path):
    more = odd.withColumn("a.b", odd["size"]).withColumn("`", odd["size"])
    assert Counter(tuple(r["row"]) for r in sharding.dealt(more, 3).collect()) == Counter(tuple(r) for r in more.collect())
    sharding.write(odd, f"{tmp_path}/shards", 3, rows_a_file=2)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 12 and {(r["shard"], r["slot"]) for r in back.select("shard", "slot").collect()} == {(k % 3, k // 3) for k in range(12)}


def test_a_hot_id_is_spread(spark):
    rows = spark.range(20_000).selectExpr("1L AS doc_id", "'same' AS text").repartition(8)
    held = sharding.numbered(rows.select("doc_id"), "doc_id", sharding.F.lit(0))
    assert sorted(r["number"] for r in held.collect()) == list(range(20_000))


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    built = {c: tuple(convs.get(c - c % 5, [])[: h[c]] + own[h[c] :]) for c, own in convs.items()}
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for x, members in nodes.items():
        below = [y for y in nodes if y[: len(x)] == x]
        kids = [y for y in below if len(y) == len(x) + 1]
        leaves = sum(not any(z[: len(y)] == y and len(z) == len(y) + 1 for z in below) for y in below)
        saved = sum((len(nodes[y]) - 1) * len(y[-1][1]) for y in below if y)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(x))))
        out.append((min(members), len(x), min(nodes[x[:-1]]) if x else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("waiting", "piece", "parts"), [(20_000, 8_192, 1), (3, 2, 9), (1, 1, 23)])
def test_trie_over_many_ranges(spark, monkeypatch, waiting, piece, parts):
    """Limits so small that rows wait for parents of other ranges, runs come in pieces, and levels have two ranges each."""
    import matloom.plans.materialize as m

    monkeypatch.setattr(m, "FILES", 50)
    for name, value in (("WAITING", waiting), ("PIECE", piece), ("FAN", 2)):
        monkeypatch.setattr(trie, name, value)
    rng, rows = random.Random(parts), []
    for c in range(150):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["a", None, ""]), rng.choice(["x", "y", None, "zzé"])))
    rows += [(c, 0, "a", "the same") for c in range(1000, 1120)] + [(None, 0, "a", "x")]
    rows += [(2000, t, "a", f"turn {t}") for t in range(50)] + [(2001, t, "a", f"turn {t}") for t in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), 5, 8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(tuple(r) for r in got) == plain_trie(rows)


def test_audit_against_plain_filters(spark, odd):
    rows = odd.select("doc_id", "text", "lang").collect()
    labels = [(4, 1, 0), (5, 0, 1), (7, 1, 1), (None, 1, 1)]
    got = audit.audit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = Counter()
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(least.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    shapley = Counter()
    for r in rows:
        text, part = r["text"] or "", r["lang"] or ""
        w = text.encode().split()
        fails = {"A": len(w) < 200, "B": 2 * len(set(w)) < len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = r["doc_id"] is not None and r["doc_id"] > least[text]
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, x in enumerate(order, 1):
                key = (part, order, k)
                hit = fails[x]
                want[key + ("kept",)] += not gone and not hit
                want[key + ("removed",)] += hit and not gone
                want[key + ("redundant",)] += hit and gone
                want[key + ("unique_fails",)] += hit and sum(fails.values()) == 1
                want[key + ("good_lost",)] += hit and not gone and r["doc_id"] in good
                want[key + ("toxic_lost",)] += hit and not gone and r["doc_id"] in toxic
                shapley[part, x] += hit and not gone
                gone |= hit
    assert len(got) == 600 * len({r["lang"] or "" for r in rows})
    for r in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[r["part"], r["filter_order"], r["step"], c], (r, c)
        assert r["shapley"] == shapley[r["part"], r["filter"]]
