"""Classes against all pairs, on edited copies, repeats and passages."""

import random
from itertools import combinations

import pytest

from matloom.llm import neardup


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_classes_equal_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (6, 40, 150, 300):
        base = [word() for _ in range(size)]
        for _ in range(35):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(80)] + passage) for _ in range(20)] + ["a b", "A b", "", None, " "]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    sets = {i: shingles(t) for i, t in zip(ids, texts)}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    d = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: (r[1], r[2], r[3]) for r in neardup.classes(d).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_registers_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(both[:2600]), np.unique(both[400:])
    j, used = neardup.estimate(*[neardup.registers(x)[None, :] for x in (a, b)])
    assert used[0] == neardup.BUCKETS and abs(j[0] - 2200 / 3000) < 0.15
    assert (neardup.registers(np.zeros(0, np.uint64)) == neardup.EMPTY).all()


def test_the_pipeline_drops_copies_of_similarity_above_four_fifths(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    # 96 shingles each: 86 of 106 are shared, 0.811.
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:90] + [f"x{i}" for i in range(10)])), (3, "another text of six words")], "doc_id long, text string")
    assert sorted(r[0] for r in corpus_pipeline.distinct(spark, d, "").collect()) == [1, 3]
    assert sorted(r[0] for r in neardup.keep_one(d, 0.85).collect()) == [1, 2, 3]
    assert sorted(r[0] for r in neardup.keep_one(d, 0.82).collect()) == [1, 2, 3]
    for threshold in (0.8, 0.85):
        size = neardup.band_rows(threshold)
        assert (1 - threshold**size) ** (neardup.BUCKETS // size) < 1e-6


@pytest.mark.parametrize("threshold, share", [(0.85, (85, 100)), (0.8, (8, 10))])
def test_classes_of_a_whole_table_equal_all_pairs(spark, threshold, share):
    """1,000 documents with planted copies, against the intersections of all pairs that share a shingle."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r[0]: shingles(r[1]) for r in d.select("doc_id", "text").collect()}
    holders, shared, up = {}, {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for ids in holders.values():
        for pair in combinations(ids, 2):
            shared[pair] = shared.get(pair, 0) + 1

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if share[1] * n >= share[0] * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    got = {r[0]: (r[1], r[2], r[3]) for r in neardup.classes(d, threshold).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
