"""The registered classifier worked out again in plain Python: votes, expectation-maximisation, weights, regression and scores, a document at a time."""

import math
from collections import Counter, defaultdict

import numpy as np

from matloom.llm import entries

SMALL = "/root/testdata/sf0.001"
SPACE = b" \t\n\r\x0b\x0c"


def repeated(words):
    if len(words) < 3:
        return 0.0, 0.0
    echo = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    stretches = [words[i : i + 200] for i in range(0, len(words) - 199, 200)] + [words[-200:]]
    return echo, max(1 - len(set(s)) / len(s) for s in stretches)


def plain_votes(text):
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if n < 3:
        return "-" * 8
    dense = max(1, sum(not (9 <= c <= 13 or c == 32) for c in raw))
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    symbols = sum(c in b"#$%&*+<=>@[]^_`{|}~\\/" for c in raw) / dense
    shout, bars = upper / max(1, upper + lower), raw.count(b"|") / n
    echo, stale = repeated(words)
    stops = (raw.count(b".") + raw.count(b"?")) / n
    usual = lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c in b".,;:!?\"')"
    marked = sum(not usual(w[-1]) for w in words) / n
    tests = [
        (symbols > 0.06, symbols < 0.01), (shout > 0.5, shout < 0.2), (bars > 0.25, bars == 0), (n >= 20 and stale > 0.75, n >= 20 and stale < 0.6),
        (n >= 8 and echo > 0.3, n >= 8 and echo < 0.1), (n >= 40 and stops < 0.005, stops > 0.02), (marked > 0.3, marked < 0.05), (raw.count(b"!") / n > 0.3, b"!" not in raw),
    ]
    return "".join("0" if bad else "1" if good else "-" for bad, good in tests)


def plain_posteriors(votes):
    """A document at a time, not a pattern."""
    post = [min(0.98, max(0.02, (1 + v.count("1")) / (2 + 8 - v.count("-")))) for v in votes]
    for _ in range(200):
        share = min(0.99, max(0.01, sum(post) / len(post)))
        right, caught = [], []
        for k in range(8):
            voted = [(p, v[k]) for p, v in zip(post, votes) if v[k] != "-"]
            right.append((sum(p for p, x in voted if x == "1") + 2) / (sum(p for p, _ in voted) + 2.5))
            caught.append((sum(1 - p for p, x in voted if x == "0") + 1.5) / (sum(1 - p for p, _ in voted) + 3))
        new = []
        for v in votes:
            odds = math.log(share / (1 - share))
            for k, x in enumerate(v):
                odds += math.log(right[k] / (1 - caught[k])) if x == "1" else math.log((1 - right[k]) / caught[k]) if x == "0" else 0
            new.append(1 / (1 + math.exp(-min(30, max(-30, odds)))))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        if done:
            break
        post = new
    return post


def trigrams(text):
    raw = text.encode()
    buckets = [((((raw[i] * 0x9E3779B1) ^ (raw[i + 1] * 0x85EBCA77) ^ (raw[i + 2] * 0xC2B2AE3D)) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 18 for i in range(len(raw) - 2)]
    return {h: n / len(buckets) for h, n in Counter(buckets).items()}


def ratio(good, bad, n_good, n_bad):
    usual = 20 * ((good + bad) / max(1.0, n_good + n_bad) + 1 / 160_000)
    return math.log((good + usual) / (bad + usual)) + math.log((n_bad + 20) / (n_good + 20))


def regression(x, y, penalty):
    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
    return b


def test_the_registered_classifier_in_plain_python(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 10000", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(r[0], r[1]) for r in docs.collect()]
    # A null text votes like an empty one, but teaches the scorer nothing.
    votes = [plain_votes(t or "") for _, t in texts]
    counted = [v for v, (_, t) in zip(votes, texts)]
    post = plain_posteriors(counted)
    taught = [(trigrams(t), p, repeated(t.encode().split())) for (_, t), p in zip(texts, post) if t and len(t.encode()) > 2]
    good, bad = defaultdict(float), defaultdict(float)
    for shares, p, _ in taught:
        for h, s in shares.items():
            good[h] += s * p
            bad[h] += s * (1 - p)
    n_good, n_bad = sum(p for _, p, _ in taught), sum(1 - p for _, p, _ in taught)
    rows = []
    for shares, p, (echo, stale) in taught:
        own = sum(s * ratio(max(0, good[h] - p * s), max(0, bad[h] - (1 - p) * s), n_good - p, n_bad - (1 - p)) for h, s in shares.items())
        rows.append((1.0, round((min(4, max(-4, own)) + 4) * 64) / 64 - 4, round(echo * 16) / 16, round(stale * 16) / 16))
    x, y = np.array(rows), np.array([p for _, p, _ in taught])
    b = regression(x, y, np.diag([1e-3, 1e-3, 0.1, 0.1]))
    assert b[1] >= 0
    weight = {h: b[1] * ratio(good[h], bad[h], n_good, n_bad) for h in good}

    def scored(text):
        if not text:
            return 1.0
        z, shares = b[0], trigrams(text)
        if shares:
            echo, stale = repeated(text.encode().split())
            z += sum(s * weight[h] for h, s in shares.items()) + b[2] * echo + b[3] * stale
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    want = sorted([(d is None, d or 0, v, p, scored(t)) for (d, t), v, p in zip(texts, votes, post)])
    got = sorted([(r["doc_id"] is None, r["doc_id"] or 0, r["votes"], r["posterior"], r["score"]) for r in entries.QUERIES["op10_quality"](spark, str(tmp_path)).collect()])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 1e-6
    assert max(abs(a[4] - b[4]) for a, b in zip(got, want)) < 1e-4
