"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on a document from counts
over its whole text. The documents are grouped by their pattern of votes, so that what
expectation-maximisation needs is a table of at most 3^`len(LABELLERS)` counts over all
documents; it estimates how often each labeller is right on good and on bad documents, and the
share of good ones, without any true label. Each pattern's posterior is its documents' target, and a hashed linear scorer is
trained on all documents in two passes. The first adds up the trigrams' shares of good and of bad documents, whose log ratios are
the hashed weights. The second scores every document with the weights that the others give, its own part taken off, and counts the scores and the two shares
of repeated words in small steps; a logistic regression on these counts weighs the three. Only whole numbers are added, so the scorer does not
depend on how rows are dealt out, and the driver gets arrays of fixed size. The scorer adds the mean of hashed weights over the text's byte trigrams and two weighted shares of repeated words; its
probability that a document is good decides: below `KEEP` it is rejected.

Null text is an empty text: all labellers abstain, there is nothing against it, and it is kept. Texts too short
for a labeller's counts make it abstain. Given the model, every row is judged by itself, so repeated rows get the
same result (and count repeatedly in the model); an empty table gives no rows. Columns other than doc_id and text are not read, and `keep` returns all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matloom.llm.counting import counts

BITS = 14
KEEP = 0.5
SYMBOLS = np.frombuffer(b"#$%&*+<=>@[]^_`{|}~\\/", np.uint8)
LABELLERS = ("symbols", "shouting", "cells", "repeats", "stutter", "stops", "marked", "cries")


def _vote(bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


def repetition(words: list[bytes]) -> tuple[float, float]:
    """The share of words that repeat the one before them, and the share that is not new within 200 words, in the worst such stretch."""
    n = len(words)
    if n < 3:
        return 0.0, 0.0
    echo = sum(map(eq, words, words[1:])) / n
    starts = [*range(0, n - 199, 200), max(0, n - 200)]  # the last stretch ends with the text
    stale = max(1 - len(set(words[i : i + 200])) / len(words[i : i + 200]) for i in starts)
    return echo, stale


def votes(text: str) -> tuple[int, ...]:
    """One vote for each of LABELLERS."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if n < 3:
        return (-1,) * len(LABELLERS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    dense = max(1, len(raw) - int(count[9:14].sum() + count[32]))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    symbols = int(count[SYMBOLS].sum()) / dense
    shout = upper / max(1, upper + lower)
    cells = int(count[124]) / n
    echo, stale = repetition(words)
    stops = (int(count[46]) + int(count[63])) / n
    marked = sum(not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] >= 128 or w[-1] in b".,;:!?\"')") for w in words) / n
    return (
        _vote(symbols > 0.06, symbols < 0.01),
        _vote(shout > 0.5, shout < 0.2),
        _vote(cells > 0.25, cells == 0),
        _vote(n >= 20 and stale > 0.75, n >= 20 and stale < 0.6),
        _vote(n >= 8 and echo > 0.3, n >= 8 and echo < 0.1),
        _vote(n >= 40 and stops < 0.005, stops > 0.02),
        _vote(marked > 0.3, marked < 0.05),
        _vote(int(count[33]) / n > 0.3, count[33] == 0),
    )


def pattern(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def unpattern(p: int) -> list[int]:
    return [p // 3**i % 3 - 1 for i in range(len(LABELLERS))]


def agree(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Expectation-maximisation over patterns: the posterior of a good document for each, votes being independent given the truth. Starts from the majority of votes."""
    if not counts:
        return {}
    pats = sorted(counts)
    v = np.array([unpattern(p) for p in pats])
    n = np.array([counts[p] for p in pats], float)
    voted = v >= 0
    post = (1.0 + (v == 1).sum(1)) / (2.0 + voted.sum(1))
    post = np.clip(post, 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        good, bad = (n * post)[:, None], (n * (1 - post))[:, None]
        # Smoothed: a labeller is taken to be right more often than not until shown otherwise.
        right = ((good * (v == 1)).sum(0) + 2) / ((good * voted).sum(0) + 2.5)
        caught = ((bad * (v == 0)).sum(0) + 1.5) / ((bad * voted).sum(0) + 3)
        odds = np.log(share / (1 - share)) + np.where(v == 1, np.log(right / (1 - caught)), np.where(v == 0, np.log((1 - right) / caught), 0.0)).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(pats, post.tolist()))


#: Odd multipliers of a public mixing scheme, one for each byte of a trigram and one for the result.
MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def hashed(text: str) -> np.ndarray:
    p, q, r, last = MULTIPLIERS
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] * p) ^ (b[1:-1] * q) ^ (b[2:] * r)) * last >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's hashed trigrams and their shares."""
    h = hashed(text)
    n = np.bincount(h, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at] / max(1, len(h))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, text: str) -> float:
        """The probability that the text is good."""
        h = hashed(text)
        z = self.bias
        if len(h):
            echo, stale = repetition(text.encode().split())
            z += float(self.weights.take(h).mean()) + self.weights[-2] * echo + self.weights[-1] * stale
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


#: Shares are added as whole numbers of this part; a trigram's log ratio starts from the mean share with the weight of PRIOR documents, and a share in this many to begin with.
UNIT, PRIOR, RARE = 2.0**-32, 20.0, 160_000
#: Steps of a score, from -LIMIT to LIMIT, and of a share of repeated words.
LIMIT, STEPS, PARTS = 4, 64, 16
SHARES, CELLS = (2, (1 << BITS) + 1), (2, 2 * LIMIT * STEPS + 1, PARTS + 1, PARTS + 1)
#: Penalties of the regression: of the constant, the score and the two shares.
PENALTY = np.diag([1e-3, 1e-3, 0.1, 0.1])
Labelled = Iterable[tuple[str, float]]


def shares(rows: Labelled) -> np.ndarray:
    """The sums of trigrams' shares, and the number of documents, weighted by how good (0) and how bad (1) these are."""
    out = np.zeros(SHARES, np.int64)
    for text, good in rows:
        at, share = features(text)
        if len(at):
            for row, weight in ((0, good), (1, 1.0 - good)):
                out[row, at] += np.rint(share * (weight / UNIT)).astype(np.int64)
                out[row, -1] += round(weight / UNIT)
    return out


def ratios(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Log ratios of mean shares."""
    usual = PRIOR * ((good + bad) / max(1.0, n_good + n_bad) + 1 / RARE)
    return np.log((good + usual) / (bad + usual)) + np.log((n_bad + PRIOR) / (n_good + PRIOR))


def cells(rows: Labelled, sums: np.ndarray) -> np.ndarray:
    """How many documents, and the sum of their targets, have which score by the others' weights and which shares of repetition."""
    good, bad = sums * UNIT
    out = np.zeros(CELLS, np.int64)
    for text, y in rows:
        at, share = features(text)
        if len(at):
            own = ratios(np.maximum(good[at] - y * share, 0), np.maximum(bad[at] - (1 - y) * share, 0), max(good[-1] - y, 0), max(bad[-1] - (1 - y), 0))
            echo, stale = repetition(text.encode().split())
            place = round((min(max(float(own @ share), -LIMIT), LIMIT) + LIMIT) * STEPS), round(echo * PARTS), round(stale * PARTS)
            out[(0, *place)] += 1
            out[(1, *place)] += round(y / 2.0**-20)
    return out


def weighed(cells: np.ndarray) -> np.ndarray:
    """A logistic regression on the cells: the constant, and the weights of the score and of the two shares. A score that points the wrong way has none."""
    at = np.nonzero(cells[0])
    n, y = cells[0][at].astype(float), cells[1][at] * 2.0**-20
    x = np.stack([np.ones(len(n)), at[0] / STEPS - LIMIT, at[1] / PARTS, at[2] / PARTS], 1)
    b = np.zeros(4)
    for use in (slice(0, 4), [0, 2, 3]):
        b, own, penalty = np.zeros(4), x[:, use], PENALTY[use][:, use]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ b[use], -30, 30)))
            step = np.linalg.solve((own * (n * p * (1 - p))[:, None]).T @ own + penalty, own.T @ (y - n * p) - penalty @ b[use])
            b[use] += step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        if b[1] >= 0:
            break
    return b


Total = Callable[[Callable[[Labelled], np.ndarray], tuple[int, ...]], np.ndarray]


def scorer_of(total: Total) -> Scorer:
    """The scorer of the labelled documents that `total` counts."""
    sums = total(shares, SHARES)
    if not sums[:, -1].any():
        return Scorer(np.zeros((1 << BITS) + 2), 3.0)
    good, bad = sums * UNIT
    constant, score, echo, stale = weighed(total(lambda rows: cells(rows, sums), CELLS))
    return Scorer(np.append(score * ratios(good[:-1], bad[:-1], good[-1], bad[-1]), [echo, stale]), float(constant))


def train(texts: list[str], targets: list[float]) -> Scorer:
    return scorer_of(lambda count, shape: count(zip(texts, targets)))


@dataclass
class Model:
    posterior: dict[int, float]
    scorer: Scorer


def fit(docs: DataFrame) -> Model:
    """Votes of all documents, then the scorer on all that have a text."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t.as_py() or "")) for t in batch.column(0)], pa.int32())], names=["pattern"])

    table = docs.select("text").mapInArrow(tally, "pattern int").groupBy("pattern").count().collect()
    posterior = agree({r[0]: r[1] for r in table})
    some = docs.where(F.length("text") > 0)
    return Model(posterior, scorer_of(lambda count, shape: counts(some, lambda texts: count((t, posterior[pattern(votes(t))]) for t in texts), shape)))


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, votes (a character for each labeller: 1, 0 or -), posterior, score, keep: one row per row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                v = votes(text)
                s = m.scorer(text) if text else 1.0
                rows.append(("".join("-01"[x + 1] for x in v), m.posterior[pattern(v)], s, s >= KEEP))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=SCORED.names)

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; only texts go to the workers, and a verdict comes back."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        m = model.value
        return pa.array([not (text := t.as_py() or "") or m.scorer(text) >= KEEP for t in texts], pa.bool_())

    return docs.where(good(docs["text"]))
