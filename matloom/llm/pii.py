"""Personal data: fixed patterns, and a skip-chain conditional random field over the rest.

Base spans are the leftmost non-overlapping matches of four patterns, less those that fail
their kind's test. The field then labels units: tokens with an '@', and maximal groups of digits with the marks that
phone, card and address numbers are written with. A unit's own potential is a log-linear score of its
shape and of the words around it (the last three before it, and the next); neighbouring units that are not similar share a transition; and a unit shares a skip potential with the
last one before it that is the same or similar, however distant: the same address but for case, the same last ten digits but for marks and spaces, or the same
four numbers but for leading zeros. So a repeat of something found, written in a way that the base patterns don't
take, is pulled to its label, and repeats anywhere in a document agree. Units in base spans are clamped to their kind. Loopy sum-product
messages run over all edges at once for `ROUNDS` rounds; a unit whose marginal for
one kind reaches `SURE` becomes a further span.

The weights are trained here, piece by piece, with the base spans as labels. Labels and edges are counted over the units of all documents; the regression of a
unit's own score is fitted on at most `sample` units, those with the least hashes among the units of all documents, a parameter of `scan`. Each labelled unit is also shown with the marks that its base pattern asks for held
out, so that words around it and the rest of its shape carry weight. The skip table is the smoothed share of similar units that agree, among those with a known label: a
unit without a label that is similar to a labelled one is not known to be nothing. Without any unit nothing is added.

Null text is an empty text: no spans. Whole texts are read, in time linear in their length
(each unit has one skip edge back for each way of being similar, however often it repeats). Rows are handled one by one, so repeated rows give
repeated results; an empty table gives no rows; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm import spans
from matloom.llm.counting import counts
from matloom.llm.spans import Span
from matloom.llm.workers import tidy

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, SURE = 20, 0.95
#: Buckets of hashed words; characters between neighbours at most.
WORDS, GAP = 512, 40
#: Edges whose messages are made at once.
EDGES = 1 << 16
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANY = re.compile(r"[0-9@]")
UNIT = re.compile(r"[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]*+|\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9])*+")
WORD = re.compile(r"[^\W\d_]+")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: What a unit's shape says; those after `MARKS` are how the base patterns want it written, held out in half of training.
SHAPE = 22
MARKS = 19
#: Tails and heads that belong to the sentence, not to the unit.
TRAIL, LEAD = ".,;:!?)]}>\"'", "([{<\"'"


def shape(unit: str) -> list[float]:
    digits = NOT_DIGIT.sub("", unit)
    n, at, groups = len(digits), unit.find("@"), len(re.findall("[0-9]+", unit))
    spaces, dots, dashes = unit.count(" "), unit.count("."), unit.count("-")
    return [
        1.0, n == 0, 0 < n < 4, 4 <= n < 7, n == 7, 8 <= n < 10, n == 10, 11 <= n < 16, 16 <= n < 20, n >= 20, groups == 1, groups == 2, groups == 3, groups == 4, groups > 4, dots > 0 and at < 0, dashes > 0,
        at >= 0, 16 <= n < 20 and luhn(digits), at > 0 and "." in unit[at:], unit.startswith("+"), spaces > 0 or "(" in unit,
    ]


def around(text: str, a: int, b: int) -> list[int]:
    """Buckets of the three words before and the one after, by place and without it; WORDS where there is none."""
    before = WORD.findall(text[max(0, a - 60) : a].lower())[-3:]
    after = WORD.search(text[b : b + 30].lower())
    bucket = lambda kind, w: zlib.crc32(f"{kind}:{w}".encode()) % WORDS
    out = [bucket("near", w) for w in before] + [WORDS] * (3 - len(before))
    return [*out, bucket("last", before[-1]) if before else WORDS, bucket("next", after[0]) if after else WORDS]


def keys(unit: str) -> list[str]:
    """What makes two units similar."""
    if "@" in unit:
        return ["@" + unit.strip(TRAIL + LEAD).lower()]
    digits, numbers = NOT_DIGIT.sub("", unit), re.findall("[0-9]+", unit)
    out = ["d" + digits[-10:]] if len(digits) >= 7 else []
    if len(numbers) == 4 and all(len(x) <= 3 for x in numbers):
        out.append("i" + ".".join([str(int(x)) for x in numbers]))
    return out


@dataclass
class Units:
    places: list[tuple[int, int]]
    x: np.ndarray  # shapes
    near: np.ndarray  # buckets of the words around
    label: np.ndarray  # the base span's kind + 1, else 0
    edges: np.ndarray  # pairs of units
    skip: np.ndarray  # of edges: whether it joins distant repeats


def units(text: str, base: list[Span]) -> Units | None:
    places = []
    for m in UNIT.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in TRAIL and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        while a < b and text[a] in LEAD and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        if b > a and ANY.search(text, a, b):
            places.append((a, b))
    if not places:
        return None
    n = len(places)
    label = np.zeros(n, int)
    i = 0
    for a, b, k in sorted((a, b, KINDS.index(k) + 1) for k, a, b in base):
        while i < n and places[i][1] <= a:
            i += 1
        j = i
        while j < n and places[j][0] < b:
            label[j] = label[j] or k
            j += 1
    edges = []
    last: dict[str, int] = {}
    for i, (a, b) in enumerate(places):
        back = set()
        for key in keys(text[a:b]):
            if (j := last.get(key)) is not None and j not in back:
                edges.append((j, i, 1))
                back.add(j)
            last[key] = i
        if i and i - 1 not in back and a - places[i - 1][1] <= GAP:
            edges.append((i - 1, i, 0))
    e = np.array(edges, int).reshape(-1, 3)
    return Units(places, np.array([shape(text[a:b]) for a, b in places], float), np.array([around(text, a, b) for a, b in places]), label, e[:, :2], e[:, 2] == 1)


@dataclass
class Field:
    weights: np.ndarray  # shape x labels
    words: np.ndarray  # buckets x labels; the last is no word
    chain: np.ndarray  # labels x labels, log potentials
    skip: np.ndarray


def table(pairs: np.ndarray, share: np.ndarray, start: float, weight: float) -> np.ndarray:
    """Log odds of two labels on an edge against independence, from counts of pairs; where there are few, from the share of all pairs that agree, which starts as `start` of `weight` pairs."""
    both = pairs + pairs.T
    agree = (np.trace(both) + 2 * start * weight) / (both.sum() + 2 * weight)
    prior = agree * np.eye(len(share)) + (1 - agree) * share[None, :]
    given = (both + weight * prior) / (both.sum(1, keepdims=True) + weight)
    odds = np.log(given / share[None, :])
    return np.clip((odds + odds.T) / 2, -6, 6)


def known(t: Units) -> np.ndarray:
    """The units that may be learnt from: those without a label that are similar to labelled ones are left out, for they may be anything."""
    ok = np.ones(len(t.label), bool)
    for i, j in t.edges[t.skip].tolist():
        if (t.label[i] > 0) != (t.label[j] > 0):
            ok[i if t.label[i] == 0 else j] = False
    return ok


K = len(KINDS) + 1
#: What is counted: units by label, then pairs of labels on the edges of neighbours and of similar units.
COUNTS = K + 2 * K * K


def tally(texts: Iterable[str]) -> np.ndarray:
    """COUNTS whole numbers of the texts' units."""
    out = np.zeros(COUNTS, np.int64)
    for text in texts:
        if ANY.search(text) and (t := units(text, base_spans(text))):
            ok = known(t)
            out[:K] += np.bincount(t.label[ok], minlength=K)
            for kind in (0, 1):
                e = t.edges[(t.skip == bool(kind)) & ok[t.edges].all(1)]
                pairs = out[K + kind * K * K :][: K * K]
                pairs += np.bincount(t.label[e[:, 0]] * K + t.label[e[:, 1]], minlength=K * K)
    return out


def learn(counted: np.ndarray, x: np.ndarray, near: np.ndarray, y: np.ndarray, rounds: int = 500, decay: float = 3e-4) -> Field | None:
    """Piecewise: the own score by logistic regression on labelled units (shapes, words around, labels), each kind of edge by its table of counts."""
    if not counted[:K].sum() or not len(y):
        return None
    held = x[y > 0].copy()
    held[:, MARKS:] = 0
    x, near, y = np.concatenate([x, held]), np.concatenate([near, near[y > 0]]), np.concatenate([y, y[y > 0]])
    n, target = len(y), np.eye(K)[y]
    w, c, vw, vc = np.zeros((SHAPE, K)), np.zeros((WORDS + 1, K)), np.zeros((SHAPE, K)), np.zeros((WORDS + 1, K))
    flat = near.ravel()
    for _ in range(rounds):
        z = x @ w + c[near].sum(1)
        z = np.exp(z - z.max(1, keepdims=True))
        miss = target - z / z.sum(1, keepdims=True)
        vw = 0.9 * vw + x.T @ miss / n - decay * w
        wide = np.repeat(miss, near.shape[1], 0)
        vc = 0.9 * vc + np.stack([np.bincount(flat, wide[:, i], WORDS + 1) for i in range(K)], 1) / n - decay * c
        w, c = w + 0.8 * vw, c + 0.8 * vc
        c[WORDS] = 0
    # Units with a label stand for two, as they do in the regression.
    own = counted[:K] * np.where(np.arange(K) > 0, 2, 1)
    share = (own + 1.0) / (own.sum() + K)
    pairs = counted[K:].reshape(2, K, K).astype(float)
    return Field(w, c, table(pairs[0], share, float(share @ share), 20.0), table(pairs[1], share, 0.95, 20.0))


def train(texts: list[str], rounds: int = 500, decay: float = 3e-4) -> Field | None:
    """The field of some texts at hand."""
    seen = [(t, known(t)) for text in texts if (t := units(text, base_spans(text)))]
    if not seen:
        return None
    return learn(tally(texts), *[np.concatenate([getattr(t, f)[ok] for t, ok in seen]) for f in ("x", "near", "label")], rounds, decay)


def marginals(t: Units, field: Field) -> np.ndarray:
    """Loopy sum-product in logs; messages of all edges, in both directions, at once."""
    own = t.x @ field.weights + field.words[t.near].sum(1)
    own -= own.max(1, keepdims=True)
    fixed = t.label > 0
    own[fixed] = -50.0
    own[fixed, t.label[fixed]] = 0.0
    return messages(own, t.edges, t.skip, field.chain, field.skip)


def messages(own: np.ndarray, edges: np.ndarray, skip: np.ndarray, chain: np.ndarray, similar: np.ndarray) -> np.ndarray:
    """Marginals from log potentials of nodes (own) and of the two kinds of edges."""
    k = own.shape[1]
    if not len(edges):
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    m = len(edges)
    # Potentials of an edge's two directions, by its kind.
    pot = np.stack([chain, similar, chain.T, similar.T])
    kind = np.concatenate([skip.astype(int), skip + 2])
    msg = np.zeros((2 * m, k))
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, dst, msg)
        new = np.empty_like(msg)
        for at in range(0, 2 * m, EDGES):
            some = slice(at, at + EDGES)
            out = belief[src[some]] - msg[back[some]]
            z = out[:, :, None] + pot[kind[some]]
            top = z.max(1)
            new[some] = top + np.log(np.exp(z - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        msg = 0.3 * msg + 0.7 * new
    belief = own.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added(text: str, base: list[Span], field: Field) -> list[Span]:
    t = units(text, base)
    if t is None or (t.label > 0).all():
        return []
    p = marginals(t, field)
    best = p.argmax(1)
    sure = (best > 0) & (p[np.arange(len(p)), best] >= SURE) & (t.label == 0)
    return [(KINDS[best[i] - 1], *t.places[i]) for i in np.flatnonzero(sure).tolist()]


def by_kind(s: Span) -> tuple[int, int]:
    return KINDS.index(s[0]), s[1]


def find(field: Field | None):
    def of(text: str) -> tuple[list[Span], list[Span]]:
        if not ANY.search(text):
            return [], []
        base = base_spans(text)
        more = added(text, base, field) if field else []
        return base, sorted(base + more, key=by_kind) if more else base

    return of


def labelled(docs: DataFrame, share: float) -> DataFrame:
    """hash, x, near, label of the units of all documents (text) whose hashes, of their text and place, are below `share` of all hashes; units of equal texts are one."""
    below = min(share, 1.0) * float(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                t = units(text, base_spans(text))
                if t is None:
                    continue
                own = np.uint64(xxhash.xxh64_intdigest(text.encode(errors="surrogatepass")))
                h = (own ^ (np.arange(1, len(t.label) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                h = ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)
                for i in np.flatnonzero((h < below) & known(t)).tolist():
                    for column, value in zip(out, (int(h[i]), t.x[i].tolist(), t.near[i].tolist(), int(t.label[i]))):
                        column.append(value)
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["hash", "x", "near", "label"])
        tidy()

    found = docs.select("text").where(F.col("text").rlike("[0-9@]")).mapInArrow(run, "hash long, x array<double>, near array<int>, label int")
    return found.groupBy("hash").agg(F.first("x").alias("x"), F.first("near").alias("near"), F.first("label").alias("label"))


def fit(docs: DataFrame, sample: int) -> Field | None:
    """Counts of labels and of edges from all units; the regression from the `sample` units with the least hashes, or somewhat fewer where texts repeat."""
    counted = counts(docs.where(F.col("text").rlike("[0-9@]")), tally, (COUNTS,))
    n = int(counted[:K].sum())
    if not n:
        return None
    rows = labelled(docs, 2 * sample / n).orderBy("hash").limit(sample).toArrow().sort_by("hash")
    x, near = (np.array(rows.column(c).to_pylist()) for c in ("x", "near"))
    return learn(counted, x, near, rows.column("label").to_numpy())


def scan(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. `sample`: labelled units that the field's regression is fitted on, at most; they are drawn from all documents, and everything else is counted over all of them."""
    field = fit(docs, sample)
    return spans.scan(docs, KINDS, lambda: find(field))
