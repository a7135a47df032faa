"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

Base spans are the whole matches of the three patterns, leftmost and non-overlapping for
each kind; those that fail their kind's length are dropped. Every maximal run of at least `SHORTEST` key
characters that no base span touches is then tested: shorter ones hold too little evidence at the rate asked for. Its encoding, the least
alphabet that holds it, is inferred, and four statistics are taken: the chi-squared distance from a uniform
alphabet, the number of runs of character classes, the serial correlation of neighbours, and how usual its pairs of
neighbours are (a serial test against the pairs of ordinary text).

What ordinary text gives is not assumed but measured (`Null`), on every document: all its ordinary words, in their order and each once,
are joined as identifiers, paths, constants and dates are, and these tokens give each statistic's law for each encoding, those
of too few tokens sharing one law. Two passes in the workers count them, the pairs and moments first, then the sums of standard scores; only whole numbers are
added, so the laws do not depend on how rows are dealt out, and the driver gets a table of counts of fixed size. Fixed words give `FIXED` more tokens, so that small tables have laws too.
The four are summed as standard scores; the sum is divided by its own spread over the
ordinary tokens, so that their dependence counts, and shrunk where their tail is heavier than a normal one. The Benjamini-Hochberg step then keeps the rate of
false discoveries among a document's tokens at `rate`, with a token's weight growing with its length. A token kept
must also pass as random itself (chi-squared within its encoding), which texts in languages unlike the documents' do not. Those kept are added as kind `random`.
A run of digits and separators is never one: ordinary numbers are uniform too, so nothing tells them apart.

Null text is an empty text: no spans. Whole texts are scanned, in time linear in their
length. Given the laws, each row is handled by itself, so repeated rows give repeated results (and count repeatedly in the laws); an empty table gives no rows, and columns
other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import batched, chain

import numpy as np
from pyspark.sql import DataFrame

from matloom.llm import spans
from matloom.llm.counting import counts
from matloom.llm.spans import Span

KINDS = ["assign", "access", "hex"]
ORDER = {k: i for i, k in enumerate([*KINDS, "random"])}
#: Letters of either case without case folding beyond ASCII.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
SHORTEST = 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % SHORTEST)
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
#: A whole piece that is too short to be tested and has a letter or a digit.
WORD = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{1,%d}+(?![A-Za-z0-9+/_-])" % (SHORTEST - 1))
#: Encoding: pattern, alphabet size; from the least alphabet up.
ENCODINGS = [
    ("digits", re.compile(r"[0-9+/_-]+"), 10),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16),
    ("letters", re.compile(r"[a-z]+|[A-Z]+"), 26),
    ("base32", re.compile(r"[A-Z2-7]+|[a-z2-7]+"), 32),
    ("base36", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36),
    ("mixed", re.compile(r"[A-Za-z]+"), 52),
    ("base62", re.compile(r"[A-Za-z0-9]+"), 62),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), 64),
]
#: Encodings of letters of one case with digits have one law: ordinary tokens of the smaller alphabets are few.
GROUP = {"hex": "base36", "base32": "base36"}
RATE = 1e-4
#: Laws, and the number of each; digits have none, and the last is that of all others together.
LAWS = {"digits": 0, "letters": 1, "base36": 2, "mixed": 3, "base62": 4, "base64": 5, "any": 6}
#: Tokens of the fixed words, and the ordinary tokens that a law is measured on at least (else it is that of all together).
FIXED, ENOUGH = 32_000, 300
#: A token is no random one where its own alphabet's uniformity is rejected at this level.
ALIKE = 1e-4
#: Ordinary words in four languages, part of every law, so that small tables have laws too.
WORDS = (
    "the quick brown fox jumps over a lazy dog near an old river bank while people walk home from their work and talk about what they have seen during this long day get element by class name number of lines in file read write open close value index count total user account order item price date time zone request response error message default "
    "config server client data base table column row key list map set string buffer stream thread process memory network address path version license source main test example apache spark java python license under terms without warranty should would could information internationalization of everything do not use this in your code at all constant "
    "der die das und ist nicht ein eine mit von auf zu sich auch nach bei wie aber noch nur werden haben kann schon wenn sehr mehr immer strasse wasser haus jahr zeit leben "
    "le la les des est une dans pour que qui sur avec pas plus par tout nous vous mais comme faire temps jour monde maison ville chemin "
    "el los las por con para una como pero sus este cuando muy sin sobre tiene entre tambien hasta hay donde desde todo nos durante siempre"
).split()


def base_spans(text: str) -> list[Span]:
    low = text.lower()  # only to see whether a name can occur; lower case has every match's letters
    named = any(w in low for w in NAMES)
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if named else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


@dataclass(frozen=True)
class Law:
    """Of one encoding's ordinary tokens: each statistic's mean and scale, mean and spread of the sum of standard scores, and how far its tail outgrows a normal one."""

    mean: np.ndarray
    spread: np.ndarray
    middle: float = 0.0
    width: float = 1.0
    tail: float = 1.0

    def total(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of standard scores, a row of `values` for each token."""
        return ((self.mean - values) * np.sqrt(sizes - 1.0)[:, None] / self.spread).clip(-LIMIT, LIMIT).sum(1)

    def probability(self, values: np.ndarray, size: int) -> float:
        """That an ordinary token looks as random."""
        z = float(self.total(values[None, :], np.array([size]))[0])
        return 0.5 * math.erfc((z - self.middle) / (self.width * self.tail * math.sqrt(2)))


#: No single test decides: standard scores beyond this count as this.
LIMIT = 12.0


def symbols(token: str) -> np.ndarray:
    """Letters without case 0-25, digits 26, others 27."""
    b = np.frombuffer(token.encode(), np.uint8)
    lower = b | 32
    return np.where((lower >= 97) & (lower <= 122), lower - 97, np.where((b >= 48) & (b <= 57), 26, 27)).astype(np.intp)


def statistics(token: str, pairs: np.ndarray) -> np.ndarray:
    """Of a token: coincidences of its characters (chi-squared from any uniform alphabet but for a constant), fewness of runs of classes, strength of serial correlation, usualness of its pairs. Less is more random."""
    b = np.frombuffer(token.encode(), np.uint8)
    n = len(b)
    counts = np.bincount(b).astype(float)
    digit, lower, upper = (b >= 48) & (b <= 57), (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    classes = digit * 1 + lower * 2 + upper * 3
    value = np.where(digit, b - 48.0, np.where(lower, b - 87.0, np.where(upper, b - 55.0, 36.0)))
    off = value - value.mean()
    spread = float(off @ off)
    s = symbols(token)
    # Neighbours in the alphabet or in counting are as usual as any.
    usual = np.where(np.abs(value[1:] - value[:-1]) <= 1, -1.0, pairs[s[:-1], s[1:]])
    return np.array([
        (counts @ counts - n) / (n * (n - 1.0)), -np.count_nonzero(classes[1:] != classes[:-1]) / (n - 1.0), abs(float(off[1:] @ off[:-1])) / spread if spread else 1.0, usual.mean()
    ])


def encoding(token: str) -> tuple[str, int]:
    name, _, size = next(e for e in ENCODINGS if e[1].fullmatch(token))
    return name, size


def alike(token: str, size: int) -> bool:
    """Whether a uniform alphabet of the size may give such counts: upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    counts = np.bincount(np.frombuffer(token.encode(), np.uint8)).astype(float)
    chi, free = size / len(token) * float(counts @ counts) - len(token), size - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return 0.5 * math.erfc(z / math.sqrt(2)) >= ALIKE


def styles(rng: random.Random) -> list[Callable[[list[str]], str]]:
    """The ways that identifiers, paths, constants, names with numbers and dates are joined."""
    return [
        lambda w: "".join(w).lower(), lambda w: "".join(w).upper(), lambda w: w[0].lower() + "".join([x.capitalize() for x in w[1:]]), lambda w: "".join([x.capitalize() for x in w]), lambda w: "_".join(w).lower(), lambda w: "_".join(w).upper(), lambda w: "-".join(w).lower(), lambda w: "/".join(w),
        lambda w: "".join(w).lower() + str(rng.randint(1, 2030)), lambda w: "".join(w).upper() + "".join(rng.choices("234567", k=rng.randint(1, 4))), lambda w: "".join([x.capitalize() for x in w]) + str(rng.randint(1, 99)), lambda w: f"{w[0]}{rng.randint(1, 99)}" + "".join(w[1:]), lambda w: "-".join(w).lower() + f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda w: "_".join([w[0], str(rng.randint(0, 9)), *w[1:]]), lambda w: "".join([x.upper() if i % 3 == 0 else x.capitalize() for i, x in enumerate(w)]),
    ]


#: Letters and digits that a made token has at least, in turn.
LEAST = (20, 22, 26, 34, 50, 80)


def made(words: list[str], count: int) -> list[str]:
    """Ordinary tokens: neighbouring words, from anywhere, joined in each of the styles."""
    rng = random.Random(1)
    ways = styles(rng)
    out = []
    for i in range(count):
        at, some, least = rng.randrange(len(words)), [], LEAST[i % len(LEAST)]
        while sum(map(len, some)) < least:
            some.append(words[at % len(words)])
            at += 1
        out.append(ways[i % len(ways)](some))
    return out


def ordinary(text: str) -> Iterator[str]:
    """Tokens made of all ordinary words of a text, in order and each once; the last is filled up with fixed words. Long tokens, which may be secrets, are left out."""
    words: Iterable[str] = WORD.findall(text) if len(text) < 1 << 20 else (m[0] for m in WORD.finditer(text))
    seed = zlib.crc32(text.encode())
    rng = random.Random(seed)
    ways = styles(rng)
    i, some, held = seed % (len(ways) * len(LEAST)), [], 0
    least = LEAST[i // len(ways) % len(LEAST)]
    for w in words:
        some.append(w)
        held += len(w)
        if held >= least:
            yield ways[i % len(ways)](some)
            i, some, held = i + 1, [], 0
            least = LEAST[i // len(ways) % len(LEAST)]
    if some:
        at = seed
        while held < least:
            some.append(WORDS[at % len(WORDS)])
            held += len(some[-1])
            at += 1
        yield ways[i % len(ways)](some)


_CODES = np.arange(256)
_DIGIT, _LOWER, _UPPER = (_CODES >= 48) & (_CODES <= 57), (_CODES >= 97) & (_CODES <= 122), (_CODES >= 65) & (_CODES <= 90)
#: Of a byte: its class, its value, its symbol, and bits for a digit, a small letter, a capital, anything else, a letter beyond f.
CLASS = _DIGIT * 1 + _LOWER * 2 + _UPPER * 3
VALUE = np.where(_DIGIT, _CODES - 48.0, np.where(_LOWER, _CODES - 87.0, np.where(_UPPER, _CODES - 55.0, 36.0)))
SYMBOL = np.where(_LOWER | _UPPER, (_CODES | 32) - 97, np.where(_DIGIT, 26, 27))
BITS = (_DIGIT * 1 + _LOWER * 2 + _UPPER * 4 + ~(_DIGIT | _LOWER | _UPPER) * 8 + ((_LOWER | _UPPER) & ((_CODES | 32) > 102)) * 16).astype(np.uint8)


def groups(bits: np.ndarray) -> np.ndarray:
    """The number of the law of each token, by the bits its characters have: what encoding() and GROUP give."""
    digit, lower, upper, other, high = [(bits >> k & 1).astype(bool) for k in range(5)]
    single = np.where(digit | ~high, LAWS["base36"], LAWS["letters"])
    both = np.where(digit, LAWS["base62"], LAWS["mixed"])
    return np.where(~lower & ~upper, LAWS["digits"], np.where(other, LAWS["base64"], np.where(lower & upper, both, single)))


@dataclass
class Many:
    """What statistics() needs, of many tokens at once. A token's numbers do not depend on the others."""

    sizes: np.ndarray
    law: np.ndarray
    values: np.ndarray  # the three statistics that need no pairs
    row: np.ndarray  # of each pair of neighbours: its token, what it is, whether the two are neighbours in counting too
    pair: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, tokens: list[str]) -> Many:
        b = np.frombuffer("".join(tokens).encode(), np.uint8)
        n = np.array([len(t) for t in tokens])
        start, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        times = np.bincount(row * 128 + b, minlength=128 * len(n)).reshape(len(n), 128)
        kind, value, s = CLASS[b], VALUE[b], SYMBOL[b]
        off = value - (np.bincount(row, value, len(n)) / n)[row]
        spread = np.bincount(row, off * off, len(n))
        inner = row[1:] == row[:-1]
        first = row[:-1][inner]
        add = lambda x: np.bincount(first, x[inner], len(n))
        serial = np.where(spread > 0, np.abs(add(off[1:] * off[:-1])) / np.where(spread > 0, spread, 1.0), 1.0)
        values = np.stack([((times * times).sum(1) - n) / (n * (n - 1.0)), -add((kind[1:] != kind[:-1]).astype(float)) / (n - 1.0), serial], 1)
        return cls(n, groups(np.bitwise_or.reduceat(BITS[b], start)), values, first, (s[:-1] * 28 + s[1:])[inner], (np.abs(value[1:] - value[:-1]) <= 1)[inner])

    def usual(self, pairs: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, np.where(self.near, -1.0, pairs.ravel()[self.pair]), len(self.sizes)) / (self.sizes - 1.0)


#: Moments are added as whole numbers of this part, sums of standard scores counted in steps of 1/STEPS; PAIRS and MOMENTS are the counts that a law has.
UNIT, STEPS, PAIRS, MOMENTS = 2.0**-16, 100, 2 * 28 * 28, 15


def moments(m: Many) -> np.ndarray:
    """A row for each law: its pairs (far ones, then near ones), then its tokens, their sizes less one (s), the roots of s, and for three statistics v, s v, s v^2 and root(s) v."""
    pairs = np.bincount(m.law[m.row] * PAIRS + m.near * 784 + m.pair, minlength=len(LAWS) * PAIRS).reshape(len(LAWS), PAIRS)
    s = (m.sizes - 1.0)[:, None]
    every = np.concatenate([np.ones_like(s), s, np.sqrt(s), m.values, s * m.values, s * m.values**2, np.sqrt(s) * m.values], 1)
    sums = np.stack([np.bincount(m.law, x, len(LAWS)) for x in np.rint(every / UNIT).T], 1)
    return np.concatenate([pairs, sums], 1).astype(np.int64)


def scales(counts: np.ndarray) -> tuple[np.ndarray, dict[str, Law]]:
    """From all moments: log shares of pairs of neighbours, and the laws so far."""
    pairs = counts[:, :PAIRS].sum(0).reshape(2, 28, 28).sum(0) + 0.5
    pairs = np.log(pairs / pairs.sum(1, keepdims=True))
    laws = {}
    for name, at in LAWS.items():
        own = counts[1:].sum(0) if name == "any" else counts[at]
        n, s, root, *rest = own[PAIRS:] * UNIT
        if name == "digits" or n < ENOUGH:
            continue
        v, sv, svv, rv = np.array(rest).reshape(4, 3) / n
        mean = v
        spread = np.sqrt(np.maximum(svv - 2 * mean * sv + mean * mean * (s / n) - (rv - mean * (root / n)) ** 2, 0.0))
        # Of the pairs' usualness the spread is that of a single pair.
        share = np.append(own[:784], own[784:PAIRS].sum()) / own[:PAIRS].sum()
        each = np.append(pairs.ravel(), -1.0)
        usual = float(share @ each)
        laws[name] = Law(np.append(mean, usual), np.maximum(np.append(spread, math.sqrt(max(0.0, float(share @ (each - usual) ** 2)))), 1e-3))
    return pairs, laws


#: Of a sum of four clipped scores.
BINS = 2 * 4 * int(LIMIT) * STEPS + 1


def sums(m: Many, pairs: np.ndarray, laws: dict[str, Law]) -> np.ndarray:
    """A row for each law: how many tokens have which sum of standard scores."""
    values = np.concatenate([m.values, m.usual(pairs)[:, None]], 1)
    out = np.zeros((len(LAWS), BINS), np.int64)
    for name, law in laws.items():
        some = m.law != LAWS["digits"] if name == "any" else m.law == LAWS[name]
        total = law.total(values[some], m.sizes[some])
        out[LAWS[name]] = np.bincount(np.rint((total + 4 * LIMIT) * STEPS).astype(int), minlength=BINS)
    return out


def settled(law: Law, counts: np.ndarray) -> Law:
    at = np.arange(BINS) / STEPS - 4 * LIMIT
    n = counts.sum()
    middle = float(counts @ at / n)
    width = max(math.sqrt(float(counts @ (at - middle) ** 2 / n)), 1e-3)
    up = np.cumsum(counts)
    tail = max(1.0, *[float(at[np.searchsorted(up, (1 - q) * n)] - middle) / width / z for q, z in ((1e-2, 2.326), (1e-3, 3.09), (3e-4, 3.432))])
    return Law(law.mean, law.spread, middle, width, tail)


@dataclass(frozen=True)
class Null:
    """What ordinary text gives: log shares of pairs of neighbours, and each encoding's law."""

    pairs: np.ndarray
    laws: dict[str, Law]

    def probability(self, token: str) -> float:
        """That an ordinary token looks as random as this one; 1 for numbers, and for those whose characters are too uneven for a random one."""
        name, size = encoding(token)
        if name == "digits" or not alike(token, size):
            return 1.0
        return self.laws.get(GROUP.get(name, name), self.laws["any"]).probability(statistics(token, self.pairs), len(token))


def counted(tokens: Iterable[str], count: Callable[[Many], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.int64)
    for some in batched(tokens, 4096):
        out += count(Many.of(list(some)))
    return out


Total = Callable[[Callable[[Many], np.ndarray], tuple[int, int]], np.ndarray]


def laws_of(total: Total) -> Null:
    """The laws of the tokens that `total` counts and those of the fixed words."""
    fixed = made(WORDS, FIXED)
    shape = (len(LAWS), PAIRS + MOMENTS)
    pairs, laws = scales(total(moments, shape) + counted(fixed, moments, shape))
    second = lambda m: sums(m, pairs, laws)
    shape = (len(LAWS), BINS)
    found = total(second, shape) + counted(fixed, second, shape)
    return Null(pairs, {name: settled(law, found[LAWS[name]]) for name, law in laws.items()})


def fit(texts: list[str]) -> Null:
    """From all ordinary words of the texts."""
    return laws_of(lambda count, shape: counted(chain.from_iterable(map(ordinary, texts)), count, shape))


def measured(docs: DataFrame) -> Null:
    """From all ordinary words of every row's text; equal to fit() of all texts."""
    return laws_of(lambda count, shape: counts(docs, lambda texts: counted(chain.from_iterable(map(ordinary, texts)), count, shape), shape))


@cache
def usual() -> Null:
    """Of the fixed words alone."""
    return fit([])


def random_spans(text: str, taken: list[Span], null: Null, rate: float) -> list[Span]:
    tokens = [(m.start(), m.end()) for m in RUN.finditer(text)]
    if not tokens:
        return []
    weights = [math.log2(b - a) for a, b in tokens]
    total, m = sum(weights), len(tokens)
    scored = []
    for (a, b), w in zip(tokens, weights):
        scored.append((null.probability(text[a:b]) / (w * m / total), a, b))
    scored.sort()
    keep = max((i for i, (p, _, _) in enumerate(scored, 1) if p <= rate * i / m), default=0)
    busy = sorted((a, b) for _, a, b in taken)
    out, i = [], 0
    for a, b in sorted(x[1:] for x in scored[:keep]):
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if i == len(busy) or busy[i][0] >= b:
            out.append(("random", a, b))
    return out


def find(null: Null | None = None, rate: float = RATE):
    def of(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        more = random_spans(text, base, null or usual(), rate)
        return base, sorted(base + more, key=lambda s: (s[1], ORDER[s[0]])) if more else base

    return of


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    null = docs.sparkSession.sparkContext.broadcast(measured(docs))
    return spans.scan(docs, KINDS, lambda: find(null.value, rate))


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """`docs` with `[secret]` in place of every span."""
    null = docs.sparkSession.sparkContext.broadcast(measured(docs))
    return spans.redact(docs, lambda: find(null.value, rate), lambda kind: "[secret]")
