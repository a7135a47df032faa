"""BPE encoding and decoding with a contiguous rank array.

A short word is a row of parts with the rank of each adjacent pair beside it. The row is
scanned for its least rank, the boundary there is deleted, and the ranks to its left and
right are refreshed, until no pair has a rank. All new short words of a batch of rows go
through this together as one padded array, in numpy; each distinct word is encoded once and kept in a bounded
memory for the task. A word too long for the array (`SHORT` parts) is merged with a heap over
linked parts, so its time grows as n log n.

Text goes through the tokenizer file's own steps: special strings are cut out first, then
NFC, white space, lower case, the word pattern and the byte alphabet. Letters, numbers and
lower case are at the library's level of Unicode whatever the installed Python and regex
modules know. Only files of this kind (BPE with a word end, no decoder) are taken; others raise ValueError.

Null or empty text has no ids and decodes to the empty text. Whole texts are encoded.
Rows are handled one by one, so repeated rows give repeated results; an empty table gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matloom.llm.workers import tidy

SHORT = 40
#: Bytes that a generation of remembered chunks may take in a worker, by the estimate `ENTRY` + 2 bytes a character; there are two generations.
REMEMBERED, ENTRY = 36 << 20, 400
#: Chunks that are encoded together.
TOGETHER = 50_000
SPACE = regex.compile(r"\p{White_Space}+")
#: What Python's split() takes for white space and the Unicode property does not.
ODD = regex.compile("[\x1c-\x1f]")
NONE = np.int32(2**31 - 1)
#: What Unicode 16 adds to the letters and numbers of Unicode 15.1 (Python's `unicodedata`), in ranges. The library's word pattern is at that level.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Capitals since Unicode 15.1 (first, last, first of their small letters); the library's lower case is at Unicode 17.
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
#: What stands for a letter, a number or another character where the pattern's module and these tables differ.
STAND_INS = {"L": "\u4e00", "N": "\u0663", "": "\u00a7"}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@cache
def new_classes() -> dict[str, str]:
    """Code points that the pattern's module takes for another class (L, N or neither) than the library does, with the class that holds."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))
    taken = {c: k for k in "LN" for c in regex.findall(rf"\p{{{k}}}", every)}
    right = {c: k for c in every if (k := unicodedata.category(c)[0]) in "LN"}
    right |= {chr(c): k for k, ranges in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)) for a, b in ranges for c in range(a, b + 1)}
    return {c: right.get(c, "") for c in taken.keys() | right.keys() if taken.get(c) != right.get(c)}


class WordBpe:
    def __init__(self, spec: str):
        t = json.loads(spec)
        m = t["model"]
        if m["type"] != "BPE" or not m["end_of_word_suffix"] or t["decoder"] or m["ignore_merges"] or m["dropout"]:
            raise ValueError("a BPE file with a word end and no decoder is needed")
        end, vocab = m["end_of_word_suffix"], m["vocab"]
        self.tokens = {i: s for s, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.tokens |= {i: s for s, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.tokens}
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        self.rank_of = dict(zip(key.tolist(), range(len(pairs))))
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = next(p for p in t["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        # A chunk of ASCII letters only is one word where the pattern takes runs of letters, and what else begins with a letter is none of its alternatives.
        kinds = split["pattern"]["Regex"].split("|")
        self.runs = r"[\p{L}]+" in kinds and all(k[0] in "'[" for k in kinds)
        other = new_classes()
        self.other = frozenset(other)
        self.stand_in = str.maketrans({c: STAND_INS[k] for c, k in other.items()})
        self.lower = str.maketrans({chr(a + i): chr(low + i) for a, b, low in NEW_CAPITALS for i in range(b - a + 1)})
        self.capitals = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in NEW_CAPITALS) + "]")
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.held = 0  # the estimate for `young`

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Parts of words of one length, each row of the arrays one word. Every row that still merges loses one boundary a round, so rows stay equally long."""
        flat = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        parts = self.inner[flat]
        parts[:, -1] = self.final[flat[:, -1]]
        out: list = [None] * len(words)
        row = np.arange(len(words))
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        while len(row) and ranks.shape[1]:
            k, n = np.arange(len(row)), ranks.shape[1]
            at = ranks.argmin(1)
            least = ranks[k, at]
            go = least < NONE
            if not go.all():
                for i, ids in zip(row[~go].tolist(), parts[~go].tolist()):
                    out[i] = ids
                row, parts, ranks, at, least = row[go], parts[go], ranks[go], at[go], least[go]
                k = k[: len(row)]
            parts[k, at] = self.made[least]
            step = np.arange(n + 1)
            parts = parts[step[None, :] != at[:, None] + 1].reshape(len(row), n)
            ranks = ranks[step[None, :n] != at[:, None]].reshape(len(row), n - 1)
            for near in (at - 1, at):
                has = (near >= 0) & (near < n - 1)
                i, j = k[has], near[has]
                ranks[i, j] = self._rank(parts[i, j], parts[i, j + 1])
        for i, ids in zip(row.tolist(), parts.tolist()):
            out[i] = ids
        return out

    def merge_long(self, word: bytes) -> list[int]:
        part = self.inner[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        part[-1] = int(self.final[word[-1]])
        after, back = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made, heap = self.rank_of, self.made, []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (got := rank.get(part[i] << 32 | part[after[i]])) is not None:
                heapq.heappush(heap, (got, i, part[i], part[after[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            got, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = int(made[got]), -1, after[j]
            if after[j] < n:
                back[after[j]] = i
            push(back[i])
            push(i)
        return [x for x in part if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        by_width: dict[int, list[int]] = {}
        raw = [w.encode() for w in words]
        for i, w in enumerate(raw):
            by_width.setdefault(min(len(w), SHORT + 1), []).append(i)
        out: list = [None] * len(words)
        for width, places in by_width.items():
            for i in range(0, len(places), 20_000):
                some = places[i : i + 20_000]
                got = self.merge_short([raw[x] for x in some]) if width <= SHORT else [self.merge_long(raw[x]) for x in some]
                for x, ids in zip(some, got):
                    out[x] = ids
        return out

    def words(self, chunk: str) -> list[str]:
        """The matches of the word pattern, with characters in the library's classes."""
        if chunk.isascii():
            return [chunk] if self.runs and chunk.isalpha() else self.pattern.findall(chunk)
        if self.other.isdisjoint(chunk):
            return self.pattern.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(chunk.translate(self.stand_in))]

    def learn(self, chunks: set[str]) -> None:
        """Encodes the chunks that are not remembered; what two generations of `REMEMBERED` bytes have not used is forgotten."""
        if self.held > REMEMBERED:
            self.young, self.old, self.held = {}, self.young, 0
        young, old, new = self.young, self.old, []
        for c in chunks:
            if c not in young:
                if (got := old.get(c)) is None:
                    new.append(c)
                else:
                    self.remember(c, got)
        split = [self.words(c) for c in new]
        words = {w: i for i, w in enumerate({w for ws in split for w in ws})}
        ids = self.encode_words(list(words))
        number, token = self.decimal.__getitem__, self.tokens.__getitem__
        texts = [" ".join(map(number, x)) for x in ids]
        decoded = [" ".join(map(token, x)) for x in ids]
        for c, ws in zip(new, split):
            if len(ws) == 1:
                i = words[ws[0]]
                self.remember(c, (texts[i], decoded[i]))
                continue
            at = [words[w] for w in ws]
            self.remember(c, (" ".join([texts[i] for i in at]), " ".join([decoded[i] for i in at])))

    def remember(self, chunk: str, got: tuple[str, str]) -> None:
        self.young[chunk] = got
        self.held += ENTRY + 2 * (len(chunk) + len(got[0]) + len(got[1]))

    def chunks(self, text: str) -> list[str]:
        """The stretches between white space, which no word of the pattern crosses."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            if self.capitals.search(text):
                text = text.translate(self.lower)
        else:
            text = text.lower()
        return [x for x in SPACE.split(text) if x] if ODD.search(text) else text.split()

    def pieces(self, text: str) -> list[tuple[str, list[str]]]:
        """Special strings and the chunks between them: (special or '', chunks)."""
        if self.cut is None or not self.cut.search(text):
            return [("", self.chunks(text))]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [("", self.chunks(text[at : m.start()])), (m[0], [])]
            at = m.end()
        return [*out, ("", self.chunks(text[at:]))]

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids, joined by a space, and what decoding these gives."""
        out: list[tuple[str, str]] = []
        waiting: list[list[tuple[str, list[str]]]] = []
        needed: set[str] = set()

        def flush() -> None:
            self.learn(needed)
            known = self.young.__getitem__
            for doc in waiting:
                got = list(map(known, doc[0][1])) if len(doc) == 1 else [x for special, chunks in doc for x in ([(str(self.special[special]), special)] if special else map(known, chunks))]
                out.append((" ".join([x[0] for x in got]), " ".join([x[1] for x in got])))
            waiting.clear()
            needed.clear()

        for text in texts:
            waiting.append(self.pieces(text))
            for _, chunks in waiting[-1]:
                needed.update(chunks)
            if len(needed) > TOGETHER:
                flush()
        flush()
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
FULL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded; with `digests` the SHA-256 of the ids (in decimal, joined by a space) and of the decoded text in their place.

    `tokenizer` is the path of a tokenizer file; it is read on the driver (a few MB) and broadcast.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        model = WordBpe(spec.value)
        # The model makes no cycles, and the collector would go through all remembered words again and again.
        gc.disable()
        try:
            yield from encoded(model, batches)
        finally:
            gc.enable()
        # Idle workers stay alive for a while: they keep neither the words nor the model.
        del model
        tidy()

    def encoded(model, batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = model.encode_batch([t or "" for t in part.column(1).to_pylist()])
                n = [a.count(" ") + 1 if a else 0 for a, _ in got]
                if digests:
                    more = [[hashlib.sha256(x[k].encode()).hexdigest() for x in got] for k in (0, 1)]
                    types = [pa.string(), pa.string()]
                else:
                    more = [[[int(x) for x in a.split()] for a, _ in got], [b for _, b in got]]
                    types = [pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *[pa.array(x, t) for x, t in zip(more, types)]], names=(DIGESTS if digests else FULL).names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS if digests else FULL)
