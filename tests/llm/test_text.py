"""Scans, codecs and classifiers against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest

from matloom.llm import bpe, media, pii, quality, secrets


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return bpe.WordBpe(f.read()), Tokenizer.from_file(path)


def test_bpe_equals_the_library(both):
    ours, theirs = both
    rng = random.Random(0)
    pool = "abcXYZ éÉßñÑΣσİıſK'sS'T'LL 0123½①٣  \x1c\x85᠎​퟿日本語한글🙂👍🏽é<|endoftext|>\t\n_-!!..ǅﬁ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", "<|endoftext|>" * 3, " <|startoftext|> x", "a" * 5000, "ab" * 3000 + "é" * 50, "_" * 500]
    for text, got, want in zip(texts, ours.encode_batch(texts), theirs.encode_batch(texts, add_special_tokens=False)):
        assert got[0] == " ".join(map(str, want.ids)), text
        assert got[1] == theirs.decode(want.ids, skip_special_tokens=False) == ours.decode(want.ids)


def test_bpe_has_the_librarys_classes(both):
    """Every code point, between letters, doubled, and beside a number; in capitals' places too."""
    ours, theirs = both
    points = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in (0xE0001, 0xE0100, 0xF0000, 0x10FFFF)]
    for at in range(0, len(points), 64 * 512):
        texts = [" ".join([f"a{c}{c}b{c}1" for c in points[i : i + 64]]) for i in range(at, min(at + 64 * 512, len(points)), 64)]
        assert [a for a, _ in ours.encode_batch(texts)] == [" ".join(map(str, w.ids)) for w in theirs.encode_batch(texts, add_special_tokens=False)]


def test_bpe_forgets_and_still_agrees(both, monkeypatch):
    ours, _ = both
    texts = [f"word{i} and more{i % 7}" for i in range(400)]
    want = ours.encode_batch(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 16)
    assert ours.encode_batch(texts) == want


def test_short_and_long_merges_agree(both):
    ours, _ = both
    for w in ("hello", "x", "internationalization", "aaaaaaaaaaaaaaaaaaaaaaaa"):
        assert ours.merge_short([w.encode()])[0] == ours.merge_long(w.encode())


def plain_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans():
    rng = random.Random(1)
    draw = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    texts = [draw("a1.@-_ é+", rng.randint(0, 40)) for _ in range(4000)] + [draw("0123456789 -.+()", rng.randint(0, 60)) for _ in range(4000)] + [draw("411111111 -", rng.randint(10, 60)) for _ in range(4000)]
    for t in texts + ["mail a.b@c.de. or 10.0.0.256, 10.0.0.1 and 4111 1111 1111 1111 call +1 (269) 555-3296"]:
        assert pii.base_spans(t) == plain_pii(t)


def seen(i):
    parts = [f"mail u{i}.{i}@m{i}.example.com word", f"call +1 (269) 555-{3000 + i} word", f"card {4000000000000000 + 7 * i} pay", f"host {i % 200}.1.2.3 up", f"but {i} of {i * 7}", f"in {1900 + i % 120} or so"]
    random.Random(i).shuffle(parts)
    return " ".join(parts)


SEEN = [seen(i) for i in range(300)]
TEXT = "call +1 (269) 555-3296 now. Later reach 269.555.3296 or (269) 555-3296; write u.Name@Mail.example.com or U.NAME@MAIL.EXAMPLE.COM; card 4111 1111 1111 1111 then 4111.1111.1111.1111; host 10.0.0.1 and 010 000 000 001; 12 apples in 2019"


def test_pii_field_labels_repeats_in_other_shapes():
    """What the field adds, against what was planted; without skip edges none of the rewritten repeats is found."""
    import dataclasses

    field = pii.train([f"{t} and again {t}" if i % 3 == 0 else t for i, t in enumerate(SEEN)])
    base, every = pii.find(field)(TEXT)
    assert base == plain_pii(TEXT) and set(base) <= set(every)
    added = {(k, TEXT[a:b]) for k, a, b in set(every) - set(base)}
    assert added == {("phone", "269.555.3296"), ("phone", "(269) 555-3296"), ("card", "4111.1111.1111.1111"), ("ip", "010 000 000 001")}
    alone = dataclasses.replace(field, skip=np.zeros_like(field.skip))
    assert not {x for x in added if x[0] in ("card", "ip")} & {(k, TEXT[a:b]) for k, a, b in pii.find(alone)(TEXT)[1]}
    assert pii.find(field)("version 3 of 12 items, 1999, order 4512345678")[1] == []
    assert pii.train([]) is None and pii.find(None)(TEXT)[0] == pii.find(None)(TEXT)[1]


def test_pii_skip_table_is_learnt():
    """Repeats that agree in the sample strengthen agreement beyond its start."""
    once, twice = pii.train(SEEN[:100]), pii.train([f"{t} and again {t}" for t in SEEN[:100]])
    off = lambda f: f.skip[~np.eye(len(f.skip), dtype=bool)].mean()
    assert off(twice) < off(once) - 0.5 and (np.diag(twice.skip) > 0).all()


@pytest.mark.parametrize("edges", [[(0, 1, 0), (1, 2, 0), (1, 3, 1)], [(0, 1, 0), (1, 2, 0), (0, 2, 1)], [(0, 1, 0), (1, 2, 1), (2, 3, 0), (0, 3, 1), (1, 3, 1)]])
def test_pii_messages_against_enumeration(edges):
    """Exact on trees, near on small loops."""
    from itertools import product

    rng, e = np.random.default_rng(len(edges)), np.array(edges)
    n, k = e[:, :2].max() + 1, 3
    own, chain, skip = rng.normal(size=(n, k)), rng.normal(size=(k, k)) * 0.5, np.eye(k) * 0.7
    want = np.zeros((n, k))
    for labels in product(range(k), repeat=n):
        p = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum((skip if s else chain)[labels[a], labels[b]] for a, b, s in edges))
        for i, x in enumerate(labels):
            want[i, x] += p
    want /= want.sum(1, keepdims=True)
    got = pii.messages(own, e[:, :2], e[:, 2] == 1, chain, skip)
    assert np.abs(got - want).max() < (1e-4 if len(edges) < n else 0.06)


def plain_secrets(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.ORDER[s[0]]))


def test_secret_base_spans_and_random_tokens():
    rng = random.Random(2)
    parts = ["password", "TOKEN", "ſecret", "api_key", "apiKey", "K", " ", "=", ":", "'", '"', "AKIA", "abc123", "deadbeef" * 2, "x", "É", "A1B2"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert secrets.base_spans(t) == plain_secrets(t)
    find = secrets.find()
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    assert ("random", 9, 49) in find(f"the key: {key} ends")[1]
    assert find("ordinary words like internationalization_of_everything and 2024-01-01 stay")[1] == []


def test_identifiers_words_and_numbers_are_no_secrets():
    find = secrets.find()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for word in ["getElementsByTagNameAndClassName", "DoNotUseThisInYourCodeAtAll", "THIS_IS_A_LONG_CONSTANT_NAME", "src/main/java/org/apache/spark/sql", letters, letters.upper() + "234567", "VXVXVXVXMVXVXVXVXVXVXVXV", "-" * 60, "1234567890" * 2, "83920174650192837465", "2024-01-01_2024-12-31-00-00"]:
        assert find(f"see {word} here")[1] == []


@pytest.fixture(scope="module")
def measured():
    """Laws from one half of a table's documents, and ordinary tokens of the other half's words."""
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY hash(doc_id)").fetchall()]
    words = [w for t in texts[500:] for w in secrets.PIECE.findall(t) if len(w) < secrets.SHORTEST]
    random.Random(3).shuffle(words)
    return secrets.fit(texts[:500]), [t for t in secrets.made(words, 8000) if len(t) >= secrets.SHORTEST]


def test_false_discoveries_among_ordinary_tokens(measured):
    """Each as its document's only token."""
    null, tokens = measured
    assert sum(null.probability(t) <= secrets.RATE for t in tokens) <= 5 * secrets.RATE * len(tokens)


@pytest.mark.parametrize("alphabet, least", [
    ("0123456789ABCDEF", (0.8, 0.9)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (0.9, 0.97)), ("abcdefghijklmnopqrstuvwxyz", (0.5, 0.9)), ("abcdefghijklmnopqrstuvwxyz0123456789", (0.95, 0.98)),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", (0.4, 0.85)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (0.9, 0.97)),
])
def test_power_by_encoding_and_length(measured, alphabet, least):
    """The share of random tokens of 20 and of 32 characters that is found, each as its document's only token."""
    null, rng = measured[0], random.Random(5)
    for size, share in zip((20, 32), least):
        assert sum(null.probability("".join(rng.choice(alphabet) for _ in range(size))) <= secrets.RATE for _ in range(200)) >= share * 200


def test_laws_are_of_every_document(spark):
    """However the rows are dealt out; long tables are measured as a whole, in words that no other document has too."""
    rows = [(i, f"{a} {b} {i} " * (1 + i % 4)) for i, (a, b) in enumerate(zip(secrets.WORDS * 8, (secrets.WORDS * 9)[7:]))]
    rows += [(len(rows), "zyzzyx qwijbo " * 30), (len(rows) + 1, None), (len(rows) + 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = secrets.fit([t for _, t in rows if t])
    for n in (1, 5):
        null = secrets.measured(docs.repartition(n))
        assert (null.pairs == own.pairs).all() and null.laws.keys() == own.laws.keys()
        for k, law in null.laws.items():
            assert (law.mean == own.laws[k].mean).all() and (law.spread == own.laws[k].spread).all() and (law.middle, law.width, law.tail) == (own.laws[k].middle, own.laws[k].width, own.laws[k].tail)
    for gone in (0, len(rows) // 2, len(rows) - 3):
        assert (secrets.fit([t for i, t in rows if t and i != gone]).pairs != own.pairs).any()
    made = "".join(secrets.ordinary("alpha bravo +/ charlie " + "x" * 25 + " delta7")).lower()
    assert all(w in made for w in ("alpha", "bravo", "charlie", "delta7")) and "xxx" not in made


def test_statistics_of_many_tokens_are_those_of_each():
    rng = random.Random(3)
    tokens = secrets.made(secrets.WORDS, 900) + ["".join(rng.choice(a) for _ in range(24)) for a in ("ABCDEF01", "abcdef", "a2b7", "aB", "aB3", "aB3+/", "0-9_5/") for _ in range(20)] + ["a" * 20]
    null, many = secrets.usual(), secrets.Many.of(tokens)
    for t, values, law, usual in zip(tokens, many.values, many.law, many.usual(null.pairs)):
        assert secrets.statistics(t, null.pairs) == pytest.approx([*values, usual])
        name = secrets.encoding(t)[0]
        assert law == secrets.LAWS[secrets.GROUP.get(name, name)]


def test_repetition_at_the_end_of_a_text_is_seen():
    words = [f"w{i}".encode() for i in range(200)] + [b"buy", b"it", b"now", b"ok"] * 25
    assert quality.repetition(words)[1] == 1 - 104 / 200
    assert quality.repetition(words[:200])[1] == 0 and quality.repetition(words[:150])[1] == 0 and quality.repetition(words[200:])[1] == 0.96


def test_the_scorer_is_trained_on_every_document(spark):
    """More documents than any sample held before, however the rows are dealt out."""
    from collections import Counter

    d = "/root/testdata/sf0.1/documents.parquet"
    docs = spark.read.parquet(d).select("doc_id", "text").where("doc_id % 3 = 0")
    texts = [r["text"] for r in docs.collect() if r["text"]]
    assert len(texts) > 3000
    seen = [quality.pattern(quality.votes(t)) for t in texts]
    counted = Counter(seen)
    if blank := docs.where("text IS NULL OR text = ''").count():
        counted[quality.pattern(quality.votes(""))] += blank
    post = quality.agree(counted)
    own = quality.train(texts, [post[p] for p in seen])
    for n in (2, 9):
        scorer = quality.fit(docs.repartition(n)).scorer
        assert scorer.bias == own.bias and (scorer.weights == own.weights).all()
    for gone in (0, 1700, len(texts) - 1):
        less = quality.train(texts[:gone] + texts[gone + 1 :], [post[p] for i, p in enumerate(seen) if i != gone])
        assert (less.weights != own.weights).any()


def test_a_score_leaves_its_own_document_out():
    """The counts of a document alone hold nothing of itself: its score by the others' weights is even."""
    rows = [("some plain words of a text", 0.9)]
    alone = quality.cells(rows, quality.shares(rows))
    assert alone[0].sum() == 1 and alone[0, quality.LIMIT * quality.STEPS].sum() == 1
    pair = quality.shares([*rows, ("other plain words of one more", 0.2)])
    at, share = quality.features(rows[0][0])
    assert (pair[:, at].sum(0) * quality.UNIT >= share - 1e-6).all()


def test_media_tables_and_blocks():
    assert media.TABLES["mulaw"][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.TABLES["alaw"][[0x55, 0xD5, 0xAA, 0x2A]].tolist() == [-8, 8, 32256, -32256]
    blocks = np.random.default_rng(0).integers(0, 256, (5, media.BLOCK), dtype=np.uint8)
    for block, got in zip(blocks, media.adpcm_blocks(blocks)):
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value - size if code & 8 else value + size))
                index = max(0, min(88, index + int(media.INDEX_MOVES[code & 7])))
                want.append(value)
        assert got.tolist() == want


@pytest.mark.parametrize("codec", media.CODECS)
def test_media_round_trip(codec):
    payload = bytes(range(256)) * 9
    kind, data = media.unpack(media.pack(payload, codec))
    assert kind == codec and bytes(data) == payload
    rows = list(media.media_of(["text", None, "text", "ü" * 400]))
    assert rows[0][2] == rows[2][2] and rows[1][0] == 0 and len(rows[1][3]) == media.BLOCK
    assert zlib.crc32(bytes(rows[3][3])[:800]) == zlib.crc32(("ü" * 400).encode())
    assert media.resample(np.array([0, 1600], np.int16)).tolist()[0::2] == [0, 1600]


def test_agreement_finds_how_good_labellers_are():
    """Simulated labellers of known accuracy, some abstaining: estimated posteriors call the truth as well as the true accuracies do."""
    from collections import Counter

    rng = random.Random(8)
    right = [0.95, 0.9, 0.9, 0.85, 0.8, 0.8, 0.75, 0.7]
    rows = []
    for _ in range(6000):
        good = rng.random() < 0.7
        rows.append((good, tuple(-1 if rng.random() < 0.2 else int(good == (rng.random() < r)) for r in right)))
    post = quality.agree(Counter(quality.pattern(v) for _, v in rows))
    odds = lambda v: np.log(0.7 / 0.3) + sum((1 if x else -1) * np.log(r / (1 - r)) for x, r in zip(v, right) if x >= 0)
    ours = sum((post[quality.pattern(v)] > 0.5) == g for g, v in rows)
    best = sum((odds(v) > 0) == g for g, v in rows)
    assert ours >= best - 60
    assert np.mean([abs(post[quality.pattern(v)] - 1 / (1 + np.exp(-odds(v)))) for _, v in rows]) < 0.03


def test_quality_on_held_out_labels():
    """Posteriors and the scorer, trained without labels, against the labels that the tables have."""
    import duckdb
    from collections import Counter

    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT text, quality FROM '{d}/documents.parquet' LEFT JOIN '{d}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    seen = [quality.votes(t) for t, _ in rows]
    post = quality.agree(Counter(map(quality.pattern, seen)))
    scorer = quality.train([t for t, _ in rows[:500]], [post[quality.pattern(v)] for v in seen[:500]])
    held = [(scorer(t) >= quality.KEEP, q) for t, q in rows[500:] if q is not None]
    assert sum(k == (q == 1) for k, q in held) / len(held) > 0.98
    assert all(k for k, q in held if q == 1)
    assert quality.agree({}) == {} and quality.train([], [])("anything") > 0.5


def test_letters_are_a_word_without_the_pattern():
    """Most chunks are ASCII letters only: the pattern need not look at them."""
    import public_tokenizers

    from matloom.llm.bpe import WordBpe

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = WordBpe(f.read())
    assert model.words("don't") == model.pattern.findall("don't") and model.words("a1b") == ["a", "1", "b"]
    model.pattern = None
    assert model.words("straw") == ["straw"]
