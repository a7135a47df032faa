"""The digests of the registered queries, worked out again in plain Python over a table with odd, repeated and planted texts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from matloom.llm import entries

SMALL = "/root/testdata/sf0.001"
FORMS = {
    "phone": lambda i: (f"+1 (269) 555-{3000 + i}", [f"269.555.{3000 + i}", f"(269) 555-{3000 + i}"]),
    "ip": lambda i: (f"10.{i % 200}.7.9", [f"010 {i % 200:03d} 007 009"]),
    "card": lambda i: (luhn(f"4{100000000000 + 37 * i:014d}"), None),
}


def luhn(body):
    for last in "0123456789":
        d = [int(c) for c in reversed(body + last)]
        if (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            return body + last


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    rng, rows, planted = random.Random(11), [], {}
    for i in range(400):
        parts, spans = [], []
        for kind in ("phone", "ip", "card"):
            first, others = FORMS[kind](i)
            if kind == "card":
                others = [".".join(first[k : k + 4] for k in range(0, 16, 4))]
            lead = {"phone": "call", "ip": "host", "card": "card"}[kind]
            parts += [f"{lead} {first} now"] + ([f"or {lead} {rng.choice(others)} then"] if i % 2 else [])
            spans.append(kind)
        text = " and ".join(parts) + f" in {1900 + i % 120} of {i} at page {i * 3}"
        if i % 2:
            for m in re.finditer(r"or (call|host|card) (.+?) then", text):
                planted.setdefault(1000 + i, set()).add(({"call": "phone", "host": "ip", "card": "card"}[m[1]], *m.span(2)))
        rows.append((1000 + i, text))
    secrets = ["password: hunter2hunter2", 'Api_Key = "abc.def=ghi"', "token=short", "AKIA" + "Z" * 12, "AKIASHORT", "0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "secret : é", "f" * 31, "SECRET='AKIA1234567890ABCD'"]
    rows += [(5000 + i, " x ".join(rng.sample(secrets, 4))) for i in range(60)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more).union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 10000", "text"))
    at = tmp_path_factory.mktemp("wired")
    docs.write.parquet(f"{at}/documents.parquet")
    pages = [(i, None if i == 3 else "<p>" + "é" * (i % 4) + "</p>" * (20_000 if i == 5 else 1)) for i in range(24)] + [(30, "")]
    spark.createDataFrame([(i, f"http://h/{i}", html) for i, html in pages], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at), Counter((r[0], r[1]) for r in docs.collect()), planted, pages


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", m[0]))]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def secret(t):
    kinds = ["assign", "access", "hex"]
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    out = [("assign", *m.span()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op3_pii", pii, ["email", "ip", "card", "phone"]), ("op9_secrets", secret, ["assign", "access", "hex"])])
def test_base_digests_and_what_is_added(spark, folder, name, plain, kinds):
    at, docs, planted, _ = folder
    rows = entries.QUERIES[name](spark, at).collect()
    want, base_of = Counter(), {}
    for (doc, text), n in docs.items():
        spans = plain(text or "")
        base_of[doc] = set(spans)
        want[(doc, *[sum(s[0] == k for s in spans) for k in kinds], digest(spans))] += n
    assert Counter((r["doc_id"], *[r[f"n_{k}"] for k in kinds], r["base_sha256"]) for r in rows) == want
    found = {}
    for r in rows:
        spans = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)}
        assert base_of[r["doc_id"]] <= spans
        found[r["doc_id"]] = spans - base_of[r["doc_id"]]
    if name == "op3_pii":
        right = sum(len(found[d] & s) for d, s in planted.items())
        assert right >= 0.95 * sum(map(len, planted.values()))
        assert right >= 0.95 * sum(len(found[d]) for d in range(1000, 1400))


def test_media_payloads(spark, folder):
    at, docs, _, _ = folder
    want = Counter()
    for (doc, text), n in docs.items():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += n
    rows = entries.QUERIES["op6_media"](spark, at).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in rows) == want
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])


def test_archive_records(spark, folder):
    at, _, _, pages = folder
    largest = {}
    for page, html in pages:
        largest[html or ""] = max(page, largest.get(html or "", page))
    want = Counter()
    for page, html in pages:
        raw, last = (html or "").encode(), largest[html or ""]
        want[page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == last else "revisit", None if page == last else last] += 1
    rows = entries.QUERIES["op7_warc"](spark, at).collect()
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows) == want


def test_ids_and_decoded_texts(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    at, docs, _, _ = folder
    theirs = Tokenizer.from_file(public_tokenizers.path(entries.TOKENIZER))
    want = Counter()
    for (doc, text), n in docs.items():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    rows = entries.QUERIES["op5_bpe"](spark, at).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in rows) == want
