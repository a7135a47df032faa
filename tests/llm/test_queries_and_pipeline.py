"""The registered queries and the pipeline as they are wired, on small, odd and empty tables."""

import hashlib
from collections import Counter
from itertools import combinations

import duckdb
import pytest

import corpus_pipeline
from matloom.llm import entries, mixing, quality, secrets

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_nearest": ["query_id", "rank", "vec_id", "score"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_licenses": ["doc_id", "path", "own", "score", "inherited", "from_dir", "license"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_neardup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_quality": ["doc_id", "votes", "posterior", "score", "keep"],
    "op11_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op12_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_audit": ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
}


@pytest.fixture(scope="module")
def tables(spark, odd, none, tmp_path_factory):
    """Folders with odd and with empty tables."""
    out = []
    pages = spark.createDataFrame([(1, "u", "<p>", 1), (2, None, None, 2), (3, "v", "<p>", 3), (None, "w", "", 4)], "page_id long, url string, html string, n int")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.5, 0.5]), (7, None), (8, [0.0, 0.0]), (9, [1.0, 1.0])], "vec_id long, embedding array<float>")
    turns = [(0, 0, "user", "hi", 1), (0, None, None, None, 2), (0, 1, "user", "x" * 100_000, 3), (1, 0, "user", "hi", 4), (1, 0, "user", "hi", 4), (5, 3, "", "é", 5), (6, 3, "", None, 6), (None, 0, "user", "hi", 7)]
    conversations = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part int")
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 1), (6, 0, 1), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    others = {"pages": pages, "embeddings": vectors, "conversations": conversations, "labels": labels}
    for some in (False, True):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in ({"documents": odd} | others if some else {"documents": none} | {k: df.limit(0) for k, df in others.items()}).items():
            df.write.parquet(f"{folder}/{name}.parquet")
        out.append(str(folder))
    return out


@pytest.mark.parametrize("name", entries.QUERIES)
def test_queries_on_odd_and_empty_tables(spark, tables, name):
    empty, some = tables
    assert entries.QUERIES[name](spark, empty).count() == 0
    df = entries.QUERIES[name](spark, some)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == {"op2_nearest": 5, "op7_warc": 4, "op12_trie": 5, "op13_audit": 1800}.get(name, 12)
    if name in entries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "conversations", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{some}/{t}.parquet/*.parquet'")
        at = [c for c in COLUMNS[name] if not (name == "op1_mixing" and c == "taken")]  # rows that repeat share their places' copies
        want = con.sql(f"SELECT {', '.join(at)} FROM ({entries.ORACLES[name]})").fetchall()
        assert sorted((tuple(r[c] for c in at) for r in rows), key=repr) == sorted(want, key=repr)


def test_pipeline_on_odd_and_empty_tables(spark, tables):
    empty, some = tables
    assert corpus_pipeline.run(spark, empty).count() == 0
    rows = corpus_pipeline.run(spark, some).collect()
    assert rows and {r["doc_id"] for r in rows} <= {None, *range(1, 11)}
    docs = spark.read.parquet(f"{some}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, some)
        assert docs.columns == spark.read.parquet(f"{some}/documents.parquet").columns


def test_pipeline_against_plain_stages(spark):
    """Every stage in plain Python over the small table: reject, all pairs, mask, SQL of the mix, the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    scorer = quality.fit(docs).scorer
    rows = [r for r in rows if not r[1] or scorer(r[1]) >= quality.KEEP]
    sets = {}
    for i, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    rows = [r for r in rows if root(r[0]) == r[0]]
    null = secrets.fit([r[1] for r in rows if r[1] is not None])
    find, masked = secrets.find(null), []
    for i, text, source in rows:
        out, done = [], 0
        for _, a, b in sorted(find(text or "")[1], key=lambda s: s[1]):
            if a >= done:
                out += [text[done:a], "[secret]"]
            done = max(done, b)
        masked.append((i, "".join([*out, text[done:]]) if text else text, source))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", masked)
    copies = {r[0]: r[4] // r[1] if r[1] else 0 for r in con.sql(mixing.MIX_SQL).fetchall()}
    theirs = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter()
    for i, text, _ in masked:
        ids = " ".join(map(str, theirs.encode(text or "", add_special_tokens=False).ids))
        if copies[i]:
            want[i, hashlib.sha256(ids.encode()).hexdigest()] += copies[i]
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()) == want
