"""Odd tables through every operator: one row out for each row in, and defined results."""

import duckdb
import pytest

from matloom.llm import bpe, licenses, media, mixing, nearest, neardup, pii, quality, secrets, warc


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OPERATORS = {
    "mixing": lambda d: mixing.shares(d).select("row.doc_id", "taken"),
    "mix": lambda d: mixing.mix(d).select("row.doc_id", "taken"),
    "pii": pii.scan,
    "secrets": secrets.scan,
    "media": lambda d: media.of_texts(d, digests=True),
    "media_full": media.of_texts,
    "bpe": lambda d: bpe.encode(d, tokenizer(), digests=True),
    "bpe_full": lambda d: bpe.encode(d, tokenizer()),
    "quality": quality.score,
    "neardup": neardup.classes,
    "licenses": lambda d: licenses.scan(d, d["source"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, none, name):
    got = OPERATORS[name](odd)
    rows = got.collect()
    assert len(rows) == 12 and sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd.select("doc_id").collect())
    same = [r.asDict(recursive=True) for r in rows if r["doc_id"] == 6]
    if name not in ("mixing", "mix"):
        assert same[0] == same[1]
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("keep", [quality.keep, secrets.redact, neardup.keep_one, lambda d: mixing.emit(mixing.mix(d))])
def test_stages_keep_the_columns(odd, none, keep):
    assert keep(odd).schema.simpleString() == odd.schema.simpleString()
    assert keep(odd).count() > 0 and keep(none).count() == 0


def test_nulls_have_defined_results(odd):
    n = {r["doc_id"]: r for r in neardup.classes(odd).collect()}
    assert n[1]["n_shingles"] == n[2]["n_shingles"] == n[3]["n_shingles"] == 0 and n[4]["n_shingles"] == 1
    assert n[3]["component_id"] == 3 and n[6]["component_id"] == n[10]["component_id"] == 5 and n[None]["component_id"] is None
    assert {r["doc_id"]: r["n_bytes"] for r in media.of_texts(odd, digests=True).collect()}[1] == 0
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode(odd, tokenizer(), digests=True).collect()}[1] == 0
    assert all(r["keep"] for r in quality.score(odd).collect() if r["doc_id"] in (1, 2))
    m = {r["doc_id"]: r for r in mixing.shares(odd).select("row.doc_id", "size", "source_size", "target", "taken").collect()}
    assert m[1]["size"] == m[1]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in m.values())


def test_mixing_agrees_with_sql_and_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(d)
    flat = sorted(tuple(r) for r in got.select("row.doc_id", "size", "source_size", "target", "taken").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert [(a, b, c, round(d, 6), e) for a, b, c, d, e in flat] == [(a, b, c, round(d, 6), e) for a, b, c, d, e in sorted(con.sql(mixing.MIX_SQL).fetchall())]
    for r in got.groupBy("row.source").agg({"target": "max", "taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.05 * r["max(target)"] + 97
    again = sorted(tuple(r) for r in mixing.mix(d.repartition(2)).select("row.doc_id", "size", "source_size", "target", "taken").collect())
    assert flat == again


def test_warc_round_trip(spark):
    import base64
    import hashlib

    html = ["<p>same</p>", None, "", "é\r\n\r\nWARC/1.1\r\n\r\n", "<p>same</p>", "x" * 700_000, "<p>same</p>", "z"]
    pages = spark.createDataFrame([(i if i < 7 else None, None if i == 1 else f"http://a/{i} ü", h, 5) for i, h in enumerate(html)], "page_id long, url string, html string, n int").repartition(3)
    manifest = warc.archive(spark, pages)
    got = {r[0]: tuple(r)[1:] for r in warc.read(manifest).collect()}
    assert len(got) == 8
    for i, h in enumerate(html):
        raw = (h or "").encode()
        n, digest, kind, refers = got[i if i < 7 else None]
        assert n == len(raw) and digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (kind, refers) == {0: ("revisit", 6), 4: ("revisit", 6), 1: ("revisit", 2)}.get(i, ("response", None))
    assert {r[3] for r in warc.read(warc.archive(spark, pages, least=10**6)).collect()} == {"response"}
    assert warc.read(warc.archive(spark, pages.limit(0))).count() == 0


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:400] = x[20]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [float("inf")] * 16), (None, x[0].tolist()), (1100, [None] * 16), (1120, [1.0, 2.0]), (1121, [3.0, 4.0])]
    d = spark.createDataFrame([r + (1,) for r in rows], "vec_id long, embedding array<float>, id int").repartition(3)
    got = {}
    for r in nearest.among(d, "vec_id", "embedding", 20, 20).collect():
        got.setdefault(r[0], []).append((r[1], r[2], r[3]))
    y = x.astype(np.float64)
    for q in range(0, 900, 20):
        s = (y * y[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert [i for _, i, _ in sorted(got[q])] == order
        assert np.allclose([v for _, _, v in sorted(got[q])], s[order], rtol=0, atol=1e-12)
    assert sorted(got) == [*range(0, 900, 20), 1120] and got[1120] == [(1, 1121, 11.0)]


def test_mix_shares_copies_among_repeated_rows(spark):
    rows = [(i % 40, f"w{i % 40} " * (1 + i % 40), None if i % 40 == 7 else "a" if i % 2 else "b") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).select("row.*", "size", "copies", "taken").collect()
    assert sorted((r[0], r[1], str(r[2])) for r in got) == sorted((a, b, str(c)) for a, b, c in rows) and all(r["copies"] in (0, 1, 2) for r in got)
    shares = {r["row"]["doc_id"]: r["n"] for r in mixing.shares(d).groupBy("row").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["taken"]
    assert total == shares


def test_nearest_with_repeated_ids_and_none(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 2.0]), (3, [1.0, 1.0]), (3, [0.0, 1.0]), (5, [2.0, 0.0]), (40, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(tuple(r) for r in nearest.among(d, "vec_id", "embedding", 20, 20).collect()) == sorted(con.sql(nearest.NEAREST_SQL).fetchall())
    assert nearest.among(d.limit(0), "vec_id", "embedding", 20, 20).count() == 0


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    """A cell that takes its queries in several blocks finds the same."""
    import numpy as np

    x = np.random.default_rng(4).standard_normal((300, 8)).astype(np.float64)
    ids = np.arange(300)

    def found():
        cell = nearest.Cell(5)
        cell.add_queries(ids[::3], x[::3])
        for i in range(0, 300, 64):
            cell.add_candidates(ids[i : i + 64], x[i : i + 64])
        return sorted(r for b in cell.found() for r in zip(*[c.to_pylist() for c in b.columns]))

    whole = found()
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "TILE", 16)
    assert found() == whole and len(whole) == 500


def test_warc_with_clashing_names(spark):
    names = ["sha", "n", "refers_to", "own_id", "own_sha", "data", "last", "chunk", "html_2"]
    rows = [(i, f"http://a/{i}", h, *["x"] * len(names)) for i, h in enumerate(["a", "a", None, "bb"])]
    d = spark.createDataFrame(rows, ["page_id", "url", "html", *names])
    got = {r[0]: (r[1], r[3], r[4]) for r in warc.read(warc.archive(spark, d)).collect()}
    assert got == {0: (1, "revisit", 1), 1: (1, "response", None), 2: (0, "response", None), 3: (2, "response", None)}


def notices():
    """Files: path, text, and the licence that each should get."""
    import textwrap

    full = {name: text for name, kind, _, text in licenses.TEMPLATES if kind == "text"}
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    title = next(text for name, kind, _, text in licenses.TEMPLATES if kind == "title" and name == "Apache-2.0")
    return [
        ("r/LICENSE", "Released under the MIT License.", "MIT"), ("r/a/x", "code", "MIT"), ("r/b/NOTICE", "Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("r/b/c/d/y", "more\ncode", "Apache-2.0"), ("q/z", None, None), ("r/b/own", "Licensed under CC BY-NC 4.0.\n" + "word " * 50, "CC-BY-NC-4.0"),
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + textwrap.fill(full["MIT"], 70), "MIT"), ("m/src/deep/er/a.py", "print(1)", "MIT"), ("b/COPYING", "Copyright (c) 2019\n" + textwrap.fill(full["BSD-3-Clause"], 50), "BSD-3-Clause"), ("b/b", "", "BSD-3-Clause"),
        ("g/x.c", "\n".join(["# " + x for x in gpl]) + "\nint main();\n" + "code " * 300, "GPL-3.0"), ("g/y.c", "no notice", None), ("s/y.py", "# SPDX-License-Identifier: MIT\ncode", "MIT"), ("s/z.py", "// SPDX-License-Identifier: (MIT OR Apache-2.0)", "(MIT OR Apache-2.0)"),
        ("i/x", "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted." + " code" * 100, "ISC"), ("w/t", "an ordinary sentence. This work is licensed under the GNU General Public License, version 3. Another ordinary sentence.", "GPL-3.0"),
        ("ap/LICENSE", title + " license text" * 700, "Apache-2.0"), ("ap/src/main/x", "code", "Apache-2.0"), ("e/a", "", None), ("e/b", "mit dem license", None),
    ]


def test_licences_of_whole_notices_and_files(spark):
    files = notices()
    d = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, p string, text string")
    got = {r["path"]: r for r in licenses.scan(d, d["p"]).collect()}
    assert {p: got[p]["license"] for p, _, _ in files} == {p: want for p, _, want in files}
    assert got["r/a/x"]["from_dir"] == "r" and got["r/b/c/d/y"]["from_dir"] == "r/b" and got["m/src/deep/er/a.py"]["from_dir"] == "m"


def test_every_template_is_like_itself(spark):
    files = [(i, f"t{i}/x", "some words first " * 9 + text + " and words after it " * 30) for i, (*_, text) in enumerate(licenses.TEMPLATES)]
    d = spark.createDataFrame(files, "doc_id long, p string, text string")
    for r in licenses.scan(d, d["p"]).collect():
        assert (r["own"], r["score"]) == (licenses.TEMPLATES[r["doc_id"]][0], 1.0)


def test_licences_agree_with_sql_and_ancestors(spark, tmp_path):
    """The query itself, on documents whose ids put licence files above others at several levels."""
    from matloom.llm import entries

    texts = [t for _, t, _ in notices()]
    rows = [(i, texts[(i * 7) % len(texts)] if i % 9 == 0 or i in (3, 12) else "plain words here", None if i % 50 == 49 else "a", "en") for i in range(1300)] + [(None, "x", "a", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in entries.op4_licenses(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(con.sql(licenses.SCAN_SQL).fetchall(), key=repr)
    levels = {r[1].count("/") - 1 - r[5].count("/") for r in got if r[5]}
    assert {0, 1, 2} <= levels
