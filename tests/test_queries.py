"""Every registered query of the library against its SQL, over a small scale."""

import math
import os

import duckdb
import pytest

from matloom.registry import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Slow ones; tests/test_operators.py has their small cases.
SLOW = {"archetype_trace", "aa"} | {f"layout_{m}" for m in ("umap", "tumap", "largevis")}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.6g}") + 0.0
    return x


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_rows(spark, sql, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(ORACLES) == {"singular_values", "knn_cells", "knn_descent", "density_clusters", "archetype_collect", "archetype_merge", "archetype_pipeline"}


def test_whole_queries_have_every_column_and_pair(spark, sql):
    n = sql.sql("SELECT max(len(embedding)) FROM embeddings").fetchall()[0][0]
    for name in ("moran_perm", "geary_perm"):
        assert sorted(r["dim"] for r in QUERIES[name](spark, DIR).select("dim").collect()) == list(range(n))
    assert QUERIES["xicor_matrix"](spark, DIR).select("i", "j").distinct().count() == n * n
