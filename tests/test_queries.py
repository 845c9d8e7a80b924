"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tracewell.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in ORACLES:
        got = sql.execute(ORACLES[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == names
        expected = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in got.fetchall())
        assert rows == expected
    else:
        assert rows


def test_greedy_pairs_take_each_row_once(spark):
    from tracewell.operators.joins import greedy_pairs

    rows = [(1, 0, "p", 1), (1, 10, "c", 2), (1, 12, "p", 3), (1, 14, "c", 4), (1, 500, "p", 5)]
    df = spark.createDataFrame(rows, "f int, at long, kind string, id long")
    out = greedy_pairs(df, ["f"], "at", "kind", "p", "c", "id", 100).collect()
    assert sorted((r.a, r.b, r.distance) for r in out) == [(1, 2, 10), (3, 4, 2)]


def test_leaky_bucket_against_a_loop(spark):
    import random

    from tracewell.operators.sequence import leaky_bucket

    random.seed(3)
    rows, t = [], 0
    for i in range(200):
        t += random.randint(0, 5)
        rows.append((1, i, t, random.randint(0, 30)))
    full, at, under, low = 50, None, 0, 50
    for _, _, t, size in rows:
        full = min(50, full + (t - at if at is not None else 0) * 4) - size
        at, under, full = t, under + (full < 0), max(full, 0)
        low = min(low, full)
    df = spark.createDataFrame(rows, "f int, i int, at long, size long")
    got = leaky_bucket(df, ["f"], ["i"], "at", "size", 4, 50).first()
    assert (got.full, got.underflows, got.lowest) == (full, under, low)
