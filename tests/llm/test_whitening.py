"""Whitening against numpy in exact and extended arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tracewell.llm import whitening
from tracewell.llm.common import read
from tracewell.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x string"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "n", "x") for i, v in vectors], SCHEMA)


def usable(vectors, size):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]


def check(vectors, rows, size, components):
    """Counts and deviations exactly; eigenvectors by what they do to the covariance."""
    own = usable(vectors, size)
    n, sums = len(own), [sum(column) for column in zip(*[x for _, x in own])]
    deviation = {i: sum((n * x - s) ** 2 for x, s in zip(v, sums)) for i, v in own}
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(v, sums)] for _, v in own])
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * min(components, size)
    matrix = np.array([[got[i, c + 1]["whitened"] for c in range(min(components, size))] for i, _ in own])
    for k in range(matrix.shape[1]):
        # The projections of all vectors give the component back: covariance * axis = value * axis.
        axis = centred.T @ matrix[:, k] / n / math.sqrt(values[k])
        assert abs(np.linalg.norm(axis) - 1) < 1e-9
        assert np.abs(covariance @ axis - values[k] * axis).max() < 1e-8 * values[0]
        assert np.abs(centred @ axis / math.sqrt(values[k]) - matrix[:, k]).max() < 1e-7
    for (i, c), r in got.items():
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(r["explained"] / (values[c - 1] / np.trace(covariance)) - 1) < 1e-6
        assert r["identity_error"] == rows[0]["identity_error"] < 1e-6


@pytest.mark.parametrize("size,products", [(5, 8_256), (40, 8_256), (5, 4)])
def test_against_numpy(spark, monkeypatch, size, products):
    monkeypatch.setattr(whitening, "PRODUCTS", products)
    random = np.random.default_rng(size)
    vectors = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(90, size)) * np.arange(1, size + 1))]
    vectors += [(200, None), (201, [None] * size), (202, [NAN] + [0.0] * (size - 1)), (203, [INF] * size), (204, [-INF] + [1.0] * (size - 1)), (205, []), (206, [0.0] * size), (207, [-0.004] * size)]
    rows = [r.asDict() for r in whitening.whiten(table(spark, vectors), ["vec_id"]).collect()]
    check(vectors, rows, size, 32)


def test_lengths_are_fitted_apart(spark):
    random = np.random.default_rng(1)
    vectors = [(i, random.normal(size=3 if i % 2 else 2).tolist()) for i in range(60)]
    rows = [r.asDict() for r in whitening.whiten(table(spark, vectors), ["vec_id"]).collect()]
    for size in (2, 3):
        check(vectors, [r for r in rows if (r["vec_id"] % 2 == 1) == (size == 3)], size, 32)


def test_nothing_varies_ties_extremes_and_empty_tables(spark):
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])]), ["vec_id", "n"]).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    flat = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])]), ["vec_id"]).collect()
    assert sorted((r.vec_id, r.component, r.n, r.explained) for r in flat) == [(1, 1, 3, 1.0), (1, 1, 3, 1.0), (1, 2, 3, 0.0), (1, 2, 3, 0.0), (2, 1, 3, 1.0), (2, 2, 3, 0.0)]
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    huge = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.5]), (3, [0.0, 0.0])]), ["vec_id"]).collect()
    assert len(huge) == 6 and {r.vec_id: r.deviation for r in huge}[1] is None
    assert all(abs(r.whitened) < 2 for r in huge if r.component == 1)
    empty = whitening.whiten(table(spark, [(1, None), (2, [])]), ["vec_id"])
    assert empty.count() == 0 and empty.columns == flat[0].__fields__


def test_query_over_the_embeddings(spark):
    sf_dir = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in read(spark, sf_dir, "embeddings").collect()]
    check(vectors, [r.asDict() for r in QUERIES["op12_embedding_whitening"](spark, sf_dir).collect()], 64, 32)
