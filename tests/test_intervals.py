"""Sweeps against all pairs."""

import random

from tracewell.operators import intervals as I


def test_sweeps_against_all_pairs(spark):
    random.seed(9)
    spans = [(f, i, s, s + random.choice([-1, 0, 0, 3, 40, 400])) for i in range(300) for f in [random.choice("aabc")] for s in [random.randint(0, 900)]]
    spans += [("z", 900, 1, 5), ("a", 901, None, 5), ("a", 902, 5, None)]
    points = [(random.choice("aabcy"), random.randint(0, 1000), n) for n in range(400)] + [("a", None, 999)]
    s = spark.createDataFrame(spans, "f string, i int, lo long, hi long").repartition(3)
    p = spark.createDataFrame(points, "f string, at long, n int").repartition(4)
    want = sorted((f, i, at, n) for f, i, lo, hi in spans if None not in (lo, hi) for g, at, n in points if f == g and at is not None and lo <= at <= hi)
    got = I.points_inside(s, p, ["f"], ["i"], "lo", "hi", "at", ["at", "n"])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 2000
    held = {(f, i): sorted((at, n) for g, j, at, n in want if (g, j) == (f, i)) for f, i, lo, hi in spans if None not in (lo, hi) and lo <= hi}
    summary = I.first_and_last(s, p.filter("at is not null"), ["f"], ["i"], "lo", "hi", "at", "n").collect()
    assert {(r.f, r.i): (r["first"], r["last"], r.points) for r in summary} == {k: (v[0][1], v[-1][1], len(v)) if v else (None, None, 0) for k, v in held.items()}


def test_no_more_pairs_than_there_are(spark):
    """A thousand units in a thousand packets of one time: a thousand rows, not a million."""
    units = spark.range(1000).selectExpr("1 as f", "id as i", "id as lo", "id as hi")
    packets = spark.range(1000).selectExpr("1 as f", "id as at")
    assert I.points_inside(units, packets, ["f"], ["i"], "lo", "hi", "at", ["at"]).filter("i = at").count() == 1000
