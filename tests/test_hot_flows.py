"""Scans in two levels against those that take a flow as one task."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import hot_flows as H
from tracewell.operators import sequence as S


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the rows are one flow; numbers wrap, repeat, get lost and come late."""
    random.seed(6)
    out, at = [], {}
    for n in range(6000):
        flow = 0 if n % 2 else random.randint(1, 30)
        at[flow] = at.get(flow, random.randint(0, 255)) + random.choice([1, 1, 1, 1, 2, 3, 0, -2, -5])
        out.append((flow, n, at[flow] % 256, at[flow], n * 10 + random.randint(-40, 40), random.randint(0, 60), n * 10))
    return spark.createDataFrame(out, "flow long, n long, seq long, ext long, us long, size long, at long").repartition(5)


def listed(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("width", [100, 777, 1 << 20])
def test_equal_to_one_task_per_flow(rows, width):
    assert listed(H.unwrap(rows, ["flow"], "n", "seq", 256, width=width)) == listed(S.unwrap(rows, ["flow"], ["n"], "seq", 256))
    assert listed(H.sequence_statistics(rows, ["flow"], "n", "ext", width)) == listed(S.sequence_statistics(rows, ["flow"], ["n"], "ext"))
    before = S._window(["flow"], ["n"]).rowsBetween(S.Window.unboundedPreceding, -1)
    high = rows.withColumn("high", F.max("ext").over(before))
    ahead = F.col("high").isNull() | (F.col("ext") > F.col("high"))
    assert listed(H.rollbacks(rows, ["flow"], "n", "ext", "us", width=width)) == listed(S.rollbacks(high, ["flow"], ["n"], ahead, "us"))
    for rate, capacity in ((2, 500), (3, 90), (4, 100_000)):
        assert listed(H.leaky_bucket(rows, ["flow"], "n", "at", "size", rate, capacity, width)) == listed(S.leaky_bucket(rows, ["flow"], ["n"], "at", "size", rate, capacity))


def test_a_hot_flow_is_dealt_out(rows):
    dealt, key = H.in_pieces(rows, ["flow"], "n", 50)
    sizes = [r["count"] for r in dealt.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    assert dealt.filter("flow = 0").groupBy(*key).count().agg(F.max("count")).first()[0] == 25
