"""Intervals and points of a flow by one sweep over both, instead of a join of all pairs that is filtered."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]
_BEGIN, _POINT, _END = 0, 1, 2


def points_inside(intervals: DataFrame, points: DataFrame, flow: Keys, interval: Keys, start: str, end: str, at: str, point: Keys) -> DataFrame:
    """One row per interval and point of its flow from ``start`` to ``end``, both included: flow, ``interval`` and ``point`` columns.

    Both sides are sorted once; the state is the intervals that are open, by
    their ends. Only pairs that hold are made. Intervals whose end is before
    their start hold none, as do null bounds.
    """
    place = [F.col(at).cast("bigint").alias("_at")]
    ids = F.struct(*interval).alias("_interval")
    begins = intervals.filter(F.col(start) <= F.col(end)).select(
        *flow, F.col(start).cast("bigint").alias("_at"), F.lit(_BEGIN).alias("_kind"), F.col(end).cast("bigint").alias("_end"), ids
    )
    rows = begins.unionByName(points.filter(F.col(at).isNotNull()).select(*flow, *place, F.lit(_POINT).alias("_kind"), F.struct(*point).alias("_point")), allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*flow, "_interval", "_point"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, opened = None, []  # (end, a number that tells equal ends apart, the interval)
        count = 0
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            keys = zip(*[column(c).to_pylist() for c in flow])
            owners, found = [], []
            its = column("_interval")
            for i, (key, now, kind, until) in enumerate(zip(keys, column("_at").to_pylist(), column("_kind").to_pylist(), column("_end").to_pylist())):
                if key != this:
                    this, opened = key, []
                if kind == _BEGIN:
                    count += 1
                    heapq.heappush(opened, (until, count, its[i].as_py()))
                    continue
                while opened and opened[0][0] < now:
                    heapq.heappop(opened)
                owners += [i] * len(opened)
                found += [o[2] for o in opened]
            if owners:
                take = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays([*[column(c).take(take) for c in flow], pa.array(found, its.type), column("_point").take(take)], names=names)

    ordered = rows.repartition(*flow).sortWithinPartitions(*flow, "_at", "_kind")
    pairs = ordered.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return pairs.select(*flow, "_interval.*", "_point.*")


def first_and_last(intervals: DataFrame, points: DataFrame, flow: Keys, interval: Keys, start: str, end: str, at: str, value: str) -> DataFrame:
    """Each interval with the ``first`` and ``last`` value of the points inside it, by their time and value, and how many there are (``points``).

    The points before an interval's begin and up to its end are counted while
    both are sorted, so that not even the pairs that hold are made. Intervals
    without points have none and 0.
    """
    key = F.struct(*interval).alias("_interval")
    bound = lambda column, kind: intervals.filter(F.col(start) <= F.col(end)).select(*flow, F.col(column).alias("_at"), F.lit(kind).alias("_kind"), key)
    rows = points.select(*flow, F.col(at).alias("_at"), F.lit(_POINT).alias("_kind"), F.col(value).alias("_value"))
    rows = rows.unionByName(bound(start, _BEGIN).unionByName(bound(end, _END)), allowMissingColumns=True)
    w = Window.partitionBy(*flow).orderBy("_at", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*flow).orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("_kind") == _POINT, F.struct(F.col("_value").alias("v")))
    swept = rows.withColumns({"_seen": F.count(point).over(w), "_latest": F.last(point, True).over(w), "_next": F.last(point, True).over(back)})
    at_begin, at_end = F.col("_kind") == _BEGIN, F.col("_kind") == _END
    found = swept.filter(F.col("_kind") != _POINT).groupBy(*flow, "_interval").agg(
        (F.max(F.when(at_end, F.col("_seen"))) - F.max(F.when(at_begin, F.col("_seen")))).alias("points"),
        F.max(F.when(at_begin, F.col("_next"))).alias("_first"),
        F.max(F.when(at_end, F.col("_latest"))).alias("_last"),
    )
    some = F.col("points") > 0
    return found.select(*flow, "_interval.*", F.when(some, F.col("_first.v")).alias("first"), F.when(some, F.col("_last.v")).alias("last"), "points")
