"""Joins in time inside a flow, written as one sort per flow instead of pairs of rows."""

from __future__ import annotations

import bisect
import collections
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def last_before(rows: DataFrame, flow: Keys, order: Keys, where: Column, value: str) -> Column:
    """The value of the latest earlier row of the flow where ``where`` holds."""
    w = Window.partitionBy(*flow).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(where, F.col(value)), True).over(w)


def next_after(rows: DataFrame, flow: Keys, order: Keys, where: Column, value: str) -> Column:
    """The value of the first later row of the flow where ``where`` holds."""
    # Spark looks ahead by reading all later rows again for each row; looking back reads each once.
    w = Window.partitionBy(*flow).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(where, F.col(value)), True).over(w)


def nearest(rows: DataFrame, flow: Keys, order: Keys, at: str, where: Column, value: str) -> DataFrame:
    """For each row, the value of the nearest other row where ``where`` holds; the earlier one on a tie."""
    both = rows.withColumns(
        {
            "_b": last_before(rows, flow, order, where, value),
            "_bt": last_before(rows, flow, order, where, at),
            "_a": next_after(rows, flow, order, where, value),
            "_at": next_after(rows, flow, order, where, at),
        }
    )
    use_before = F.col("_bt").isNotNull() & (
        F.col("_at").isNull() | (F.col(at) - F.col("_bt") <= F.col("_at") - F.col(at))
    )
    return both.withColumn("nearest", F.when(use_before, F.col("_b")).otherwise(F.col("_a"))).withColumn(
        "distance", F.when(use_before, F.col(at) - F.col("_bt")).otherwise(F.col("_at") - F.col(at))
    ).drop("_b", "_bt", "_a", "_at")


def mutual_nearest(rows: DataFrame, flow: Keys, order: Keys, at: str, kind: str, one: str, two: str, key: str, within: int) -> DataFrame:
    """Pairs of a ``one`` and a ``two`` row that are each other's nearest, at most ``within`` apart."""
    some = rows.filter(F.col(kind).isin(one, two))
    # The nearest row of the other kind, seen from both kinds.
    to_two = nearest(some, flow, order, at, F.col(kind) == two, key)
    to_one = nearest(some, flow, order, at, F.col(kind) == one, key)
    a = to_two.filter(F.col(kind) == one).select(*flow, F.col(key).alias("a"), F.col("nearest").alias("b"), "distance")
    b = to_one.filter(F.col(kind) == two).select(*flow, F.col(key).alias("b"), F.col("nearest").alias("a"))
    return a.filter(F.col("distance") <= within).join(b, [*flow, "a", "b"]).select(*flow, "a", "b", "distance")


def greedy_pairs(rows: DataFrame, flow: Keys, at: str, kind: str, one: str, two: str, key: str, within: int) -> DataFrame:
    """Each ``one`` row in order takes the nearest free ``two`` row of its flow, at most ``within`` away.

    Of two equally near rows the earlier is taken; a row taken is gone for
    those that follow. One fold over a flow's rows in order: a row waits until
    all that are near it have come, so the state is what lies within reach.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = ", ".join([f"`{c}` {kinds[c]}" for c in flow] + [f"a {kinds[key]}", f"b {kinds[key]}", f"distance {kinds[at]}"])

    def nearest_free(free: list[tuple], t: int) -> int | None:
        """The place of the free row nearest to t, the first of equal ones."""
        right = bisect.bisect_left(free, (t,))
        left = bisect.bisect_left(free, (free[right - 1][0],)) if right else None
        near = [i for i in (left, right) if i is not None and i < len(free) and abs(free[i][0] - t) <= within]
        return min(near, key=lambda i: (abs(free[i][0] - t), i), default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, free, waiting, out = None, [], collections.deque(), []

        def settle(now: int | None) -> None:
            while waiting and (now is None or waiting[0][0] + within < now):
                t, name = waiting.popleft()
                del free[: bisect.bisect_left(free, (t - within,))]
                if (i := nearest_free(free, t)) is not None:
                    u, other = free.pop(i)
                    out.append((*this, name, other, abs(u - t)))

        schema = None
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            if schema is None:
                types = [*[column(c).type for c in flow], column(key).type, column(key).type, column(at).type]
                schema = pa.schema(list(zip([*flow, "a", "b", "distance"], types)))
            for *who, t, what, name in zip(*[column(n).to_pylist() for n in [*flow, at, kind, key]]):
                if who != this:
                    settle(None)
                    this, free = who, []
                settle(t)
                if what == one:
                    waiting.append((t, name))
                else:
                    free.append((t, name))
                    if not waiting:
                        del free[: bisect.bisect_left(free, (t - within,))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        settle(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    some = rows.filter(F.col(kind).isin(one, two)).select(*flow, at, kind, key)
    return some.repartition(*flow).sortWithinPartitions(*flow, at, key).mapInArrow(run, fields)
