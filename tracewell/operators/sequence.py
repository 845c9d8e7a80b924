"""Sequence analytics inside a flow: ``flow`` names its key columns, ``order`` its arrival order.

Each operator needs one shuffle on the flow key; windows of one flow share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import signed_wrap

Keys = list[str]


def _window(flow: Keys, order: Keys):
    return Window.partitionBy(*flow).orderBy(*order)


def tumbling_peak(rows: DataFrame, flow: Keys, at: str, size: str, width: int) -> DataFrame:
    """Count, total and peak of ``size`` over buckets of ``width`` aligned to each flow's first row."""
    first = Window.partitionBy(*flow)
    bucket = F.floor((F.col(at) - F.min(at).over(first)) / width)
    buckets = (
        rows.withColumn("bucket", bucket)
        .groupBy(*flow, "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    )
    return buckets.groupBy(*flow).agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("total"),
        F.max("s").alias("peak"),
        (F.max("hi") - F.min("lo")).alias("span"),
    )


def unwrap(rows: DataFrame, flow: Keys, order: Keys, seq: str, modulus: int, name: str = "ext") -> DataFrame:
    """Unfold a wrapping counter: a running sum of signed steps from the first value. ``order`` has no ties."""
    w = _window(flow, order)
    step = F.coalesce(signed_wrap(F.col(seq) - F.lag(seq).over(w), modulus), F.col(seq))
    return rows.withColumn("_step", step.cast("bigint")).withColumn(name, F.sum("_step").over(w)).drop("_step")


def first_copies(rows: DataFrame, key: Keys, order: Keys) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_rn", F.row_number().over(_window(key, order))).filter("_rn = 1").drop("_rn")


def sequence_statistics(rows: DataFrame, flow: Keys, order: Keys, seq: str) -> DataFrame:
    """packets, unique, duplicates, lost, max_gap and out_of_order of an unfolded sequence.

    lost counts the numbers missing between the first arrival's and the
    highest; max_gap is the longest run of numbers skipped at once. Rows are
    dealt by flow once; copies are then told apart and looked at in place.
    """
    w = _window(flow, order)
    dealt = rows.select(*flow, *order, *([seq] if seq not in order else [])).repartition(*flow)
    copies = dealt.withColumn("_copy", F.row_number().over(_window([*flow, seq], order)))
    unique = copies.withColumn("_u", F.when(F.col("_copy") == 1, F.col(seq)))
    before = F.max("_u").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = unique.withColumn("_before", before).withColumn("_first", F.first("_u", True).over(w))
    ahead = (F.col("_copy") == 1) & (F.col("_before").isNull() | (F.col(seq) > F.col("_before")))
    return marked.groupBy(*flow).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count("_u").alias("uniques"),
        (F.count(F.lit(1)) - F.count("_u")).alias("duplicates"),
        (F.max("_u") - F.min("_first") + 1 - F.count_if(F.col("_u") >= F.col("_first"))).alias("lost"),
        F.coalesce(F.max(F.when(ahead, F.col(seq) - F.col("_before") - 1)), F.lit(0)).alias("max_gap"),
        F.count_if((F.col("_copy") == 1) & ~ahead).alias("out_of_order"),
    )


def jitter(rows: DataFrame, flow: Keys, order: Keys, deviation: Column) -> DataFrame:
    """J += (|D| - J) / 16 over a flow's rows, as one weighted sum; D is null on the first row."""
    w = _window(flow, order)
    spaced = rows.withColumn("_d", F.abs(deviation)).withColumn("_rn", F.row_number().over(w))
    sized = spaced.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*flow)))
    weight = F.pow(F.lit(15 / 16), F.col("_n") - F.col("_rn")) / 16
    return sized.groupBy(*flow).agg(F.coalesce(F.sum(F.col("_d") * weight), F.lit(0.0)).alias("jitter"))


def rollbacks(rows: DataFrame, flow: Keys, order: Keys, ahead: Column, at: str, modulus: int | None = None) -> DataFrame:
    """How often an advancing row's clock is behind that of the last advancing one; clocks wrap at ``modulus``."""
    w = _window(flow, order)
    marked = rows.withColumn("_ahead", ahead)
    last = F.last(F.when(F.col("_ahead"), F.col(at)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.col(at) - F.col("_last")
    behind = (signed_wrap(step, modulus) if modulus else step) < 0
    return (
        marked.withColumn("_last", last)
        .groupBy(*flow)
        .agg(F.count_if(F.col("_ahead") & behind).alias("rollbacks"))
    )


def changes(rows: DataFrame, flow: Keys, order: Keys, value: str) -> DataFrame:
    w = _window(flow, order)
    return (
        rows.withColumn("_before", F.lag(value).over(w))
        .groupBy(*flow)
        .agg(F.count_if(F.col("_before").isNotNull() & (F.col(value) != F.col("_before"))).alias("changes"))
    )


def stages(rows: DataFrame, flow: Keys, order: Keys, at: str, gap: int) -> DataFrame:
    """Number the stages of a flow; a new one starts after more than ``gap`` without a row."""
    w = _window(flow, order)
    start = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return rows.withColumn("_start", F.coalesce(start, F.lit(0))).withColumn("stage", F.sum("_start").over(w)).drop("_start")


#: Sequence numbers from this far ahead to that far behind (modulo 2**16) count as a jump.
JUMP_FROM, JUMP_BELOW = 3_001, 65_436


def restarts(rows: DataFrame, flow: Keys, order: Keys, seq: str) -> DataFrame:
    """The stage (0, 1 and so on) of each row of a 16-bit sequence; null for rows left out.

    A jump that the next row confirms by the following number starts a stage;
    other rows that jump belong to none. One fold over a flow's rows in order,
    whose state is the highest number and the stage.
    """
    follower = F.lead(seq).over(_window(flow, order))
    ahead = rows.withColumn("_next", follower).repartition(*flow).sortWithinPartitions(*flow, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ahead.schema if f.name != "_next") + ", stage bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, highest, stage = None, 0, 0
        for batch in batches:
            out = []
            keys = zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in flow])
            numbers = batch.column(batch.schema.get_field_index(seq)).to_pylist()
            for this, number, after in zip(keys, numbers, batch.column(batch.schema.get_field_index("_next")).to_pylist()):
                if this != key:
                    key, highest, stage = this, number, 0
                step = (number - highest) % 65_536
                if JUMP_FROM <= step < JUMP_BELOW:
                    if after != (number + 1) % 65_536 or step + 1 >= JUMP_BELOW:
                        out.append(None)
                        continue
                    stage, highest = stage + 1, number
                elif step < 32_768:
                    highest = number
                out.append(stage)
            kept = [n for n in batch.schema.names if n != "_next"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(out, pa.int64())], names=[*kept, "stage"])

    return ahead.mapInArrow(run, fields)


def gaps(rows: DataFrame, flow: Keys, order: Keys, seq: str, first: int = 256) -> DataFrame:
    """The first ``first`` gaps of each flow in an unfolded sequence: the row after it, the first number missing, how many."""
    w = _window(flow, order)
    before = F.max(seq).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_before", before).withColumn("missing", F.col(seq) - F.col("_before") - 1)
    found = marked.filter((F.col("missing") >= 1) & (F.col("missing") < JUMP_FROM - 1))
    return (
        found.withColumn("gap", F.row_number().over(w))
        .filter(F.col("gap") <= first)
        .select(*flow, *order, "gap", (F.col("_before") + 1).alias("first_missing"), "missing")
    )


def runs(rows: DataFrame, flow: Keys, order: Keys, state: Column, index: str) -> DataFrame:
    """Maximal runs of rows where ``state`` holds: first, last and length; ``index`` numbers the flow's rows."""
    w = _window(flow, order)
    numbered = rows.withColumn("_rn", F.row_number().over(w)).filter(state)
    island = numbered.withColumn("_island", F.col("_rn") - F.row_number().over(w))
    return (
        island.groupBy(*flow, "_island")
        .agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("length"))
        .drop("_island")
    )


def heads(rows: DataFrame, flow: Keys, order: Keys, n: int) -> DataFrame:
    """The first ``n`` rows of each flow, and whether the flow has more."""
    w = _window(flow, order)
    numbered = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n + 1)
    more = (F.max("rn").over(Window.partitionBy(*flow)) > n).alias("truncated")
    return numbered.select("*", more).filter(F.col("rn") <= n)


def units(rows: DataFrame, flow: Keys, order: Keys, starts: Column) -> DataFrame:
    """Number the units of a flow; a row where ``starts`` holds begins the next."""
    return rows.withColumn("unit", F.sum(starts.cast("int")).over(_window(flow, order)))


def regressions(rows: DataFrame, flow: Keys, order: Keys, value: str) -> DataFrame:
    """How often a value is below the highest one before it."""
    before = _window(flow, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_high", F.max(value).over(before))
        .groupBy(*flow)
        .agg(F.count_if(F.col(value) < F.col("_high")).alias("regressions"))
    )


def leaky_bucket(rows: DataFrame, flow: Keys, order: Keys, at: str, size: str, rate: int, capacity: int) -> DataFrame:
    """Fullness of a bucket that fills at ``rate`` per unit of ``at`` and loses ``size`` at each row.

    The bucket starts full, never exceeds ``capacity``, and an underflow leaves
    it empty. Saturation makes the recurrence sequential: one fold over the
    sorted rows of each flow, whose state is the bucket.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in flow) + ", full bigint, underflows bigint, lowest bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, full, last, under, low, types = None, capacity, None, 0, capacity, None
        out: list[tuple] = []
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            types = types or [*[column(c).type for c in flow], pa.int64(), pa.int64(), pa.int64()]
            for *who, now, taken in zip(*[column(n).to_pylist() for n in [*flow, at, size]]):
                if who != this:
                    if this is not None:
                        out.append((*this, full, under, low))
                    this, full, last, under, low = who, capacity, now, 0, capacity
                full = min(capacity, full + (now - last) * rate) - taken
                under, full, last = under + (full < 0), max(full, 0), now
                low = min(low, full)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*flow, "full", "underflows", "lowest"])
                out = []
        if this is not None:
            out.append((*this, full, under, low))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*flow, "full", "underflows", "lowest"])

    return rows.select(*flow, *order, F.col(at), F.col(size)).repartition(*flow).sortWithinPartitions(*flow, *order).mapInArrow(run, fields)


def every_nth(rows: DataFrame, flow: Keys, order: Keys, points: int) -> DataFrame:
    """At most ``points`` rows of each flow, evenly spaced from the first."""
    w = _window(flow, order)
    counted = rows.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*flow))
    )
    return counted.filter((F.col("_rn") - 1) % F.ceil(F.col("_n") / points) == 0).drop("_rn", "_n")
