"""Sequence analytics for flows that are too long for one task: a scan in two levels.

A flow is cut into pieces of its arrival order. Each piece is looked at by
itself and leaves one small summary (sum of steps, last value, highest number);
a window over the summaries of a flow, a few per million rows, says in which
state each piece begins. Results equal those of ``sequence``, which takes a flow
as one task and one shuffle less.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import signed_wrap

Keys = list[str]
#: Values of the arrival number in a piece.
WIDTH = 1 << 20
_PIECE = "_piece"


def in_pieces(rows: DataFrame, flow: Keys, order: str, width: int) -> tuple[DataFrame, Keys]:
    """Rows dealt by flow and piece, and that key."""
    key = [*flow, _PIECE]
    return rows.withColumn(_PIECE, F.floor(F.col(order) / width)).repartition(*key), key


def _inside(key: Keys, order: str) -> Window:
    return Window.partitionBy(*key).orderBy(order)


def begun_with(rows: DataFrame, flow: Keys, key: Keys, summary: DataFrame, state: dict[str, Column]) -> DataFrame:
    """Rows with the ``state`` in which their piece begins; it is made by windows over the summaries in order."""
    starts = summary.select(*key, *[c.alias(n) for n, c in state.items()])
    return rows.join(starts, key)


def _of_pieces(flow: Keys) -> Window:
    return Window.partitionBy(*flow).orderBy(_PIECE)


def _earlier(flow: Keys) -> Window:
    return _of_pieces(flow).rowsBetween(Window.unboundedPreceding, -1)


def unwrap(rows: DataFrame, flow: Keys, order: str, seq: str, modulus: int, name: str = "ext", width: int = WIDTH) -> DataFrame:
    """``sequence.unwrap`` in two levels; ``order`` is a number without ties."""
    dealt, key = in_pieces(rows, flow, order, width)
    w = _inside(key, order)
    step = F.coalesce(signed_wrap(F.col(seq) - F.lag(seq).over(w), modulus), F.lit(0)).cast("bigint")
    walked = dealt.withColumn("_step", step).withColumn("_inner", F.sum("_step").over(w)).drop("_step")
    summary = walked.groupBy(*key).agg(
        F.min_by(seq, order).alias("_first"), F.max_by(seq, order).alias("_last"), F.max_by("_inner", order).alias("_total")
    )
    pieces = _of_pieces(flow)
    jump = F.coalesce(signed_wrap(F.col("_first") - F.lag("_last").over(pieces), modulus), F.col("_first")) + F.coalesce(F.lag("_total").over(pieces), F.lit(0))
    summary = summary.withColumn("_jump", jump.cast("bigint"))
    placed = begun_with(walked, flow, key, summary, {"_base": F.sum("_jump").over(pieces)})
    return placed.withColumn(name, (F.col("_base") + F.col("_inner")).cast("bigint")).drop("_base", "_inner", _PIECE)


def _with_high(rows: DataFrame, flow: Keys, key: Keys, order: str, seq: str) -> DataFrame:
    """Rows with the highest number before them in their flow as ``_before``, null for the first one."""
    summary = rows.groupBy(*key).agg(F.max(seq).alias("_top"))
    begun = begun_with(rows, flow, key, summary, {"_high": F.max("_top").over(_earlier(flow))})
    inner = F.max(seq).over(_inside(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return begun.withColumn("_before", F.greatest("_high", inner)).drop("_high")


def sequence_statistics(rows: DataFrame, flow: Keys, order: str, seq: str, width: int = WIDTH) -> DataFrame:
    """``sequence.sequence_statistics`` in two levels; copies are found by number, which deals a flow out as well."""
    copies = rows.groupBy(*flow, seq).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("_n"))
    dealt, key = in_pieces(copies, flow, order, width)
    marked = _with_high(dealt, flow, key, order, seq)
    ahead = F.col("_before").isNull() | (F.col(seq) > F.col("_before"))
    # The number that came first is only known per flow; those below it are counted by the pieces.
    firsts = copies.groupBy(*flow).agg(F.min_by(seq, order).alias("_first"))
    each = marked.join(firsts, flow).groupBy(*flow).agg(
        F.sum("_n").alias("packets"),
        F.count(F.lit(1)).alias("uniques"),
        (F.max(seq) - F.min("_first") + 1 - F.count_if(F.col(seq) >= F.col("_first"))).alias("lost"),
        F.coalesce(F.max(F.when(ahead, F.col(seq) - F.col("_before") - 1)), F.lit(0)).alias("max_gap"),
        F.count_if(~ahead).alias("out_of_order"),
    )
    return each.select(*flow, "packets", "uniques", (F.col("packets") - F.col("uniques")).alias("duplicates"), "lost", "max_gap", "out_of_order")


def rollbacks(rows: DataFrame, flow: Keys, order: str, seq: str, at: str, modulus: int | None = None, width: int = WIDTH) -> DataFrame:
    """How often a row that advances its flow's highest number has a clock behind that of the last one that did."""
    dealt, key = in_pieces(rows, flow, order, width)
    marked = _with_high(dealt, flow, key, order, seq)
    ahead = F.col("_before").isNull() | (F.col(seq) > F.col("_before"))
    marked = marked.filter(ahead)
    summary = marked.groupBy(*key).agg(F.max_by(at, order).alias("_end"))
    begun = begun_with(marked, flow, key, summary, {"_last": F.last("_end").over(_earlier(flow))})
    before = F.coalesce(F.lag(at).over(_inside(key, order)), F.col("_last"))
    step = F.col(at) - before
    behind = (signed_wrap(step, modulus) if modulus else step) < 0
    return begun.withColumn("_behind", behind).groupBy(*flow).agg(F.count_if("_behind").alias("rollbacks"))


def _walked(rows: DataFrame, key: Keys, order: str, at: str, size: str, rate: int, capacity: int, levels: list[str]) -> DataFrame:
    """One row per piece: first_at, last_at, shift, and for each column of ``levels``, the level that a piece begins with: full, underflows, lowest."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*key, "first_at", "last_at", "shift", *[f"{n}_{level}" for level in levels for n in ("full", "underflows", "lowest")]]
    fields = ", ".join([f"`{c}` {kinds[c]}" for c in key] + [f"`{n}` bigint" for n in names[len(key) :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, state, types = None, None, None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

        def closed() -> tuple:
            first, last, shift, walks = state
            return (*this, first, last, shift, *[x for walk in walks for x in walk])

        for rows_of in batches:
            column = lambda n: rows_of.column(rows_of.schema.get_field_index(n))  # noqa: E731, B023
            types = types or [*[column(c).type for c in key], *[pa.int64()] * (len(names) - len(key))]
            done = []
            for who, now, taken, begin in zip(zip(*[column(c).to_pylist() for c in key]), column(at).to_pylist(), column(size).to_pylist(), zip(*[column(c).to_pylist() for c in levels])):
                if who != this:
                    if this is not None:
                        done.append(closed())
                    this, state = who, (now, now, 0, [[level, 0, capacity] for level in begin])
                first, last, shift, walks = state
                filled = (now - last) * rate
                for walk in walks:
                    full = min(capacity, walk[0] + filled) - taken
                    walk[1] += full < 0
                    walk[0] = max(full, 0)
                    walk[2] = min(walk[2], walk[0])
                state = (first, now, shift + filled - taken, walks)
            if done:
                yield batch(done)
        if this is not None:
            yield batch([closed()])

    wanted = rows.select(*key, order, at, size, *levels)
    return wanted.sortWithinPartitions(*key, order).mapInArrow(run, fields)


def leaky_bucket(rows: DataFrame, flow: Keys, order: str, at: str, size: str, rate: int, capacity: int, width: int = WIDTH) -> DataFrame:
    """``sequence.leaky_bucket`` in two levels.

    What a piece does to any level is to move it by its shift and to hold it
    between the levels at which an empty and a full bucket end up. So a piece is
    walked from both for its summary, and then once from the level it begins with.
    """
    dealt, key = in_pieces(rows, flow, order, width)
    ends = dealt.withColumn("empty", F.lit(0).cast("bigint")).withColumn("brim", F.lit(capacity).cast("bigint"))
    summary = _walked(ends, key, order, at, size, rate, capacity, ["empty", "brim"])
    parts = F.array_sort(F.collect_list(F.struct(_PIECE, "first_at", "last_at", "shift", F.col("full_empty").alias("least"), F.col("full_brim").alias("most"))))

    def through(state: Column, p: Column) -> Column:
        """The level behind a piece, by way of the time before it; the level at its beginning is kept."""
        gap = F.coalesce(p["first_at"] - state["last_at"], F.lit(0))
        begin = F.least(state["level"] + gap * rate, F.lit(capacity).cast("bigint"))
        level = F.least(F.greatest(begin + p["shift"], p["least"]), p["most"])
        return F.struct(level.alias("level"), p["last_at"].alias("last_at"), F.concat(state["begins"], F.array(F.struct(p[_PIECE].alias(_PIECE), begin.alias("level")))).alias("begins"))

    none = F.array().cast(f"array<struct<{_PIECE}:bigint,level:bigint>>")
    zero = F.struct(F.lit(capacity).cast("bigint").alias("level"), F.lit(None).cast("bigint").alias("last_at"), none.alias("begins"))
    begins = summary.groupBy(*flow).agg(parts.alias("_parts")).select(*flow, F.inline(F.aggregate("_parts", zero, through, lambda state: state["begins"])))
    done = _walked(dealt.join(begins, key), key, order, at, size, rate, capacity, ["level"])
    return done.groupBy(*flow).agg(
        F.max_by("full_level", _PIECE).alias("full"), F.sum("underflows_level").alias("underflows"), F.min("lowest_level").alias("lowest")
    )
