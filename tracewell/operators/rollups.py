"""Groupings that end in a state, a score or a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def status(rows: DataFrame, group: Keys, done: Column) -> DataFrame:
    """completed if all rows are, failed if none is, else partial."""
    return rows.groupBy(*group).agg(
        F.when(F.every(done), "completed").when(F.bool_or(done), "partial").otherwise("failed").alias("status"),
        F.count(F.lit(1)).alias("n"),
    )


def health(rows: DataFrame, group: Keys, weights: Column, full: int = 100) -> DataFrame:
    """``full`` less the weights of all rows, 0 at least."""
    return rows.groupBy(*group).agg(F.greatest(F.lit(0), full - F.sum(weights)).cast("bigint").alias("score"))


def ordered_distinct(rows: DataFrame, group: Keys, order: Keys, value: str, name: str) -> DataFrame:
    """The distinct values of each group, in the order of their first appearance, joined by commas."""
    firsts = rows.groupBy(*group, value).agg(F.min(F.struct(*order)).alias("_first"))
    return firsts.groupBy(*group).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda x: x[value]), ",").alias(name)
    )


def aliases(rows: DataFrame, key: str, order: str, group: Keys, prefix: str) -> DataFrame:
    """Numbered aliases in the order of first appearance inside each group."""
    firsts = rows.groupBy(*group, key).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_first", key))
    return firsts.select(*group, key, F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 4, "0")).alias("alias"))


def numbered(rows: DataFrame, at: Column, order: Keys, name: str, width: int = 65_536) -> DataFrame:
    """Rows numbered from 1 in the order of ``at`` (whole numbers, first in ``order``), without one task for all.

    Rows are counted by ranges of ``at``; only the counts are summed in one place.
    """
    ranged = rows.withColumn("_range", F.floor(at / width))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", inside).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def changed_fields(rows: DataFrame, key: Keys, order: Keys, fields: Keys) -> DataFrame:
    """Rows that differ from the one before with the same key, and which fields do."""
    w = Window.partitionBy(*key).orderBy(*order)
    differing = F.array_join(
        F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), F.lit(f)) for f in fields])), ","
    )
    first = F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("_first", first).withColumn("changed", differing).filter("not _first and changed != ''").drop("_first")


def reasons(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """The names of the tests that a row fails, and whether it fails none."""
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return rows.withColumn("reasons", F.array_join(failed, ",")).withColumn("sufficient", F.col("reasons") == "")


def history(rows: DataFrame, run: Keys, severity: str, kind: str, at: str, newest: int = 20) -> DataFrame:
    """The newest runs with their rows, findings that are critical or high, distinct kinds and last time (a list's first page)."""
    counted = rows.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(severity).isin("critical", "high")).alias("critical"),
        F.count_distinct(kind).alias("kinds"),
        F.max(at).alias("newest"),
    )
    return counted.orderBy(F.desc("newest")).limit(newest)
