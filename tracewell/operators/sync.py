"""Events in picture and sound, their pairing, and the alignment of two recordings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refractory(rows: DataFrame, flow: list[str], at: str, least: int) -> DataFrame:
    """The rows of each flow that are at least ``least`` after the last one kept; one fold over a flow in order."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keep = []
            for *this, now in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in [*flow, at]]):
                if this != key:
                    key, last = this, None
                keep.append(last is None or now - last >= least)
                last = now if keep[-1] else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(*flow).sortWithinPartitions(*flow, at).mapInArrow(run, fields)


def rising(rows: DataFrame, flow: list[str], at: str, level: str, rise: Column, least: float, wait: int) -> DataFrame:
    """Events where a level reaches ``least`` and ``rise`` holds (of level and before), ``wait`` apart: flow, at, level, before."""
    w = Window.partitionBy(*flow).orderBy(at)
    found = rows.withColumn("before", F.lag(level).over(w)).filter((F.col(level) >= least) & rise)
    return refractory(found.select(*flow, at, level, "before"), flow, at, wait)


def flashes(frames: DataFrame, flow: list[str], at: str = "offset_ms", luma: str = "luma") -> DataFrame:
    """Frames at least 40 brighter than the one before and 120 bright, 200 ms apart, with their strength in thousandths."""
    found = rising(frames, flow, at, luma, F.col(luma) - F.col("before") >= 40, 120, 200)
    return found.withColumn("strength_milli", F.floor((F.col(luma) - F.col("before")) * 1000 / 255))


def beeps(levels: DataFrame, flow: list[str], at: str = "offset_ms", rms: str = "rms") -> DataFrame:
    """10 ms windows at least 4,000 loud and three times as loud as the one before (taken as 200 at least), 200 ms apart."""
    found = rising(levels, flow, at, rms, F.col(rms) >= 3 * F.greatest("before", F.lit(200)), 4000, 200)
    return found.withColumn("strength_milli", F.least(F.greatest(F.round(F.col(rms) / 32.768), F.lit(0)), F.lit(1000)).cast("bigint"))


def sync_summary(pairs: DataFrame, flow: list[str], at: str = "a_at", offset: str = "offset_ms") -> DataFrame:
    """Per flow: pairs, upper median of the offsets, their drift from the first pair to the last, and how sure that is in per cent."""
    n = F.count(F.lit(1))
    sorted_offsets = F.sort_array(F.collect_list(offset))
    spread = F.max(offset) - F.min(offset)
    moved = F.when(F.max(at) != F.min(at), F.max_by(offset, at) - F.min_by(offset, at))
    sure = F.when(n == 1, 45).when(n == 2, 75).when(spread <= 80, 95).otherwise(80)
    return pairs.groupBy(*flow).agg(
        n.alias("pairs"), F.get(sorted_offsets, F.floor(n / 2).cast("int")).alias("median_ms"), moved.alias("drift_ms"), sure.alias("confidence")
    )


def alignment(source: DataFrame, reference: DataFrame, key: list[str], rate: int, reach: int = 60) -> DataFrame:
    """The shift between two series of small pictures (key, idx, luma) with the least mean difference.

    Only shifts of ``reach`` frames at most count under which a third of the
    shorter series, four frames at least, overlap. Columns: key, shift,
    offset_ms, error_milli, zero_error_milli.
    """
    sizes = lambda df, n: df.groupBy(*key).agg((F.max("idx") + 1).alias(n), F.first(F.size("luma")).alias("cells_" + n))
    shorter = sizes(source, "a").join(sizes(reference, "b"), key).withColumn("least", F.greatest(F.floor(F.least("a", "b") / 3), F.lit(4)))
    shorter = shorter.filter(F.least("a", "b") >= 4).select(*key, "least", F.col("cells_a").alias("cells"), F.least(F.lit(reach), F.least("a", "b") - F.col("least")).alias("most"))
    moved = source.join(shorter, key).withColumn("shift", F.explode(F.sequence(-F.col("most"), F.col("most"))))
    moved = moved.withColumn("other", F.col("idx") + F.col("shift"))
    theirs = reference.select(*key, F.col("idx").alias("other"), F.col("luma").alias("luma_b"))
    apart = F.aggregate(F.zip_with("luma", "luma_b", lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    scores = (
        moved.join(theirs, [*key, "other"])
        .groupBy(*key, "shift", "least", "cells")
        .agg(F.sum(apart).alias("total"), F.count(F.lit(1)).alias("n"))
        .filter("n >= least")
        .withColumn("error", F.col("total") / (F.col("n") * F.col("cells")) / 255)
    )
    return scores.groupBy(*key).agg(
        F.min_by("shift", F.struct("error", "shift")).alias("shift"),
        F.floor(F.min_by("shift", F.struct("error", "shift")) * 1000 / rate).alias("offset_ms"),
        F.round(F.min("error") * 1000).cast("bigint").alias("error_milli"),
        F.round(F.max(F.when(F.col("shift") == 0, F.col("error"))) * 1000).cast("bigint").alias("zero_error_milli"),
    )


def run_boundaries(rows: DataFrame, flow: list[str], index: str) -> DataFrame:
    """The first and last row of each run of consecutive indices."""
    w = Window.partitionBy(*flow).orderBy(index)
    first = F.coalesce(F.lag(index).over(w) != F.col(index) - 1, F.lit(True))
    last = F.coalesce(F.lead(index).over(w) != F.col(index) + 1, F.lit(True))
    return rows.select("*", first.alias("begins"), last.alias("ends")).filter("begins or ends")


def neighbours(rows: DataFrame, index: str, chosen: int, reach: int = 20) -> DataFrame:
    """The page around a chosen row."""
    return rows.filter(F.col(index).between(chosen - reach, chosen + reach))


def loudness_summary(lines: DataFrame, key: list[str], order: str, line: str) -> DataFrame:
    """Integrated loudness, range and true peak in thousandths from the last summary of a loudness log."""
    from tracewell.functions.text import marker_value

    w = Window.partitionBy(*key).orderBy(order)
    text = F.trim(F.col(line))
    rows = lines.withColumn("_t", text).withColumn("_start", F.max(F.when(F.col(line).contains("Summary:"), F.col(order))).over(Window.partitionBy(*key)))
    rows = rows.filter(F.col(order) > F.col("_start"))
    title = F.when(F.col("_t").isin("Integrated loudness:", "Loudness range:", "True peak:"), F.col("_t"))
    rows = rows.withColumn("_section", F.last(title, True).over(w))
    value = lambda section, marker: F.max_by(
        F.round(marker_value(F.col("_t"), marker) * 1000).cast("bigint"), F.when((F.col("_section") == section) & F.col("_t").startswith(marker), F.col(order))
    )
    return rows.groupBy(*key).agg(
        value("Integrated loudness:", "I:").alias("integrated_milli"), value("Loudness range:", "LRA:").alias("range_milli"),
        value("True peak:", "Peak:").alias("peak_milli"),
    )


def loudness_series(lines: DataFrame, key: list[str], order: str, line: str, points: int = 6000) -> DataFrame:
    """Momentary, short-term and integrated loudness over time; what a log writes for silence is null; at most ``points`` rows."""
    from tracewell.functions.text import marker_value
    from tracewell.operators.sequence import every_nth

    c = F.col(line)
    value = lambda marker, silent: F.when(marker_value(c, marker) > silent + 0.05, F.round(marker_value(c, marker) * 1000).cast("bigint"))
    rows = lines.filter(c.contains("] t:") & c.contains(" M:") & c.contains(" S:")).filter(marker_value(c, "t:").isNotNull())
    rows = rows.select(
        *key, order, F.greatest(F.round(marker_value(c, "t:") * 1000), F.lit(0)).cast("bigint").alias("offset_ms"), value("M:", -120.0).alias("momentary_milli"),
        value("S:", -120.0).alias("short_term_milli"), value("I:", -70.0).alias("integrated_milli"),
    )
    return every_nth(rows, key, [order], points)


def last_metric(lines: DataFrame, key: list[str], order: str, line: str, marker: str) -> DataFrame:
    """The number after ``marker`` (joined to it or the next word) in the last line that has it."""
    import re

    token = F.regexp_extract(F.col(line), r"(?:^|\s)" + re.escape(marker) + r"\s*([^\s,;]+)", 1)
    rows = lines.withColumn("_token", token).filter("_token != ''")
    return rows.groupBy(*key).agg(F.max_by(F.col("_token").try_cast("double"), order).alias("value"))


def last_progress(lines: DataFrame, key: list[str], order: str, line: str) -> DataFrame:
    """frames and duration_ms of the last progress report."""
    of = lambda name: F.when(F.col(line).startswith(name + "="), F.trim(F.substring_index(line, "=", -1)).try_cast("bigint"))
    rows = lines.withColumn("_frame", of("frame")).withColumn("_us", of("out_time_us"))
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return rows.groupBy(*key).agg(pick("_frame").alias("frames"), F.floor(pick("_us") / 1000).alias("duration_ms"))
