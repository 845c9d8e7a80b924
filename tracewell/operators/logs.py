"""Decoder logs: known problems, how often they occur, and the frames near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a problem's line contains, and its kind.
PATTERNS = [
    ("non-existing pps referenced", "missing_pps"),
    ("decode_slice_header error", "slice_header_error"),
    ("no frame", "no_frame"),
    ("concealing", "concealment"),
    ("cbp too large", "invalid_cbp"),
    ("error while decoding mb", "macroblock_error"),
    ("reference picture missing", "missing_reference"),
    ("corrupt decoded frame", "corrupt_frame"),
    ("invalid nal unit", "invalid_nal_unit"),
    ("rtp: missed", "rtp_missed_packets"),
    ("black_start:", "black_segment"),
    ("freeze_start:", "freeze_segment"),
    ("could not find ref with poc", "missing_reference"),
    ("missing reference picture", "missing_reference"),
    ("the first slice in a frame is missing", "slice_header_error"),
    ("cabac decode of qscale diff failed", "macroblock_error"),
    ("error parsing nal unit", "invalid_nal_unit"),
    ("invalid short term rps", "invalid_nal_unit"),
    ("skipping invalid undecodable nalu", "invalid_nal_unit"),
    ("cabac_max_bin", "bitstream_syntax_error"),
    ("outside the valid range", "bitstream_syntax_error"),
]
SHOWN_FRAMES = 256


def field(line: Column, name: str) -> Column:
    """The word after ``name`` in a log line, with or without blanks between; null without it."""
    value = F.regexp_extract(line, r"(?:^|\s)" + name + r"\s*(\S+)", 1)
    return F.when(value != "", value)


def kinds_of(line: Column) -> Column:
    """The kinds of the patterns that a line contains, one for each pattern."""
    low = F.lower(line)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(k)) for p, k in PATTERNS]))


def decode_issues(lines: DataFrame, key: list[str], order: str, line: str) -> DataFrame:
    """Problem lines of logs with the frame line nearest to them (the earlier of two).

    Columns: key, order, kind, example (the line), frame (from 1), time and
    precision. Lines are joined to frames by two windows, not by pairs.
    """
    shown = F.when(F.col(line).contains("showinfo"), field(F.col(line), "n:").try_cast("bigint") + 1)
    place = F.when(shown.isNotNull(), F.struct(F.col(order).alias("at"), shown.alias("frame"), field(F.col(line), "pts_time:").alias("time")))
    w = Window.partitionBy(*key).orderBy(order)
    back = Window.partitionBy(*key).orderBy(F.desc(order))
    rows = lines.withColumn("_f", place)
    rows = rows.withColumns(
        {
            "_before": F.last("_f", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.last("_f", True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    later = F.col("_before").isNull() | (F.col("_after.at") - F.col(order) < F.col(order) - F.col("_before.at"))
    near = F.when(later & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before"))
    found = rows.withColumn("_near", near).withColumn("kind", F.explode(kinds_of(F.col(line))))
    filtered = F.when(F.col("kind") == "black_segment", field(F.col(line), ".*black_start:")).when(
        F.col("kind") == "freeze_segment", field(F.col(line), ".*freeze_start:")
    )
    return found.select(
        *key, order, "kind", F.trim(line).alias("example"), F.col("_near.frame").alias("frame"), F.coalesce(filtered, F.col("_near.time")).alias("time"),
        F.when(filtered.isNotNull(), "filter_timestamp_nearest_frame").when(F.col("_near").isNotNull(), "candidate_nearest_log_frame").alias("precision"),
    )


def issue_summary(issues: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per kind: how often it occurs (n), its first line (example), the first 256 distinct frames near it, and whether there are more (more_frames)."""
    # One dealing by key and three groupings on it: kinds and frames of many logs would be a join's large side on both sides.
    at = F.min(order).alias("_at")
    frames = issues.groupBy(*key, "kind", "frame").agg(at, F.min_by("example", order).alias("example"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key, "kind").orderBy(F.col("frame").isNull(), "_at", "frame")
    ranked = frames.withColumn("_rank", F.when(F.col("frame").isNotNull(), F.row_number().over(w)))
    shown = F.when(F.col("_rank") <= SHOWN_FRAMES, F.struct("_rank", "frame"))
    listed = F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["frame"])
    return ranked.groupBy(*key, "kind").agg(
        F.sum("n").alias("n"), F.min_by("example", "_at").alias("example"), F.when(F.count("_rank") > 0, listed).alias("frames"),
        F.coalesce(F.max("_rank") > SHOWN_FRAMES, F.lit(False)).alias("more_frames"),
    )


def mentions(issues: Column, needles: list[str]) -> Column:
    """Whether an issue (kind, example) of an array contains one of some words."""
    has = lambda i: F.lower(F.concat_ws(" ", i["kind"], i["example"])).rlike("|".join(n.lower() for n in needles))
    return F.exists(issues, has)


def evidence_of(issues: Column, needles: list[str]) -> Column:
    """The issues that contain one of some words, as ``kind x count: example``."""
    has = lambda i: F.lower(F.concat_ws(" ", i["kind"], i["example"])).rlike("|".join(n.lower() for n in needles))
    return F.transform(F.filter(issues, has), lambda i: F.concat(i["kind"], F.lit(" x "), i["n"], F.lit(": "), i["example"]))
