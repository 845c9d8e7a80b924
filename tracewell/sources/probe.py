"""Frames that a media probe reports, as JSON whose scalars may be numbers, texts or truth values: read as VARIANT, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scalar(value: Column, name: str) -> Column:
    """A scalar field as text, however it is written; null where it is missing or null."""
    return F.try_variant_get(value, f"$.{name}", "string")


def whole(text: Column) -> Column:
    """A whole number that isn't negative; truth values are 1 and 0, anything else is null."""
    return F.when(text.rlike(r"^\+?\d+$"), text.try_cast("bigint")).when(text == "true", 1).when(text == "false", 0)


def flag(text: Column) -> Column:
    return F.when(text.isin("0", "false"), False).when(text.rlike(r"^-?\d+$") | (text == "true"), True)


def milliseconds(text: Column) -> Column:
    """Seconds as whole milliseconds, halves away from zero."""
    seconds = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(F.abs(seconds) < 9e15, F.round(seconds * 1000).cast("bigint"))


def probe_frames(documents: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row for each frame of probe documents, in the order of display.

    Columns: key, display_index (from 0), decode_index and how it is known
    (decode_precision: coded_picture_number; not_unique, where the number comes
    twice in a document or is beyond its frames; unavailable), pts_ms (the best
    effort time where there is no other), dts_ms, duration_ms, packet_position,
    packet_size, picture_type, key_frame, interlaced, top_field_first. Documents
    that can't be read, and those without frames, have no rows; ``key`` names
    one document.
    """
    document = F.try_parse_json(F.col(text))
    frames = F.try_variant_get(document, "$.frames", "array<variant>")
    rows = documents.select(*key, frames.alias("_frames")).select(*key, F.size("_frames").alias("_total"), F.posexplode("_frames").alias("display_index", "_f"))
    f = F.col("_f")
    seconds = lambda name: milliseconds(scalar(f, name))
    rows = rows.select(
        *key, "_total", F.col("display_index").cast("bigint").alias("display_index"), whole(scalar(f, "coded_picture_number")).alias("_reported"),
        F.when(scalar(f, "pts_time").isNotNull(), seconds("pts_time")).otherwise(seconds("best_effort_timestamp_time")).alias("pts_ms"),
        seconds("pkt_dts_time").alias("dts_ms"), F.when(seconds("pkt_duration_time") >= 0, seconds("pkt_duration_time")).alias("duration_ms"),
        whole(scalar(f, "pkt_pos")).alias("packet_position"), whole(scalar(f, "pkt_size")).alias("packet_size"), scalar(f, "pict_type").alias("picture_type"),
        F.coalesce(flag(scalar(f, "key_frame")), F.lit(False)).alias("key_frame"), flag(scalar(f, "interlaced_frame")).alias("interlaced"),
        flag(scalar(f, "top_field_first")).alias("top_field_first"),
    )
    alone = (F.count(F.lit(1)).over(Window.partitionBy(*key, "_reported")) == 1) & (F.col("_reported") < F.col("_total"))
    rows = rows.withColumn("decode_index", F.when(alone, F.col("_reported")))
    precision = F.when(F.col("_reported").isNull(), "unavailable").when(F.col("decode_index").isNull(), "not_unique").otherwise("coded_picture_number")
    rest = ["pts_ms", "dts_ms", "duration_ms", "packet_position", "packet_size", "picture_type", "key_frame", "interlaced", "top_field_first"]
    return rows.select(*key, "display_index", "decode_index", precision.alias("decode_precision"), *rest)


def probe_coverage(frames: DataFrame, key: list[str]) -> DataFrame:
    """Frames of each document, and the times that they cover; a negative start is none."""
    start = F.min("pts_ms")
    end = F.max(F.when(F.col("pts_ms") >= 0, F.col("pts_ms") + F.coalesce("duration_ms", F.lit(0))))
    return frames.groupBy(*key).agg(
        F.count(F.lit(1)).alias("frames"), F.when(start >= 0, start).alias("coverage_start_ms"), end.alias("coverage_end_ms"), F.count("decode_index").alias("decode_indices")
    )
