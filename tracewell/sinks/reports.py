"""Report tables, written by Spark's own writers, and reports read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import valid_stream_id
from tracewell.operators.rollups import numbered

#: The columns of the audio evidence table and of the block table.
AUDIO_COLUMNS = [
    "record_type", "kind", "start_ms", "end_ms", "duration_ms", "channel", "previous_packet", "current_packet", "last_packet", "previous_seq", "current_seq",
    "last_seq", "expected_rtp_timestamp", "actual_rtp_timestamp", "delta_timestamp", "previous_arrival_ms", "current_arrival_ms", "detail", "precision",
]
BLOCK_COLUMNS = [
    "record_type", "index", "x", "y", "width", "height", "qp_base", "qp_delta", "qp_value", "source_direction", "source_x", "source_y", "destination_x",
    "destination_y", "motion_x", "motion_y", "motion_scale", "flags", "block_level", "type_flags", "prediction_flags", "ref_index_l0", "ref_index_l1",
    "reference_poc_l0", "reference_poc_l1", "partition_mode", "sub_partition_modes", "prediction_mode", "tree_depth", "transform_flags",
]


def _shaped(rows: DataFrame, kind: str, columns: list[str], keep: list[str]) -> DataFrame:
    """The rows with all ``columns`` as text, empty where they lack one."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    return rows.select(*keep, *[(F.lit(kind) if c == "record_type" else text(c)).alias(c) for c in columns])


def audio_evidence(issues: DataFrame, intervals: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Timestamp issues and content intervals as one table of 19 text columns."""
    precise = issues.withColumn("precision", F.lit("rtp_timestamp+sequence_order"))
    lasting = intervals.withColumn("duration_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    return _shaped(precise, "timestamp_issue", AUDIO_COLUMNS, keep).unionByName(_shaped(lasting, "content_interval", AUDIO_COLUMNS, keep))


def block_evidence(quantisers: DataFrame, vectors: DataFrame, blocks: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Quantisers, motion vectors and coding blocks of a frame as one table of 30 text columns; lists are joined by ``;``."""
    lists = [f.name for f in blocks.schema if isinstance(f.dataType, T.ArrayType)]
    flat = blocks.withColumns({n: F.array_join(n, ";", "") for n in lists})
    out = _shaped(quantisers, "qp", BLOCK_COLUMNS, keep).unionByName(_shaped(vectors, "mv", BLOCK_COLUMNS, keep))
    return out.unionByName(_shaped(flat, "internal", BLOCK_COLUMNS, keep))


def write_evidence(rows: DataFrame, folder: str, mark: bool = False) -> None:
    """CSV with every field quoted, lines ended by CR LF, and a byte order mark before the header if asked for."""
    named = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]) if mark else rows
    named.write.mode("overwrite").option("header", True).option("quoteAll", True).option("emptyValue", "").option("lineSep", "\r\n").csv(folder)


def refused_ids(results: DataFrame, key: str = "stream_id") -> DataFrame:
    """Stream names that a report can't be written under: invalid ones and repeated ones, with the reason."""
    counted = results.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    reason = F.when(~F.coalesce(valid_stream_id(F.col(key)), F.lit(False)), "invalid").when(F.col("n") > 1, "repeated")
    return counted.withColumn("reason", reason).filter("reason is not null").select(key, "reason")


def write_reports(results: DataFrame, folder: str, key: str = "stream_id") -> None:
    """One folder of JSON per stream. Nothing is written if a name is invalid or occurs twice."""
    bad = refused_ids(results, key).limit(5).collect()  # a few examples for the message
    if bad:
        raise ValueError("streams can't be written: " + ", ".join(f"{r[key]!r} ({r.reason})" for r in bad))
    results.write.mode("errorifexists").partitionBy(key).json(folder)


def read_reports(spark: SparkSession, folder: str, schema: str, newest: int = 20) -> DataFrame:
    """The newest reports below a folder; what can't be read is left out."""
    rows = spark.read.schema(schema + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    found = rows.option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    return found.filter("_broken is null").drop("_broken").orderBy(F.desc("generated_at"), "file").limit(newest)


def comparison(one: DataFrame, two: DataFrame, key: list[str], metrics: list[str], names: tuple[str, str] = ("tcp", "udp")) -> DataFrame:
    """Two runs side by side, a row per metric: both values, the change and which is lower."""
    long = lambda df, n: df.select(*key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in metrics])))
    joined = long(one, names[0]).join(long(two, names[1]), [*key, "metric"], "full")
    a, b = F.col(names[0]), F.col(names[1])
    lower = F.when(a < b, names[0]).when(b < a, names[1])
    return joined.withColumn("change", b - a).withColumn("lower", lower)


def aliases(rows: DataFrame, columns: list[str], order: str, prefix: str) -> DataFrame:
    """(value, alias): the values of some columns, numbered in the order in which they first occur."""
    places = F.array(*[F.struct(F.col(order).alias("at"), F.lit(i).alias("column"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    first = rows.select(F.inline(places)).filter("value is not null").groupBy("value").agg(F.min(F.struct("at", "column")).alias("first"))
    return numbered(first, F.col("first.at"), ["first", "value"], "n").select("value", F.concat(F.lit(prefix + "-"), F.col("n")).alias("alias"))


def redacted(rows: DataFrame, tables: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """Rows whose ``columns`` (name: table) hold aliases instead of values; equal values stay equal across tables of one report."""
    for column, name in columns.items():
        known = tables[name].select(F.col("value").alias("_value"), F.col("alias").alias("_alias"))
        rows = rows.join(known, F.col(column) == F.col("_value"), "left").withColumn(column, F.col("_alias")).drop("_value", "_alias")
    return rows


def redacted_details(findings: DataFrame, key: list[str], detail: str, known: DataFrame) -> DataFrame:
    """Free text without the values of ``known`` (key, value, alias), longest first so that none hides in another."""
    pairs = known.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.length("value").alias("n"), "value", "alias")), False).alias("_pairs"))
    joined = findings.join(pairs, key, "left")
    replaced = F.aggregate(F.coalesce("_pairs", F.expr("array()").cast("array<struct<n:int,value:string,alias:string>>")), F.col(detail), lambda t, p: F.replace(t, p["value"], p["alias"]))
    return joined.withColumn(detail, replaced).drop("_pairs")
