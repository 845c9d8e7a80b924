"""Evidence joins: units, frames, issues and parameter changes back to the packets and positions they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.intervals import points_inside


def packets_of_issues(issues: DataFrame, packets: DataFrame, flow: list[str], carry: list[str]) -> DataFrame:
    """Issues with the last packet of their RTP time and sequence number, if there is one."""
    key = [*flow, "rtp_ts", "seq"]
    last = packets.groupBy(*key).agg(F.max_by(F.struct("number", "offset_ms"), "number").alias("p"))
    joined = issues.join(last, key, "left")
    return joined.select(*key, *carry, F.col("p.number").alias("number"), F.col("p.offset_ms").alias("offset_ms"))


def packets_of_units(units: DataFrame, packets: DataFrame, flow: list[str], unit: str) -> DataFrame:
    """One row per unit and packet that carries a part of it: the same RTP time, and a number from the unit's first to its last.

    Both use the unfolded sequence number ``ext``, so that ranges don't wrap.
    """
    found = points_inside(units, packets, [*flow, "rtp_ts"], [unit], "first_seq", "last_seq", "ext", ["ext", "number"])
    return found.select(*flow, unit, "ext", "number")


def units_of_packet(pairs: DataFrame, number: Column) -> DataFrame:
    """The units that a packet carries, from rows of ``packets_of_units``."""
    return pairs.filter(F.col("number") == number)


def units_between(units: DataFrame, first: int, last: int, order: str = "nalu_number") -> DataFrame:
    """A range of an elementary stream's units."""
    return units.filter(F.col(order).between(first, last))


def chosen_streams(streams: DataFrame, wanted: list[str], key: str = "stream_id") -> tuple[DataFrame, DataFrame]:
    """The streams asked for (``["*"]``: all), and the names asked for that don't exist."""
    names = streams.sparkSession.createDataFrame([(w,) for w in wanted if w != "*"], f"{key} string")
    chosen = streams if "*" in wanted else streams.join(F.broadcast(names), key, "left_semi")
    return chosen, names.join(streams, key, "left_anti")


def frames_to_units(frames: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """Decoded frames with the access unit they come from, and how that is known.

    With a decode index it is the unit of that number (from 1). Else it is the
    one unit that begins in the frame's bytes and ends where they end; where
    several do or none, there is no match.
    """
    one = units.select(*key, F.col("unit_number").alias("_n"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    by_index = frames.filter("decode_index is not null").join(
        one.select(*key, "_n").withColumn("decode_index", F.col("_n") - 1), [*key, "decode_index"], "left"
    )
    ranged = frames.filter("decode_index is null").withColumn("_e", F.col("position") + F.col("size"))
    hits = ranged.join(one, [*key, "_e"], "left").withColumn("_in", (F.col("_s") >= F.col("position")) & (F.col("_s") < F.col("_e")))
    names = [*key, "display_index"]
    by_range = hits.groupBy(*names).agg(F.count_if("_in").alias("_hits"), F.max(F.when(F.col("_in"), F.col("_n"))).alias("_n"))
    matched = lambda df, n, how: df.select(*names, n.alias("unit_number"), F.when(n.isNotNull(), F.lit(how)).alias("matched_by"))
    alone = F.when(F.col("_hits") == 1, F.col("_n"))
    return matched(by_index, F.col("_n"), "decode_index").unionByName(matched(by_range, alone, "byte_range"))


def with_position(rows: DataFrame, positions: DataFrame, key: list[str], number: str) -> DataFrame:
    """Rows that name a unit or frame by number (parameter changes, buffer points) with that one's columns; kept without one."""
    return rows.join(positions, [*key, number], "left")


def next_random_access(frames: DataFrame, flow: list[str], order: str, broken: Column, access: Column) -> DataFrame:
    """Frames with the first random access point after each broken one, and how far it is."""
    w = Window.partitionBy(*flow).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.min(F.when(access, F.col(order))).over(w)
    return frames.withColumn("recovers_at", F.when(broken, nearest)).withColumn("recovery_frames", F.col("recovers_at") - F.col(order))


def is_audio(kind: Column, codec: Column) -> Column:
    """Whether a stream was declared as sound, by its kind or by its codec."""
    #: Codecs of sound.
    names = ["pcma", "pcmu", "mpeg4-generic", "aac", "opus", "g722", "g723", "g723.1", "g723_1", "g729", "g729a", "g726"]
    return F.coalesce((kind == "audio") | F.lower(codec).isin(names), F.lit(False))


def observed_rate(frames: Column, duration_ms: Column) -> Column:
    return F.when((duration_ms > 0) & (frames > 0), F.round(frames * 1000 / duration_ms, 3))


def frame_rates(streams: DataFrame) -> DataFrame:
    """Streams with one frame rate out of those observed, declared and probed, and whether two of them disagree.

    Rates disagree if they differ by more than a half and by more than 5 % of the larger.
    """
    rates = F.array_compact(F.array("declared_rate", "probed_rate", "observed_rate"))
    apart = lambda a, b: F.abs(a - b) > F.greatest(F.lit(0.5), F.greatest(a, b) * 0.05)
    conflict = F.exists(rates, lambda a: F.exists(rates, lambda b: apart(a, b)))
    return streams.withColumn("frame_rate", F.coalesce("observed_rate", "declared_rate", "probed_rate")).withColumn("rate_conflict", conflict)


def distinct_warnings(rows: DataFrame, flow: list[str], order: str, text: str, most: int = 128) -> DataFrame:
    """Each flow's first ``most`` warnings in the order they first came, each once, and whether there are more."""
    first = rows.groupBy(*flow, text).agg(F.min(order).alias("_at"))
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*flow).orderBy("_at", text))).filter(F.col("_rank") <= most + 1)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_rank", text))), lambda x: x[text])
    return ranked.groupBy(*flow).agg(F.slice(listed, 1, most).alias("warnings"), (F.max("_rank") > most).alias("more"))


def requires_partial(errors: Column, begins: list[str], contains: Column | None = None) -> Column:
    """Whether an error of the control connection makes a result partial."""
    bad = F.exists(errors, lambda e: F.array_contains(F.array(*[e.startswith(b) for b in begins]), True))
    return F.coalesce(bad | contains if contains is not None else bad, F.lit(False))


def overridden_status(status: Column, partial: Column) -> Column:
    return F.when(partial & (status == "completed"), "partial").otherwise(status)
