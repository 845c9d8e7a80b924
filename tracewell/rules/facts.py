"""The facts of streams that rules test, gathered from the operators' results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.scalar import signed_wrap
from tracewell.operators import audio, evidence, joins, parameter_sets, rtsp, sequence, tcp, video
from tracewell.operators import packets as P
from tracewell.rules.catalog import FACTS, RULES
from tracewell.rules.engine import findings, of_source
from tracewell.sources.spool import spooled

#: Facts that a result holds under another name.
RENAMED = {
    "timestamp_rollbacks": "rollbacks",
    "incomplete_nalus": "incomplete_units",
    "max_num_ref_frames": "reference_frames",
    "max_dec_frame_buffering": "buffered_frames",
    "max_num_reorder_frames": "reorder_frames",
    "hrd_max_bps": "bit_rate_bps",
}
#: Frames that fit into a decoder's buffer are limited by macroblocks, by level (tenths).
LARGEST_BUFFER = {
    10: 396, 11: 900, 12: 2376, 13: 2376, 20: 2376, 21: 4752, 22: 8100, 30: 8100, 31: 18000, 32: 20480, 40: 32768, 41: 32768, 42: 34816, 50: 110400,
    51: 184320, 52: 184320, 60: 696320, 61: 696320, 62: 696320,
}


#: Samples of the largest picture of an H.265 level (thirty times its number), and the pictures that
#: a decoder holds where one takes up to a quarter, a half, three quarters, or more of that.
H265_SAMPLES = {
    30: 36_864, 60: 122_880, 63: 245_760, 90: 552_960, 93: 983_040, **dict.fromkeys((120, 123), 2_228_224),
    **dict.fromkeys((150, 153, 156), 8_912_896), **dict.fromkeys((180, 183, 186), 35_651_584),
}
H265_PICTURES = (16, 12, 8, 6)


def h265_dpb_limit(level: Column, width: Column, height: Column) -> Column:
    """Pictures that a decoder of this H.265 level has to hold; null for an unknown level, no size or one too large."""
    samples = F.try_element_at(F.create_map(*[F.lit(x) for pair in H265_SAMPLES.items() for x in pair]), level.cast("int"))
    quarters = F.ceil(width * height * 4 / samples)
    return F.get(F.array(*map(F.lit, H265_PICTURES)), (quarters - 1).cast("int")).cast("bigint")


def dpb_limit(level: Column, width: Column, height: Column) -> Column:
    """Frames that a decoder of this H.264 level has to hold, 16 at most; null for an unknown level."""
    blocks = F.ceil(width / 16) * F.ceil(height / 16)
    table = F.create_map(*[F.lit(x) for pair in LARGEST_BUFFER.items() for x in pair])
    return F.least(F.floor(F.try_element_at(table, level.cast("int")) / blocks), F.lit(16)).cast("bigint")


def stream_facts(streams: DataFrame, key: list[str], *results: DataFrame) -> DataFrame:
    """One row per stream with every fact that ``results`` hold, joined on ``key``; the others are null.

    Each result has at most one row per key. A fact that several hold is taken from the first.
    """
    rows, have = streams, set(streams.columns)
    for result in results:
        new = [c for c in result.columns if c not in have]
        rows = rows.join(result.select(*key, *new), key, "left")
        have |= set(new)
    source = lambda name: name if name in have else RENAMED.get(name, "")
    found = [(F.col(source(n)) if source(n) in have else F.lit(None)).cast(kind).alias(n) for n, kind in FACTS.items()]
    return rows.select(*key, *found)


def video_facts(frames: DataFrame, units: DataFrame, flow: list[str]) -> DataFrame:
    """incomplete_units, first_frame_is_idr, and issues of H.264 flows, from their frames and units."""
    first = frames.groupBy(*flow).agg(
        F.min_by("idr", "frame").alias("first_frame_is_idr"),
        F.when(F.bool_or("missing_marker"), F.array(F.lit("missing_marker"))).alias("_marker"),
    )
    broken = units.groupBy(*flow).agg(F.count_if(~F.col("complete")).alias("incomplete_units"), F.collect_set("issue").alias("_issues"))
    joined = first.join(broken, flow, "left")
    none = F.array().cast("array<string>")
    issues = F.array_union(F.coalesce("_issues", none), F.coalesce("_marker", none))
    return joined.select(*flow, "first_frame_is_idr", "incomplete_units", F.array_sort(issues).alias("issues"))


#: What operators say besides the facts of the catalog; derived facts are made of it.
MORE = {
    "declared": "string", "inferred": "string", "binding_kind": "string", "sdp_frame_rate": "string", "frames": "bigint", "width": "bigint", "height": "bigint",
    "level_idc": "bigint", "fps_milli": "bigint", "audio_packets": "bigint", "audio_samples": "bigint", "audio_values": "bigint", "audio_clock": "bigint",
    "silent_samples": "bigint", "clipped_samples": "bigint", "units": "bigint", "has_sps": "boolean", "has_pps": "boolean", "has_vps": "boolean",
}


def fact_rows(result: DataFrame, key: list[str], facts: dict[str, Column | str]) -> DataFrame:
    """Rows (key, fact, value) of what a result says; what is null says nothing."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    pairs = F.array(*[F.struct(F.lit(name).alias("fact"), column(c).cast("string").alias("value")) for name, c in facts.items()])
    return result.select(*key, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def listed_rows(result: DataFrame, key: list[str], fact: str, value: Column) -> DataFrame:
    """Rows (key, fact, value) for a fact that is a list of names: one for each row whose value isn't null."""
    return result.select(*key, F.lit(fact).alias("fact"), value.alias("value")).filter("value is not null")


def gathered(rows: DataFrame, key: list[str], kinds: dict[str, str]) -> DataFrame:
    """One wide row per key out of rows (key, fact, value), in one grouping; lists hold each name once, sorted."""
    value = lambda name: F.when(F.col("fact") == name, F.col("value"))
    whole = lambda name, kind: F.array_sort(F.collect_set(value(name))) if kind == "array<string>" else F.max(value(name)).cast(kind)
    return rows.groupBy(*key).agg(*[whole(name, kind).alias(name) for name, kind in kinds.items()])


def _transport(rtp: DataFrame, flow: list[str]) -> DataFrame:
    order = ["number", "message"]
    statistics = P.rtp_statistics(rtp)
    turns = sequence.changes(rtp, [c for c in flow if c != "ssrc"], order, "ssrc")
    names = {n: n for n in ("packets", "lost", "max_gap", "out_of_order", "duplicates", "duration_ms", "mean_bps")} | {"timestamp_rollbacks": "rollbacks"}
    sources = statistics.select(*flow).join(turns, [c for c in flow if c != "ssrc"])
    return fact_rows(statistics, flow, names).unionByName(fact_rows(sources, flow, {"ssrc_changes": "changes"}))


def _described(rtp: DataFrame, found: DataFrame, flow: list[str]) -> DataFrame:
    """What the session that a stream belongs to says of it: its first packet's track, and the last SETUP and PLAY of the connection."""
    first = rtp.groupBy(*flow).agg(F.min_by(F.struct("codec", "binding"), F.struct("number", "message")).alias("f")).select(*flow, "f.*")
    size = F.col("binding.frame_size")
    width, height = text.dimensions(size)
    facts = fact_rows(
        first, flow,
        {
            "declared": F.regexp_replace(F.lower("codec"), "^hevc$", "h265"), "binding_kind": "binding.kind", "has_protocol": F.when(F.col("binding").isNotNull(), F.lit(True)),
            "sdp_frame_size": F.concat(width, F.lit("x"), height), "sdp_frame_size_invalid": F.when(size.isNotNull(), text.invalid_dimensions(size)),
            "sdp_frame_rate_invalid": F.when(F.col("binding.frame_rate").isNotNull(), text.invalid_rate(F.col("binding.frame_rate"))),
        },
    )
    done = F.col("status").between(200, 299)
    setup = F.when(F.col("method") == "SETUP", F.col("request_packet"))
    failed = F.when((F.col("status") >= 400) & ~F.coalesce("accepted_later", F.lit(False)), F.col("request_packet"))
    sessions = rtsp.retried(found).groupBy(*rtsp.CONNECTION).agg(
        F.max_by("status", setup).alias("last_setup_status"), F.bool_or((F.col("method") == "PLAY") & done).alias("play_succeeded"),
        F.min_by(F.concat_ws(" ", "method", "status", "reason"), failed).alias("error_text"),
    )
    own = first.filter("binding is not null").select(*flow, F.col("binding.ends").alias("ends"), F.col("binding.connection").alias("control"))
    sessions = sessions.withColumnRenamed("connection", "control")
    joined = own.join(sessions, ["capture", "interface", "ends", "control"])
    return facts.unionByName(fact_rows(joined, flow, {n: n for n in ("last_setup_status", "play_succeeded", "error_text")}))


#: Fields of parameter sets that take part in the comparison with the set before of the same number.
_COMPARED = [n for n in parameter_sets.FIELDS if n not in ("unit", "id", "problem")]


def _pictures(units: DataFrame, flow: list[str], codec: str) -> DataFrame:
    """What units of video say: frames, GOPs, parameter sets, what is broken or missing, and how far recovery is."""
    prefix = "h265_" if codec == "h265" else ""
    frames = video.access_units(units, flow, codec)
    gops = video.gop_statistics(frames, flow)
    facts = {n: n for n in ("frames", "idr_frames", "first_idr_frame", "maximum_gop_frames", "sps_before_idr", "pps_before_idr", "vps_before_idr")}
    rows = [fact_rows(gops, flow, facts), listed_rows(gops, flow, "issues", F.when(F.col("missing_markers") > 0, F.lit("missing_marker")))]
    after = joins.next_after(frames, flow, ["frame"], F.col("idr"), "point")
    ahead = frames.withColumn("point", F.struct("frame", "rtp_ts")).withColumn("after", after)
    ms = F.floor(signed_wrap(F.col("after.rtp_ts") - F.col("rtp_ts"), 1 << 32) / 90)
    recovery = ahead.groupBy(*flow).agg(
        F.min_by("idr", "frame").alias("first_frame_is_idr"),
        F.max(F.when(~F.col("complete"), F.col("after.frame") - F.col("frame"))).alias("recovery_frames"), F.max(F.when(~F.col("complete"), ms)).alias("recovery_ms"),
    )
    rows.append(fact_rows(recovery, flow, {n: n for n in ("first_frame_is_idr", "recovery_frames", "recovery_ms")}))
    rows.append(listed_rows(units.filter("issue is not null").select(*flow, "issue").distinct(), flow, "issues", F.col("issue")))
    kind = video.h264_type(F.col("data")) if codec == "h264" else video.h265_type(F.col("data"))
    numbers = {"sps": 7, "pps": 8} if codec == "h264" else {"sps": 33, "pps": 34, "vps": 32}
    typed = units.withColumnRenamed("unit", "at").withColumn("type", kind)
    broken = F.count_if(~F.col("complete"))
    seen = typed.groupBy(*flow).agg(F.count(F.lit(1)).alias("units"), broken.alias("incomplete"), F.bool_or(F.col("type") == numbers.get("vps", -1)).alias("has_vps"))
    rows.append(fact_rows(seen, flow, {"units": "units", "incomplete_nalus": "incomplete", "has_vps": "has_vps"}))
    sets = parameter_sets.parameters(typed.filter(F.col("type").isin(numbers["sps"], numbers["pps"])), [*flow, "at", "type"], codec)
    good = sets.filter("problem is null")
    rows.append(fact_rows(good.groupBy(*flow).agg(F.bool_or(F.col("unit") == "sps").alias("sps"), F.bool_or(F.col("unit") == "pps").alias("pps")), flow, {"has_sps": "sps", "has_pps": "pps"}))
    named = F.when(F.col("type") == numbers["sps"], "invalid_sps").otherwise("invalid_pps")
    rows.append(listed_rows(sets.filter("problem is not null").select(*flow, named.alias("issue")).distinct(), flow, "issues", F.col("issue")))
    changed = parameter_sets.changed_fields(good, flow, "at", _COMPARED)
    sized = F.array_contains("changed", "width") | F.array_contains("changed", "height")
    rows.append(fact_rows(changed.groupBy(*flow).agg(F.count(F.lit(1)).alias("n")), flow, {"parameter_changes": "n"}))
    rows.append(listed_rows(changed.filter(sized).select(*flow).distinct(), flow, "issues", F.lit(f"{prefix}resolution_changed")))
    # Of the sequence parameters whose number came first, the last ones.
    said = ["width", "height", "level_idc", "fps_milli", "reference_frames", "buffered_frames", "reorder_frames", "bit_rate_bps"]
    latest = good.filter("unit = 'sps'").groupBy(*flow, "id").agg(F.min("at").alias("first"), F.max_by(F.struct(*said), "at").alias("s"))
    latest = latest.groupBy(*flow).agg(F.min_by("s", "first").alias("s")).select(*flow, "s.*")
    names = {n: n for n in said[:4]} | {"max_num_ref_frames": said[4], "max_dec_frame_buffering": said[5], "max_num_reorder_frames": said[6], "hrd_max_bps": said[7]}
    rows.append(fact_rows(latest, flow, names | {"sps_frame_size": F.concat("width", F.lit("x"), "height")}))
    return reduce(DataFrame.unionByName, rows)


def _sound(rtp: DataFrame, flow: list[str]) -> DataFrame:
    """Gaps and overlaps of audio whose packets tell their length, and the levels of plain PCM, by packets counted once, in sequence."""
    codec = F.lower("codec")
    per_packet = F.when(codec == "opus", audio.opus_samples(F.col("body"))).when(codec.isin("pcmu", "pcma", "g722"), F.col("size")).when(
        codec == "l16", F.floor(F.col("size") / (2 * F.greatest(F.coalesce("channels", F.lit(1)), F.lit(1))))
    )
    some = rtp.withColumn("frames", per_packet).filter("frames is not null and clock > 0")
    unique = sequence.first_copies(sequence.unwrap(some, flow, ["number", "message"], "seq", 1 << 16), [*flow, "ext"], ["number", "message"])
    unique = unique.withColumn("channels", F.coalesce("channels", F.lit(1)))
    wrong = audio.timestamp_issues(unique, flow, "ext", F.col("clock")).groupBy(*flow).agg(
        F.count_if(F.col("kind") == "timestamp_gap").alias("gaps"), F.count_if(F.col("kind") == "timestamp_overlap").alias("overlaps")
    )
    counted = unique.groupBy(*flow).agg(F.count(F.lit(1)).alias("n"), F.max("clock").alias("clock"))
    sound = audio.stream_sound(audio.stream_levels(unique, flow, "ext"), flow)
    names = {"audio_samples": "samples", "audio_values": "values", "silent_samples": "silent", "clipped_samples": "clipped"}
    names |= {n: n for n in ("level_jumps", "level_difference_milli", "stereo_correlation_milli")}
    return (
        fact_rows(wrong, flow, {"audio_gaps": "gaps", "audio_overlaps": "overlaps"})
        .unionByName(fact_rows(counted, flow, {"audio_packets": "n", "audio_clock": "clock"}))
        .unionByName(fact_rows(sound, flow, names))
    )


def _derived(wide: DataFrame) -> DataFrame:
    """The facts that follow from several others."""
    codec = F.coalesce("declared", "inferred")
    h264, h265 = codec == "h264", codec == "h265"
    seen = (h264 | h265) & (F.col("units") > 0)
    reliable = (F.col("audio_samples") * 1000 >= F.col("audio_clock") * 1000) & (F.col("audio_packets") >= 20) & ~F.coalesce("truncated", F.lit(False))
    share = lambda c, of, least: reliable & (F.col(c) * of >= F.col("audio_values") * least)
    lacks = lambda name, video: seen & video & ~F.coalesce(f"has_{name}", F.lit(False))
    more = {
        "missing_sps": lacks("sps", F.lit(True)), "missing_pps": lacks("pps", F.lit(True)), "missing_vps": lacks("vps", h265),
        "near_silence": share("silent_samples", 100, 95), "clipping": share("clipped_samples", 10_000, 10),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in more.items()]))
    rates = evidence.frame_rates(
        wide.withColumn("declared_rate", F.col("fps_milli") / 1000).withColumn("probed_rate", F.lit(None).cast("double"))
        .withColumn("observed_rate", evidence.observed_rate(F.col("frames"), F.col("duration_ms")))
    )
    limit = F.when(h264, dpb_limit(F.col("level_idc"), F.col("width"), F.col("height"))).when(h265, h265_dpb_limit(F.col("level_idc"), F.col("width"), F.col("height")))
    return rates.withColumns(
        {
            "codec": codec, "issues": F.array_sort(F.array_union("issues", found)), "audio_reliable": F.when(F.col("audio_packets").isNotNull(), F.coalesce(reliable, F.lit(False))),
            "dpb_limit": limit, "frame_rate_conflict": F.when(F.size(F.array_compact(F.array("declared_rate", "observed_rate"))) > 1, F.col("rate_conflict")),
        }
    )


def _sufficient() -> Column:
    """Video of three seconds, ten packets and ten frames that no capture cut short, or reliable audio."""
    whole = (F.col("duration_ms") >= 3_000) & (F.col("packets") >= 10) & (F.col("frames") >= 10) & ~F.coalesce("truncated", F.lit(False))
    return F.when(F.col("codec").isin("h264", "h265"), whole).otherwise(F.col("audio_reliable"))


def stream_rows(rows: DataFrame, found: DataFrame, flow: list[str] = P.FLOW) -> DataFrame:
    """Everything that operators say about RTP streams, as rows (flow, fact, value).

    ``rows`` are packets with their binding, codec and clock, ``found`` the
    transactions of their capture's sessions. Video that nobody declared is read as H.264 and
    as H.265, and counts if it looks like it. Units and what they say are written
    once between the passes over them.
    """
    said = _described(rows, found, flow)
    parts = [_transport(rows, flow), said, _sound(rows, flow)]
    name = F.regexp_replace(F.lower("codec"), "^hevc$", "h265")
    undeclared = F.col("codec").isNull() & (F.col("pt") >= 96)
    for codec in ("h264", "h265"):
        some = rows.filter((name == codec) | undeclared)
        units = video.depacketise(sequence.unwrap(some, flow, ["number", "message"], "seq", 1 << 16), codec)
        facts = spooled(_pictures(spooled(units, f"{codec}-units"), flow, codec), f"{codec}-facts")
        open_flows = some.groupBy(*flow).agg(F.bool_and(F.col("codec").isNull()).alias("undeclared"), F.count(F.lit(1)).alias("packets"))
        wide = gathered(facts.filter("fact in ('incomplete_nalus', 'has_sps', 'has_pps', 'frames')"), flow, {"incomplete_nalus": "bigint", "has_sps": "boolean", "has_pps": "boolean", "frames": "bigint"})
        counts = open_flows.join(wide, flow, "left").select(
            *flow, "undeclared", "packets", F.coalesce("incomplete_nalus", F.lit(0)).alias("invalid"),
            (F.coalesce("has_sps", F.lit(False)).cast("int") + F.coalesce("has_pps", F.lit(False)).cast("int")).alias("parameter_sets"), F.coalesce("frames", F.lit(0)).alias("frames"),
        )
        accepted = counts.filter(~F.col("undeclared") | parameter_sets.inferred_codec(counts))
        parts.append(facts.join(accepted.select(*flow), flow, "left_semi"))
        parts.append(fact_rows(accepted.filter("undeclared"), flow, {"inferred": F.lit(codec)}))
    return reduce(DataFrame.unionByName, parts)


def capture_facts(frames: DataFrame) -> DataFrame:
    """One row of facts for each RTP stream of captures (frames as ``stream_frames`` reads them).

    Columns: FLOW, stream_id, sufficient (whether its sample is large enough for
    conclusions) and the catalog's facts.

    Every operator adds rows (stream, fact, value) to one union, which is grouped
    once. decode_issues and the facts of content and clocks need other sources
    than the bytes of a capture and stay null.
    """
    segments = P.segments(frames)
    messages = tcp.messages(tcp.reassemble(segments))
    observed = rtsp.observed(messages)
    datagrams = segments.filter("proto = 'udp'")
    rtp = P.rtp_packets(datagrams).unionByName(P.rtp_packets(P.interleaved_payloads(messages)))
    observed = spooled(observed, "messages")
    packets = spooled(rtsp.with_codec(rtsp.bound(rtp, rtsp.bindings(observed))), "packets")
    rows = stream_rows(packets, rtsp.transactions(observed))
    truncated = frames.groupBy("capture").agg(F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("cut"))
    firsts = packets.groupBy(*P.FLOW).agg(F.min("number").alias("first_packet"))
    rows = rows.unionByName(fact_rows(firsts.join(truncated, "capture"), P.FLOW, {"truncated": "cut", "first_packet": "first_packet"}))
    wide = gathered(rows, P.FLOW, FACTS | MORE | {"first_packet": "bigint"})
    ready = P.stream_ids(_derived(wide)).withColumn("sufficient", F.coalesce(_sufficient(), F.lit(False)))
    return ready.select(*P.FLOW, "stream_id", "sufficient", *[F.col(n).cast(k).alias(n) for n, k in FACTS.items()])


def capture_findings(frames: DataFrame, live: bool = False) -> DataFrame:
    """The findings of each stream of captures: capture, stream_id, and what ``findings`` says of it.

    Rules on the control connection are for live sources.
    """
    facts = capture_facts(frames)
    return of_source(findings(facts, RULES, ["capture", "stream_id"], F.col("sufficient")), F.lit(live))
