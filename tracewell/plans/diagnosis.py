"""The rule catalog over facts of every customer, the facts of streams, and the whole timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.scalar import micros
from tracewell.queries import query, table
from tracewell.rules.catalog import FACTS, RULES
from tracewell.rules.engine import SEVERITIES, findings
from tracewell.rules.timeline import FEEDS, timeline

#: Facts as SQL over customers, for both engines; k is the customer's number.
_TEXT = {
    "codec": "CASE k % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'h265' ELSE 'pcmu' END",
    "error_text": "CASE k % 13 WHEN 0 THEN 'Connection refused' WHEN 1 THEN 'read TIMEOUT' WHEN 2 THEN '401 Unauthorized' WHEN 3 THEN 'bad SDP' WHEN 4 THEN 'no control URI' WHEN 5 THEN 'Setup failed' END",
    "sdp_frame_size": "CASE WHEN k % 5 > 1 THEN '640x480' END",
    "sps_frame_size": "CASE k % 7 WHEN 0 THEN '640x480' WHEN 1 THEN '1280x720' END",
}
_FLAGS = [name for name, kind in FACTS.items() if kind == "boolean"]
_NUMBERS = [name for name, kind in FACTS.items() if kind == "bigint"]
_SCALE = {"max_gap": 3, "first_idr_frame": 60, "maximum_gop_frames": 200, "recovery_frames": 200, "recovery_ms": 6000, "duration_ms": 3000, "last_setup_status": 600, "level_difference_milli": 12000, "content_confidence": 100, "clock_confidence": 100, "content_offset_ms": 200, "clock_offset_ms": 200, "mean_bps": 300, "hrd_max_bps": 300, "packets": 3}
_LISTS = {
    "issues": ["missing_sps", "invalid_pps", "missing_marker", "resolution_changed", "missing_vps", "h265_fu_header", "h265_resolution_changed", "near_silence", "clipping"],
    "decode_issues": ["missing_reference", "macroblock", "black_segment", "freeze_segment", "visual_corruption_candidate", "concealment"],
}


def _number(name: str, i: int) -> str:
    scaled = f"(k * {2 * i + 3}) % {_SCALE.get(name, 4)}"
    if name == "stereo_correlation_milli":
        scaled = f"(k * {2 * i + 3}) % 2000 - 1000"
    return f"CASE WHEN (k + {i}) % 4 > 0 THEN {scaled} END"


def _names(values: list[str], step: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v},{values[(i + step) % len(values)]}'" for i, v in enumerate(values))
    return f"CASE k % {len(values) + 3} {cases} END"


_SCALARS = {
    **_TEXT,
    **{name: f"CASE (k + {i}) % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE END" for i, name in enumerate(_FLAGS)},
    **{name: _number(name, i) for i, name in enumerate(_NUMBERS)},
}

_H4, _H5, _AUD = "codec = 'h264' AND ", "codec = 'h265' AND ", "audio_reliable AND "


def _has(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(issues, '{n}')" for n in names) + ")"


def _decoded(*names: str) -> str:
    return "(" + " OR ".join(f"len(list_filter(decode_issues, lambda x: contains(x, '{n}'))) > 0" for n in names) + ")"


#: What each rule means, written for the other engine: severity, confidence, capped, condition.
_MEANING = {
    "RTSP-001": (4, 80, 0, "NOT coalesce(has_protocol, FALSE) AND (e LIKE '%connect%' OR e LIKE '%refused%')"),
    "RTSP-002": (3, 85, 0, "e LIKE '%timeout%'"),
    "RTSP-003": (4, 90, 0, "e LIKE '%401%' OR e LIKE '%unauthorized%' OR e LIKE '%auth%'"),
    "RTSP-004": (3, 75, 0, "e LIKE '%sdp%'"),
    "RTSP-005": (3, 85, 0, "e LIKE '%control uri%'"),
    "RTSP-006": (4, 90, 0, "coalesce(e LIKE '%setup%', FALSE) OR last_setup_status >= 400"),
    "RTSP-007": (4, 95, 1, "play_succeeded AND packets = 0"),
    "SDP-010": (3, 90, 0, "sdp_frame_size_invalid"),
    "SDP-011": (2, 85, 0, "sdp_frame_rate_invalid"),
    "H264-012": (4, 95, 1, _H4 + _has("missing_sps", "missing_pps")),
    "H264-013": (4, 95, 1, _H4 + _has("invalid_sps", "invalid_pps")),
    "H264-014": (3, 95, 1, _H4 + "sdp_frame_size <> sps_frame_size"),
    "RTP-015": (3, 95, 1, "lost > 0"),
    "RTP-016": (4, 95, 1, "max_gap > 1 AND lost > 0"),
    "RTP-017": (2, 95, 1, "out_of_order > 0"),
    "RTP-018": (1, 95, 1, "duplicates > 0"),
    "RTP-019": (3, 95, 1, "timestamp_rollbacks > 0"),
    "RTP-020": (2, 90, 1, "ssrc_changes > 0"),
    "RTP-021": (2, 90, 1, _has("missing_marker")),
    "H264-022": (4, 95, 1, _H4 + "incomplete_nalus > 0"),
    "H264-023": (3, 95, 1, _H4 + "NOT first_frame_is_idr"),
    "H264-024": (2, 85, 1, _H4 + "first_idr_frame > 30"),
    "H264-025": (2, 85, 1, _H4 + "maximum_gop_frames > 100"),
    "H264-026": (4, 95, 1, _H4 + "idr_frames > 0 AND (NOT sps_before_idr OR NOT pps_before_idr)"),
    "H264-027": (3, 95, 1, _H4 + _has("resolution_changed")),
    "DEC-028": (3, 80, 1, _decoded("missing_reference", "reference", "ref pic")),
    "DEC-029": (3, 80, 1, _decoded("macroblock", "concealment", "mb_type")),
    "REC-031": (2, 75, 0, "recovery_frames > 100 OR recovery_ms > 3000"),
    "CMP-032": (2, 65, 1, "sdp_frame_size_invalid AND decode_succeeded"),
    "VIS-033": (2, 65, 0, _decoded("black_segment")),
    "VIS-034": (2, 65, 0, _decoded("freeze_segment")),
    "VID-035": (2, 95, 0, "frame_rate_conflict"),
    "H265-036": (4, 95, 1, _H5 + "(" + _has("missing_vps", "missing_sps", "missing_pps") + " OR (idr_frames > 0 AND (NOT vps_before_idr OR NOT sps_before_idr OR NOT pps_before_idr)))"),
    "H265-037": (4, 95, 1, _H5 + "(incomplete_nalus > 0 OR len(list_filter(issues, lambda x: starts_with(x, 'h265_fu_') OR starts_with(x, 'h265_ap_length'))) > 0)"),
    "H265-038": (2, 90, 1, _H5 + "NOT first_frame_is_idr"),
    "H265-039": (2, 85, 1, _H5 + "maximum_gop_frames > 100"),
    "H265-040": (3, 95, 1, _H5 + _has("h265_resolution_changed")),
    "H264-049": (2, 85, 1, _H4 + "parameter_changes > 0"),
    "H265-050": (2, 85, 1, _H5 + "parameter_changes > 0"),
    "H264-051": (3, 95, 1, _H4 + "greatest(max_num_ref_frames, max_dec_frame_buffering) > dpb_limit"),
    "H265-052": (3, 95, 1, _H5 + "max_dec_frame_buffering > dpb_limit"),
    "H264-053": (3, 100, 1, _H4 + "(max_dec_frame_buffering < max_num_ref_frames OR max_dec_frame_buffering < max_num_reorder_frames)"),
    "H264-054": (3, 95, 1, _H4 + "duration_ms >= 1000 AND NOT truncated AND mean_bps * 100 > hrd_max_bps * 105"),
    "H264-055": (3, 98, 1, _H4 + "hrd_overflows + hrd_underflows > 0"),
    "VIS-041": (3, 78, 0, _decoded("visual_corruption_candidate")),
    "AUD-042": (3, 90, 1, "audio_gaps > 0 OR audio_overlaps > 0"),
    "AUD-043": (2, 85, 1, _AUD + _has("near_silence")),
    "AUD-044": (3, 90, 1, _AUD + _has("clipping")),
    "AUD-046": (2, 80, 1, _AUD + "level_jumps > 0"),
    "AUD-047": (2, 85, 1, _AUD + "level_difference_milli >= 6000"),
    "AUD-048": (3, 88, 1, _AUD + "stereo_correlation_milli <= -800"),
    "AVS-045": (3, 80, 1, "(content_confidence >= 75 AND abs(content_offset_ms) > 80) OR (coalesce(content_confidence, 0) < 75 AND clock_confidence >= 80 AND abs(clock_offset_ms) > 80)"),
}

_FIRED = ",\n".join(
    f"CASE WHEN {condition} THEN {{'rule_id': '{rule}', 'level': {level}, 'confidence': {sure}, 'capped': {capped}}} END"
    for rule, (level, sure, capped, condition) in _MEANING.items()
)
_LEVEL = "CASE WHEN k % 4 = 0 AND x.capped = 1 THEN least(x.level, 2) ELSE x.level END"


@query(
    "q120_rule_catalog",
    f"""
WITH c AS (SELECT c_custkey AS k FROM customer),
f AS (SELECT k, {", ".join(f"{sql} AS {name}" for name, sql in _SCALARS.items())}, {", ".join(f"string_split({_names(v, i + 1)}, ',') AS {n}" for i, (n, v) in enumerate(_LISTS.items()))} FROM c),
g AS (SELECT *, lower(error_text) AS e FROM f),
r AS (SELECT k, unnest([{_FIRED}]) AS x FROM g)
SELECT k, x.rule_id AS rule_id, ['info', 'low', 'medium', 'high', 'critical'][{_LEVEL} + 1] AS severity,
       CASE WHEN k % 4 = 0 AND x.capped = 1 THEN least(x.confidence, 55) ELSE x.confidence END AS confidence
FROM r WHERE x IS NOT NULL
""",
)
def q120(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    lists = {n: F.split(F.expr(_names(v, i + 1)), ",") for i, (n, v) in enumerate(_LISTS.items())}
    facts = rows.select("k", *[F.expr(sql).cast(FACTS[name]).alias(name) for name, sql in _SCALARS.items()], *[c.alias(n) for n, c in lists.items()])
    return findings(facts, RULES, ["k"], F.col("k") % 4 != 0).select("k", "rule_id", "severity", "confidence")


@query(
    "q121_rule_totals",
    f"""
WITH c AS (SELECT c_custkey AS k FROM customer),
f AS (SELECT k, {", ".join(f"{sql} AS {name}" for name, sql in _SCALARS.items())}, {", ".join(f"string_split({_names(v, i + 1)}, ',') AS {n}" for i, (n, v) in enumerate(_LISTS.items()))} FROM c),
g AS (SELECT *, lower(error_text) AS e FROM f),
r AS (SELECT k, unnest([{_FIRED}]) AS x FROM g)
SELECT k, count(*) AS findings, ['info', 'low', 'medium', 'high', 'critical'][max(x.level) + 1] AS worst FROM r WHERE x IS NOT NULL GROUP BY k
""",
)
def q121(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    lists = {n: F.split(F.expr(_names(v, i + 1)), ",") for i, (n, v) in enumerate(_LISTS.items())}
    facts = rows.select("k", *[F.expr(sql).cast(FACTS[name]).alias(name) for name, sql in _SCALARS.items()], *[c.alias(n) for n, c in lists.items()])
    levels = F.array(*[F.lit(s) for s in SEVERITIES])
    found = findings(facts, RULES, ["k"]).withColumn("level", F.array_position(levels, F.col("severity")))
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("findings"), F.get(levels, (F.max("level") - 1).cast("int")).alias("worst"))


@query(
    "q122_whole_timeline",
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS layer, event_id AS key, CASE WHEN event_id % 9 > 0 THEN epoch_us(ts) // 1000 END AS offset_ms, event_type AS kind FROM events WHERE event_id % {len(FEEDS)} = {i}"
        for i, name in enumerate(FEEDS)
    ),
)
def q122(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("us", micros("ts")).select(
        F.col("event_id").alias("key"), F.when(F.col("event_id") % 9 > 0, F.expr("us div 1000")).alias("offset_ms"), F.col("event_type").alias("kind"), "event_id"
    )
    feeds = {name: rows.filter(F.col("event_id") % len(FEEDS) == i).drop("event_id") for i, name in enumerate(FEEDS)}
    return timeline(feeds, "key").select("layer", "key", "offset_ms", "kind")
