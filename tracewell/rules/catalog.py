"""The diagnostic rules over one wide row of facts per stream.

A fact that is unknown is null, and a test on it does not fire. Facts that are
lists of names (issues, decode_issues) are arrays of strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

from tracewell.rules.engine import Rule


def _has(*names: str) -> str:
    return f"arrays_overlap(issues, array({', '.join(repr(n) for n in names)}))"


def _decode(*parts: str) -> str:
    return f"exists(decode_issues, x -> x rlike '{'|'.join(parts)}')"


def _error(pattern: str) -> str:
    return f"lower(error_text) rlike '{pattern}'"


#: Identifier, area, severity, confidence, test, evidence. Three
#: identifiers of the catalog (RTSP-008, RTSP-009, CMP-030) have no test and never fire.
RULES = [
    Rule("RTSP-001", "session", "critical", 80, f"not coalesce(has_protocol, false) and {_error('connect|refused')}", ("error_text",), False),
    Rule("RTSP-002", "session", "high", 85, _error("timeout"), ("error_text",), False),
    Rule("RTSP-003", "session", "critical", 90, _error("401|unauthorized|auth"), ("error_text",), False),
    Rule("RTSP-004", "session", "high", 75, _error("sdp"), ("error_text",), False),
    Rule("RTSP-005", "session", "high", 85, _error("control uri"), ("error_text",), False),
    Rule("RTSP-006", "session", "critical", 90, f"coalesce({_error('setup')}, false) or last_setup_status >= 400", ("last_setup_status",), False),
    Rule("RTSP-007", "session", "critical", 95, "play_succeeded and packets = 0", ("packets",)),
    Rule("SDP-010", "description", "high", 90, "sdp_frame_size_invalid", ("sdp_frame_size",), False),
    Rule("SDP-011", "description", "medium", 85, "sdp_frame_rate_invalid", (), False),
    Rule("H264-012", "video", "critical", 95, "codec = 'h264' and " + _has("missing_sps", "missing_pps")),
    Rule("H264-013", "video", "critical", 95, "codec = 'h264' and " + _has("invalid_sps", "invalid_pps")),
    Rule("H264-014", "video", "high", 95, "codec = 'h264' and sdp_frame_size <> sps_frame_size", ("sdp_frame_size", "sps_frame_size")),
    Rule("RTP-015", "transport", "high", 95, "lost > 0", ("lost",)),
    Rule("RTP-016", "transport", "critical", 95, "max_gap > 1 and lost > 0", ("max_gap",)),
    Rule("RTP-017", "transport", "medium", 95, "out_of_order > 0", ("out_of_order",)),
    Rule("RTP-018", "transport", "low", 95, "duplicates > 0", ("duplicates",)),
    Rule("RTP-019", "transport", "high", 95, "timestamp_rollbacks > 0", ("timestamp_rollbacks",)),
    Rule("RTP-020", "transport", "medium", 90, "ssrc_changes > 0", ("ssrc_changes",)),
    Rule("RTP-021", "transport", "medium", 90, _has("missing_marker")),
    Rule("H264-022", "video", "critical", 95, "codec = 'h264' and incomplete_nalus > 0", ("incomplete_nalus",)),
    Rule("H264-023", "video", "high", 95, "codec = 'h264' and first_frame_is_idr = false"),
    Rule("H264-024", "video", "medium", 85, "codec = 'h264' and first_idr_frame > 30", ("first_idr_frame",)),
    Rule("H264-025", "video", "medium", 85, "codec = 'h264' and maximum_gop_frames > 100", ("maximum_gop_frames",)),
    Rule("H264-026", "video", "critical", 95, "codec = 'h264' and idr_frames > 0 and not (sps_before_idr and pps_before_idr)"),
    Rule("H264-027", "video", "high", 95, "codec = 'h264' and " + _has("resolution_changed")),
    Rule("DEC-028", "decoder", "high", 80, _decode("missing_reference", "reference", "ref pic")),
    Rule("DEC-029", "decoder", "high", 80, _decode("macroblock", "concealment", "mb_type")),
    Rule("REC-031", "decoder", "medium", 75, "recovery_frames > 100 or recovery_ms > 3000", ("recovery_frames", "recovery_ms"), False),
    Rule("CMP-032", "comparison", "medium", 65, "sdp_frame_size_invalid and decode_succeeded", ("sdp_frame_size",)),
    Rule("VIS-033", "picture", "medium", 65, _decode("black_segment"), (), False),
    Rule("VIS-034", "picture", "medium", 65, _decode("freeze_segment"), (), False),
    Rule("VID-035", "video", "medium", 95, "frame_rate_conflict", (), False),
    Rule("H265-036", "video", "critical", 95, "codec = 'h265' and (" + _has("missing_vps", "missing_sps", "missing_pps") + " or (idr_frames > 0 and not (vps_before_idr and sps_before_idr and pps_before_idr)))"),
    Rule("H265-037", "video", "critical", 95, "codec = 'h265' and (incomplete_nalus > 0 or exists(issues, x -> x like 'h265_fu_%' or x like 'h265_ap_length%'))", ("incomplete_nalus",)),
    Rule("H265-038", "video", "medium", 90, "codec = 'h265' and first_frame_is_idr = false"),
    Rule("H265-039", "video", "medium", 85, "codec = 'h265' and maximum_gop_frames > 100", ("maximum_gop_frames",)),
    Rule("H265-040", "video", "high", 95, "codec = 'h265' and " + _has("h265_resolution_changed")),
    Rule("H264-049", "video", "medium", 85, "codec = 'h264' and parameter_changes > 0", ("parameter_changes",)),
    Rule("H265-050", "video", "medium", 85, "codec = 'h265' and parameter_changes > 0", ("parameter_changes",)),
    Rule("H264-051", "video", "high", 95, "codec = 'h264' and greatest(max_num_ref_frames, max_dec_frame_buffering) > dpb_limit", ("dpb_limit",)),
    Rule("H265-052", "video", "high", 95, "codec = 'h265' and max_dec_frame_buffering > dpb_limit", ("dpb_limit",)),
    Rule("H264-053", "video", "high", 100, "codec = 'h264' and (max_dec_frame_buffering < max_num_ref_frames or max_dec_frame_buffering < max_num_reorder_frames)"),
    Rule("H264-054", "video", "high", 95, "codec = 'h264' and duration_ms >= 1000 and not truncated and mean_bps * 100 > hrd_max_bps * 105", ("mean_bps", "hrd_max_bps")),
    Rule("H264-055", "video", "high", 98, "codec = 'h264' and hrd_overflows + hrd_underflows > 0", ("hrd_overflows", "hrd_underflows")),
    Rule("VIS-041", "picture", "high", 78, _decode("visual_corruption_candidate"), (), False),
    Rule("AUD-042", "audio", "high", 90, "audio_gaps > 0 or audio_overlaps > 0", ("audio_gaps", "audio_overlaps")),
    Rule("AUD-043", "audio", "medium", 85, "audio_reliable and " + _has("near_silence")),
    Rule("AUD-044", "audio", "high", 90, "audio_reliable and " + _has("clipping")),
    Rule("AUD-046", "audio", "medium", 80, "audio_reliable and level_jumps > 0", ("level_jumps",)),
    Rule("AUD-047", "audio", "medium", 85, "audio_reliable and level_difference_milli >= 6000", ("level_difference_milli",)),
    Rule("AUD-048", "audio", "high", 88, "audio_reliable and stereo_correlation_milli <= -800", ("stereo_correlation_milli",)),
    Rule("AVS-045", "sync", "high", 80, "(content_confidence >= 75 and abs(content_offset_ms) > 80) or (coalesce(content_confidence, 0) < 75 and clock_confidence >= 80 and abs(clock_offset_ms) > 80)", ("content_offset_ms", "clock_offset_ms")),
]

_NAMES = {
    "string": ["codec", "error_text", "sdp_frame_size", "sps_frame_size"],
    "boolean": [
        "has_protocol", "play_succeeded", "sdp_frame_size_invalid", "sdp_frame_rate_invalid", "first_frame_is_idr", "sps_before_idr",
        "pps_before_idr", "vps_before_idr", "decode_succeeded", "frame_rate_conflict", "truncated", "audio_reliable",
    ],
    "bigint": [
        "last_setup_status", "packets", "lost", "max_gap", "out_of_order", "duplicates", "timestamp_rollbacks", "ssrc_changes",
        "incomplete_nalus", "first_idr_frame", "maximum_gop_frames", "idr_frames", "recovery_frames", "recovery_ms", "parameter_changes",
        "max_num_ref_frames", "max_dec_frame_buffering", "max_num_reorder_frames", "dpb_limit", "duration_ms", "mean_bps", "hrd_max_bps",
        "hrd_overflows", "hrd_underflows", "audio_gaps", "audio_overlaps", "level_jumps", "level_difference_milli",
        "stereo_correlation_milli", "content_confidence", "content_offset_ms", "clock_confidence", "clock_offset_ms",
    ],
    "array<string>": ["issues", "decode_issues"],
}
#: Every fact that a rule may use, and its type.
FACTS = {name: kind for kind, names in _NAMES.items() for name in names}


def facts_schema() -> T.StructType:
    return T.StructType.fromDDL("stream_id string, " + ", ".join(f"{n} {k}" for n, k in FACTS.items()))
