from tracewell.rules.catalog import FACTS, RULES, facts_schema
from tracewell.rules.engine import findings
from pyspark.sql import functions as F


def fired(spark, sufficient=None, **facts):
    row = [tuple(["s"] + [facts.get(n) for n in FACTS])]
    out = findings(spark.createDataFrame(row, facts_schema()), RULES, ["stream_id"], sufficient)
    return {r.rule_id: r for r in out.collect()}


POSITIVE = {
    "RTSP-001": dict(error_text="Connection refused"), "RTSP-002": dict(error_text="read timeout"), "RTSP-003": dict(error_text="401"),
    "RTSP-006": dict(last_setup_status=454), "RTSP-007": dict(play_succeeded=True, packets=0), "SDP-010": dict(sdp_frame_size_invalid=True),
    "H264-012": dict(codec="h264", issues=["missing_sps"]), "RTP-015": dict(lost=1), "RTP-017": dict(out_of_order=2),
    "RTP-018": dict(duplicates=1), "H264-023": dict(codec="h264", first_frame_is_idr=False), "H264-025": dict(codec="h264", maximum_gop_frames=101),
    "DEC-028": dict(decode_issues=["missing_reference"]), "H265-037": dict(codec="h265", issues=["h265_fu_header"]),
    "H264-054": dict(codec="h264", duration_ms=1000, truncated=False, mean_bps=106, hrd_max_bps=100), "AUD-042": dict(audio_gaps=1),
    "AUD-044": dict(audio_reliable=True, issues=["clipping"]), "AUD-048": dict(audio_reliable=True, stereo_correlation_milli=-800),
    "AVS-045": dict(content_confidence=75, content_offset_ms=120),
}


def test_unknown_facts_fire_nothing(spark):
    assert fired(spark) == {}


def test_each_positive_case_fires_its_rule(spark):
    rows = [tuple([rule] + [facts.get(n) for n in FACTS]) for rule, facts in POSITIVE.items()]
    out = findings(spark.createDataFrame(rows, facts_schema()), RULES, ["stream_id"])
    assert set(POSITIVE) == {r.rule_id for r in out.filter("rule_id = stream_id").collect()}


def test_zero_facts_fire_nothing(spark):
    zero = {n: 0 for n, k in FACTS.items() if k == "bigint"} | {"issues": [], "decode_issues": [], "codec": "h264", "packets": 5}
    assert set(fired(spark, **zero)) == set()


def test_insufficient_data_caps_severity_and_confidence(spark):
    rows = fired(spark, F.lit(False), lost=3, max_gap=3, error_text="sdp")
    assert (rows["RTP-016"].severity, rows["RTP-016"].confidence) == ("medium", 55)
    assert "insufficient sample" in rows["RTP-016"].evidence
    assert (rows["RTSP-004"].severity, rows["RTSP-004"].confidence) == ("high", 75)


def test_identifiers_are_unique():
    assert len({r.id for r in RULES}) == len(RULES)
