"""Small cases of operators whose queries use stand-ins for their input."""

from pyspark.sql import functions as F

from tests.builders import sip as message
from tracewell.operators import parameter_sets, rtcp, sip, sync, tcp
from tracewell.rules import facts
from tracewell.sources import spool


def test_flashes_and_beeps_are_200_ms_apart(spark):
    luma = [10, 10, 200, 20, 180, 30, 30, 30, 30, 150, 100, 139]
    frames = spark.createDataFrame([("v", i * 40, x) for i, x in enumerate(luma)], "f string, offset_ms long, luma int")
    found = sorted((r.offset_ms, r.strength_milli) for r in sync.flashes(frames, ["f"]).collect())
    assert found == [(80, 745), (360, 470)]
    rms = [0.0, 100.0, 5000.0, 4000.0, 1000.0, 3999.0, *[500.0] * 20, 4500.0]
    levels = spark.createDataFrame([("a", i * 10, x) for i, x in enumerate(rms)], "f string, offset_ms long, rms double")
    found = sorted((r.offset_ms, r.strength_milli) for r in sync.beeps(levels, ["f"]).collect())
    assert found == [(20, 153), (260, 137)]


def test_names_of_streams(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (2, "c")], "ssrc long, cname string")
    assert sorted((r.ssrc, r.cnames) for r in rtcp.names_of_streams(rows, []).collect()) == [(1, ["a", "b"]), (2, ["c"])]


def test_sip_over_a_stream(spark):
    text = message("INVITE sip:b@h SIP/2.0") + b"\r\n" + message("SIP/2.0 200 OK", to_tag="t")
    text = text.replace(b"CSeq", b"Content-Length: 0\r\nCSeq")
    rows = [("c", "0", i, i, "a", 5060, "b", 5060, "tcp", 100 + at, tcp.ACK, bytearray(text[at : at + 50])) for i, at in enumerate(range(0, len(text), 50))]
    schema = "capture string, interface string, number bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto string, tcp_seq bigint, tcp_flags int, payload binary"
    framed = tcp.messages(tcp.reassemble(spark.createDataFrame(rows, schema)), tcp.SipFraming)
    found = sip.messages(sip.of_streams(framed)).orderBy("packet").collect()
    assert [(r.method, r.status, r.from_tag, r.to_tag, r.problem) for r in found] == [("INVITE", None, "a", None, None), ("INVITE", 200, "a", "t", None)]


def test_video_that_nobody_declared(spark):
    rows = spark.createDataFrame([(100, 5, 2, 1), (100, 6, 2, 1), (100, 0, 0, 1), (100, 0, 1, 0)], "packets int, invalid int, parameter_sets int, frames int")
    assert [r.v for r in rows.select(parameter_sets.inferred_codec(rows).alias("v")).collect()] == [True, False, False, False]


def test_facts_of_video(spark):
    frames = spark.createDataFrame([("a", 1, False, True), ("a", 2, True, False)], "f string, frame int, idr boolean, missing_marker boolean")
    units = spark.createDataFrame([("a", False, "fua_sequence_gap"), ("a", True, None)], "f string, complete boolean, issue string")
    row = facts.video_facts(frames, units, ["f"]).first()
    assert (row.first_frame_is_idr, row.incomplete_units, row.issues) == (False, 1, ["fua_sequence_gap", "missing_marker"])


def test_packets_wait_between_passes(spark, tmp_path):
    rows = spark.createDataFrame([("c", 7 * i % 3, i, bytearray([i])) for i in range(50)], "capture string, ssrc bigint, number bigint, body binary")
    spool.write_spool(rows, str(tmp_path / "spool"), 4)
    back = spool.read_spool(spark, str(tmp_path / "spool"))
    assert sorted(back.columns) == sorted(rows.columns)
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_units_with_escapes_and_broken_sets(spark):
    data = [b"\x67\x42\x00\x00\x03\x00\x00\x03\x01", b"\x67", b"\x68\x80", b"\x65\x88\x84"]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, data binary")
    plain = [bytes(r.d) for r in df.select(parameter_sets.without_escapes(F.col("data")).alias("d")).collect()]
    assert plain[0] == b"\x67\x42\x00\x00\x00\x00\x01"
    raw = spark.createDataFrame([(bytearray(b"\x00\x00\x00\x00\x01\x00\x00\x02\x00\x00"),)], "d binary")
    back = raw.select(parameter_sets.without_escapes(parameter_sets.with_escapes(F.col("d"))).alias("d"), parameter_sets.with_escapes(F.col("d")).alias("e")).first()
    assert bytes(back.d) == b"\x00\x00\x00\x00\x01\x00\x00\x02\x00\x00" and b"\x00\x00\x00" not in bytes(back.e) and b"\x00\x00\x01" not in bytes(back.e)
    rows = {r.i: r for r in parameter_sets.parameters(df, ["i"]).collect()}
    assert all(rows[i].problem for i in (0, 1, 2)) and (rows[3].unit, rows[3].first_mb, rows[3].slice_type, rows[3].idr) == ("slice", 0, 2, True)
