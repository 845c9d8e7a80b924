"""Bindings of datagrams to tracks, and reports to streams."""

import struct

from pyspark.sql import functions as F

from tests.builders import pcap, rtp, udp
from tracewell.operators import packets as P
from tracewell.operators import rtcp, rtsp
from tracewell.sources import captures as C

SETUPS = (
    "capture string, interface string, ends string, connection long, request_packet long, response_packet long, session string, index int, kind string, "
    "codecs array<struct<payload_type int, codec string, clock_rate int, channels int>>, transport string, rtp_channel int, client_ip string, server_ip string, client_port int, server_port int"
)


def setup(capture, packet, codec, clock, port=None, server_port=None, channel=None, server="192.0.2.1"):
    ends = "198.51.100.1|40000 192.0.2.1|00554"
    return (capture, "0", ends, 1, packet - 1, packet, "s", 0, "audio", [(96, codec, clock, None)], "tcp" if channel is not None else "udp", channel, "198.51.100.1", server, port, server_port)


def packets_of(spark, tmp_path, frames):
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    return P.rtp_packets(P.segments(C.read_captures(spark, str(tmp_path / "a.pcap"))))


def test_datagrams_get_the_codec_of_the_latest_binding_before_them(spark, tmp_path):
    frames = [(i * 20_000, udp(rtp(i, i * 960, b"x"), sport=port, dport=40000 + 2 * (i % 2), src=src)) for i, (port, src) in enumerate([(5004, "192.0.2.1"), (6970, "192.0.2.1"), (6970, "192.0.2.9"), (7000, "192.0.2.1"), (6970, "192.0.2.1")] * 3)]
    rows = packets_of(spark, tmp_path, frames)
    capture = rows.first().capture
    interface = rows.first().interface
    setups = [setup(capture, 3, "OPUS", 48000, 40000), setup(capture, 6, "L16", 16000, 40000, 6970), setup(capture, 11, "G722", 8000, 40000), setup(capture, 8, "AMR", 8000, 40002, 7000)]
    agreed = spark.createDataFrame(setups, SETUPS).withColumn("interface", F.lit(interface))
    found = {r.number: r.codec for r in rtsp.codec_of(rows, agreed).collect()}

    def expected(r):
        fits = [s for s in setups if s[5] <= r.number and r.src_ip == s[13] and r.dst_port == s[14] and s[15] in (None, r.src_port)]
        return max(fits, key=lambda s: s[5])[9][0][1] if fits else None

    wanted = {r.number: expected(r) for r in rows.collect()}
    assert found == wanted and {"OPUS", "L16", "G722", "AMR", None} == set(wanted.values())


def test_a_perfect_stream_of_opus_has_no_jitter(spark, tmp_path):
    rows = packets_of(spark, tmp_path, [(i * 20_000, udp(rtp(i, i * 960, b"x"), dport=40000)) for i in range(50)])
    first = rows.first()
    agreed = spark.createDataFrame([setup(first.capture, 0, "OPUS", 48000, 40000)], SETUPS).withColumn("interface", F.lit(first.interface))
    assert P.rtp_statistics(rtsp.codec_of(rows, agreed)).first().jitter_ms == 0
    assert P.rtp_statistics(rows).first().jitter_ms > 5


def test_channels_keep_their_codec(spark):
    rows = spark.createDataFrame([("c", "0", n, "192.0.2.1", 554, "198.51.100.1", 40000, 1, channel, 96) for n, channel in ((4, 0), (9, 0), (9, 2))], "capture string, interface string, number long, src_ip string, src_port long, dst_ip string, dst_port long, connection long, channel long, pt long")
    agreed = spark.createDataFrame([setup("c", 3, "H264", 90000, channel=0), setup("c", 7, "H265", 90000, channel=0)], SETUPS).withColumn("ends", F.lit("192.0.2.1|00554 198.51.100.1|40000"))
    assert sorted((r.number, r.channel, r.codec) for r in rtsp.codec_of(rows, agreed).collect()) == [(4, 0, "H264"), (9, 0, "H265"), (9, 2, None)]


FLOWS = "stream string, capture string, interface string, src_ip string, src_port long, dst_ip string, dst_port long, connection long, channel long, ssrc long"


def test_reports_find_their_stream_by_ports_and_channels(spark):
    flows = spark.createDataFrame(
        [("one", "c", "0", "a", 6000, "b", 7000, 0, -1, 42), ("two", "c", "0", "z", 6000, "b", 7000, 0, -1, 42), ("tcp", "c", "0", "a", 554, "b", 7000, 3, 0, 42)]
        + [("x", "c", "0", "p", 10, "b", 20, 0, -1, 9), ("y", "c", "0", "p", 11, "b", 20, 0, -1, 9)],
        FLOWS,
    )
    places = [(1, "a", 6000, "b", 7000, 0, -1, 42), (2, "a", 6001, "b", 7001, 0, -1, 42), (3, "z", 6000, "b", 7001, 0, -1, 42), (4, "a", 6002, "b", 7000, 0, -1, 42), (5, "a", 6000, "b", 7000, 0, -1, 43)]
    places += [(6, "a", 554, "b", 7000, 3, 0, 42), (7, "a", 554, "b", 7000, 3, 1, 42), (8, "a", 554, "b", 7000, 3, 2, 42), (9, "a", 554, "b", 7000, 4, 1, 42), (10, "p", 11, "b", 21, 0, -1, 9), (11, "p", 12, "b", 20, 0, -1, 9), (12, "p", 10, "b", 20, 0, -1, None)]
    reports = spark.createDataFrame([("c", "0", *p) for p in places], "capture string, interface string, number long, src_ip string, src_port long, dst_ip string, dst_port long, connection long, channel long, ssrc long")
    found, warnings = rtcp.reports_of_flows(reports, flows, "stream")
    assert sorted((r.number, r.stream) for r in found.collect()) == [(1, "one"), (2, "one"), (3, "two"), (6, "tcp"), (7, "tcp"), (11, "y")]
    assert sorted((r.number, r.candidates) for r in warnings.collect()) == [(4, 0), (5, 0), (8, 0), (9, 0), (10, 2)]


def test_sender_reports_go_by_their_ends_and_not_only_by_source(spark, tmp_path):
    report = struct.pack(">BBHI", 0x80, 200, 6, 42) + bytes(20)
    frames = [(i, udp(rtp(1, 0, b"\1"), src=f"192.0.2.{i + 1}", sport=6000)) for i in range(2)] + [(1000, udp(report, src="192.0.2.1", sport=6000))]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    segments = P.segments(C.read_captures(spark, str(tmp_path / "a.pcap")))
    flows = P.stream_ids(P.rtp_statistics(P.rtp_packets(segments))).select(*P.FLOW, "stream_id")
    ends = [c for c in P.FLOW if c not in ("connection", "channel", "ssrc")]
    placed = rtcp.rtcp_packets(segments.filter("proto = 'udp'"), ["number", *ends]).withColumn("connection", F.lit(0)).withColumn("channel", F.lit(-1))
    found, warnings = rtcp.reports_of_flows(placed, flows, "stream_id")
    assert [r.stream_id for r in found.collect()] == ["stream-0001"] and warnings.count() == 0
