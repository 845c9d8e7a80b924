import pytest
from pyspark.sql import functions as F

from tests.builders import pcap, pcapng, rtp, sip, udp
from tracewell.operators import packets as P
from tracewell.operators import sip as S
from tracewell.operators import video as V
from tracewell.operators import sequence
from tracewell.sources import captures as C


@pytest.fixture
def capture(spark, tmp_path):
    def read(content, name="a.pcap"):
        (tmp_path / name).write_bytes(content)
        return C.read_captures(spark, str(tmp_path / name))

    return read


@pytest.mark.parametrize("order,nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_all_four_magics(capture, order, nano):
    rows = capture(pcap([(1_500_000, b"abc"), (2_000_001, b"")], order=order, nano=nano)).collect()
    assert [(r.number, r.ts_us, bytes(r.data), r.truncated) for r in rows] == [(1, 1_500_000, b"abc", False), (2, 2_000_001, b"", False)]


def test_pcapng_keeps_interfaces_apart_and_scales_time(capture):
    rows = capture(pcapng([(0, 1_000_001, b"x"), (1, 2_000_000, b"yy")])).collect()
    assert [(r.interface, r.ts_us, bytes(r.data)) for r in rows] == [("0:0", 1_000_001, b"x"), ("0:1", 2_000_000, b"yy")]


@pytest.mark.parametrize("content", [b"junk", pcap([(0, b"abcdef")])[:-3]])
def test_broken_files_end_in_an_error(capture, content):
    rows = capture(content).collect()
    assert rows[-1].error and rows[-1].number is None


def streams(n):
    return pcap([(s * 10 + i * 500_000, udp(rtp(i + 1, i * 4000, b"abcd", pt=0), src=f"192.0.2.{s}")) for i in range(10) for s in range(1, n + 1)])


@pytest.mark.parametrize("n", [2, 50])
def test_streams_of_equal_ssrc_stay_apart(capture, n):
    rtp_rows = P.rtp_packets(P.segments(capture(streams(n))))
    rows = P.stream_ids(P.rtp_statistics(rtp_rows)).collect()
    assert len(rows) == n
    assert {(r.packets, r.lost, r.duplicates, r.duration_ms) for r in rows} == {(10, 0, 0, 4500)}
    assert sorted(r.stream_id for r in rows)[0] == "stream-0001"


def test_gap_duplicate_wrap_and_reorder(capture):
    order = [65534, 65535, 0, 0, 3, 2]
    frames = [(i * 20_000, udp(rtp(s, i * 1800, b"x" * 10))) for i, s in enumerate(order)]
    row = P.rtp_statistics(P.rtp_packets(P.segments(capture(pcap(frames))))).first()
    assert (row.packets, row.uniques, row.duplicates, row.lost, row.max_gap, row.out_of_order) == (6, 5, 1, 1, 2, 1)


def test_vlan_and_skipped_frames(capture):
    rows = P.segments(capture(pcap([(0, udp(b"hello", vlan=True)), (1, b"\0" * 12 + b"\x08\x06" + b"\0" * 30), (2, b"short")]))).collect()
    assert bytes(rows[0].payload) == b"hello" and rows[0].src_port == 5004
    assert [r.skipped for r in rows] == [None, "not IP", "not IP"]


def test_fragments_are_joined_and_gaps_found(capture):
    start, middle, end = b"\x7c\x85\x01", b"\x7c\x05\x02", b"\x7c\x45\x03"
    frames = [(0, udp(rtp(10, 0, start))), (1, udp(rtp(12, 0, end, marker=True))), (2, udp(rtp(11, 0, middle)))]
    frames += [(3, udp(rtp(10, 0, start), src="192.0.2.9")), (4, udp(rtp(12, 0, end), src="192.0.2.9"))]
    rows = sequence.unwrap(P.rtp_packets(P.segments(capture(pcap(frames)))), P.FLOW, ["number"], "seq", 1 << 16)
    units = V.depacketise(rows)
    whole = units.filter("src_ip = '192.0.2.1'").collect()
    assert [(bytes(u.data), u.complete, u.first_seq, u.last_seq) for u in whole] == [(b"\x65\x01\x02\x03", True, 10, 12)]
    broken = units.filter("src_ip = '192.0.2.9'").collect()
    assert "fua_sequence_gap" in {u.issue for u in broken} and not any(u.complete for u in broken)


def test_frames_and_gops(capture):
    frames = []
    for i in range(7):
        unit = bytes([0x65 if i % 3 == 0 else 0x41]) + b"\xb8"
        if i == 0:
            frames.append((0, udp(rtp(0, 0, b"\x18\x00\x02\x67a\x00\x02\x68b"))))
        frames.append((i * 40_000, udp(rtp(i + 1, i * 3600, unit, marker=i != 2))))
    rows = sequence.unwrap(P.rtp_packets(P.segments(capture(pcap(frames)))), P.FLOW, ["number"], "seq", 1 << 16)
    units = V.access_units(V.depacketise(rows), P.FLOW)
    row = V.gop_statistics(units, P.FLOW).first()
    assert (row.frames, row.idr_frames, row.average_gop_frames, row.maximum_gop_frames) == (7, 3, 3, 3)
    assert row.sps_before_idr and row.pps_before_idr and row.missing_markers == 1


def test_annex_b_units(spark, tmp_path):
    (tmp_path / "a.h264").write_bytes(b"\0\0\0\1\x67a\0\0\1\x68b\0\0\0\1\x65c")
    rows = C.read_annex_b(spark, str(tmp_path / "a.h264")).orderBy("nalu_number").collect()
    assert [bytes(r.data) for r in rows] == [b"\x67a", b"\x68b", b"\x65c"]


def test_sip_call(capture):
    body = "v=0\r\nc=IN IP4 10.0.0.1\r\nm=audio 4000 RTP/AVP 0\r\n"
    sent = [
        sip("INVITE sip:b@h SIP/2.0", body=body),
        sip("INVITE sip:b@h SIP/2.0", body=body),
        sip("SIP/2.0 180 Ringing", to_tag="b"),
        sip("SIP/2.0 200 OK", to_tag="b"),
        sip("ACK sip:b@h SIP/2.0", to_tag="b", branch="z9hG4bK2", cseq="1 ACK"),
        sip("BYE sip:a@h SIP/2.0", from_tag="b", to_tag="a", branch="z9hG4bK3", cseq="1 BYE"),
        sip("SIP/2.0 200 OK", from_tag="b", to_tag="a", branch="z9hG4bK3", cseq="1 BYE"),
        b"not sip at all",
    ]
    rows = S.messages(P.segments(capture(pcap([(i * 10_000, udp(m, sport=5060, dport=5060)) for i, m in enumerate(sent)]))))
    assert rows.count() == 7
    invite = S.transactions(rows).filter("method = 'INVITE'").first()
    assert (invite.retransmissions, invite.provisional, invite.final_status, invite.final_ms) == (1, 180, 200, 30)
    assert [d.state for d in S.dialogs(rows).collect()] == ["terminated"]
    first = rows.orderBy("packet").first()
    assert (first.sdp_media, first.sdp_address, first.sdp_port) == (1, "10.0.0.1", 4000)
    assert S.findings(rows).count() == 0


def test_wav(spark, tmp_path):
    import struct

    pcm = struct.pack("<4h", 1, -2, 3, -4)
    head = b"fmt " + struct.pack("<I2H2I2H", 16, 1, 2, 8000, 32000, 4, 16)
    body = head + b"data" + struct.pack("<I", len(pcm)) + pcm
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxxWAVE")
    rows = {r.path[-5:]: r for r in C.read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].pcm == [1, -2, 3, -4] and rows["a.wav"].rate == 8000
    assert rows["b.wav"].error
