"""TCP, RTSP, RTCP, restarts and answers on small hand-made captures."""

import struct

import pytest

from tests.builders import pcap, udp
from tracewell.operators import packets, rtcp, rtsp, sdp, sequence, tcp
from tracewell.sources.captures import frames_of

SEGMENTS = "capture string, interface string, number bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto string, tcp_seq bigint, tcp_flags int, payload binary"


def segment(number, seq, data=b"", flags=tcp.ACK, port=40_000, back=False):
    ends = ("192.0.2.1", 554, "198.51.100.1", port) if back else ("198.51.100.1", port, "192.0.2.1", 554)
    return ("c", "0", number, number * 1000, *ends, "tcp", seq % (1 << 32), flags, bytearray(data))


def rtp(seq, ssrc=1, pt=0, body=b"abcd", ts=0):
    return struct.pack(">BBHII", 0x80, pt, seq, ts, ssrc) + body


def dollar(channel, data):
    return b"$" + bytes([channel]) + struct.pack(">H", len(data)) + data


def test_reordered_split_and_repeated_segments(spark):
    """Two connections with two channels each; a frame's header is split over segments that arrive in the wrong order, and all is sent twice."""
    rows = []
    for port, start in ((40_000, (1 << 32) - 10), (40_001, 77)):
        stream = b"".join(dollar(c, rtp(s, ssrc=c + 5)) for s, c in ((1, 0), (1, 2), (2, 0)))
        rows.append(segment(len(rows), start, flags=tcp.SYN, port=port))
        pieces = [(0, 2), (2, 30), (30, len(stream))]
        for a, b in [pieces[1], pieces[0], pieces[2], (0, len(stream))]:
            rows.append(segment(len(rows), start + 1 + a, stream[a:b], port=port))
    segments = spark.createDataFrame(rows, SEGMENTS)
    chunks = tcp.reassemble(segments)
    messages = tcp.messages(chunks)
    stats = packets.rtp_statistics(packets.rtp_packets(packets.interleaved_payloads(messages))).collect()
    assert sorted((r.src_port, r.channel, r.packets, r.duplicates, r.lost) for r in stats) == [(40_000, 0, 2, 0, 0), (40_000, 2, 1, 0, 0), (40_001, 0, 2, 0, 0), (40_001, 2, 1, 0, 0)]
    totals = tcp.stream_statistics(segments, chunks).collect()
    assert {(r.bytes, r.retransmitted, r.missing) for r in totals} == {(60, 60, 0)}


def test_missing_bytes_and_a_new_connection(spark):
    one, two = dollar(0, rtp(1)), dollar(0, rtp(2))
    rows = [segment(0, 99, flags=tcp.SYN), segment(1, 100, one), segment(2, 110 + len(one), b"junk" + two), segment(3, 5000, flags=tcp.SYN), segment(4, 5001, one)]
    chunks = tcp.reassemble(spark.createDataFrame(rows, SEGMENTS))
    assert sorted((r.connection, r.gap) for r in chunks.collect()) == [(1, 0), (1, 10), (2, 0)]
    found = sorted((r.connection, r.number, r.skipped) for r in tcp.messages(chunks).collect())
    assert found == [(1, 1, 0), (1, 2, 4), (2, 4, 0)]


def test_noise_is_skipped_and_a_cut_header_is_kept(spark):
    noise = bytes(range(128, 160)) + b"$\x00\x00\x02ab"
    text = b"OPTIONS rtsp://h RTSP/1.0\r\nCSeq: 3\r\n\r\n"
    rows = [segment(1, 1, noise + text), segment(2, 1 + len(noise + text), b"RTSP/1.0 200 OK\r\nCSeq: 3\r\nServer: x")]
    messages = tcp.messages(tcp.reassemble(spark.createDataFrame(rows, SEGMENTS)))
    found = sorted((r.kind, r.skipped) for r in messages.collect())
    assert found == [("rtsp", len(noise)), ("rtsp_cut", 0)]
    seen = rtsp.observed(messages).orderBy("number").collect()
    assert [(r.method, r.status, r.server, r.cut) for r in seen] == [("OPTIONS", None, None, False), (None, 200, "x", True)]


def test_requests_replaced_unanswered_and_refused(spark):
    def text(t):
        return t.replace("\n", "\r\n").encode()

    asks = [text(f"{m} rtsp://h/x RTSP/1.0\nCSeq: {c}\n\n") for m, c in (("DESCRIBE", 1), ("DESCRIBE", 2), ("PLAY", 3), ("PLAY", 3), ("TEARDOWN", 9))]
    answers = [text(f"RTSP/1.0 {s} R\nCSeq: {c}\n\n") for s, c in ((401, 1), (200, 2), (200, 3), (200, 77))]
    rows, at, back = [], 1, 1
    order = [(0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (0, 3), (1, 2), (1, 3), (0, 4)]
    for n, (side, i) in enumerate(order):
        data = answers[i] if side else asks[i]
        rows.append(segment(n, back if side else at, data, back=bool(side)))
        at, back = (at, back + len(data)) if side else (at + len(data), back)
    seen = rtsp.observed(tcp.messages(tcp.reassemble(spark.createDataFrame(rows, SEGMENTS))))
    found = rtsp.retried(rtsp.transactions(seen)).orderBy("request_packet").collect()
    assert [(r.cseq, r.method, r.status, r.elapsed_ms, r.accepted_later) for r in found] == [
        (1, "DESCRIBE", 401, 1, True), (2, "DESCRIBE", 200, 1, None), (3, "PLAY", 200, 1, None), (9, "TEARDOWN", 0, 0, None),
    ]
    row = rtsp.sessions(seen).first()
    assert (row.connected, row.authenticated, row.cut_header, row.first_packet, row.last_packet) == (True, False, False, 0, 8)


def test_confirmed_jumps_start_a_stage(spark):
    rows = [("a", i, s) for i, s in enumerate([40_000, 40_001, 1000, 1001, 1002])]
    rows += [("b", i, s) for i, s in enumerate([10, 11, 30_000, 12, 65_535])]
    rows += [("c", i, s) for i, s in enumerate([65_534, 65_535, 0, 1, 30_000])]
    df = spark.createDataFrame(rows, "flow string, number bigint, seq bigint")
    staged = sequence.restarts(df, ["flow"], ["number"], "seq")
    found = {}
    for r in sorted(staged.collect(), key=lambda r: (r.flow, r.number)):
        found.setdefault(r.flow, []).append(r.stage)
    assert found == {"a": [0, 0, 1, 1, 1], "b": [0, 0, None, 0, 0], "c": [0, 0, 0, 0, None]}
    unfolded = sequence.unwrap(staged.filter("flow = 'a'"), ["flow", "stage"], ["number"], "seq", 1 << 16)
    stats = sequence.sequence_statistics(unfolded, ["flow", "stage"], ["number"], "ext").collect()
    assert sorted((r.stage, r.packets, r.lost) for r in stats) == [(0, 2, 0), (1, 3, 0)]


def test_perfect_streams_of_any_clock_have_no_jitter(spark):
    rows = [("c", "0", i, i * 20_000, "a", 1, "b", 2, "udp", bytearray(rtp(i, ts=i * 160))) for i in range(100)]
    df = spark.createDataFrame(rows, "capture string, interface string, number bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto string, payload binary")
    row = packets.rtp_statistics(packets.rtp_packets(df)).first()
    assert (row.packets, row.jitter_ms, row.rollbacks, row.payload_type_changes) == (100, 0.0, 0, 0)


def test_a_clock_that_wraps_is_no_rollback(spark):
    times = [(1 << 32) - 160, 0, 160, 100, 320]
    rows = [("c", "0", i, i * 20_000, "a", 1, "b", 2, "udp", bytearray(rtp(i, ts=t))) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "capture string, interface string, number bigint, ts_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, proto string, payload binary")
    assert packets.rtp_statistics(packets.rtp_packets(df)).first().rollbacks == 1


def test_broken_compounds(spark):
    report = struct.pack(">BBHI", 0x80, 201, 1, 9)
    names = struct.pack(">BBHIBB", 0x81, 202, 2, 7, 1, 2) + b"me"
    cases = [report + names, report + b"\x00\xc8\x00\x00", report[:-2], struct.pack(">BBH", 0x80, 204, 0), b"\x82\xcb\x00\x01" + bytes(4)]
    df = spark.createDataFrame(list(enumerate(map(bytearray, cases))), "n int, payload binary")
    found = {}
    for r in rtcp.rtcp_packets(df, ["n"]).collect():
        found.setdefault(r.n, []).append((r.type, r.ssrc, r.cname, r.error))
    assert found[0] == [(201, 9, None, None), (202, 7, "me", None)]
    assert [x[3] for x in found[1]] == ["version"] and [x[3] for x in found[2]] == ["short"]
    assert found[3] == [(204, None, None, None)] and found[4] == [(203, None, None, None)]


def exchange(spark, offer, answer):
    media = lambda t: sdp.media(spark.createDataFrame([(1, t)], "id int, t string"), ["id"], "t")
    return [r.finding for r in sdp.answers(media(offer), media(answer), ["id"]).orderBy("index").collect()]


@pytest.mark.parametrize(
    "answer,finding",
    [
        ("v=0\nm=audio 5 RTP/AVP 0\n", [None]),
        ("v=0\nm=audio 5 RTP/AVP 0 101\n", ["payload_mismatch"]),
        ("v=0\nm=audio 5 RTP/SAVP 0\n", ["kind_mismatch"]),
        ("v=0\nm=audio 5 RTP/AVP 0\nm=video 6 RTP/AVP 96\n", [None, "extra_media"]),
        ("v=0\nm=audio 0 RTP/AVP 99\n", [None]),
        ("v=0\n", ["missing_media"]),
        ("v=0\nm=audio 5 RTP/AVP 8\na=inactive\n", [None]),
    ],
)
def test_answers(spark, answer, finding):
    assert exchange(spark, "v=0\nm=audio 4 RTP/AVP 0 8\n", answer) == finding


def test_answers_with_directions(spark):
    assert exchange(spark, "v=0\na=sendonly\nm=audio 4 RTP/AVP 0\n", "v=0\nm=audio 5 RTP/AVP 0\na=sendonly\n") == ["direction_mismatch"]
    assert exchange(spark, "v=0\na=sendonly\nm=audio 4 RTP/AVP 0\n", "v=0\nm=audio 5 RTP/AVP 0\na=recvonly\n") == [None]


def test_a_report_belongs_to_the_stream_of_its_own_server(spark):
    """Two servers use one source number; only the first sends a report."""
    df = spark.createDataFrame([("s1", 42, 1), ("s2", 42, 2)], "src_ip string, ssrc bigint, stream int")
    reports = spark.createDataFrame([("s1", 42), ("s3", 42)], "src_ip string, ssrc bigint")
    assert [tuple(r) for r in rtcp.reports_of_streams(reports, df, ["src_ip", "ssrc"], "stream").collect()] == [("s1", 42, 1)]
    assert rtcp.reports_of_streams(reports.select("ssrc").distinct(), df, ["ssrc"], "stream").count() == 0


def test_summary_of_a_capture(spark):
    files = spark.createDataFrame([("f", bytearray(pcap([(0, udp(rtp(1))), (20_000, udp(rtp(2))), (30_000, b"\0" * 20)])))], "path string, content binary")
    frames = frames_of(files)
    row = packets.transport_summary(frames, packets.segments(frames)).first()
    assert (row.frames, row.segments, row.ignored, row.first_reason, row.duration_ms) == (3, 2, 1, "not IP", 30)
