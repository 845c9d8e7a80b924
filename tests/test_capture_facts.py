"""From the bytes of a capture to findings."""

import struct

import pytest
from pyspark.sql import functions as F

from tests.builders import h264_sets, h265_sets, pcap, rtp, rtsp_dialog, udp
from tracewell.operators import audio
from tracewell.rules import facts
from tracewell.sources.stream import stream_frames

SDP = (
    "v=0\r\nc=IN IP4 0.0.0.0\r\nm=video 0 RTP/AVP 96\r\na=rtpmap:96 H264/90000\r\na=framesize:96 640-480\r\na=framerate:25\r\na=control:track1\r\n"
    "m=audio 0 RTP/AVP 97\r\na=rtpmap:97 L16/8000/2\r\na=control:track2\r\n"
)


def dialog():
    request = lambda method, uri, n, more="": f"{method} {uri} RTSP/1.0\r\nCSeq: {n}\r\n{more}\r\n"
    reply = lambda n, more="", status="200 OK": f"RTSP/1.0 {status}\r\nCSeq: {n}\r\n{more}\r\n"
    described = f"Content-Base: rtsp://h/x/\r\nContent-Type: application/sdp\r\nContent-Length: {len(SDP)}\r\n"
    return rtsp_dialog(
        0,
        [
            request("DESCRIBE", "rtsp://h/x", 1), f"RTSP/1.0 200 OK\r\nCSeq: 1\r\n{described}\r\n{SDP}",
            request("SETUP", "rtsp://h/x/track1", 2, "Transport: RTP/AVP;unicast;client_port=40000-40001\r\n"), reply(2, "Session: s\r\nTransport: RTP/AVP;unicast;client_port=40000-40001;server_port=6970-6971\r\n"),
            request("SETUP", "rtsp://h/x/track2", 3, "Transport: RTP/AVP;unicast;client_port=40002-40003\r\n"), reply(3, "Session: s\r\nTransport: RTP/AVP;unicast;client_port=40002-40003\r\n"),
            request("PLAY", "rtsp://h/x", 4, "Session: s\r\n"), reply(4, "Session: s\r\n"),
        ],
    )


def video():
    """12 frames of H.264, larger in the second half, the fourth packet lost, then 3 of another source without parameters."""
    frames, seq = [], 0
    for i in range(12):
        sps, pps = h264_sets(1280, 720) if i < 6 else h264_sets(1920, 1088)
        for unit in ([sps, pps] if i % 6 == 0 else []) + [(b"\x65" if i % 6 == 0 else b"\x41") + b"\xb8" + bytes([i])]:
            frames.append((100_000 + i * 300_000, rtp(seq, i * 27_000, unit, marker=unit[0] % 32 < 7)))
            seq += 1
    del frames[3]
    frames += [(4_000_000 + i * 40_000, rtp(500 + i, i * 3600, b"\x41\xb8x", ssrc=43, marker=True)) for i in range(3)]
    return [(us, udp(data, sport=6970)) for us, data in frames]


def sound():
    """40 packets of 100 ms of stereo, the channels opposite, with a hole of 50 ms in the times."""
    wave = [(3000 if i % 8 < 4 else -3000) for i in range(800)]
    body = b"".join(struct.pack(">2h", x, -x) for x in wave)
    return [(100_500 + i * 100_000, udp(rtp(i, i * 800 + (400 if i >= 20 else 0), body, ssrc=7, pt=97), sport=9000, dport=40002)) for i in range(40)]


def undeclared():
    """30 frames of H.265 that nobody described: more pictures than the level holds, a fragment without its start."""
    frames = [(200_000 + i, rtp(i, 0, unit, ssrc=9, pt=98)) for i, unit in enumerate(h265_sets(1280, 720, 93, 7))]
    frames += [(200_100 + i * 200_000, rtp(3 + i, i * 18_000, (b"\x26\x01" if i == 0 else b"\x02\x01") + b"\xe0x", ssrc=9, pt=98, marker=True)) for i in range(30)]
    frames.append((6_300_000, rtp(33, 600_000, b"\x62\x01\x41abc", ssrc=9, pt=98, marker=True)))
    return [(us, udp(data, sport=7000, dport=50_000)) for us, data in frames]


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    path = tmp_path_factory.mktemp("capture") / "a.pcap"
    path.write_bytes(pcap(sorted(dialog() + video() + sound() + undeclared(), key=lambda f: f[0])))
    return str(path)


def test_rules_fire_from_the_bytes_of_a_capture(spark, capture):
    rows = {r.ssrc: r for r in facts.capture_facts(stream_frames(spark, capture, 4096)).collect()}
    assert {k: r.codec for k, r in rows.items()} == {42: "h264", 43: "h264", 7: "l16", 9: "h265"}
    first = rows[42]
    assert (first.packets, first.lost, first.max_gap, first.ssrc_changes, first.sps_frame_size, first.sdp_frame_size) == (15, 1, 1, 1, "1280x720" if first.sps_frame_size == "1280x720" else "1920x1088", "640x480")
    assert (first.parameter_changes, first.idr_frames, first.first_frame_is_idr, first.play_succeeded, first.last_setup_status) == (1, 2, True, True, 200)
    assert (first.sdp_frame_size_invalid, first.sdp_frame_rate_invalid, first.truncated, first.sufficient) == (False, False, False, True)
    assert (rows[7].audio_gaps, rows[7].audio_overlaps, rows[7].audio_reliable, rows[7].stereo_correlation_milli, rows[7].level_difference_milli, rows[7].level_jumps) == (1, 0, True, -1000, 0, 0)
    assert (rows[9].dpb_limit, rows[9].max_dec_frame_buffering, rows[9].sps_frame_size, rows[9].issues) == (6, 7, "1280x720", ["h265_fu_missing_start"])
    found = facts.capture_findings(stream_frames(spark, capture, 4096)).collect()
    by_stream = {k: {f.rule_id for f in found if f.stream_id == r.stream_id} for k, r in rows.items()}
    assert {"RTP-015", "RTP-020", "H264-014", "H264-027", "H264-049"} <= by_stream[42] and "H264-012" not in by_stream[42]
    assert {"RTP-020", "H264-012", "H264-023"} <= by_stream[43]
    assert by_stream[7] == {"AUD-042", "AUD-048"}
    assert {"H265-037", "H265-052"} <= by_stream[9] and "H265-036" not in by_stream[9]
    assert not any(f.rule_id.startswith("RTSP-") for f in found)
    assert all(f.severity in ("low", "medium") for f in found if f.stream_id == rows[43].stream_id)


def test_a_hundred_streams(spark, tmp_path):
    frames = [(seq * 500_000, udp(rtp(seq, seq * 4000, b"\1\2\3", marker=True), src=f"10.0.0.{server}")) for seq in range(1, 11) for server in range(1, 101)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    rows = facts.capture_facts(stream_frames(spark, str(tmp_path / "a.pcap"))).collect()
    assert len(rows) == 100 and {(r.packets, r.codec, r.sufficient) for r in rows} == {(10, None, False)}
    assert {r.stream_id for r in rows} == {f"stream-{i:04}" for i in range(1, 101)}


def test_levels_of_streams(spark):
    loud, soft = b"\x80" * 800, b"\xf0" * 800
    rows = [("m", i, "PCMU", 8000, 1, bytearray(loud if i < 3 else soft)) for i in range(6)] + [("e", 0, "PCMU", 8000, 1, bytearray(b""))]
    rows += [("s", i, "L16", 8000, 2, bytearray(struct.pack(">4h", 100, 50, -100, -50) * 300)) for i in range(4)]
    levels = audio.stream_levels(spark.createDataFrame(rows, "f string, ext int, codec string, clock int, channels int, body binary"), ["f"], "ext")
    windows = {(r.f, r.window, r.pcm_channel): r for r in levels.collect()}
    assert {k[1] for k in windows if k[0] == "m"} == set(range(6)) and windows["m", 0, 1].n == 800 and windows["m", 0, 1].energy == 800 * 32124**2
    assert sum(r.n for r in windows.values() if r.f == "s" and r.pcm_channel == 2) == 2400 and windows["s", 2, 1].cross == 800 * 5000
    sound = {r.f: r for r in audio.stream_sound(levels, ["f"]).collect()}
    assert (sound["m"].level_jumps, sound["m"].level_difference_milli, sound["m"].samples) == (1, None, 4800)
    assert (sound["s"].stereo_correlation_milli, sound["s"].level_difference_milli, sound["s"].silent) == (1000, 6021, 4800)


def test_pictures_that_an_h265_level_holds(spark):
    rows = spark.createDataFrame([(93, 1280, 720), (93, 640, 360), (93, 960, 540), (93, 1024, 640), (93, 1920, 1080), (94, 640, 480), (93, 0, 720)], "l int, w int, h int")
    assert [r.d for r in rows.select(facts.h265_dpb_limit(F.col("l"), F.col("w"), F.col("h")).alias("d")).collect()] == [6, 16, 8, 8, None, None, None]
