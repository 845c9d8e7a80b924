"""Boundaries of pictures by slice headers, and by times where headers can't be read."""

import random

import pyarrow as pa
import pytest

from tests.builders import pcap, rtp, udp
from tracewell.operators import packets as P
from tracewell.operators import parameter_sets, sequence
from tracewell.operators import video as V
from tracewell.sources import captures as C
from tracewell.sources.stream import stream_units

UNIT = "f string, unit long, first_seq long, last_seq long, rtp_ts long, complete boolean, marker boolean, data binary"


def units(spark, rows):
    return spark.createDataFrame([(f, i, seq, seq, ts, True, marker, bytearray(data)) for i, (f, seq, ts, marker, data) in enumerate(rows)], UNIT)


def test_slices_come_first_where_times_come_again(spark):
    rows = [("f", 1, 90_000, False, b"\x41\xbc"), ("f", 2, 90_000, True, b"\x41\x4f"), ("f", 3, 90_000, True, b"\x41\xbc")]
    found = V.access_units(units(spark, rows), ["f"]).orderBy("frame").collect()
    assert [(r.frame, r.first_seq, r.last_seq, r.units, r.boundary, r.missing_marker) for r in found] == [(1, 1, 2, 2, "slice_header", False), (2, 3, 3, 1, "slice_header", False)]


def test_times_tell_where_headers_end_early(spark):
    rows = [("f", 1, 90_000, False, b"\x41\xb0"), ("f", 2, 93_600, False, b"\x41\xb0"), ("f", 3, 93_600, True, b"\x41\xb0"), ("f", 4, 90_000, True, b"\x41\xb0")]
    found = V.access_units(units(spark, rows), ["f"]).orderBy("frame").collect()
    assert [(r.units, r.boundary, r.missing_marker) for r in found] == [(1, "rtp_timestamp", True), (2, "rtp_timestamp", False), (1, "rtp_timestamp", False)]


def test_a_stream_whose_times_begin_again_keeps_its_frames(spark):
    rows = [("f", i, 0 if i in (1, 5, 9) else i * 3600, True, (b"\x65" if i % 4 == 1 else b"\x41") + b"\xb8") for i in range(12)]
    found = V.access_units(units(spark, rows), ["f"]).orderBy("frame").collect()
    assert [(r.frame, r.first_seq, r.units) for r in found] == [(i + 1, i, 1) for i in range(12)]
    gops = V.gop_statistics(V.access_units(units(spark, rows), ["f"]), ["f"]).first()
    assert (gops.frames, gops.idr_frames, gops.maximum_gop_frames) == (12, 3, 4)


def test_other_units_go_with_the_next_slice(spark):
    first, later, end = b"\x65\xb8", b"\x65\x4f", b"\x0b"
    rows = [("f", 0, 1, False, later), ("f", 1, 2, False, b"\x67a"), ("f", 1, 2, False, b"\x68b"), ("f", 2, 2, False, first), ("f", 3, 2, False, b"\x06x"), ("f", 4, 2, True, later), ("f", 5, 3, False, b"\x06y"), ("f", 6, 3, True, first), ("f", 7, 3, True, end), ("g", 0, 1, True, b"\x67a")]
    found = V.access_units(units(spark, rows), ["f"]).orderBy("f", "frame").collect()
    assert [(r.f, r.frame, r.first_seq, r.units, r.sps, r.pps) for r in found] == [("f", 1, 1, 5, True, True), ("f", 2, 5, 3, False, False)]


@pytest.mark.parametrize("codec", ["h264", "h265"])
def test_header_kernel_against_the_bit_reader(codec):
    random.seed(4)
    read = parameter_sets.h264_slice if codec == "h264" else parameter_sets.h265_slice
    heads = []
    for _ in range(3000):
        kind = random.choice([1, 5] if codec == "h264" else [0, 1, 9, 16, 19, 21])
        head = bytes([0x40 | kind]) if codec == "h264" else bytes([kind << 1, 1])
        heads.append(head + random.choice([b"", b"\0", b"\0\0\0\0", b"\x80"]) + random.randbytes(random.choice([0, 1, 2, 20, 60])))
    expected = []
    for h in heads:
        h = h[: V.SLICE_HEAD]
        try:
            found = read(h[1:], h[0]) if codec == "h264" else read(h[2:], h[0] >> 1)
            expected.append(found["first_mb"] == 0 if codec == "h264" else found["first_slice"])
        except ValueError:
            expected.append(None)
    assert V._begins(pa.array([None, *heads]).slice(1), codec == "h264").to_pylist() == expected


def test_elementary_streams_have_frames_and_gops(spark, tmp_path):
    stream = b"".join(b"\0\0\0\1" + u for u in [b"\x67a", b"\x68b", b"\x65\xb8", b"\x65\x4f", b"\x41\xb8", b"\x06z", b"\x41\xb8", b"\x67a", b"\x68b", b"\x65\xb8"])
    (tmp_path / "a.h264").write_bytes(stream)
    for rows in (C.read_annex_b(spark, str(tmp_path)), stream_units(spark, str(tmp_path), 16)):
        frames = V.access_units(rows, ["path"])
        assert [(r.frame, r.units, r.idr, r.has_marker, r.missing_marker) for r in frames.orderBy("frame").collect()] == [(1, 4, True, None, False), (2, 1, False, None, False), (3, 2, False, None, False), (4, 3, True, None, False)]
        gops = V.gop_statistics(frames, ["path"]).first()
        assert (gops.frames, gops.idr_frames, gops.first_idr_frame, gops.maximum_gop_frames, gops.sps_before_idr, gops.missing_markers) == (4, 2, 1, 3, True, 0)


def test_issues_are_named_by_codec_and_units_may_be_long(spark, tmp_path):
    fragments = [bytes([0x62, 1, 0x93]) + b"a", bytes([0x62, 1, 0x13]) + b"b", bytes([0x60, 1, 0, 9]) + b"c"]
    (tmp_path / "a.pcap").write_bytes(pcap([(i, udp(rtp(10 + 2 * (i > 0) + i, 0, data))) for i, data in enumerate(fragments)]))
    rows = sequence.unwrap(P.rtp_packets(P.segments(C.read_captures(spark, str(tmp_path / "a.pcap")))), P.FLOW, ["number"], "seq", 1 << 16)
    assert [u.issue for u in V.depacketise(rows, "h265").orderBy("unit").collect()] == ["h265_fu_sequence_gap", "h265_fu_missing_start", "h265_ap_length"]
    size, parts = 60_000, 150
    long = [b"\x7c" + bytes([(0x80 if i == 0 else 0x40 if i == parts - 1 else 0) | 5]) + bytes(size) for i in range(parts)]
    (tmp_path / "b.pcap").write_bytes(pcap([(i, udp(rtp(i, 0, data))) for i, data in enumerate(long)]))
    rows = sequence.unwrap(P.rtp_packets(P.segments(C.read_captures(spark, str(tmp_path / "b.pcap")))), P.FLOW, ["number"], "seq", 1 << 16)
    assert [(len(u.data), u.complete, u.issue, u.first_seq, u.last_seq) for u in V.depacketise(rows).collect()] == [(size * parts + 1, True, None, 0, parts - 1)]
