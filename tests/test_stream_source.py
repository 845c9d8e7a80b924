"""Captures and elementary streams read in small pieces give what whole files give."""

import random

import pytest
from pyspark.errors import PySparkException

from tests.builders import pcap, pcapng
from tracewell.sources.captures import frames_of, split_annex_b
from tracewell.sources import stream
from tracewell.sources.stream import capture_tables, stream_frames, stream_units


def rows_of(df):
    return sorted((r.number is None, r.number or 0, r.ts_us or 0, r.interface or "", bytes(r.data or b""), r.truncated, r.error or "") for r in df.collect())


def whole(spark, content):
    return rows_of(frames_of(spark.createDataFrame([("f", bytearray(content))], "path string, content binary")))


def some_frames(n, seed, zeros=False):
    random.seed(seed)
    return [(1_700_000_000_000_000 + i * 1000, bytes(random.choice([0, 1]) if zeros else random.randrange(256) for _ in range(random.choice([1, 14, 60, 300, 1400])))) for i in range(n)]


@pytest.mark.parametrize("piece", [331, 5000, 1 << 20])
def test_pieces_of_captures(spark, tmp_path, piece):
    for name, content in {
        "little.pcap": pcap(some_frames(30, 1)), "big.pcap": pcap(some_frames(30, 2), order=">", nano=True), "zeros.pcap": pcap(some_frames(30, 3, True)), "empty.pcap": pcap([]),
    }.items():
        file = tmp_path / f"{piece}-{name}"
        file.write_bytes(content)
        assert rows_of(stream_frames(spark, str(file), piece)) == whole(spark, content), name


@pytest.mark.parametrize("piece", [331, 5000, 1 << 20])
def test_pieces_of_block_captures(spark, tmp_path, piece):
    tagged = lambda n, seed, zeros=False: [(i % 2, us, data) for i, (us, data) in enumerate(some_frames(n, seed, zeros))]
    sections = pcapng(tagged(20, 1)) + pcapng(tagged(25, 2), 6, ">") + pcapng(tagged(1, 3), 3) + pcapng([], 6, ">") + pcapng(tagged(30, 4, True), 9, ">")
    for name, content in {"one": pcapng(tagged(60, 5)), "big": pcapng(tagged(60, 6), order=">"), "sections": sections, "empty": pcapng([]), "cut": sections[:-30], "shorter": sections[:-5]}.items():
        (tmp_path / name).write_bytes(content)
        assert rows_of(stream_frames(spark, str(tmp_path / name), piece)) == whole(spark, content), name
    tables = capture_tables(spark, str(tmp_path), piece)
    assert {len(found) for found in tables.values()} == {3, 15} and len(tables) == 6
    parts = stream.FrameReader(str(tmp_path / "sections"), 331, {k: v for k, v in tables.items()}).partitions()
    assert len(parts) > 60


def test_a_block_capture_inside_a_packet_is_not_misread(spark, tmp_path):
    inner = pcapng([(0, us, data) for us, data in some_frames(40, 6)])
    content = pcapng([(0, 1_700_000_000_000_000, inner), *[(1, us, data) for us, data in some_frames(5, 7)]])
    (tmp_path / "nested").write_bytes(content)
    with pytest.raises(PySparkException):
        stream_frames(spark, str(tmp_path / "nested"), 500).collect()
    assert rows_of(stream_frames(spark, str(tmp_path / "nested"), len(content))) == whole(spark, content)


def test_block_captures_and_broken_files(spark, tmp_path):
    frames = [(i % 2, us, data) for i, (us, data) in enumerate(some_frames(50, 4))]
    good = pcapng(frames)
    for name, content in {"good": good, "cut": good[:-7], "short": pcap(some_frames(5, 5))[:-3], "shorter": pcap([*some_frames(5, 5), (1_700_000_000_000_000, b"")])[:-9], "other": b"no capture at all, but long enough" * 40}.items():
        file = tmp_path / name
        file.write_bytes(content)
        assert rows_of(stream_frames(spark, str(file), 300)) == whole(spark, content), name
    assert stream_frames(spark, str(tmp_path), 300).select("capture").distinct().count() == 5


def test_a_capture_inside_a_capture_is_not_misread(spark, tmp_path):
    inner = pcap(some_frames(40, 6))
    content = pcap([(1_700_000_000_000_000, inner), *some_frames(5, 7)])
    (tmp_path / "nested").write_bytes(content)
    with pytest.raises(PySparkException):
        stream_frames(spark, str(tmp_path / "nested"), 500).collect()
    assert rows_of(stream_frames(spark, str(tmp_path / "nested"), len(content))) == whole(spark, content)


@pytest.mark.parametrize("piece", [64, 1000, 1 << 20])
def test_pieces_of_elementary_streams(spark, tmp_path, piece):
    random.seed(8)
    units = [bytes([random.choice([0x41, 0x65])]) + bytes(random.choice([1, 2, 3, 255]) for _ in range(random.choice([1, 5, 50, 700]))) for _ in range(40)]
    content = b"\x09\x00" + b"".join(random.choice([b"\x00\x00\x01", b"\x00\x00\x00\x01"]) + u for u in units) + b"\x00\x00"
    (tmp_path / "s.h264").write_bytes(content)
    rows = stream_units(spark, str(tmp_path / "s.h264"), piece).orderBy("nalu_number").collect()
    assert [bytes(r.data) for r in rows] == split_annex_b(content)
    assert [r.nalu_number for r in rows] == list(range(1, len(units) + 1))
    assert all(content[r.position : r.position + 3] == b"\x00\x00\x01" for r in rows)
