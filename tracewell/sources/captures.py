"""Packet captures as tables of frames. Files are read by Spark; each file is parsed by one task."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: magic numbers (byte order, ticks per second) and block types.
PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, PACKET, SIMPLE_PACKET, ENHANCED_PACKET = 0x0A0D0D0A, 1, 2, 3, 6
LONGEST_FRAME = 16 << 20
BATCH = 4096

FRAMES = "capture string, number bigint, ts_us bigint, interface string, link_type int, truncated boolean, data binary, error string"


def _pcap(content: bytes) -> Iterator[tuple]:
    order, ticks = PCAP_MAGIC[content[:4]]
    if len(content) < 24:
        raise ValueError("short file header")
    link = struct.unpack(order + "I", content[20:24])[0] & 0xFFFF
    at, number = 24, 0
    while at < len(content):
        if at + 16 > len(content):
            raise ValueError("short packet header")
        seconds, part, kept, full = struct.unpack(order + "4I", content[at : at + 16])
        at += 16
        if kept > LONGEST_FRAME or at + kept > len(content):
            raise ValueError("packet ends after the file")
        number += 1
        yield number, seconds * 1_000_000 + part * 1_000_000 // ticks, "0", link, kept < full, content[at : at + kept]
        at += kept


def _options(body: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(body):
        code, size = struct.unpack(order + "2H", body[at : at + 4])
        if code == 0:
            break
        out[code] = body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4
    return out


def _blocks(content: bytes) -> Iterator[tuple[int, bytes, str]]:
    """(kind, body, byte order) of the blocks of a pcapng file."""
    at, order = 0, "<"
    while at < len(content):
        if at + 12 > len(content):
            raise ValueError("short block")
        if content[at : at + 4] == PCAPNG_MAGIC:
            order = "<" if content[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack(order + "2I", content[at : at + 8])
        if size < 12 or size % 4 or at + size > len(content):
            raise ValueError("block ends after the file")
        if struct.unpack(order + "I", content[at + size - 4 : at + size])[0] != size:
            raise ValueError("block lengths differ")
        yield kind, content[at + 8 : at + size - 4], order
        at += size


def read_pcapng_blocks(blocks: Iterator[tuple[int, bytes, str]]) -> Iterator[tuple]:
    """(ts_us, interface, link_type, truncated, data) of the packets in blocks."""
    section, interfaces = -1, []
    for kind, body, order in blocks:
        if kind == SECTION:
            interfaces, section = [], section + 1
        elif kind == INTERFACE:
            options = _options(body[8:], order)
            unit = options.get(9, b"\x06")[0]
            ticks = 2 ** (unit & 0x7F) if unit & 0x80 else 10**unit
            offset = struct.unpack(order + "q", options[14])[0] if len(options.get(14, b"")) == 8 else 0
            interfaces.append((struct.unpack(order + "H", body[:2])[0], ticks, offset))
        elif kind == SIMPLE_PACKET:
            raise ValueError("packets without a time")
        elif kind in (ENHANCED_PACKET, PACKET):
            if kind == ENHANCED_PACKET:
                index, high, low, kept, full = struct.unpack(order + "5I", body[:20])
            else:
                index, _, high, low, kept, full = struct.unpack(order + "2H4I", body[:20])
            if index >= len(interfaces) or kept > LONGEST_FRAME or 20 + kept > len(body):
                raise ValueError("packet of no interface or beyond its block")
            link, ticks, offset = interfaces[index]
            us = (high << 32 | low) * 1_000_000 // ticks + offset * 1_000_000
            yield us, f"{section}:{index}", link, kept < full, body[20 : 20 + kept]


def _pcapng(content: bytes) -> Iterator[tuple]:
    for number, row in enumerate(read_pcapng_blocks(_blocks(content)), 1):
        yield number, *row


def parse_capture(content: bytes) -> Iterator[tuple]:
    """(number, ts_us, interface, link_type, truncated, data) of a pcap or pcapng file."""
    if content[:4] == PCAPNG_MAGIC:
        return _pcapng(content)
    if content[:4] in PCAP_MAGIC:
        return _pcap(content)
    raise ValueError("neither pcap nor pcapng")


def frames_of(files: DataFrame) -> DataFrame:
    """Frames of files given as (path, content); a broken file ends in a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in FRAMES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                try:
                    for row in parse_capture(content.as_py()):
                        rows.append((path.as_py(), *row, None))
                        if len(rows) == BATCH:
                            yield batch_of(rows)
                            rows = []
                except (ValueError, struct.error) as error:
                    rows.append((path.as_py(), None, None, None, None, None, None, str(error)))
                if rows:
                    yield batch_of(rows)

    return files.select("path", "content").mapInArrow(run, FRAMES)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all captures below ``path``; for small files, which Spark reads whole. See ``stream.stream_frames``."""
    return frames_of(spark.read.format("binaryFile").load(path))


def read_annex_b(spark: SparkSession, path: str) -> DataFrame:
    """(path, nalu_number, data) of H.264 or H.265 elementary streams; start codes have 3 or 4 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                units = split_annex_b(content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(units)), pa.array(range(1, len(units) + 1), pa.int64()), pa.array(units, pa.binary())],
                    names=["path", "nalu_number", "data"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, nalu_number bigint, data binary")


def split_annex_b(content: bytes) -> list[bytes]:
    """The units between start codes, without trailing zeros; empty ones are left out."""
    parts = content.split(b"\x00\x00\x01")[1:]
    return [unit for part in parts if (unit := part.rstrip(b"\x00"))]


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, channels, rate, pcm, error): 16-bit PCM samples of RIFF files, interleaved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at, kind, pcm = 12, None, None
                while content[:4] == b"RIFF" and content[8:12] == b"WAVE" and at + 8 <= len(content):
                    size = struct.unpack("<I", content[at + 4 : at + 8])[0]
                    body = content[at + 8 : at + 8 + size]
                    if content[at : at + 4] == b"fmt " and size >= 16:
                        kind = struct.unpack("<2H2I2H", body[:16])
                    elif content[at : at + 4] == b"data":
                        pcm = np.frombuffer(body[: len(body) // 2 * 2], "<i2")
                    at += 8 + size + size % 2
                good = kind is not None and pcm is not None and kind[0] == 1 and kind[5] == 16
                rows.append((name, kind[1], kind[2], pcm, None) if good else (name, None, None, None, "not 16-bit PCM"))
            types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types],
                names=["path", "channels", "rate", "pcm", "error"],
            )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, channels int, rate int, pcm array<smallint>, error string")
