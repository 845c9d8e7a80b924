"""Capture files that still grow, as a stream of frames.

An offset holds, for each file of a folder, the byte behind the last whole
packet and how many packets there were. The driver finds it by stepping over
packet or block headers of what is new; a packet that the file's end cuts waits
for the next batch. Tasks then read one file's new bytes each.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracewell.sources.captures import LONGEST_FRAME, PCAP_MAGIC, PCAPNG_MAGIC, read_pcapng_blocks
from tracewell.sources.stream import BATCH, BATCH_BYTES, _Buffered, _open

#: New bytes of one file that one batch takes, at least one packet.
MOST = 64 << 20
GROWING = "capture string, number bigint, position bigint, ts_us bigint, interface string, link_type int, truncated boolean, data binary, error string"
#: Pcapng blocks that begin a section, describe an interface, and hold a packet.
SECTION, INTERFACE, PACKETS = 0x0A0D0D0A, 1, (2, 3, 6)
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]


class Part(InputPartition):
    def __init__(self, path: str, start: dict, end: dict):
        self.path, self.start, self.end = path, start, end


class _Walk:
    """Steps from one packet or block to the next over a file's headers."""

    def __init__(self, file, at: dict, size: int):
        self.buffer, self.size = _Buffered(file, at.get("bytes", 0)), size
        self.packets, self.order, self.broken = at.get("packets", 0), at.get("order", ""), at.get("broken", False)

    def offset(self) -> dict:
        found = {"bytes": self.buffer.position, "packets": self.packets, "order": self.order}
        return found | {"bytes": self.size, "broken": True} if self.broken else found

    def _skip(self, n: int) -> bool:
        if self.buffer.position + n > self.size or not self.buffer.need(n):
            return False
        self.buffer.take(n)
        return True

    def begin(self) -> bool:
        """At a file's first byte: whether its kind is known yet."""
        if self.buffer.position or self.broken:
            return not self.broken
        if self.size < 24 or not self.buffer.need(24):
            return False
        head = bytes(self.buffer.data[:4])
        if head in PCAP_MAGIC:
            self.order = PCAP_MAGIC[head][0]
            return self._skip(24)
        self.broken = head != PCAPNG_MAGIC
        return not self.broken

    def pcap(self) -> bool:
        if self.buffer.position + 16 > self.size or not self.buffer.need(16):
            return False
        kept = struct.unpack_from(self.order + "I", self.buffer.data, 8)[0]
        self.broken = kept > LONGEST_FRAME
        if self.broken or not self._skip(16 + kept):
            return False
        self.packets += 1
        return True

    def pcapng(self) -> bool:
        if self.buffer.position + 12 > self.size or not self.buffer.need(12):
            return False
        if bytes(self.buffer.data[:4]) == PCAPNG_MAGIC:
            self.order = "<" if bytes(self.buffer.data[8:12]) == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(self.order + "2I", self.buffer.data, 0)
        self.broken = size < 12 or size % 4 > 0 or size > LONGEST_FRAME + 4096
        if self.broken or not self._skip(size):
            return False
        self.packets += kind in PACKETS
        return True


def _walked(path: str, at: dict, size: int, most: int | None) -> dict:
    """The offset behind ``at`` after ``most`` bytes, or as far as whole packets go."""
    store, inside = _open(path)
    with store.open_input_file(inside) as file:
        ng = file.read(4) == PCAPNG_MAGIC
        walk = _Walk(file, at, size)
        begun = at.get("bytes", 0)
        if walk.begin():
            step = walk.pcapng if ng else walk.pcap
            while (most is None or walk.buffer.position - begun < most) and step():
                pass
        return walk.offset()


def _pcap(file, part: Part) -> Iterator[tuple]:
    file.seek(0)
    head = file.read(24)
    order, ticks = PCAP_MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    buffer = _Buffered(file, max(part.start.get("bytes", 0), 24))
    while buffer.position < part.end["bytes"]:
        position = buffer.position
        buffer.need(16)
        seconds, fraction, kept, full = struct.unpack(order + "4I", buffer.take(16))
        if kept > LONGEST_FRAME:
            yield position, None, None, None, None, None, "packet too long"
            return
        buffer.need(kept)
        yield position, seconds * 1_000_000 + fraction * 1_000_000 // ticks, "0", link, kept < full, buffer.take(kept), None


def _pcapng(file, part: Part) -> Iterator[tuple]:
    """Packets of a part; sections and interfaces before it are read again, its other blocks are stepped over."""
    position, start, end = 0, part.start.get("bytes", 0), part.end["bytes"]

    def blocks() -> Iterator[tuple[int, bytes, str]]:
        nonlocal position
        order, at = "<", 0
        while at < end:
            file.seek(at)
            head = file.read(12)
            if head[:4] == PCAPNG_MAGIC:
                order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            kind, size = struct.unpack_from(order + "2I", head)
            if size < 12 or size % 4 or size > LONGEST_FRAME + 4096:
                raise ValueError("block length")
            if at >= start or kind in (SECTION, INTERFACE):
                block = head + file.read(size - 12)
                if struct.unpack(order + "I", block[-4:])[0] != size:
                    raise ValueError("block lengths differ")
                position = at
                yield kind, block[8:-4], order
            at += size

    try:
        for us, interface, link, cut, data in read_pcapng_blocks(blocks()):
            yield position, us, interface, link, cut, data, None
    except (ValueError, struct.error) as error:
        yield position, None, None, None, None, None, str(error)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, log: str | None):
        self.path, self.most, self.log = path, most, log
        #: Where the stream is. Spark asks for the latest offset before it says where it starts, so that only the log tells.
        self.known: dict | None = None
        if log:
            store, inside = _open(log)
            self.known = {}
            if store.get_file_info(inside).is_file:
                with store.open_input_stream(inside) as file:
                    self.known = json.loads(file.read())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, inside = _open(self.path)
        prefix = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        files = store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
        out = dict(self.known or {})
        for info in sorted((f for f in files if f.type == fs.FileType.File and f.size), key=lambda f: f.path):
            path = prefix + info.path
            at = out.get(path, {})
            if not at.get("broken") and info.size > at.get("bytes", 0):
                found = _walked(path, at, info.size, None if self.known is None else self.most)
                if found["bytes"]:
                    out[path] = found
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.known = end
        if self.log:  # before any of it is read, so that the log is never behind what was committed
            store, inside = _open(self.log)
            with store.open_output_stream(inside) as file:
                file.write(json.dumps(end).encode())
        return [Part(path, start.get(path, {}), at) for path, at in end.items() if at["bytes"] > start.get(path, {}).get("bytes", 0)]

    def commit(self, end: dict) -> None:
        self.known = end

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = [p.split()[0] for p in GROWING.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)

        store, inside = _open(part.path)
        with store.open_input_file(inside) as file:
            head = file.read(4)
            if head in PCAP_MAGIC:
                found = _pcap(file, part)
            elif head == PCAPNG_MAGIC:
                found = _pcapng(file, part)
            else:
                found = iter([(0, None, None, None, None, None, "neither pcap nor pcapng")])
            rows, size, number = [], 0, part.start.get("packets", 0)
            for row in found:
                number += 1
                rows.append((part.path, None if row[-1] else number, *row))
                size += len(row[5] or b"")
                if len(rows) == BATCH or size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class GrowingSource(DataSource):
    """``spark.readStream.format("growing_captures")``: frames of the capture files below a folder; options ``most``: bytes of a file in a batch, and ``log``."""

    @classmethod
    def name(cls) -> str:
        return "growing_captures"

    def schema(self) -> str:
        return GROWING

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("most", MOST)), self.options.get("log"))


def growing_frames(spark: SparkSession, path: str, most: int = MOST, log: str | None = None) -> DataFrame:
    """Frames of the captures below a folder, as they are written, in the form of ``stream_frames``.

    Every packet comes once, whole, also after a restart from the checkpoint. A
    batch takes up to ``most`` new bytes of each file; ``log`` names a file, one
    for each query and beside its checkpoint, that says where the stream is, and
    without it the first batch after a start takes all there is. A file that isn't a capture, or whose headers
    are broken, gives one row with its error and is left alone from then on.
    Offsets have an entry for each file of the folder, so move finished ones away.
    """
    spark.dataSource.register(GrowingSource)
    options = {"most": most} | ({"log": log} if log else {})
    return spark.readStream.format("growing_captures").options(**options).load(path)
