"""Captures and elementary streams as a Spark data source: files are read in pieces by many tasks, never whole.

A pcap file is cut at byte offsets. A task finds the first packet of its piece
by looking for a place from which several packet headers follow each other, and
reads on until it has the last packet that begins before its piece's end. It then
looks for the next piece's first packet the same way: if that isn't where its
own last one ends (as in a capture that carries another one's bytes), the read
fails and asks for pieces as large as the file. Elementary
streams are cut the same way at start codes.

pcapng files are cut where several blocks follow each other, whose lengths stand
at both of their ends. Their packets refer to sections and interfaces anywhere
before them: a first pass over the pieces gathers only the blocks of these, a
few per file, and each piece of the second pass is told those that stand before
it.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewell.sources.captures import BATCH, INTERFACE, LONGEST_FRAME, PCAP_MAGIC, PCAPNG_MAGIC, SECTION, read_pcapng_blocks

#: Bytes of a piece, of a read, and of an Arrow batch; headers that have to follow each other; seconds that times may lie apart.
PIECE, READ, BATCH_BYTES, CHAIN, APART = 128 << 20, 1 << 20, 8 << 20, 4, 366 * 86_400
FRAME_FIELDS = "capture string, split bigint, position bigint, ts_us bigint, interface string, link_type int, truncated boolean, data binary, error string"
TABLE_FIELDS = "capture string, position bigint, byte_order string, kind bigint, body binary"
#: Kinds of pcapng blocks that applications make up; others are small numbers, sections, or have the first bit set.
CUSTOM_BLOCKS = (0x0BAD, 0x40000BAD)
#: Sections and interfaces of all captures together that the driver holds.
MOST_TABLES = 1_000_000
UNIT_FIELDS = "path string, split bigint, position bigint, data binary"


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size
        #: Sections and interfaces of a pcapng file: (position, byte order, kind, body), in order.
        self.tables: list[tuple[int, str, int, bytes]] = []


def _open(path: str):
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, inside


def _pieces(path: str, size: int, whole: bool = False) -> list[Piece]:
    """Pieces of all files at or below a path."""
    from pyarrow import fs

    store, inside = _open(path)
    found = store.get_file_info(inside)
    files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    out = []
    for info in sorted((f for f in files if f.type == fs.FileType.File and f.size), key=lambda f: f.path):
        step = info.size if whole else size
        out += [Piece(prefix + info.path, at, min(at + step, info.size), info.size) for at in range(0, info.size, step)]
    return out


class _Buffered:
    """A file from a position on, read in steps; ``need`` makes sure that so many bytes are at hand."""

    def __init__(self, file, position: int, step: int = READ):
        self.file, self.position, self.step, self.data = file, position, step, bytearray()
        file.seek(position)

    def need(self, n: int) -> bool:
        while len(self.data) < n:
            more = self.file.read(max(self.step, n - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def take(self, n: int) -> bytes:
        out = bytes(self.data[:n])
        del self.data[:n]
        self.position += n
        return out


def _plausible(buffer: _Buffered, at: int, order: str, first: int, left: int) -> bool:
    """Whether packet headers follow each other from byte ``at`` of the buffer on, up to the file's end or ``CHAIN`` of them.

    The file may end inside a packet, but not inside the first one.
    """
    for n in range(CHAIN):
        if at + 16 > left or not buffer.need(at + 16):
            return n > 0
        seconds, _, kept, full = struct.unpack_from(order + "4I", buffer.data, at)
        if not 0 < full <= LONGEST_FRAME or kept > full or abs(seconds - first) > APART:
            return False
        at += 16 + kept
        if at > left:
            return n > 0
    return True


def _first_packet(buffer: _Buffered, end: int, order: str, first: int, size: int) -> None:
    """Move to the first packet header that begins before ``end``, or to ``end``."""
    at = 0
    while buffer.position + at < end and not _plausible(buffer, at, order, first, size - buffer.position):
        at += 1
    buffer.need(at)
    buffer.take(at)


def _pcap_rows(file, piece: Piece, head: bytes) -> Iterator[tuple]:
    order, ticks = PCAP_MAGIC[head[:4]]
    if len(head) < 24:
        yield piece.start, None, None, None, None, None, "short file header"
        return
    link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    first = struct.unpack(order + "I", head[24:28])[0] if len(head) >= 28 else 0
    buffer = _Buffered(file, max(piece.start, 24))
    if piece.start > 24:
        _first_packet(buffer, piece.end, order, first, piece.size)
    begun = False
    while buffer.position < piece.end:
        position, begun = buffer.position, True
        if not buffer.need(16):
            yield position, None, None, None, None, None, "short packet header"
            return
        seconds, part, kept, full = struct.unpack(order + "4I", buffer.take(16))
        if kept > LONGEST_FRAME or not buffer.need(kept):
            yield position, None, None, None, None, None, "packet ends after the file"
            return
        yield position, seconds * 1_000_000 + part * 1_000_000 // ticks, "0", link, kept < full, buffer.take(kept), None
    left = piece.size - buffer.position
    if not begun or not left:
        return
    # What follows begins in a later piece, which can't tell a packet that the file cuts short.
    if not buffer.need(16):
        yield buffer.position, None, None, None, None, None, "short packet header"
    elif (kept := struct.unpack_from(order + "I", buffer.data, 8)[0]) > LONGEST_FRAME or not buffer.need(16 + kept):
        yield buffer.position, None, None, None, None, None, "packet ends after the file"
    else:
        following = _Buffered(file, max(piece.end, 24))
        _first_packet(following, buffer.position + 1, order, first, piece.size)
        if following.position != buffer.position:
            raise ValueError(f"{piece.path}: pieces don't meet at byte {buffer.position}; read it with a piece of {piece.size} bytes")


def _block_size(buffer: _Buffered, at: int, order: str) -> tuple[int, str]:
    """The length of the block at byte ``at`` of the buffer and its byte order; 0 where its two lengths say something else."""
    if not buffer.need(at + 12):
        return 0, order
    if bytes(buffer.data[at : at + 4]) == PCAPNG_MAGIC:
        order = "<" if bytes(buffer.data[at + 8 : at + 12]) == b"\x4d\x3c\x2b\x1a" else ">"
    size = struct.unpack_from(order + "I", buffer.data, at + 4)[0]
    if size < 12 or size % 4 or size > LONGEST_FRAME + 4096 or not buffer.need(at + size):
        return 0, order
    return (size if struct.unpack_from(order + "I", buffer.data, at + size - 4)[0] == size else 0), order


def _first_block(buffer: _Buffered, end: int, orders: str) -> str:
    """Move to the first block that begins before ``end``, or to ``end``; returns its byte order.

    A block has whole ones behind it, ``CHAIN`` with itself, but for the file's end.
    """

    def follows(at: int, order: str) -> bool:
        for n in range(CHAIN):
            if not buffer.need(at + 12):
                return n > 0
            size, order = _block_size(buffer, at, order)
            kind, said = struct.unpack_from(order + "2I", buffer.data, at)
            if not (0 < kind < 0x210 or kind == SECTION or kind & 0x7FFFFFFF in CUSTOM_BLOCKS or kind >> 31):
                return False
            if not size:
                return n > 0 and 12 <= said <= LONGEST_FRAME + 4096 and not said % 4 and not buffer.need(at + said)
            at += size
        return True

    at = -buffer.position % 4
    while buffer.position + at < end:
        for order in orders:
            if follows(at, order):
                buffer.take(at)
                return order
        at += 4
    buffer.need(at)
    buffer.take(at)
    return orders[0]


def _piece_blocks(file, piece: Piece, orders: str) -> Iterator[tuple[int, int, bytes, str]]:
    """(position, kind, body, byte order) of the blocks that begin inside a piece; a broken one is an error."""
    buffer, order, begun = _Buffered(file, piece.start), orders[0], False
    if piece.start:
        order = _first_block(buffer, piece.end, orders)
    while buffer.position < piece.end and buffer.need(1):
        position, begun = buffer.position, True
        size, order = _whole_block(buffer, order)
        block = buffer.take(size)
        yield position, struct.unpack(order + "I", block[:4])[0], block[8:-4], order
    if not begun or not buffer.need(1):
        return
    # What follows begins in a later piece, which can't tell a block that the file cuts short.
    _whole_block(buffer, order)
    following = _Buffered(file, piece.end)
    _first_block(following, buffer.position + 1, order)
    if following.position != buffer.position:
        raise RuntimeError(f"{piece.path}: pieces don't meet at byte {buffer.position}; read it with a piece of {piece.size} bytes")


def _whole_block(buffer: _Buffered, order: str) -> tuple[int, str]:
    """The length and byte order of the block that begins here, or an error that says why there is none."""
    if not buffer.need(12):
        raise ValueError("short block")
    size, order = _block_size(buffer, 0, order)
    if not size:
        said = struct.unpack_from(order + "I", buffer.data, 4)[0]
        whole = 12 <= said <= LONGEST_FRAME + 4096 and not said % 4 and buffer.need(said)
        raise ValueError("block lengths differ" if whole else "block ends after the file")
    return size, order


def _pcapng_rows(file, piece: Piece) -> Iterator[tuple]:
    """Packets of a piece, by the sections and interfaces that stand before it and in it."""
    position = piece.start
    tables = piece.tables[: bisect.bisect_left([t[0] for t in piece.tables], piece.start)]
    sections = [i for i, (_, _, kind, _) in enumerate(tables) if kind == SECTION]
    order = tables[-1][1] if tables else "<"

    def blocks() -> Iterator[tuple[int, bytes, str]]:
        nonlocal position
        for i, (_, its_order, kind, body) in enumerate(tables):
            if kind == SECTION or sections and i > sections[-1]:
                yield kind, body, its_order
        for position, kind, body, its_order in _piece_blocks(file, piece, order):
            yield kind, body, its_order

    try:
        for us, interface, link, cut, data in read_pcapng_blocks(blocks()):
            yield position, us, interface, link, cut, data, None
    except (ValueError, struct.error) as error:
        yield position, None, None, None, None, None, str(error)


def _is_pcapng(path: str) -> bool:
    store, inside = _open(path)
    with store.open_input_file(inside) as file:
        return file.read(4) == PCAPNG_MAGIC


class TableReader(DataSourceReader):
    """Sections and interfaces of pcapng files; nothing else of them leaves the tasks."""

    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def partitions(self) -> list[Piece]:
        files: dict[str, bool] = {}
        pieces = _pieces(self.path, self.piece)
        for piece in pieces:
            if piece.path not in files:
                files[piece.path] = _is_pcapng(piece.path)
        return [piece for piece in pieces if files[piece.path]]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # Spark asks once where there are no pieces
            return
        store, inside = _open(piece.path)
        rows = []
        with store.open_input_file(inside) as file:
            try:
                for position, kind, body, order in _piece_blocks(file, piece, "<>"):
                    if kind in (SECTION, INTERFACE):
                        rows.append((piece.path, position, order, kind, body))
            except (ValueError, struct.error):
                pass  # the second pass says what is broken
        if rows:
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[p.split()[0] for p in TABLE_FIELDS.split(", ")])


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_tables"

    def schema(self) -> str:
        return TABLE_FIELDS

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"], int(self.options.get("piece", PIECE)))


class FrameReader(DataSourceReader):
    def __init__(self, path: str, piece: int, tables: dict | None):
        self.path, self.piece, self.tables = path, piece, tables

    def partitions(self) -> list[Piece]:
        """Pieces of all files; pcapng files of which no tables are known are one piece each."""
        out, seen = [], {}
        for piece in _pieces(self.path, self.piece):
            if piece.path not in seen:
                seen[piece.path] = _is_pcapng(piece.path)
            known = (self.tables or {}).get(piece.path)
            if not seen[piece.path] or known is not None:
                piece.tables = [(at, order, kind, base64.b64decode(body)) for at, order, kind, body in known or []]
                out.append(piece)
            elif piece.start == 0:
                out.append(Piece(piece.path, 0, piece.size, piece.size))
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, inside = _open(piece.path)
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
        names = [part.split()[0] for part in FRAME_FIELDS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[piece.path] * len(rows), [piece.start] * len(rows), *zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        with store.open_input_file(inside) as file:
            head = file.read(28)
            if head[:4] == PCAPNG_MAGIC:
                found = _pcapng_rows(file, piece)
            elif head[:4] in PCAP_MAGIC:
                found = _pcap_rows(file, piece, head)
            else:
                found = iter([(0, None, None, None, None, None, "neither pcap nor pcapng")] if piece.start == 0 else [])
            rows, size = [], 0
            for row in found:
                rows.append(row)
                size += len(row[5] or b"")
                if len(rows) == BATCH or size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class FrameSource(DataSource):
    """``spark.read.format("capture")``: frames of pcap and pcapng files at or below a path.

    Option ``piece``: bytes of a piece; ``tables``: what ``capture_tables`` found, as JSON, without which a pcapng file is one piece.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return FRAME_FIELDS

    def reader(self, schema) -> FrameReader:
        tables = self.options.get("tables")
        return FrameReader(self.options["path"], int(self.options.get("piece", PIECE)), json.loads(tables) if tables else None)


class UnitReader(DataSourceReader):
    CODE = re.compile(b"\x00\x00\x01")

    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def partitions(self) -> list[Piece]:
        return _pieces(self.path, self.piece)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, inside = _open(piece.path)
        with store.open_input_file(inside) as file:
            buffer, rows, size = _Buffered(file, piece.start, min(READ, max(self.piece, 64))), [], 0
            if not self._to_code(buffer, piece.end):
                return
            while buffer.position < piece.end:
                position, at = buffer.position, 3
                while not (code := self.CODE.search(buffer.data, at)):
                    at = max(len(buffer.data) - 2, 3)
                    if not buffer.need(len(buffer.data) + 1):
                        break
                unit = buffer.take(code.start() if code else len(buffer.data))[3:].rstrip(b"\x00")
                if unit:
                    rows.append((piece.path, piece.start, position, unit))
                    size += len(unit)
                if len(rows) == BATCH or size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
                if not code:
                    break
            if rows:
                yield self._batch(rows)

    def _to_code(self, buffer: _Buffered, end: int) -> bool:
        """Move to the first start code that begins before ``end``."""
        while buffer.position < end:
            buffer.need(READ)
            if code := self.CODE.search(buffer.data):
                buffer.take(code.start())
                return buffer.position < end
            if len(buffer.data) < 3:
                return False
            buffer.take(len(buffer.data) - 2)
        return False

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[p.split()[0] for p in UNIT_FIELDS.split(", ")])


class UnitSource(DataSource):
    """``spark.read.format("annex_b")``: units of H.264 and H.265 elementary streams at or below a path; option ``piece``."""

    @classmethod
    def name(cls) -> str:
        return "annex_b"

    def schema(self) -> str:
        return UNIT_FIELDS

    def reader(self, schema) -> UnitReader:
        return UnitReader(self.options["path"], int(self.options.get("piece", PIECE)))


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows numbered from 1 by position inside each file: counts per piece are added up, rows are sorted inside pieces."""
    counts = rows.groupBy(key, "split").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(key, "split", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "split").orderBy("position"))
    return rows.withColumn("_in", inside).join(starts, [key, "split"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in")


def capture_tables(spark: SparkSession, path: str, piece: int = PIECE) -> dict[str, list[tuple]]:
    """Sections and interfaces of the pcapng files at or below a path, by file, in order; the driver holds them."""
    spark.dataSource.register(TableSource)
    found = spark.read.format("capture_tables").option("piece", piece).load(path).limit(MOST_TABLES + 1).collect()
    if len(found) > MOST_TABLES:
        raise ValueError(f"more than {MOST_TABLES} sections and interfaces; read fewer files at once")
    out: dict[str, list[tuple]] = {}
    for row in sorted(found, key=lambda r: (r.capture, r.position)):
        out.setdefault(row.capture, []).append((row.position, row.byte_order, row.kind, base64.b64encode(row.body).decode()))
    return out


def stream_frames(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """Frames of captures with their numbers, in the form of ``captures.read_captures``; a broken file ends in a row with its error.

    Where there are pcapng files, their sections and interfaces are read at once.
    """
    spark.dataSource.register(FrameSource)
    tables = capture_tables(spark, path, piece)
    reader = spark.read.format("capture").option("piece", piece)
    rows = _numbered((reader.option("tables", json.dumps(tables)) if tables else reader).load(path), "capture", "_number")
    number = F.when(F.col("error").isNull(), F.col("_number")).alias("number")
    return rows.select("capture", number, "ts_us", "interface", "link_type", "truncated", "data", "error")


def stream_units(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(path, nalu_number, position, data): units of elementary streams, with the byte at which their start code begins."""
    spark.dataSource.register(UnitSource)
    rows = _numbered(spark.read.format("annex_b").option("piece", piece).load(path), "path", "nalu_number")
    return rows.select("path", "nalu_number", "position", "data")
