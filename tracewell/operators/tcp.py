"""TCP streams: reassembly by window functions, and the messages that interleave on them.

Reassembly sorts the segments of a direction by their unfolded sequence number
and keeps of each what lies beyond all before it. Messages are cut out by one
fold over a direction's pieces, whose state is the unfinished message.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import signed_wrap

SYN, ACK = 2, 16
DIRECTION = ["capture", "interface", "src_ip", "src_port", "dst_ip", "dst_port"]
STREAM = [*DIRECTION, "connection"]
#: The longest message and the longest header, and the methods of RTSP.
LONGEST, LONGEST_HEADER = 256 << 10, 64 << 10
METHODS = ["OPTIONS", "DESCRIBE", "ANNOUNCE", "SETUP", "PLAY", "PAUSE", "RECORD", "REDIRECT", "TEARDOWN", "GET_PARAMETER", "SET_PARAMETER"]
_BEGIN = re.compile(b"RTSP/1\\.0 |(?:%s) " % b"|".join(m.encode() for m in METHODS))
_ANYWHERE = re.compile(b"\\$|" + _BEGIN.pattern)


def connections(segments: DataFrame) -> DataFrame:
    """Segments with ``connection``: 1, 2 and so on of the same two endpoints.

    A SYN without ACK whose sequence number differs from the last one's opens the next.
    """
    ends = [F.concat_ws("|", f"{side}_ip", F.lpad(F.col(f"{side}_port").cast("string"), 5, "0")) for side in ("src", "dst")]
    opening = (F.col("tcp_flags").bitwiseAND(SYN | ACK) == SYN)
    w = Window.partitionBy("capture", "interface", "_low", "_high").orderBy("number")
    last = F.last(F.when(F.col("_opening"), F.col("tcp_seq")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.filter("proto = 'tcp'").withColumns(
        {"_low": F.least(*ends), "_high": F.greatest(*ends), "_opening": opening}
    )
    rows = rows.withColumn("_new", (F.col("_opening") & (last.isNull() | (last != F.col("tcp_seq")))).cast("int"))
    return rows.withColumn("connection", F.greatest(F.sum("_new").over(w), F.lit(1))).drop("_low", "_high", "_opening", "_new")


def reassemble(segments: DataFrame) -> DataFrame:
    """The bytes of each direction of each connection, in order and each once.

    Columns: the stream, pos (from its first byte), number and ts_us of the
    segment, data, gap (bytes missing before it) and retransmitted (bytes of
    the segment that were there already). Of two segments with one position
    the longer wins. A SYN counts as one byte before the first.
    """
    rows = connections(segments)
    arrival = Window.partitionBy(*STREAM).orderBy("number")
    begins = F.col("tcp_seq") + F.when(F.col("tcp_flags").bitwiseAND(SYN) > 0, 1).otherwise(0)
    rows = rows.withColumn("_begin", begins % (1 << 32))
    step = F.coalesce(signed_wrap(F.col("_begin") - F.lag("_begin").over(arrival), 1 << 32), F.lit(0))
    rows = rows.withColumn("_step", step.cast("bigint")).withColumn("_pos", F.sum("_step").over(arrival))
    first = F.min(F.when(F.col("tcp_flags").bitwiseAND(SYN) > 0, F.col("_pos"))).over(Window.partitionBy(*STREAM))
    full = rows.withColumn("_first", first).filter(F.octet_length("payload") > 0)
    low = F.coalesce(F.col("_first"), F.min("_pos").over(Window.partitionBy(*STREAM)))
    full = full.withColumn("_at", F.col("_pos") - low).withColumn("_end", F.col("_at") + F.octet_length("payload"))
    sorted_by = Window.partitionBy(*STREAM).orderBy("_at", F.desc("_end"), "number")
    reached = F.coalesce(F.max("_end").over(sorted_by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = full.withColumn("_reached", reached).withColumn("pos", F.greatest("_at", "_reached")).filter(F.col("_end") > F.col("pos"))
    return kept.select(
        *STREAM,
        "pos",
        "number",
        "ts_us",
        F.substring(F.col("payload"), (F.col("pos") - F.col("_at") + 1).cast("int"), F.octet_length("payload")).alias("data"),
        (F.col("pos") - F.col("_reached")).alias("gap"),
        (F.col("pos") - F.col("_at")).alias("retransmitted"),
    )


class Interleaved:
    """Cuts RTSP messages and ``$`` frames out of one direction; what fits neither is skipped and counted."""

    def __init__(self) -> None:
        self.buffer, self.spans, self.skipped = bytearray(), [], 0

    def _drop(self, n: int, skipped: bool = True) -> None:
        self.skipped += n if skipped else 0
        del self.buffer[:n]
        while n and self.spans:
            size, meta = self.spans[0]
            if size > n:
                self.spans[0] = (size - n, meta)
                return
            n -= size
            self.spans.pop(0)

    def _message(self, kind: str, channel: int | None, size: int, head: int) -> tuple:
        meta, skipped = self.spans[0][1], self.skipped
        data = bytes(self.buffer[head:size])
        self._drop(size, False)
        self.skipped = 0
        return (*meta, kind, channel, data, skipped)

    def push(self, data: bytes, gap: bool, meta: tuple) -> Iterator[tuple]:
        """(number, ts_us, kind, channel, data, skipped) of the messages that are complete now."""
        if gap:
            self._drop(len(self.buffer))
        self.spans.append((len(data), meta))
        self.buffer += data
        if len(self.buffer) > LONGEST:
            self._drop(len(self.buffer))
        while self.buffer:
            if self.buffer[0] == 0x24:
                if len(self.buffer) < 4:
                    return
                size = 4 + int.from_bytes(self.buffer[2:4], "big")
                if size < 8 or len(self.buffer) > 4 and self.buffer[4] >> 6 != 2:
                    self._drop(1)
                elif len(self.buffer) < size:
                    return
                else:
                    yield self._message("interleaved", self.buffer[1], size, 4)
            elif _BEGIN.match(self.buffer):
                head = self.buffer.find(b"\r\n\r\n") + 4
                if head < 4:
                    if len(self.buffer) > LONGEST_HEADER:
                        self._drop(len(self.buffer))
                    return
                length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", self.buffer[:head])
                size = head + (int(length[1]) if length else 0)
                if size > LONGEST:
                    self._drop(len(self.buffer))
                elif len(self.buffer) < size:
                    return
                else:
                    yield self._message("rtsp", None, size, 0)
            else:
                if len(self.buffer) < 16:
                    return
                found = _ANYWHERE.search(self.buffer, 1)
                self._drop(found.start() if found else len(self.buffer) - 15)

    def finish(self) -> Iterator[tuple]:
        """At the end of the stream: a header with its CSeq, though it isn't ended and no body can follow."""
        text = bytes(self.buffer).lower()
        if _BEGIN.match(self.buffer) and b"cseq:" in text and b"content-length:" not in text:
            yield self._message("rtsp_cut", None, len(self.buffer), 0)


class SipFraming(Interleaved):
    """Cuts SIP messages out of one direction; line breaks between messages are skipped."""

    START = re.compile(rb"SIP/2\.0 \d{3} |[A-Z]{2,20} [^\r\n ]{1,512} SIP/2\.0\r\n")
    LARGEST, PATIENCE = 1 << 20, 64

    def push(self, data: bytes, gap: bool, meta: tuple) -> Iterator[tuple]:
        if gap:
            self._drop(len(self.buffer))
        self.spans.append((len(data), meta))
        self.buffer += data
        if len(self.buffer) > self.LARGEST:
            self._drop(len(self.buffer))
        while self.buffer:
            if self.buffer[:2] in (b"\r\n", b"\r"):
                if len(self.buffer) < 2:
                    return
                self._drop(2, False)
            elif self.START.match(self.buffer):
                head = self.buffer.find(b"\r\n\r\n") + 4
                length = re.search(rb"(?im)^(?:content-length|l)[ \t]*:[ \t]*(\d+)[ \t]*\r?$", self.buffer[: max(head, 0)])
                size = head + (int(length[1]) if length else 0)
                if head < 4 or len(self.buffer) < size:
                    return
                yield self._message("sip", None, size, 0)
            else:
                found = self.START.search(self.buffer, 1)
                if not found and len(self.buffer) <= self.PATIENCE:
                    return
                self._drop(found.start() if found else len(self.buffer) - self.PATIENCE)

    def finish(self) -> Iterator[tuple]:
        return iter(())


def messages(chunks: DataFrame, framing: type[Interleaved] = Interleaved) -> DataFrame:
    """Messages of reassembled streams: the stream, message (from 1), number and ts_us of the first byte, kind, channel, data, skipped.

    kind: rtsp, interleaved, rtsp_cut (a header that the stream's end cuts) or
    sip. skipped counts the bytes before the message that belong to none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    fields = ", ".join(f"{n} {kinds[n]}" for n in STREAM)
    fields += ", message bigint, number bigint, ts_us bigint, kind string, channel int, data binary, skipped bigint"
    names = [part.split()[0] for part in fields.split(", ")]
    tail = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, open_one, schema, count = None, framing(), None, itertools.count(1)
        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(n) for n in STREAM], *map(pa.field, names[len(STREAM) :], tail)])
            keys = list(zip(*[batch.column(n).to_pylist() for n in STREAM]))
            values = zip(*[batch.column(n).to_pylist() for n in ("data", "gap", "number", "ts_us")])
            rows = []
            for key, (data, gap, number, ts_us) in zip(keys, values):
                if key != stream:
                    rows += [(*stream, next(count), *m) for m in open_one.finish()] if stream else []
                    stream, open_one, count = key, framing(), itertools.count(1)
                rows += [(*key, next(count), *m) for m in open_one.push(data, gap > 0, (number, ts_us))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if stream and (rows := [(*stream, next(count), *m) for m in open_one.finish()]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ordered = chunks.select(*STREAM, "pos", "number", "ts_us", "data", "gap").repartition(*STREAM).sortWithinPartitions(*STREAM, "pos")
    return ordered.mapInArrow(run, fields)


def stream_statistics(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per direction: segments with data, bytes received and kept, gaps, missing and retransmitted bytes."""
    received = (
        connections(segments)
        .filter(F.octet_length("payload") > 0)
        .groupBy(*STREAM)
        .agg(F.count(F.lit(1)).alias("segments"), F.sum(F.octet_length("payload")).alias("received"))
    )
    kept = chunks.groupBy(*STREAM).agg(
        F.sum(F.octet_length("data")).alias("bytes"),
        F.count_if(F.col("gap") > 0).alias("gaps"),
        F.sum("gap").alias("missing"),
    )
    return received.join(kept, STREAM, "left").withColumn("retransmitted", F.col("received") - F.coalesce("bytes", F.lit(0)))
