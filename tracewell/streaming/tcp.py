"""TCP streams as they arrive: reassembly and the messages on them, with what waits kept as state.

One key holds both directions between two endpoints, as a new connection begins
for both. What came too early waits as one map entry per segment; a hole is
given up after two seconds of capture time, by the next segment or by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.tcp import ACK, SYN, Interleaved

FIN, RST = 1, 4
#: How long the first segment may be waited for, and a hole (microseconds); how much may wait.
FIRST_US, HOLE_US = 200_000, 2_000_000
FIRST_SEGMENTS, FIRST_BYTES, MOST_SEGMENTS, MOST_BYTES = 16, 64 << 10, 256, 256 << 10
#: A connection without segments for so long is forgotten (milliseconds).
IDLE_MS = 600_000

_KEY = ["capture", "interface", "low", "high"]
MESSAGES = (
    "capture string, interface string, src_ip string, src_port bigint, dst_ip string, dst_port bigint, connection bigint, message bigint, "
    "number bigint, ts_us bigint, kind string, channel int, data binary, skipped bigint, gaps bigint, late bigint"
)
_Message = Row(*[part.split()[0] for part in MESSAGES.split(", ")])
_LINK = "connection bigint, syn bigint, closed boolean"
_SIDE = (
    "first bigint, next bigint, last bigint, fin bigint, gaps bigint, late bigint, count bigint, skipped bigint, buffer binary, "
    "sizes array<bigint>, numbers array<bigint>, times array<bigint>"
)


@dataclass
class Side:
    """One direction: ``first`` is the sequence number at position 0, ``next`` the position that comes next, if that is known."""

    first: int | None = None
    next: int | None = None
    last: int = 0
    fin: int | None = None
    gaps: int = 0
    late: int = 0
    count: int = 0
    framing: Interleaved = field(default_factory=Interleaved)
    held: dict[int, tuple[bytes, int, int]] = field(default_factory=dict)

    def place(self, sequence: int) -> int:
        """The position of a sequence number: the nearest to where the side is now."""
        if self.first is None:
            self.first = sequence
        here = self.last if self.next is None else self.next
        step = (sequence - self.first - here) % (1 << 32)
        return here + (step - (1 << 32) if step >= 1 << 31 else step)

    def take(self, sequence: int, flags: int, data: bytes, number: int, ts_us: int) -> None:
        at = self.place((sequence + bool(flags & SYN)) % (1 << 32))
        self.last = at
        if flags & SYN and self.next is None:
            self.next = at
        if flags & FIN:
            self.fin = at + len(data)
        if data:
            known = max((self.next or at) - at, 0) if self.next is not None else 0
            if known and self.gaps:
                self.late += min(known, len(data))
            data, at = data[known:], at + known
            if data and len(self.held.get(at, (b"",))[0]) < len(data):
                self.held[at] = (data, number, ts_us)

    def _ripe(self, now: int, waited: int, segments: int, size: int) -> bool:
        oldest = min(ts for _, _, ts in self.held.values())
        return now - oldest >= waited or len(self.held) >= segments or sum(len(d) for d, _, _ in self.held.values()) >= size

    def release(self, now: int, all_of_it: bool = False) -> Iterator[tuple]:
        """Messages that are complete now; holes are given up where they have lasted long enough, or all of them."""
        while self.held:
            at = min(self.held)
            if self.next is None:
                if not (all_of_it or self._ripe(now, FIRST_US, FIRST_SEGMENTS, FIRST_BYTES)):
                    return
                self.next = at
            hole = max(at - self.next, 0)
            if hole:
                if not (all_of_it or self._ripe(now, HOLE_US, MOST_SEGMENTS + 1, MOST_BYTES + 1)):
                    return
                self.gaps += 1
                self.next = at
            data, number, ts_us = self.held.pop(at)
            data = data[self.next - at :]
            if data:
                self.next += len(data)
                yield from self._numbered(self.framing.push(data, hole > 0, (number, ts_us)))

    def finish(self, now: int) -> Iterator[tuple]:
        yield from self.release(now, True)
        yield from self._numbered(self.framing.finish())

    def _numbered(self, messages: Iterator[tuple]) -> Iterator[tuple]:
        for message in messages:
            self.count += 1
            yield (self.count, *message, self.gaps, self.late)

    def wakes_us(self) -> int | None:
        """When what is held has waited long enough."""
        if not self.held:
            return None
        return min(ts for _, _, ts in self.held.values()) + (FIRST_US if self.next is None else HOLE_US)

    def ended(self) -> bool:
        return self.fin is not None and not self.held and self.next is not None and self.next >= self.fin


class Reassembler(StatefulProcessor):
    def __init__(self, framing: type[Interleaved]):
        self.framing = framing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", _LINK)
        self.sides = handle.getMapState("sides", "side int", _SIDE)
        self.held = handle.getMapState("held", "side int, at bigint", "data binary, number bigint, ts_us bigint")

    def _load(self) -> tuple[int, int | None, bool, list[Side]]:
        connection, syn, closed = self.link.get() if self.link.exists() else (0, None, False)
        sides = [Side(framing=self.framing()) for _ in range(2)]
        for (number,), s in self.sides.iterator():
            side = sides[number]
            side.first, side.next, side.last, side.fin, side.gaps, side.late, side.count = s[:7]
            side.framing.skipped, side.framing.buffer = s[7], bytearray(s[8])
            side.framing.spans = [(size, (n, ts)) for size, n, ts in zip(s[9], s[10], s[11])]
        for (number, at), value in self.held.iterator():
            sides[number].held[at] = (bytes(value[0]), value[1], value[2])
        return connection, syn, closed, sides

    def _save(self, connection: int, syn: int | None, closed: bool, sides: list[Side], before: list[set[int]]) -> None:
        self.link.update((connection, syn, closed))
        if closed:
            self.sides.clear()
            self.held.clear()
            return
        for number, side in enumerate(sides):
            spans = side.framing.spans
            self.sides.updateValue(
                (number,),
                (side.first, side.next, side.last, side.fin, side.gaps, side.late, side.count, side.framing.skipped, bytes(side.framing.buffer),
                 [s for s, _ in spans], [m[0] for _, m in spans], [m[1] for _, m in spans]),
            )
            for at in before[number] - side.held.keys():
                self.held.removeKey((number, at))
            for at in side.held.keys():
                self.held.updateValue((number, at), side.held[at])

    def _wake(self, sides: list[Side], watermark_ms: int, latest_us: int | None, closed: bool) -> None:
        """One timer: for what waits, else for the time when nothing has come for long."""
        waits = [w // 1000 + 1 for w in (side.wakes_us() for side in sides) if w is not None]
        idle = (latest_us // 1000 if latest_us is not None else watermark_ms) + IDLE_MS
        wanted = idle if closed or not waits else min(waits)
        wanted = max(wanted, watermark_ms + 1)
        known = list(self.handle.listTimers())
        for timer in known:
            if timer != wanted:
                self.handle.deleteTimer(timer)
        if wanted not in known:
            self.handle.registerTimer(wanted)

    @staticmethod
    def _rows(key: tuple, connection: int, side: int, messages: Iterator[tuple]) -> Iterator[Row]:
        ends = [(end.split("|")[0], int(end.split("|")[1])) for end in key[2:]]
        source, target = ends[side], ends[1 - side]
        for message in messages:
            yield _Message(*key[:2], *source, *target, connection, *message)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        connection, syn, closed, sides = self._load()
        before = [set(side.held) for side in sides]
        connection, now = max(connection, 1), None
        for row in sorted(rows, key=lambda r: r.number):
            number, flags = int(not row.from_low), row.tcp_flags
            now = row.ts_us
            if flags & (SYN | ACK) == SYN and row.tcp_seq != syn:
                if syn is not None:
                    for i, side in enumerate(sides):
                        yield from self._rows(key, connection, i, side.finish(now))
                    connection, sides = connection + 1, [Side(framing=self.framing()) for _ in range(2)]
                syn, closed = row.tcp_seq, False
            if closed:
                continue
            side = sides[number]
            side.take(row.tcp_seq, flags, bytes(row.payload or b""), row.number, row.ts_us)
            yield from self._rows(key, connection, number, side.release(now))
            if flags & RST or all(s.ended() for s in sides):
                for i, one in enumerate(sides):
                    yield from self._rows(key, connection, i, one.finish(now))
                closed = True
        self._save(connection, syn, closed, sides, before)
        self._wake(sides, timerValues.getCurrentWatermarkInMs(), now, closed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        connection, syn, closed, sides = self._load()
        before = [set(side.held) for side in sides]
        watermark = timerValues.getCurrentWatermarkInMs()
        if closed or not any(side.held for side in sides):
            # Nothing has come for long: what is unfinished ends here.
            for i, side in enumerate(sides):
                yield from self._rows(key, connection, i, side.finish(watermark * 1000))
            for state in (self.link, self.sides, self.held):
                state.clear()
            return
        for i, side in enumerate(sides):
            yield from self._rows(key, connection, i, side.release(watermark * 1000))
        self._save(connection, syn, closed, sides, before)
        self._wake(sides, watermark, None, closed)

    def close(self) -> None:
        pass


def live_messages(segments: DataFrame, framing: type[Interleaved] = Interleaved, late: str = "10 seconds") -> DataFrame:
    """Messages on the TCP connections in a stream of segments, in the form of ``tcp.messages``, with the gaps and late bytes so far.

    A message comes out with the segment that completes it. Before a side's
    first byte is known (a SYN, else 200 ms, 16 segments or 64 KiB), and behind
    a hole (2 s, 256 segments or 256 KiB), segments wait. State is dropped when
    both sides have ended, at a reset, and after ten idle minutes; the number of
    the connection stays until then. Bytes that come after their hole was given
    up are counted as late. A session needs the RocksDB state store.
    """
    ends = [F.concat_ws("|", f"{side}_ip", F.lpad(F.col(f"{side}_port").cast("string"), 5, "0")) for side in ("src", "dst")]
    rows = segments.filter("proto = 'tcp'").select(
        "capture", "interface", F.least(*ends).alias("low"), F.greatest(*ends).alias("high"), (ends[0] <= ends[1]).alias("from_low"),
        F.timestamp_micros("ts_us").alias("ts"), "ts_us", "number", "tcp_seq", "tcp_flags", "payload",
    )
    return rows.withWatermark("ts", late).groupBy(*_KEY).transformWithState(Reassembler(framing), MESSAGES, "Append", "EventTime")
