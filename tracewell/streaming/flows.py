"""Live flow statistics: watermarked windows, and sequence tracking in keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACKED = "flow string, packets bigint, lost bigint, duplicates bigint, out_of_order bigint, highest bigint"
_STATE = "packets bigint, first bigint, highest bigint, seen binary, unique_count bigint, out_of_order bigint, duplicates bigint"
#: Sequence numbers below the highest for which a repeat can be told from a late first arrival.
WINDOW = 131_072


def windowed_rates(packets: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Packets and bits per flow and tumbling window; windows close after the watermark.

    ``packets`` needs flow, ts (a timestamp with zone) and size in bytes.
    """
    return (
        packets.withWatermark("ts", late)
        .groupBy("flow", F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("size") * 8).alias("bits"))
        .select("flow", F.col("window.start").alias("start"), "packets", "bits")
    )


class Seen:
    """Which of the last ``WINDOW`` numbers up to the highest have arrived: one bit each, whatever arrives."""

    def __init__(self, bits: bytes | None = None, highest: int | None = None):
        self.bits, self.highest = bytearray(bits or WINDOW // 8), highest

    def add(self, number: int) -> bool:
        """Whether a number is new; numbers below the window count as new and are forgotten."""
        if self.highest is None or number > self.highest:
            ahead = WINDOW if self.highest is None else number - self.highest
            if ahead >= WINDOW:
                self.bits = bytearray(WINDOW // 8)
            else:
                for n in range(self.highest + 1, number + 1):
                    self.bits[n % WINDOW // 8] &= ~(1 << n % 8)
            self.highest = number
        elif number <= self.highest - WINDOW:
            return True
        place, bit = number % WINDOW // 8, 1 << number % 8
        new = not self.bits[place] & bit
        self.bits[place] |= bit
        return new


def tracked_sequences(packets: DataFrame, idle: str = "30 seconds", modulus: int | None = None) -> DataFrame:
    """Counters of each flow after every batch, from packets (flow, ts, number, ext).

    With a ``modulus``, ext is a counter that wraps, and is unfolded by the
    nearest step from the highest number so far. The state of a flow is a
    handful of counters and one bit for each of the last ``WINDOW`` numbers. A
    flow that is idle longer than ``idle`` in event time is dropped.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        packets_n, first, highest, bits, unique, late, repeats = state.get if state.exists else (0, None, None, None, 0, 0, 0)
        seen, latest = Seen(bits, highest), state.getCurrentWatermarkMs()
        for rows in batches:
            latest = max(latest, int(rows["ts"].max().timestamp() * 1000))
            for ext in rows.sort_values("number")["ext"].tolist():
                packets_n += 1
                if modulus and seen.highest is not None:
                    ext = seen.highest + (ext - seen.highest + modulus // 2) % modulus - modulus // 2
                first = ext if first is None else first
                behind = seen.highest is not None and ext < seen.highest
                if not seen.add(ext):
                    repeats += 1
                    continue
                unique += ext >= first
                late += behind
        state.update((packets_n, first, seen.highest, bytes(seen.bits), unique, late, repeats))
        state.setTimeoutTimestamp(latest + wait)
        lost = seen.highest - first + 1 - unique
        yield pd.DataFrame([(key[0], packets_n, lost, repeats, late, seen.highest)], columns=[f.split()[0] for f in TRACKED.split(", ")])

    return (
        packets.withWatermark("ts", "10 seconds")
        .groupBy("flow")
        .applyInPandasWithState(update, TRACKED, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )


def live_flows(segments: DataFrame, idle: str = "30 seconds") -> DataFrame:
    """Counters of the RTP flows in a stream of segments (with ``ts``), in one pass: headers are read, flows told apart and tracked.

    A flow is named by its interface, endpoints, channel and source.
    """
    from tracewell.operators.packets import FLOW, rtp_packets

    at = F.timestamp_micros("ts_us").alias("ts")
    rows = rtp_packets(segments).select(F.concat_ws("|", *FLOW[1:]).alias("flow"), at, "number", F.col("seq").alias("ext"))
    return tracked_sequences(rows, idle, 1 << 16)
