"""Messages out of segments in micro-batches, against the batch operator."""

import os
import random

import pytest

from tests.test_wire import SEGMENTS, dollar, rtp, segment
from tracewell.operators import tcp
from tracewell.streaming import tcp as live

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, path, batches, name):
    """Each list of rows is a micro-batch of its own."""
    os.makedirs(path)
    stream = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", 1).parquet(path)
    query = live.live_messages(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.mode("append").parquet(path)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


COLUMNS = [*tcp.STREAM, "message", "number", "ts_us", "kind", "channel", "data", "skipped"]


def listed(rows):
    return sorted(tuple(bytes(r[c]) if c == "data" else r[c] for c in COLUMNS) for r in rows)


def traffic():
    """Two connections of two ports after each other, with requests, frames, other orders, repeats, and sequence numbers that wrap."""
    random.seed(2)
    rows, clock = [], 0
    for port in (40_000, 40_001):
        for start in ((1 << 32) - 700, 5_000):
            texts = [b"OPTIONS rtsp://h RTSP/1.0\r\nCSeq: 1\r\n\r\n"] + [dollar(0, rtp(i, body=bytes(random.randrange(150)))) for i in range(12)]
            stream, cuts = b"".join(texts), [0]
            while cuts[-1] < len(stream):
                cuts.append(min(cuts[-1] + random.randint(20, 130), len(stream)))
            pieces = [(start + 1 + a, stream[a : b + random.choice([0, 0, 15])], tcp.ACK) for a, b in zip(cuts, cuts[1:])]
            for i in range(0, len(pieces) - 1, 3):
                pieces[i], pieces[i + 1] = pieces[i + 1], pieces[i]
            pieces = [(start, b"", tcp.SYN), *pieces, *random.sample(pieces, 3), (start + 1 + len(stream), b"", live.FIN | tcp.ACK)]
            for seq, data, flags in pieces:
                clock += 1
                rows.append(segment(clock, seq, data, flags, port))
    return rows


@pytest.mark.parametrize("size", [1000, 17, 5])
def test_any_cut_gives_the_messages_of_the_batch(rocks, tmp_path, size):
    rows = traffic()
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    got = run(rocks, str(tmp_path / "in"), batches, f"cut_{size}")
    want = tcp.messages(tcp.reassemble(rocks.createDataFrame(rows, SEGMENTS))).collect()
    assert len(want) == 4 * 13 and listed(got) == listed(want)


def test_a_hole_is_given_up_by_its_timer_and_late_bytes_are_counted(rocks, tmp_path):
    one, two, three = (dollar(0, rtp(i)) for i in (1, 2, 3))
    at = lambda s, seconds: (*s[:3], int(seconds * 1e6), *s[4:])
    batches = [
        [at(segment(1, 99, flags=tcp.SYN), 0), at(segment(2, 100, one), 0.1), at(segment(3, 100 + len(one + two), three), 0.2)],
        [at(segment(4, 1, b"x", port=41_000), 20)],  # only time goes on
        [at(segment(5, 1, b"x", port=41_000), 21)],
        [at(segment(6, 100 + len(one), two), 22), at(segment(7, 100 + len(one + two + three), one), 22.1)],
    ]
    got = {r.number: r for r in run(rocks, str(tmp_path / "in"), batches, "hole")}
    assert sorted(got) == [2, 3, 7]
    assert [(got[n].gaps, got[n].late) for n in (2, 3, 7)] == [(0, 0), (1, 0), (1, len(two))]


def test_closed_connections_leave_no_state(rocks, tmp_path):
    rows = [r for r in traffic() if r[5] == 40_000]
    first = rows[: next(i for i, r in enumerate(rows) if r[10] & live.FIN) + 1]
    answers = [segment(998, 0, flags=tcp.SYN | tcp.ACK, back=True), segment(999, 1, flags=live.FIN | tcp.ACK, back=True)]
    rocks.createDataFrame([*first, *answers, segment(1000, 77, b"after the end")], SEGMENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(SEGMENTS).parquet(str(tmp_path / "in"))
    query = live.live_messages(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert rocks.table("closed").count() == 13
    for name in ("sides", "held"):
        assert rocks.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp")).count() == 0


def test_positions_unfold_over_the_wrap():
    side = live.Side()
    assert [side.place(s) for s in ((1 << 32) - 10,)] == [0]
    side.take((1 << 32) - 10, 0, b"a" * 20, 1, 0)
    side.take(10, 0, b"b", 2, 0)
    assert sorted(side.held) == [0, 20]
