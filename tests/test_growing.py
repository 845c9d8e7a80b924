"""Capture files that grow between batches."""

import struct

import pytest

from tests.builders import pcap, pcapng, rtp, udp
from tracewell.operators import packets as P
from tracewell.sources.stream import stream_frames
from tracewell.streaming.captures import growing_frames


class Growing:
    def __init__(self, spark, tmp_path, name, most=1 << 20):
        self.spark, self.folder, self.checkpoint, self.name = spark, tmp_path / "in", tmp_path / "cp", name
        self.folder.mkdir(exist_ok=True)
        self.most, self.query, self.rows, self.starts = most, None, [], 0

    def start(self):
        def keep(rows, number):
            self.rows += [(r.capture[-6:], r.number, r.position, r.ts_us, r.interface, bytes(r.data or b""), r.error) for r in rows.collect()]

        self.query = growing_frames(self.spark, str(self.folder), self.most, str(self.checkpoint) + ".log").writeStream.foreachBatch(keep).option("checkpointLocation", str(self.checkpoint)).start()
        return self

    def add(self, name, data):
        with open(self.folder / name, "ab") as file:
            file.write(data)

    def run(self):
        self.query.processAllAvailable()

    def stop(self):
        self.query.stop()


def frames(n, at=0):
    return [(1_000_000 + i * 1000, udp(rtp(i, i, bytes([i % 250]) * (i % 90)))) for i in range(at, at + n)]


@pytest.mark.parametrize("form", ["<", ">", "ng"])
def test_every_packet_comes_once_and_whole(spark, tmp_path, form):
    if form == "ng":
        whole = pcapng([(i % 2, us, data) for i, (us, data) in enumerate(frames(60))])
    else:
        whole = pcap(frames(60), order=form)
    stream = Growing(spark, tmp_path, "once").start()
    cuts = [0, 10, 40, 41, 700, 1999, 2000, 2003, len(whole) - 1, len(whole)]
    try:
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            stream.add("a.pcap", whole[a:b])
            stream.run()
            if i in (4, 6):  # a restart from the checkpoint
                stream.stop()
                stream.start()
    finally:
        stream.stop()
    want = [(r.capture[-6:], r.number, r.ts_us, r.interface, bytes(r.data)) for r in stream_frames(spark, str(stream.folder)).collect()]
    assert len(want) == 60 and sorted((r[0], r[1], *r[3:6]) for r in stream.rows) == sorted(want)


def test_batches_are_bounded_and_files_told_apart(spark, tmp_path):
    stream = Growing(spark, tmp_path, "bounded", most=500)
    stream.add("a.pcap", pcap(frames(40)))
    stream.add("b.pcap", pcap(frames(25, 100)))
    progress = []
    for _ in range(2):  # the second time after a restart
        stream.start()
        try:
            stream.run()
            progress += [p["numInputRows"] for p in stream.query.recentProgress if p["numInputRows"]]
        finally:
            stream.stop()
        stream.add("b.pcap", pcap(frames(25, 200))[24:])
    stream.start()
    stream.run()
    stream.stop()
    assert sorted((r[0], r[1]) for r in stream.rows) == [("a.pcap", i) for i in range(1, 41)] + [("b.pcap", i) for i in range(1, 76)]
    assert len(progress) > 5 and max(progress) < 20


def test_broken_files_give_one_error(spark, tmp_path):
    stream = Growing(spark, tmp_path, "broken")
    stream.add("a.pcap", pcap(frames(3)) + struct.pack("<4I", 1, 1, 1 << 30, 1 << 30) + b"x" * 40)
    stream.add("c.text", b"not a capture, but long enough")
    stream.start()
    try:
        stream.run()
        stream.add("a.pcap", b"more" * 20)
        stream.add("c.text", b"more" * 20)
        stream.run()
    finally:
        stream.stop()
    assert sorted((r[0], r[1], r[6]) for r in stream.rows if r[6]) == [("a.pcap", None, "packet too long"), ("c.text", None, "neither pcap nor pcapng")]
    assert sum(r[6] is None for r in stream.rows) == 3


def test_packets_of_a_growing_capture(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(pcap(frames(20)))
    query = P.rtp_packets(P.segments(growing_frames(spark, str(folder)))).select("number", "seq").writeStream.format("memory").queryName("live_rtp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.number, r.seq) for r in spark.table("live_rtp").collect()) == [(i + 1, i) for i in range(20)]
