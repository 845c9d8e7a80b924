import datetime as dt

from pyspark.sql import functions as F

from tracewell.streaming.flows import tracked_sequences, windowed_rates

START = dt.datetime(2024, 1, 1)


def write(spark, path, rows):
    at = [(f, START + dt.timedelta(milliseconds=ms), n, e, s) for f, ms, n, e, s in rows]
    spark.createDataFrame(at, "flow string, ts timestamp, number long, ext long, size long").coalesce(1).write.mode("append").parquet(path)


def run(spark, df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_rates_equal_the_batch_result(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", i * 300, i, i, 10) for i in range(10)] + [("b", 60_000, 11, 1, 5)]
    write(spark, path, rows)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = run(spark, windowed_rates(stream), "append", "rates")
    got = sorted((r.flow, r.start, r.packets, r.bits) for r in out.collect())
    batch = windowed_rates(spark.read.parquet(path)).filter(F.col("flow") == "a").collect()
    assert got == sorted((r.flow, r.start, r.packets, r.bits) for r in batch)


def test_sequences_keep_state_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("a", i, i, e, 1) for i, e in enumerate([10, 11, 13])])
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = tracked_sequences(stream).writeStream.format("memory").queryName("tracked").outputMode("update").start()
    query.processAllAvailable()
    write(spark, path, [("a", 10 + i, 10 + i, e, 1) for i, e in enumerate([12, 13, 16])])
    query.processAllAvailable()
    query.stop()
    last = max(spark.table("tracked").collect(), key=lambda r: r.packets)
    assert (last.packets, last.lost, last.duplicates, last.out_of_order, last.highest) == (6, 2, 1, 1, 16)


def test_a_bit_for_each_recent_number():
    import random

    from tracewell.streaming.flows import WINDOW, Seen

    random.seed(4)
    seen, known, high = Seen(), set(), None
    for _ in range(5000):
        n = (high or 500) + random.choice([-3, -1, 0, 1, 1, 2, 5, 40, -WINDOW - 5, WINDOW + 9 if random.random() < 0.01 else 1])
        if high is not None and n <= high - WINDOW:
            assert seen.add(n)
            continue
        assert seen.add(n) == (n not in known)
        high = n if high is None else max(high, n)
        known = {x for x in known | {n} if x > high - WINDOW}
    again = Seen(bytes(seen.bits), seen.highest)
    assert not again.add(high)


def test_live_flows_of_wrapping_numbers(spark, tmp_path):
    import struct

    from tracewell.streaming.flows import live_flows

    path = str(tmp_path / "segments")
    numbers = [65_534, 65_535, 0, 2, 2, 1]
    rows = [("c", "0", i, 5_000_000 + i * 1000, "a", 1, "b", 2, "udp", bytearray(struct.pack(">BBHII", 0x80, 0, n, 0, 9) + b"x")) for i, n in enumerate(numbers)]
    schema = "capture string, interface string, number long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, proto string, payload binary"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    out = run(spark, live_flows(spark.readStream.schema(schema).parquet(path)), "update", "live").collect()
    assert [(r.packets, r.lost, r.duplicates, r.out_of_order) for r in out] == [(6, 0, 1, 1)]
