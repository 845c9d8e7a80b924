"""Transactions of a stream against those of the batch."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import rtsp, sip
from tracewell.streaming import requests

RTSP = "capture string, interface string, ends string, connection long, number long, ts_us long, response boolean, method string, uri string, status int, reason string, cseq string, session string, transport string, src_ip string, dst_ip string"
SIP = "capture string, packet long, ts_us long, source string, destination string, method string, status int, call_id string, branch string, cseq long"
END = 200_000_000  # a late row that ends all waiting


def run(spark, path, make, schema, batches, name):
    path.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def rtsp_row(number, ms, cseq, status=None, connection=1):
    asks = status is None
    return ("c", "0", "ends", connection, number, (ms + 1000) * 1000, not asks, "GET" if asks else None, f"u{cseq}" if asks else None, status, None if asks else "OK", str(cseq), None if asks else "s", None, "a", "b")


def rtsp_rows():
    rows = []
    for i in range(60):
        rows.append(rtsp_row(2 * i, i * 700, i, connection=i % 3))
        if i % 4:
            rows.append(rtsp_row(2 * i + 1, i * 700 + 40 * (i % 9), i, 200 if i % 5 else 404, connection=i % 3))
    return sorted(rows, key=lambda r: r[5]) + [rtsp_row(999, 41_000, 777, 200)]


@pytest.mark.parametrize("size", [200, 9])
def test_rtsp_transactions_of_stream_and_batch(spark, tmp_path, size):
    rows = rtsp_rows()
    batches = [rows[i : i + size] for i in range(0, len(rows), size)] + [[rtsp_row(5000 + i, END // 1000 + i, 5000 + i)] for i in range(3)]
    got = run(spark, tmp_path / "in", requests.live_rtsp_transactions, RTSP, batches, f"rtsp_{size}")
    names = [*rtsp.CONNECTION, "cseq", "method", "uri", "status", "reason", "elapsed_ms", "request_packet", "response_packet"]
    want = rtsp.transactions(spark.createDataFrame(rows, RTSP)).select(*names)
    listed = lambda df: sorted(map(str, df.select(*names).filter("cseq < 5000").collect()))
    assert listed(got) == listed(want) and want.count() == 60
    assert requests.without_answer(got).filter("cseq < 5000").count() == 15


def sip_rows():
    rows, packet = [], 0
    for i in range(40):
        for copy in range(1 + i % 3):
            rows.append((packet := packet + 1, i * 900 + copy * 100, "INVITE", None, i))
        rows.append((packet := packet + 1, i * 900 + 250, "INVITE", 180, i))
        if i % 5:
            rows.append((packet := packet + 1, i * 900 + 400, "INVITE", 200 if i % 2 else 486, i))
            rows.append((packet := packet + 1, i * 900 + 700, "INVITE", 200, i))
    return [("c", p, (ms + 1000) * 1000, "a", "b", m, s, f"call{i}", f"z{i}", 1) for p, ms, m, s, i in rows]


def test_sip_transactions_of_stream_and_batch(spark, tmp_path):
    rows = sorted(sip_rows(), key=lambda r: r[2])
    batches = [rows[i : i + 23] for i in range(0, len(rows), 23)] + [[("c", 9000 + i, END + i * 1000, "a", "b", "OPTIONS", None, f"x{i}", "z", 1)] for i in range(3)]
    got = run(spark, tmp_path / "in", requests.live_sip_transactions, SIP, batches, "sip_live").filter("call_id like 'call%'")
    want = sip.transactions(spark.createDataFrame(rows, SIP))
    listed = lambda df: sorted((r.call_id, r.final_status, r.final_ms) for r in df.collect())
    assert listed(got) == listed(want) and got.count() == 40
    assert requests.without_answer(got).count() == 8


def test_an_answer_that_comes_too_late_is_none(spark, tmp_path):
    batches = [[rtsp_row(1, 0, 1)], [rtsp_row(2, 33_000, 1, 200), rtsp_row(3, 33_000, 2), rtsp_row(4, 65_000, 2, 200)], [rtsp_row(9, END // 1000, 9)], [rtsp_row(10, END // 1000 + 1, 10)]]
    got = run(spark, tmp_path / "in", requests.live_rtsp_transactions, RTSP, batches, "too_late").filter(F.col("cseq") < 9)
    assert sorted((r.cseq, r.status, r.elapsed_ms) for r in got.collect()) == [(1, 0, 0), (2, 200, 32_000)]
