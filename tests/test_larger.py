"""Queries over more rows than one task or the driver should hold: how they are dealt, and keys beyond 16 bits."""

import pytest

from tracewell.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q126_issue_evidence", "q71_sdp_sections", "q87_stream_summary"])
def test_nothing_of_the_tables_size_is_sent_to_the_driver(spark, name):
    assert "Broadcast" not in plan_of(QUERIES[name](spark, DATA))


def test_issues_of_a_log_with_many_frames(spark):
    from tracewell.operators import logs

    rows = [("a", i, "no_frame", f"line {i}", None if i % 3 == 0 else (i * 7) % 400) for i in range(1000)] + [("b", 1, "no_frame", "x", None)]
    issues = spark.createDataFrame(rows, "log string, no long, kind string, example string, frame long")
    found = {r.log: r for r in logs.issue_summary(issues, ["log"], "no").collect()}
    seen = list(dict.fromkeys(f for _, _, _, _, f in rows[:1000] if f is not None))
    assert (found["a"].n, found["a"].example, found["a"].frames, found["a"].more_frames) == (1000, "line 0", seen[:256], True)
    assert (found["b"].n, found["b"].example, found["b"].frames, found["b"].more_frames) == (1, "x", None, False)


def test_sources_of_announced_media_are_counted_once(spark):
    from tracewell.operators import sip

    schema = "capture string, call_id string, call long, index int, address string, port int, payload_types array<bigint>"
    offers = [("c", f"call-{i}", i, 0, "10.0.0.1", 4000, [0, 96]) for i in range(3)] + [("c", "h", 9, 0, "0.0.0.0", 4000, [0]), ("c", "n", 10, 0, "10.0.0.2", 4000, None)]
    packets = [("c", "10.0.0.1", 4000, pt, n, n, ssrc) for n, (pt, ssrc) in enumerate([(0, 5), (96, 5), (0, 6), (0, 5), (8, 7)])]
    rtp = spark.createDataFrame(packets, "capture string, dst_ip string, dst_port int, pt long, number long, ts_us long, ssrc long")
    given = spark.createDataFrame(offers, schema)
    flows = sip.media_flows(given, rtp, ["call"])
    found = {r.call: (r.packets, r.first_packet, r.last_packet, r.sources, r.quality, r.shared) for r in flows.collect()}
    assert found == {**{i: (4, 0, 3, 2, "candidate", True) for i in range(3)}, 9: (0, None, None, 0, "hold", False), 10: (0, None, None, 0, "none", False)}
    listed = sip.media_sources(given, rtp).collect()
    assert sorted((r.dst_ip, r.dst_port, r.payload_types, r.ssrc) for r in listed) == [("10.0.0.1", 4000, [0, 96], 5), ("10.0.0.1", 4000, [0, 96], 6)]


@pytest.mark.parametrize("name", ["q82_h264_parameters", "q83_h265_parameters", "q130_frame_documents", "q71_sdp_sections", "q86_timing_messages"])
def test_rows_of_a_small_file_are_dealt_before_much_is_made_of_them(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert "REPARTITION_BY_NUM" in plan


def test_bits_are_packed_to_whole_bytes(spark):
    from pyspark.sql import functions as F

    from tracewell.plans.media import packed

    texts = ["", "1", "0" * 7, "01" * 4, "1" * 31, "0000000" + "1" * 32, "01" * 150, "0" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed(F.col("t")).alias("b")).collect()
    for r in rows:
        whole = r.t + "1"
        whole += "0" * (-len(whole) % 8)
        plain = bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8))
        assert bytes(r.b) == plain.replace(b"\0\0\0", b"\0\0\3\0"), r.t


def test_dangling_sets_are_found_without_a_window(spark):
    from tracewell.operators import parameter_sets

    rows = [("f", 1, "pps", 7, 3, None), ("f", 2, "sps", 3, None, None), ("f", 3, "pps", 8, 3, None), ("f", 4, "slice", None, None, 8), ("f", 5, "slice", None, None, 9), ("g", 6, "slice", None, None, 8), ("f", 7, "pps", 9, None, None)]
    sets = spark.createDataFrame(rows, "flow string, at long, unit string, id long, sps_id long, pps_id long")
    found = parameter_sets.dangling(sets, ["flow"], "at")
    assert sorted((r.flow, r.at, r.unit, r.missing) for r in found.collect()) == [("f", 1, "pps", "sps"), ("f", 5, "slice", "pps"), ("f", 7, "pps", "sps"), ("g", 6, "slice", "pps")]
    assert "Window" not in plan_of(found)


def test_users_beyond_16_bits_have_streams_of_their_own(spark, tmp_path):
    import duckdb

    from tracewell.queries import ORACLES

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(20 * i) AS ts, [1, 70000, 70001][1 + i % 3] AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props
                    FROM range(1, 240) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = QUERIES["q140_capture_findings"](spark, str(tmp_path)).collect()
    wanted = con.execute("SELECT stream_id, rule_id, severity, confidence FROM (" + ORACLES["q140_capture_findings"] + ")").fetchall()
    assert sorted((r.stream_id, r.rule_id, r.severity, r.confidence) for r in found) == sorted(wanted)


def test_events_of_a_user_may_be_over_32767_apart(spark, tmp_path):
    import duckdb

    from tracewell.queries import ORACLES

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT 40000 * i + i % 3 AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(700 * i) AS ts, i % 2 AS user_id, ['view', 'purchase'][1 + i % 5 // 4] AS event_type FROM range(40) r(i))
                    TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    wanted = con.execute(ORACLES["q62_rtp_statistics"])
    names = [d[0] for d in wanted.description]
    assert sorted(tuple(r) for r in QUERIES["q62_rtp_statistics"](spark, str(tmp_path)).select(*names).collect()) == sorted(wanted.fetchall())
