"""Queries of evidence joins, report tables and file contents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.scalar import cents, micros
from tracewell.operators import evidence, parameter_sets, rtsp, sdp, tcp
from tracewell.operators.sync import neighbours
from tracewell.queries import query, table
from tracewell.sources import probe
from tracewell.sinks import media, reports


def _packets(spark, sf_dir):
    """Order lines as packets: an order is a flow, a ship date an RTP time, lines in their order are numbered."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("flow"), F.row_number().over(w).cast("bigint").alias("number"), F.col("l_linenumber").cast("bigint").alias("seq"),
        micros("l_shipdate").alias("rtp_ts"),
    )


_PACKETS = """
WITH p AS (SELECT l_orderkey AS flow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS number,
                  CAST(l_linenumber AS BIGINT) AS seq, epoch_us(l_shipdate) AS rtp_ts FROM lineitem)
"""


@query(
    "q102_issue_packets",
    _PACKETS
    + """, i AS (SELECT DISTINCT flow, rtp_ts, seq FROM p WHERE seq <= 2 UNION SELECT flow, rtp_ts, seq + 100 FROM p WHERE seq = 1)
SELECT i.flow, i.rtp_ts, i.seq, max(number) AS number, max(number) * 10 AS offset_ms FROM i LEFT JOIN p ON p.flow = i.flow AND p.rtp_ts = i.rtp_ts AND p.seq = i.seq GROUP BY 1, 2, 3
""",
)
def q102(spark, sf_dir):
    packets = _packets(spark, sf_dir).withColumn("offset_ms", F.col("number") * 10)
    known = packets.filter("seq <= 2").select("flow", "rtp_ts", "seq")
    unknown = packets.filter("seq = 1").select("flow", "rtp_ts", (F.col("seq") + 100).alias("seq"))
    return evidence.packets_of_issues(known.union(unknown).distinct(), packets, ["flow"], [])


@query(
    "q103_unit_packets",
    _PACKETS
    + """, u AS (SELECT flow, rtp_ts, min(number) AS unit, min(number) AS first_seq, min(number) + 1 AS last_seq FROM p GROUP BY 1, 2)
SELECT u.flow, unit, number AS ext, number FROM u JOIN p ON p.flow = u.flow AND p.rtp_ts = u.rtp_ts AND number BETWEEN first_seq AND last_seq
""",
)
def q103(spark, sf_dir):
    packets = _packets(spark, sf_dir).withColumn("ext", F.col("number"))
    units = packets.groupBy("flow", "rtp_ts").agg(F.min("number").alias("unit"), F.min("ext").alias("first_seq"), (F.min("ext") + 1).alias("last_seq"))
    return evidence.packets_of_units(units, packets, ["flow"], "unit")


@query(
    "q104_packet_lookup_and_ranges",
    """
WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT 'range' AS kind, conv_id, turn FROM c WHERE turn BETWEEN 2 AND 4
UNION ALL SELECT 'page', conv_id, turn FROM c WHERE turn BETWEEN 5 - 20 AND 5 + 20
UNION ALL SELECT 'packet', conv_id, turn FROM c WHERE turn = 3
""",
)
def q104(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    parts = {
        "range": evidence.units_between(rows, 2, 4, "turn"),
        "page": neighbours(rows, "turn", 5),
        "packet": evidence.units_of_packet(rows.withColumn("number", F.col("turn")), F.lit(3)).drop("number"),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("kind"), "conv_id", "turn")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "q105_chosen_streams",
    """
WITH s AS (SELECT 'stream-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS stream_id FROM supplier), w(stream_id) AS (VALUES ('stream-0001'), ('stream-0003'), ('stream-x'))
SELECT stream_id, TRUE AS found FROM s WHERE stream_id IN (SELECT stream_id FROM w) UNION ALL SELECT stream_id, FALSE FROM w WHERE stream_id NOT IN (SELECT stream_id FROM s)
UNION ALL SELECT 'all', count(*) = (SELECT count(*) FROM s) FROM s
""",
)
def q105(spark, sf_dir):
    streams = table(spark, sf_dir, "supplier").select(F.format_string("stream-%04d", "s_suppkey").alias("stream_id"))
    chosen, missing = evidence.chosen_streams(streams, ["stream-0001", "stream-0003", "stream-x"])
    everything, _ = evidence.chosen_streams(streams, ["*"])
    counts = everything.agg(F.count(F.lit(1)).alias("a")).join(streams.agg(F.count(F.lit(1)).alias("b")))
    found = chosen.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))
    return found.unionByName(counts.select(F.lit("all").alias("stream_id"), (F.col("a") == F.col("b")).alias("found")))


@query(
    "q106_frames_to_units",
    """
WITH u AS (SELECT conv_id, turn + 1 AS n, CAST(sum(strlen(coalesce(text, '')) + 4) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e, strlen(coalesce(text, '')) + 4 AS l FROM conversations),
d AS (SELECT conv_id, n, n AS display_index FROM u)
SELECT conv_id, display_index, CASE WHEN n % 5 = 4 THEN NULL ELSE n END AS unit_number, CASE WHEN n % 5 = 4 THEN NULL WHEN n % 2 = 0 THEN 'decode_index' ELSE 'byte_range' END AS matched_by FROM d
""",
)
def q106(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    units = parameter_sets.unit_ranges(rows, ["conv_id"], "turn").withColumn("unit_number", F.col("turn") + 1)
    n, lost = F.col("unit_number"), F.col("unit_number") % 5 == 4
    # Odd units are known by their bytes, even ones by their index; one in five is wrong either way.
    frames = units.select(
        "conv_id", n.alias("display_index"), F.when(n % 2 == 0, n - 1 + F.when(lost, 1_000_000).otherwise(0)).alias("decode_index"),
        (F.col("start") - 0).alias("position"), (F.col("end") - F.col("start") - F.when(lost, 1).otherwise(0)).alias("size"),
    )
    return evidence.frames_to_units(frames, units, ["conv_id"])


@query(
    "q107_positions_of_changes",
    """
SELECT o_custkey AS flow, o_orderkey AS frame, o_orderkey % 3 = 0 AS known, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) // 1000 END AS offset_ms FROM orders WHERE o_orderstatus = 'F'
""",
)
def q107(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("flow", F.col("o_custkey")).withColumn("frame", F.col("o_orderkey"))
    changes = rows.filter("o_orderstatus = 'F'").select("flow", "frame")
    positions = rows.filter("o_orderkey % 3 = 0").select("flow", "frame", F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000").alias("offset_ms"))
    found = evidence.with_position(changes, positions.withColumn("known", F.lit(True)), ["flow"], "frame")
    return found.select("flow", "frame", F.coalesce("known", F.lit(False)).alias("known"), "offset_ms")


@query(
    "q108_frame_rates",
    """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS declared_rate, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1.04 END AS probed_rate,
                  CASE WHEN p_partkey % 5 > 0 THEN round((p_size * 2 + p_partkey % 2) * 1000 / 2000.0, 3) END AS observed_rate FROM part)
SELECT p_partkey, coalesce(observed_rate, declared_rate, probed_rate) AS frame_rate,
       coalesce(abs(declared_rate - probed_rate) > greatest(0.5, greatest(declared_rate, probed_rate) * 0.05), FALSE) OR coalesce(abs(declared_rate - observed_rate) > greatest(0.5, greatest(declared_rate, observed_rate) * 0.05), FALSE)
       OR coalesce(abs(probed_rate - observed_rate) > greatest(0.5, greatest(probed_rate, observed_rate) * 0.05), FALSE) AS rate_conflict,
       CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS audio
FROM p
""",
)
def q108(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    frames = F.when(k % 5 > 0, size * 2 + k % 2)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 3 > 0, size.cast("double")).alias("declared_rate"), F.when(k % 2 == 0, size * 1.04).alias("probed_rate"),
        evidence.observed_rate(frames, F.lit(2000)).alias("observed_rate"),
    )
    kind = F.when(k % 4 == 0, "audio").when(k % 4 == 2, "video")
    codec = F.when(k % 4 == 1, "OPUS").when(k % 4 == 3, "H264")
    return evidence.frame_rates(rows).select("p_partkey", "frame_rate", "rate_conflict", evidence.is_audio(kind, codec).alias("audio"))


@query(
    "q109_warnings_and_partial_status",
    """
WITH f AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2),
w AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS all_of, list(event_type ORDER BY first_at) AS l FROM f GROUP BY 1)
SELECT user_id, array_to_string(l[1:3], ',') AS warnings, len(l) > 3 AS more, list_contains(l, 'error') AS partial, CASE WHEN list_contains(l, 'error') THEN 'partial' ELSE 'completed' END AS status FROM w
""",
)
def q109(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    shown = evidence.distinct_warnings(rows, ["user_id"], "event_id", "event_type", 3)
    whole = evidence.distinct_warnings(rows, ["user_id"], "event_id", "event_type").select("user_id", F.col("warnings").alias("all"))
    partial = evidence.requires_partial(F.col("all"), ["err"])
    joined = shown.join(whole, "user_id")
    return joined.select(
        "user_id", F.array_join("warnings", ",").alias("warnings"), "more", partial.alias("partial"), evidence.overridden_status(F.lit("completed"), partial).alias("status")
    )


@query(
    "q110_audio_evidence",
    """
SELECT o_orderkey, 'timestamp_issue' AS record_type, 'timestamp_gap' AS kind, CAST(o_orderkey AS VARCHAR) AS start_ms, '' AS end_ms, '7' AS duration_ms, '' AS channel, 'rtp_timestamp+sequence_order' AS precision, o_orderpriority AS detail
FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'content_interval', 'silence', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey + 20 AS VARCHAR), '20', '2', '', '' FROM orders WHERE o_orderkey % 2 = 1
""",
)
def q110(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    issues = rows.filter("o_orderkey % 2 = 0").select(
        "o_orderkey", F.lit("timestamp_gap").alias("kind"), F.col("o_orderkey").alias("start_ms"), F.lit(7).alias("duration_ms"), F.col("o_orderpriority").alias("detail")
    )
    intervals = rows.filter("o_orderkey % 2 = 1").select(
        "o_orderkey", F.lit("silence").alias("kind"), F.col("o_orderkey").alias("start_ms"), (F.col("o_orderkey") + 20).alias("end_ms"), F.lit(2).alias("channel")
    )
    names = ["o_orderkey", "record_type", "kind", "start_ms", "end_ms", "duration_ms", "channel", "precision", "detail"]
    return reports.audio_evidence(issues, intervals, ["o_orderkey"]).select(*names)


@query(
    "q111_block_evidence",
    """
SELECT p_partkey, 'qp' AS record_type, CAST(p_size AS VARCHAR) AS x, '26' AS qp_base, '' AS motion_x, '' AS ref_index_l0 FROM part
UNION ALL SELECT p_partkey, 'mv', '', '', CAST(-p_size AS VARCHAR), '' FROM part
UNION ALL SELECT p_partkey, 'internal', CAST(p_size AS VARCHAR), '', '', p_size || ';' || (p_size + 1) FROM part
""",
)
def q111(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    qp = rows.select("p_partkey", F.col("p_size").alias("x"), F.lit(26).alias("qp_base"))
    mv = rows.select("p_partkey", (-F.col("p_size")).alias("motion_x"))
    blocks = rows.select("p_partkey", F.col("p_size").alias("x"), F.array(F.col("p_size"), F.col("p_size") + 1).alias("ref_index_l0"))
    return reports.block_evidence(qp, mv, blocks, ["p_partkey"]).select("p_partkey", "record_type", "x", "qp_base", "motion_x", "ref_index_l0")


@query(
    "q112_refused_reports",
    """
WITH s AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'bad id ' || c_custkey WHEN c_custkey % 10 = 1 THEN 'twice-' || (c_custkey // 100) ELSE 'ok_' || c_custkey END AS stream_id FROM customer)
SELECT stream_id, CASE WHEN starts_with(stream_id, 'bad') THEN 'invalid' ELSE 'repeated' END AS reason FROM s GROUP BY stream_id HAVING starts_with(stream_id, 'bad') OR count(*) > 1
""",
)
def q112(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("bad id "), k)).when(k % 10 == 1, F.concat(F.lit("twice-"), F.floor(k / 100))).otherwise(F.concat(F.lit("ok_"), k))
    return reports.refused_ids(table(spark, sf_dir, "customer").select(name.alias("stream_id")))


@query(
    "q113_run_comparison",
    """
WITH m AS (SELECT l_linenumber AS k, l_returnflag AS f, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
l AS (SELECT k, f, 'n' AS metric, CAST(n AS DOUBLE) AS v FROM m UNION ALL SELECT k, f, 'price', CAST(price AS DOUBLE) FROM m)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.metric, b.metric) AS metric, a.v AS tcp, b.v AS udp, b.v - a.v AS change, CASE WHEN a.v < b.v THEN 'tcp' WHEN b.v < a.v THEN 'udp' END AS lower
FROM (SELECT * FROM l WHERE f = 'A') a FULL JOIN (SELECT * FROM l WHERE f = 'R') b ON a.k = b.k AND a.metric = b.metric
""",
)
def q113(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k"), "l_returnflag", cents("l_extendedprice").alias("price"))
    run = lambda f: rows.filter(F.col("l_returnflag") == f).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))
    return reports.comparison(run("A"), run("R"), ["k"], ["n", "price"])


@query(
    "q114_redacted_report",
    """
WITH v AS (SELECT event_id AS o, 0 AS c, 'call-' || user_id AS v FROM events UNION ALL SELECT event_id, 1, 'call-' || (user_id // 2) FROM events),
f AS (SELECT v, min(o * 10 + c) AS first_at FROM v GROUP BY v), a AS (SELECT v, 'call-' || 'x' || row_number() OVER (ORDER BY first_at) AS alias FROM f),
t AS (SELECT event_type AS v, 'type-' || row_number() OVER (ORDER BY min(event_id)) AS alias FROM events GROUP BY event_type)
SELECT event_id, a.alias AS call_id, b.alias AS other_id, 'saw ' || t.alias || ' from ' || a.alias AS detail
FROM events e JOIN a ON a.v = 'call-' || user_id JOIN a b ON b.v = 'call-' || (user_id // 2) JOIN t ON t.v = event_type
""",
)
def q114(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("call-"), "user_id").alias("call_id"), F.concat(F.lit("call-"), F.floor(F.col("user_id") / 2)).alias("other_id"), "event_type"
    )
    calls = reports.aliases(rows, ["call_id", "other_id"], "event_id", "call-x").withColumn("alias", F.replace("alias", F.lit("call-x-"), F.lit("call-x")))
    types = reports.aliases(rows, ["event_type"], "event_id", "type")
    out = reports.redacted(rows.withColumn("was", F.col("call_id")), {"calls": calls}, {"call_id": "calls", "other_id": "calls"})
    said = out.withColumn("detail", F.concat(F.lit("saw "), "event_type", F.lit(" from "), "was"))
    known = said.select("event_id", F.col("was").alias("value"), F.col("call_id").alias("alias")).unionByName(
        said.select("event_id", "event_type").join(types, F.col("event_type") == F.col("value")).select("event_id", "value", "alias")
    )
    return reports.redacted_details(said, ["event_id"], "detail", known).select("event_id", "call_id", "other_id", "detail")


@query(
    "q115_file_contents",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 30000) AS BIGINT)) AS p FROM embeddings)
SELECT vec_id, 172 AS bytes, sha256(unhex('52494646' || 'a4000000' || '57415645666d7420' || '10000000' || '0100' || '0200' || '401f0000' || '007d0000' || '0400' || '1000' || '64617461' || '80000000' ||
  array_to_string(list_transform(p, lambda x: lpad(to_hex((x + 65536) % 256), 2, '0') || lpad(to_hex((x + 65536) % 65536 // 256), 2, '0')), ''))) AS digest
FROM e
""",
)
def q115(spark, sf_dir):
    pcm = F.transform("embedding", lambda x: F.round(x.cast("double") * 30_000).cast("smallint"))
    content = media.wav(pcm, F.lit(8000), F.lit(2))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("digest"))


@query(
    "q116_elementary_stream",
    """
WITH c AS (SELECT conv_id, count(*) AS n, string_agg('00000001' || hex(encode(coalesce(text, ''))), '' ORDER BY turn) AS h FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(length(h) // 2 AS BIGINT) AS bytes, sha256(unhex(h)) AS digest FROM c
""",
)
def q116(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    files = media.elementary_stream(units, ["conv_id"], "turn")
    return files.select("conv_id", "part", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query(
    "q117_history_and_header_counts",
    """
WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS critical, count(DISTINCT event_type) AS kinds, max(event_id) AS newest FROM events GROUP BY user_id)
SELECT user_id, n, critical, kinds, newest FROM u ORDER BY newest DESC LIMIT 20
""",
)
def q117(spark, sf_dir):
    from tracewell.operators.rollups import history

    rows = table(spark, sf_dir, "events").withColumn("severity", F.when(F.col("event_type") == "error", "critical").otherwise("low"))
    return history(rows, ["user_id"], "severity", "event_type", "event_id")


@query(
    "q118_sip_over_tcp",
    """
SELECT conv_id, turn AS cseq, CASE WHEN role = 'user' THEN 'MESSAGE' END AS method, CASE WHEN role <> 'user' THEN 200 END AS status, 'c' || conv_id AS call_id, strlen(coalesce(text, '')) AS body
FROM conversations
""",
)
def q118(spark, sf_dir):
    """Conversations as SIP over one TCP direction each, with line breaks between messages, cut every 300 bytes."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    start = F.when(F.col("role") == "user", "MESSAGE sip:b@h SIP/2.0\r\n").otherwise("SIP/2.0 200 OK\r\n")
    head = F.concat(start, F.lit("Call-ID: c"), "conv_id", F.lit("\r\nCSeq: "), "turn", F.lit(" MESSAGE\r\nl: "), F.octet_length(text), F.lit("\r\n\r\n"))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.encode(head, "UTF-8"), text, F.lit(bytearray(b"\r\n"))).alias("data"))
    stream = media.joined(said, ["conv_id"], "turn", F.col("data"))
    pieces = stream.select("conv_id", "content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(300))).alias("pos"))
    chunks = pieces.select(
        F.concat(F.lit("c-"), "conv_id").alias("capture"), F.lit("0").alias("interface"), F.lit("a").alias("src_ip"), F.lit(5060).alias("src_port"), F.lit("b").alias("dst_ip"),
        F.lit(5060).alias("dst_port"), F.lit(1).cast("bigint").alias("connection"), "pos", F.col("pos").cast("bigint").alias("number"), F.col("pos").cast("bigint").alias("ts_us"),
        F.expr("substring(content, pos + 1, 300)").alias("data"), F.lit(0).cast("bigint").alias("gap"),
    )
    rows = tcp.messages(chunks, tcp.SipFraming).withColumn("text", F.decode("data", "UTF-8"))
    head = F.substring_index("text", "\r\n\r\n", 1)
    status = F.regexp_extract(head, r"^SIP/2\.0 (\d{3})", 1)
    return rows.select(
        F.regexp_extract("capture", r"\d+", 0).cast("bigint").alias("conv_id"), F.regexp_extract(rtsp.header(head, "cseq"), r"^\d+", 0).cast("bigint").alias("cseq"),
        F.when(status == "", F.substring_index(head, " ", 1)).alias("method"), F.when(status != "", status.cast("int")).alias("status"), rtsp.header(head, "call-id").alias("call_id"),
        (F.octet_length("text") - F.octet_length(head) - 4).cast("bigint").alias("body"),
    )


@query(
    "q119_trace_log_and_errors",
    """
SELECT s_suppkey, 'v=0' || chr(10) || 's=' || s_name || chr(10) || 'm=video 0' AS sdp, 'GET rtsp://u:REDACTED@h/' || s_suppkey || ',again REDACTED' AS errors FROM supplier
""",
)
def q119(spark, sf_dir):
    lines = F.array(
        F.lit("start"), F.lit("x=0"), F.lit("[rtsp] SDP:"), F.lit("v=0  "), F.concat(F.lit("s="), "s_name"), F.lit("m=video 0"), F.lit("[rtsp] a=later"), F.lit("b=no"), F.lit("SDP:"), F.lit("c=never")
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(lines).alias("no", "line"))
    found = sdp.session_from_trace(rows, ["s_suppkey"], "no", "line")
    url = F.concat(F.lit("rtsp://u:pw9@h/"), "s_suppkey")
    errors = F.array_join(T.redact_all(F.array(F.concat(F.lit("GET "), url), F.lit("again pw9")), url), ",")
    return found.select("s_suppkey", "sdp", errors.alias("errors"))


@query(
    "q142_probe_frames",
    """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, CASE event_id % 5 WHEN 0 THEN NULL WHEN 3 THEN i // 2 WHEN 4 THEN 1000000 ELSE i END AS r FROM e),
u AS (SELECT *, CASE WHEN r < n AND count(*) OVER (PARTITION BY user_id, r) = 1 THEN r END AS d FROM c)
SELECT user_id, i AS display_index, d AS decode_index, CASE WHEN r IS NULL THEN 'unavailable' WHEN d IS NULL THEN 'not_unique' ELSE 'coded_picture_number' END AS decode_precision,
       i * 40 AS pts_ms, CASE WHEN event_id % 2 = 0 THEN 40 END AS duration_ms, event_id AS packet_position, CASE WHEN event_id % 6 > 0 THEN event_id % 100 END AS packet_size,
       event_id % 4 < 3 AS key_frame, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS interlaced
FROM u
""",
)
def q142(spark, sf_dir):
    """Events as the frames of their users' probe documents; fields are numbers, texts or truth values in turn."""
    n, i = F.col("event_id"), F.col("i")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = lambda c: c.cast("string")
    seconds = F.concat(F.floor(i * 40 / 1000), F.lit("."), F.lpad(text(i * 40 % 1000), 3, "0"))
    fields = [
        F.when(n % 5 == 1, F.concat(F.lit('"coded_picture_number":'), quoted(text(i)))).when(n % 5 == 2, F.concat(F.lit('"coded_picture_number":'), i)).when(
            n % 5 == 3, F.concat(F.lit('"coded_picture_number":'), F.floor(i / 2))).when(n % 5 == 4, F.lit('"coded_picture_number":1000000')),
        F.when(n % 3 == 0, F.concat(F.lit('"pts_time":'), quoted(seconds))).when(n % 3 == 1, F.concat(F.lit('"pts_time":'), seconds)).otherwise(
            F.concat(F.lit('"pts_time":null,"best_effort_timestamp_time":'), seconds)),
        F.when(n % 2 == 0, F.lit('"pkt_duration_time":0.04')).otherwise(F.lit('"pkt_duration_time":"N/A"')),
        F.concat(F.lit('"pkt_pos":'), quoted(text(n))),
        F.concat(F.lit('"pkt_size":'), F.when(n % 6 == 0, quoted(F.lit("x"))).otherwise(text(n % 100))),
        F.element_at(F.array(*map(F.lit, ('"key_frame":1', '"key_frame":"1"', '"key_frame":true', '"other":{"key_frame":1}'))), (n % 4 + 1).cast("int")),
        F.element_at(F.array(*map(F.lit, ('"interlaced_frame":true', '"interlaced_frame":"0"', '"interlaced_frame":[1]'))), (n % 3 + 1).cast("int")),
    ]
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", place.cast("bigint").alias("i"))
    one = frames.select("user_id", "event_id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json"))
    sorted_frames = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "json"))), lambda x: x["json"])
    documents = one.groupBy("user_id").agg(F.concat(F.lit('{"streams":[],"frames":['), F.array_join(sorted_frames, ","), F.lit("]}")).alias("json"))
    names = ["display_index", "decode_index", "decode_precision", "pts_ms", "duration_ms", "packet_position", "packet_size", "key_frame", "interlaced"]
    return probe.probe_frames(documents, ["user_id"], "json").select("user_id", *names)
