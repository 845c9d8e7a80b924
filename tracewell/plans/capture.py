"""Queries of what belongs together in a capture: units to frames, datagrams to tracks, reports to streams, and findings from bytes."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import micros
from tracewell.operators import rtcp, rtsp, video
from tracewell.operators.packets import ETHERNET, IPV4, UDP
from tracewell.operators.rtcp import bytes_of
from tracewell.queries import query, table
from tracewell.rules import facts


@query(
    "q137_frames_by_slices",
    """
WITH e AS (SELECT user_id, event_id, event_type, event_type <> 'signup' AS s, (event_id // 7) % 5 * 3600 AS ts, event_id % 3 <> 0 AS m FROM events),
p AS (SELECT *, last_value(CASE WHEN s THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pts FROM e),
b AS (SELECT *, CASE WHEN event_type IN ('view', 'purchase') THEN 'slice_header' WHEN event_type = 'error' AND ts IS DISTINCT FROM pts THEN 'rtp_timestamp' END AS boundary FROM p),
o AS (SELECT *, CASE WHEN s THEN count(boundary) OVER (PARTITION BY user_id ORDER BY event_id) END AS own FROM b),
f AS (SELECT *, coalesce(own, first_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
                         last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS frame FROM o),
g AS (SELECT user_id, frame, count(*) AS units, min(event_id) AS first_seq, max(event_id) AS last_seq, bool_or(event_type = 'purchase') AS idr, max(boundary) AS boundary,
             bool_or(m) AS marked, min_by(ts, event_id) FILTER (s) AS ts FROM f WHERE frame > 0 GROUP BY user_id, frame)
SELECT user_id, frame, units, first_seq, last_seq, idr, boundary, coalesce(NOT marked AND lead(ts) OVER (PARTITION BY user_id ORDER BY frame) <> ts, FALSE) AS missing_marker FROM g
""",
)
def q137(spark, sf_dir):
    """Events as units of their users: views and purchases begin pictures, clicks go on, headers of errors end early, signups are messages; times come again."""
    kind, number = F.col("event_type"), F.col("event_id")
    heads = {"view": b"\x41\xb8", "purchase": b"\x65\xb8", "click": b"\x41\x4f", "error": b"\x41\xb0", "signup": b"\x06\x01"}
    data = F.coalesce(*[F.when(kind == name, F.lit(bytearray(head))) for name, head in heads.items()])
    units = table(spark, sf_dir, "events").select(
        "user_id", number.alias("first_seq"), number.alias("last_seq"), (F.floor(number / 7) % 5 * 3600).alias("rtp_ts"), (number % 3 != 0).alias("marker"), F.lit(True).alias("complete"), data.alias("data"),
    )
    return video.access_units(units, ["user_id"]).select("user_id", "frame", "units", "first_seq", "last_seq", "idr", "boundary", "missing_marker")


@query(
    "q138_codecs_of_datagrams",
    """
WITH e AS (SELECT event_id, event_type = 'signup' AS setup, user_id % 3 AS host, 7000 + user_id % 5 AS port, 5000 + event_id % 4 AS source FROM events),
s AS (SELECT event_id, host, port, CASE WHEN event_id % 3 > 0 THEN source END AS source FROM e WHERE setup),
x AS (SELECT e.event_id, max(s.event_id) AS setup FROM e LEFT JOIN s ON s.host = e.host AND s.port = e.port AND s.event_id < e.event_id AND (s.source IS NULL OR s.source = e.source)
      WHERE NOT e.setup GROUP BY e.event_id)
SELECT event_id AS number, 'C' || setup AS codec, CAST(8000 + setup AS BIGINT) AS clock FROM x
""",
)
def q138(spark, sf_dir):
    """Events as datagrams of three hosts to five ports; signups are bindings, two in three of them with the server's port."""
    number = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.lit("events").alias("capture"), F.lit("0").alias("interface"), number.alias("number"), F.concat(F.lit("192.0.2."), F.col("user_id") % 3).alias("src_ip"),
        (5000 + number % 4).alias("src_port"), F.lit("198.51.100.1").alias("dst_ip"), (7000 + F.col("user_id") % 5).alias("dst_port"),
        F.lit(0).alias("connection"), F.lit(-1).alias("channel"), F.lit(96).alias("pt"), (F.col("event_type") == "signup").alias("setup"),
    )
    codec = F.struct(F.lit(96).alias("payload_type"), F.concat(F.lit("C"), "number").alias("codec"), (8000 + F.col("number")).alias("clock_rate"), F.lit(1).alias("channels"))
    agreed = rows.filter("setup").select(
        "capture", "interface", F.lit("").alias("ends"), "connection", F.col("number").alias("response_packet"), F.array(codec).alias("codecs"), F.lit(None).cast("int").alias("rtp_channel"),
        F.col("src_ip").alias("server_ip"), F.col("dst_ip").alias("client_ip"), F.col("dst_port").alias("client_port"), F.when(F.col("number") % 3 > 0, F.col("src_port")).alias("server_port"),
    )
    return rtsp.codec_of(rows.filter("not setup").drop("setup"), agreed).select("number", "codec", F.col("clock").cast("bigint").alias("clock"))


@query(
    "q139_reports_of_flows",
    """
WITH f AS (SELECT DISTINCT user_id AS ssrc, 6000 + user_id % 4 AS sp, user_id AS stream FROM events UNION ALL
           SELECT DISTINCT user_id, 6001 + user_id % 4, user_id + 1000000 FROM events WHERE user_id % 5 = 0),
r AS (SELECT event_id AS number, user_id AS ssrc, 6000 + event_id % 6 AS sp, 7000 + event_id % 3 AS dp FROM events),
x AS (SELECT number, count(stream) AS candidates, min(stream) AS stream FROM r LEFT JOIN f ON f.ssrc = r.ssrc AND r.sp - f.sp IN (0, 1) AND r.dp - 7000 IN (0, 1) GROUP BY number)
SELECT number, candidates, CASE WHEN candidates = 1 THEN stream END AS stream FROM x
""",
)
def q139(spark, sf_dir):
    """Events as reports of their users from six ports to three; every fifth user has a second stream one port higher."""
    ends = [F.lit("c").alias("capture"), F.lit("0").alias("interface"), F.lit("192.0.2.1").alias("src_ip"), F.lit("198.51.100.1").alias("dst_ip")]
    inside = [F.lit(0).alias("connection"), F.lit(-1).alias("channel")]
    rows = table(spark, sf_dir, "events")
    user = F.col("user_id")
    users = rows.select("user_id").distinct()
    flow = lambda up, name: [*ends, *inside, user.alias("ssrc"), (6000 + up + user % 4).alias("src_port"), F.lit(7000).alias("dst_port"), (user + name).alias("stream")]
    flows = users.select(*flow(0, 0)).unionByName(users.filter("user_id % 5 = 0").select(*flow(1, 1_000_000)))
    reports = rows.select(*ends, *inside, user.alias("ssrc"), (6000 + F.col("event_id") % 6).alias("src_port"), (7000 + F.col("event_id") % 3).alias("dst_port"), F.col("event_id").alias("number"))
    found, warnings = rtcp.reports_of_flows(reports, flows, "stream")
    return found.select("number", F.lit(1).cast("bigint").alias("candidates"), "stream").unionByName(
        warnings.select("number", F.col("candidates").cast("bigint"), F.lit(None).cast("bigint").alias("stream"))
    )


def datagram(payload: Column, source: Column, target: Column) -> Column:
    """The Ethernet frame of a datagram between two fixed addresses."""
    size = F.octet_length(payload)
    head = [bytes_of(F.lit(0), 6), bytes_of(F.lit(0), 6), bytes_of(F.lit(IPV4), 2), F.lit(bytearray([0x45, 0])), bytes_of(size + 28, 2), bytes_of(F.lit(0), 4), F.lit(bytearray([64, UDP, 0, 0]))]
    return F.concat(*head, F.lit(bytearray([192, 0, 2, 1, 198, 51, 100, 1])), bytes_of(source, 2), bytes_of(target, 2), bytes_of(size + 8, 2), F.lit(bytearray([0, 0])), payload)


@query(
    "q140_capture_findings",
    """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 AS gap FROM e WHERE event_id % 20 > 0),
f AS (SELECT user_id, min(event_id) AS first, count(*) AS n, coalesce(max(gap), 0) AS g, count(*) FILTER (gap > 0) AS gaps, count(*) >= 50 AS enough FROM s GROUP BY user_id),
k AS (SELECT *, 'stream-' || lpad(CAST(row_number() OVER (ORDER BY first) AS VARCHAR), 4, '0') AS stream_id FROM f),
r(rule_id, severity, confidence) AS (VALUES ('RTP-015', 'high', 95), ('RTP-016', 'critical', 95), ('AUD-042', 'high', 90), ('AUD-043', 'medium', 85), ('AUD-046', 'medium', 80))
SELECT stream_id, rule_id, CASE WHEN enough THEN severity ELSE 'medium' END AS severity, CASE WHEN enough THEN confidence ELSE 55 END AS confidence
FROM k JOIN r ON CASE rule_id WHEN 'RTP-015' THEN gaps > 0 WHEN 'RTP-016' THEN g > 1 WHEN 'AUD-042' THEN gaps > 0 WHEN 'AUD-043' THEN enough AND user_id % 2 = 0 ELSE FALSE END
""",
)
def q140(spark, sf_dir):
    """Events as a capture: each user is a stream of PCMU between two ports of its own, one event in twenty got lost, users with even numbers are silent."""
    number = F.col("event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("i", place.cast("bigint")).filter(number % 20 > 0)
    sound = F.when(F.col("user_id") % 2 == 0, F.lit(bytearray(b"\xff" * 160))).otherwise(F.lit(bytearray(b"\x80" * 160)))
    packet = rtcp.encode_rtp(F.lit(0), F.lit(False), F.col("i") % 65536, F.col("i") * 160, F.col("user_id") + 7, sound)
    frames = rows.select(
        F.lit("events").alias("capture"), number.alias("number"), micros("ts").alias("ts_us"), F.lit("0").alias("interface"), F.lit(ETHERNET).alias("link_type"), F.lit(False).alias("truncated"),
        datagram(packet, 5004 + F.floor(F.col("user_id") / 50_000), 10_000 + F.col("user_id") % 50_000).alias("data"), F.lit(None).cast("string").alias("error"),
    )
    return facts.capture_findings(frames).select("stream_id", "rule_id", "severity", "confidence")
