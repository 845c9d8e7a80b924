"""Queries of SIP messages and media, decoder logs and camera answers, written as text and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import logs, packets, rtcp, rtsp, sip, soap
from tracewell.queries import dealt, query, table
from tracewell.rules import engine


@query(
    "q123_sip_messages",
    """
SELECT conv_id, turn AS cseq, CASE WHEN role = 'user' THEN 'INVITE' ELSE 'INVITE' END AS method, CASE WHEN role <> 'user' THEN 180 + turn END AS status, 'id-' || conv_id AS call_id,
       'f' || conv_id AS from_tag, CASE WHEN role <> 'user' THEN 't' || conv_id END AS to_tag, 'z9hG4bK' || turn AS branch, md5(coalesce(text, '')) AS body_md5,
       CASE turn % 3 WHEN 1 THEN 'lengths_differ' WHEN 2 THEN 'no_header' END AS problem, 'one two' AS folded
FROM conversations
""",
)
def q123(spark, sf_dir):
    """Conversations as datagrams with short and long names, continued lines, and in part a second length or a line that is no header."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    asks = F.col("role") == "user"
    head = F.concat(
        F.when(asks, F.lit("INVITE sip:b@h SIP/2.0\r\n")).otherwise(F.concat(F.lit("SIP/2.0 "), 180 + F.col("turn"), F.lit(" Ringing\r\n"))),
        F.lit("v: SIP/2.0/UDP h;rport ;branch=z9hG4bK"), "turn", F.lit("\r\nFROM : \"A\" <sip:a@h>;tag=f"), "conv_id", F.lit("\r\nt: <sip:b@h>"),
        F.when(asks, "").otherwise(F.concat(F.lit("; TAG=t"), "conv_id")), F.lit("\r\ni: id-"), "conv_id", F.lit("\r\nX-Long: one\r\n\t two\r\nCSeq: "), "turn",
        F.lit(" INVITE\r\nContent-Length: "), F.octet_length(text), F.when(F.col("turn") % 3 == 1, "\r\nl: 999999").when(F.col("turn") % 3 == 2, "\r\nbroken line").otherwise(""), F.lit("\r\n\r\n"),
    )
    segments = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c-"), "conv_id").alias("capture"), F.col("turn").alias("number"), F.col("turn").alias("ts_us"), F.lit("a").alias("src_ip"), F.lit(5060).alias("src_port"),
        F.lit("b").alias("dst_ip"), F.lit(5060).alias("dst_port"), F.lit("udp").alias("proto"), F.concat(F.encode(head, "UTF-8"), text).alias("payload"),
    )
    rows = sip.messages(segments)
    folded = F.get(F.filter("headers", lambda h: h["name"] == "x-long"), 0)["value"]
    return rows.select(
        F.regexp_extract("capture", r"\d+", 0).cast("bigint").alias("conv_id"), "cseq", "method", "status", "call_id", "from_tag", "to_tag", "branch",
        F.md5("body").alias("body_md5"), "problem", folded.alias("folded"),
    )


@query(
    "q124_media_flows",
    """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
r AS (SELECT user_id % 7 AS ip, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 96 END AS pt, count(*) AS n, min(event_id) AS a, max(event_id) AS b, count(DISTINCT user_id) AS s FROM e GROUP BY 1, 2),
o AS (SELECT s_suppkey AS call, s_suppkey % 9 AS ip, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 96 END AS pt FROM supplier),
c AS (SELECT ip, count(DISTINCT call) > 1 AS shared FROM o GROUP BY ip)
SELECT call, CASE WHEN o.ip = 7 THEN 0 WHEN o.ip = 8 THEN 0 ELSE coalesce(n, 0) END AS packets, CASE WHEN o.ip < 7 THEN a END AS first_packet, CASE WHEN o.ip < 7 THEN b END AS last_packet,
       CASE WHEN o.ip < 7 THEN coalesce(s, 0) ELSE 0 END AS sources, CASE o.ip WHEN 7 THEN 'hold' WHEN 8 THEN 'no_address' ELSE CASE WHEN n > 0 THEN 'candidate' ELSE 'none' END END AS quality, shared
FROM o JOIN c ON c.ip = o.ip LEFT JOIN r ON r.ip = o.ip AND r.pt = o.pt
""",
)
def q124(spark, sf_dir):
    k = F.col("s_suppkey")
    address = F.when(k % 9 == 7, "0.0.0.0").when(k % 9 == 8, "host.example").otherwise(F.concat(F.lit("10.0.0."), k % 9))
    offers = table(spark, sf_dir, "supplier").select(
        F.lit("c").alias("capture"), F.concat(F.lit("call-"), k).alias("call_id"), k.alias("call"), F.lit(0).alias("index"), address.alias("address"), F.lit(4000).alias("port"),
        F.array(F.when(k % 3 == 0, 0).otherwise(96)).cast("array<bigint>").alias("payload_types"),
    )
    events = table(spark, sf_dir, "events")
    packet = rtcp.encode_rtp(F.when(F.col("event_id") % 2 == 0, 0).otherwise(96), F.lit(False), F.col("event_id"), F.col("event_id"), F.col("user_id"), F.lit(bytearray(b"x")))
    segments = events.select(
        F.lit("c").alias("capture"), F.lit("0").alias("interface"), F.col("event_id").alias("number"), F.col("event_id").alias("ts_us"), F.lit("9.9.9.9").alias("src_ip"), F.lit(1).alias("src_port"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 7).alias("dst_ip"), F.lit(4000).alias("dst_port"), F.lit("udp").alias("proto"), packet.alias("payload"),
    )
    found = sip.media_flows(offers, packets.rtp_packets(segments), ["call"])
    return found.select("call", "packets", "first_packet", "last_packet", "sources", "quality", "shared")


_LOG = [
    "[h264] non-existing PPS referenced", "frame 1", "[Parsed_showinfo] n:   {n} pts:1 pts_time:0.5 x", "error while decoding MB 3", "[blackdetect] black_start:{n}.25 black_end:9",
    "quiet", "quiet", "[Parsed_showinfo] n: 900 pts_time:7", "Missing reference picture, default is 1", "could not find ref with POC 5",
]


def _log(spark, sf_dir):
    lines = F.array(*[F.concat(*[p for part in text.split("{n}") for p in (F.lit(part), F.col("p_partkey"))][:-1]) for text in _LOG])
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.posexplode(lines).alias("no", "line"))


@query(
    "q125_decode_issues",
    """
SELECT p_partkey, v.no, v.kind, CASE WHEN v.no < 5 THEN p_partkey + 1 ELSE 901 END AS frame, CASE WHEN v.kind = 'black_segment' THEN p_partkey || '.25' WHEN v.no < 5 THEN '0.5' ELSE '7' END AS time,
       CASE WHEN v.kind = 'black_segment' THEN 'filter_timestamp_nearest_frame' ELSE 'candidate_nearest_log_frame' END AS precision
FROM part, (VALUES (0, 'missing_pps'), (3, 'macroblock_error'), (4, 'black_segment'), (8, 'missing_reference'), (9, 'missing_reference')) v(no, kind)
""",
)
def q125(spark, sf_dir):
    return logs.decode_issues(_log(spark, sf_dir), ["p_partkey"], "no", "line").drop("example")


@query(
    "q126_issue_evidence",
    """
SELECT p_partkey, v.kind, v.n, v.frames AS n_frames, v.kind IN ('macroblock_error', 'missing_reference') AS mentioned, TRUE AS any_reference,
       'macroblock_error x 1: error while decoding MB 3' AS evidence
FROM part, (VALUES ('missing_pps', 1, 1), ('macroblock_error', 1, 1), ('black_segment', 1, 1), ('missing_reference', 2, 1)) v(kind, n, frames)
""",
)
def q126(spark, sf_dir):
    found = logs.issue_summary(logs.decode_issues(_log(spark, sf_dir), ["p_partkey"], "no", "line"), ["p_partkey"], "no")
    one = F.array(F.struct("kind", "n", "example"))
    whole = F.array_sort(F.collect_list(F.struct("kind", "n", "example")).over(Window.partitionBy("p_partkey")))
    joined = found.withColumn("mentioned", logs.mentions(one, ["MB", "reference"])).withColumn("issues", whole)
    return joined.select(
        "p_partkey", "kind", "n", F.size("frames").alias("n_frames"), (F.col("mentioned") & (F.col("kind") != "missing_pps")).alias("mentioned"),
        logs.mentions(F.col("issues"), ["reference picture"]).alias("any_reference"), F.array_join(logs.evidence_of(F.col("issues"), ["decoding mb"]), ",").alias("evidence"),
    )


@query(
    "q127_camera_answers",
    """
SELECT s_suppkey, 'device' AS kind, 0 AS index, 'urn:uuid:' || s_suppkey AS name, 'a,b' AS listed, 'http://10.0.0.' || (s_suppkey % 250) || '/onvif' AS address, NULL AS problem FROM supplier
UNION ALL SELECT s_suppkey, 'service', 0, 'http://media', '2.' || (s_suppkey % 10), 'http://h/media', NULL FROM supplier
UNION ALL SELECT s_suppkey, 'service', 1, 'http://ptz', NULL, NULL, 'no address' FROM supplier
UNION ALL SELECT s_suppkey, 'profile', 0, 'Main & ' || s_name, 'H264,AAC', 'p' || s_suppkey, NULL FROM supplier
UNION ALL SELECT s_suppkey, 'profile', 1, 'second', 'JPEG', NULL, 'no token' FROM supplier
UNION ALL SELECT s_suppkey, 'information', 0, s_name, NULL, 'SN' || s_suppkey, NULL FROM supplier
""",
)
def q127(spark, sf_dir):
    k = F.col("s_suppkey")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><s:Envelope xmlns:s="http://soap" xmlns:d="http://wsd" xmlns:t=\'http://tt\'><s:Body><d:ProbeMatches><d:ProbeMatch><a:EndpointReference><a:Address> urn:uuid:'), k,
        F.lit("</a:Address></a:EndpointReference><d:Types>a b</d:Types><d:Scopes/><d:XAddrs>http://10.0.0."), k % 250, F.lit("/onvif</d:XAddrs></d:ProbeMatch></d:ProbeMatches>"),
        F.lit("<t:Service><t:Namespace>http://media</t:Namespace><t:XAddr>http://h/media</t:XAddr><t:Version><v:Major>2</v:Major><v:Minor>"), k % 10,
        F.lit("</v:Minor></t:Version></t:Service><t:Service><t:Namespace>http://ptz</t:Namespace></t:Service>"),
        F.lit('<m:Profiles token="p'), k, F.lit('" fixed="true"><m:Name>Main &amp; '), "s_name",
        F.lit("</m:Name><m:VideoEncoderConfiguration><m:Encoding>H264</m:Encoding></m:VideoEncoderConfiguration><m:AudioEncoder><m:Encoding>AAC</m:Encoding></m:AudioEncoder></m:Profiles>"),
        F.lit("<m:Profiles><m:Name>second</m:Name><m:VideoEncoder><m:Encoding>JPEG</m:Encoding></m:VideoEncoder></m:Profiles><Manufacturer>"), "s_name",
        F.lit("</Manufacturer><SerialNumber>SN"), k, F.lit("</SerialNumber></s:Body></s:Envelope>"),
    )
    rows, key = table(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml")), ["s_suppkey"]
    row = lambda df, kind, name, listed, address, problem: df.select(
        "s_suppkey", F.lit(kind).alias("kind"), F.col("index").alias("index") if "index" in df.columns else F.lit(0).alias("index"), name.alias("name"), listed.alias("listed"),
        address.alias("address"), problem.alias("problem"),
    )
    none = F.lit(None).cast("string")
    c = F.col
    parts = [
        row(soap.devices(rows, key, "xml"), "device", c("address"), F.array_join("types", ","), F.array_join("xaddrs", ","), none),
        row(soap.services(rows, key, "xml"), "service", c("namespace"), c("version"), c("xaddr"), c("problem")),
        row(soap.profiles(rows, key, "xml"), "profile", c("name"), F.concat_ws(",", "video_encoding", "audio_encoding"), c("token"), c("problem")),
        row(soap.device_information(rows, key, "xml"), "information", c("manufacturer"), none, c("serial"), none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "q135_challenges_and_sessions",
    """
SELECT c_custkey AS cust, c_custkey % 3 <> 0 AS accepted_later, 'cam-' || (c_custkey % 5) AS server, 'OPTIONS,PLAY,PAUSE' AS methods, 's1,s2' AS sessions, TRUE AS several FROM customer
""",
)
def q135(spark, sf_dir):
    """Customers as captures with two connections: a challenge that is answered or not, and a second session."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey", F.lit("0").alias("interface"), F.lit("a b").alias("ends"))
    tries = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("request_packet"), F.lit(m).alias("method"), status.alias("status"))
        for n, m, status in ((1, "DESCRIBE", F.lit(401)), (2, "PLAY", F.lit(200)), (3, "DESCRIBE", F.when(k % 3 == 0, 403).otherwise(200)))
    ])
    found = rtsp.retried(base.withColumn("capture", F.col("c_custkey")).withColumn("connection", F.lit(1)).select("*", F.inline(tries)))
    first = found.filter("status = 401").select(F.col("c_custkey").alias("cust"), "accepted_later")
    each = F.array(*[
        F.struct(
            F.lit(i).alias("first_packet"), F.lit(i == 1).alias("connected"), F.lit(False).alias("authenticated"),
            F.when(F.lit(i == 1), F.concat(F.lit("cam-"), k % 5)).otherwise("late").alias("server"), F.lit(None).cast("string").alias("content_base"),
            F.array(*map(F.lit, methods)).alias("public_methods"), F.lit(f"s{i}").alias("session"),
        )
        for i, methods in ((1, ("OPTIONS", "PLAY")), (2, ("PLAY", "PAUSE")))
    ])
    merged = rtsp.merged_sessions(base.select(F.col("c_custkey").alias("cust"), F.inline(each)), ["cust"], "first_packet")
    return first.join(merged, "cust").select(
        "cust", "accepted_later", "server", F.array_join("public_methods", ",").alias("methods"), F.array_join("sessions", ",").alias("sessions"), "several"
    )


@query(
    "q136_concatenated_events",
    """
SELECT 0 AS feed, o_orderkey AS key, o_orderstatus AS kind, NULL AS rule_id FROM orders UNION ALL SELECT 1, event_id, event_type, NULL FROM events
UNION ALL SELECT 2, s_suppkey, NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'RTP-015' ELSE 'RTSP-001' END FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0
""",
)
def q136(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("kind"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("kind"))
    k = F.col("s_suppkey")
    found = table(spark, sf_dir, "supplier").select(k.alias("key"), F.when(k % 2 == 0, "RTP-015").otherwise("RTSP-001").alias("rule_id"))
    return engine.concatenated(orders, events, engine.of_source(found, F.col("key") % 3 == 0)).select("feed", "key", "kind", "rule_id")
