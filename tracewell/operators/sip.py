"""SIP signalling: messages from payloads, then transactions, dialogs and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Request methods and compact header names.
METHODS = ["INVITE", "ACK", "BYE", "CANCEL", "OPTIONS", "REGISTER", "PRACK", "UPDATE", "INFO", "SUBSCRIBE", "NOTIFY", "REFER", "MESSAGE", "PUBLISH"]
COMPACT = {"via": "v", "from": "f", "to": "t", "call-id": "i", "contact": "m", "content-length": "l", "content-type": "c"}
START = rf"(?s)^(?:SIP/2\.0 \d{{3}}|(?:{'|'.join(METHODS)}) \S+ SIP/2\.0)"


def of_streams(framed: DataFrame) -> DataFrame:
    """SIP messages cut out of TCP streams, in the form of segments."""
    return framed.filter("kind = 'sip'").select(
        "capture", "number", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", F.lit("sip").alias("proto"), F.col("data").alias("payload")
    )


def parameter(value: Column, name: str) -> Column:
    """A parameter of a header's value, without quotes; null if there is none."""
    found = F.regexp_extract(value, rf"(?i);\s*{name}\s*=\s*\"?([^;,\s>\"]*)", 1)
    return F.when(found != "", found)


def messages(segments: DataFrame) -> DataFrame:
    """SIP messages among datagrams and messages of streams.

    Columns: packet, time, endpoints, method or status, call, tags, branch,
    CSeq, headers (all of them in order, continued lines joined, short names
    long), body, what its description offers, and problem: the lengths given
    differ, the body ends early, or a line is no header. A body ends where its
    length says.
    """
    text = F.decode("payload", "UTF-8")
    found = segments.filter("proto in ('udp', 'sip')").withColumn("text", text).filter(F.col("text").rlike(START))
    head = F.regexp_replace(F.substring_index("text", "\r\n\r\n", 1), r"\r\n[ \t]+", " ")
    rest = F.substring(F.col("text"), F.length(F.substring_index("text", "\r\n\r\n", 1)) + 5, F.length("text"))
    lines = F.slice(F.split(head, "\r\n"), F.lit(2), F.greatest(F.size(F.split(head, "\r\n")) - 1, F.lit(0)))
    long = F.create_map(*[F.lit(x) for name, short in COMPACT.items() for x in (short, name)])
    key = lambda line: F.lower(F.trim(F.substring_index(line, ":", 1)))
    headers = F.transform(
        F.filter(lines, lambda x: F.instr(x, ":") > 1),
        lambda x: F.struct(F.coalesce(F.try_element_at(long, key(x)), key(x)).alias("name"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")),
    )
    found = found.select("*", head.alias("head"), rest.alias("rest"), headers.alias("headers"), lines.alias("lines"))
    lengths = F.array_distinct(F.transform(F.filter("headers", lambda h: h["name"] == "content-length"), lambda h: h["value"].try_cast("int")))
    length = F.get(lengths, 0)
    body = F.when(length.isNotNull(), F.decode(F.substring(F.encode("rest", "UTF-8"), F.lit(1), length), "UTF-8")).otherwise(F.col("rest"))
    problem = (
        F.when(F.size(lengths) > 1, "lengths_differ")
        .when(F.octet_length("rest") < length, "body_ends_early")
        .when(F.exists("lines", lambda x: (x != "") & (F.instr(x, ":") < 2)), "no_header")
    )
    status = F.regexp_extract("head", r"^SIP/2\.0 (\d{3})", 1)
    value = lambda name: F.get(F.filter("headers", lambda h: h["name"] == name), 0)["value"]
    media = F.regexp_extract_all(body, F.lit(r"(?m)^m=(\w+) (\d+) \S+ ([\d ]+)"), F.lit(1))
    return found.select(
        "capture",
        F.col("number").alias("packet"),
        "ts_us",
        F.concat_ws(":", "src_ip", "src_port").alias("source"),
        F.concat_ws(":", "dst_ip", "dst_port").alias("destination"),
        F.regexp_extract(value("cseq"), r"\d+\s+(\w+)", 1).alias("method"),
        F.when(status != "", status.cast("int")).alias("status"),
        value("call-id").alias("call_id"),
        parameter(value("from"), "tag").alias("from_tag"),
        parameter(value("to"), "tag").alias("to_tag"),
        parameter(value("via"), "branch").alias("branch"),
        F.regexp_extract(value("cseq"), r"^(\d+)", 1).try_cast("bigint").alias("cseq"),
        "headers",
        body.alias("body"),
        problem.alias("problem"),
        F.size(media).alias("sdp_media"),
        F.when(body != "", F.regexp_extract(body, r"(?m)^c=IN IP[46] (\S+)", 1)).alias("sdp_address"),
        F.when(body.rlike(r"(?m)^m="), F.regexp_extract(body, r"(?m)^m=\w+ (\d+)", 1).try_cast("int")).alias("sdp_port"),
    )


def transactions(rows: DataFrame) -> DataFrame:
    """One row per (call, branch, CSeq, method): requests, retransmissions, statuses, latencies in ms."""
    key = ["capture", "call_id", "branch", "cseq", "method"]
    request = F.col("status").isNull()
    final = F.col("status") >= 200
    asked = F.min(F.when(request, F.col("ts_us")))
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("messages"),
        F.greatest(F.count_if(request) - 1, F.lit(0)).alias("retransmissions"),
        F.max(F.when(~final, F.col("status"))).alias("provisional"),
        F.min_by("status", F.when(final, F.col("packet"))).alias("final_status"),
        F.floor((F.min(F.when(~request, F.col("ts_us"))) - asked) / 1000).alias("first_response_ms"),
        F.floor((F.min(F.when(final, F.col("ts_us"))) - asked) / 1000).alias("final_ms"),
        F.min("packet").alias("first_packet"),
        F.max("packet").alias("last_packet"),
    )


def dialogs(rows: DataFrame) -> DataFrame:
    """One row per call and unordered pair of tags, with its state."""
    pair = [F.least("from_tag", "to_tag").alias("tag_a"), F.greatest("from_tag", "to_tag").alias("tag_b")]
    both = rows.filter("from_tag is not null and to_tag is not null")
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    is_of = lambda m: F.col("method") == m
    state = (
        F.when(F.bool_or(is_of("BYE") & ok), "terminated")
        .when(F.bool_or(is_of("BYE") & F.col("status").isNull()), "terminating")
        .when(F.bool_or(is_of("ACK")), "confirmed")
        .when(F.bool_or(is_of("INVITE") & ok), "answered")
        .otherwise("early")
    )
    return both.groupBy("capture", "call_id", *pair).agg(
        state.alias("state"),
        F.count(F.lit(1)).alias("messages"),
        F.min("packet").alias("first_packet"),
        F.max("packet").alias("last_packet"),
    )


def findings(rows: DataFrame) -> DataFrame:
    """Messages without a required header, and requests whose CSeq falls back inside a dialog direction."""
    required = {c: F.col(c).isNull() for c in ("call_id", "from_tag", "branch", "cseq")}
    missing = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in required.items()])), ",")
    lacking = rows.withColumn("detail", missing).filter("detail != ''").select(
        "capture", "packet", F.lit("missing_required_header").alias("code"), "detail"
    )
    w = Window.partitionBy("capture", "call_id", "from_tag", "source").orderBy("packet")
    high = F.max("cseq").over(w.rowsBetween(Window.unboundedPreceding, -1))
    requests = rows.filter("status is null and method not in ('ACK', 'CANCEL') and call_id is not null")
    fell = requests.withColumn("high", high).filter("cseq < high").select(
        "capture", "packet", F.lit("cseq_regression").alias("code"), F.concat_ws("<", "cseq", "high").alias("detail")
    )
    return lacking.unionByName(fell)


#: What announced media and packets are joined by, and the form of an address.
_ENDPOINT = ["capture", "dst_ip", "dst_port"]
_ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*)$"


def _targets(offers: DataFrame) -> DataFrame:
    """Announced media with the destination of their packets: dst_ip (null if the address is none) and dst_port."""
    from tracewell.functions.text import unspecified

    usable = F.coalesce(F.col("address").rlike(_ADDRESS) & ~unspecified(F.col("address")), F.lit(False))
    return offers.withColumn("dst_ip", F.when(usable, F.col("address"))).withColumn("dst_port", F.col("port"))


def media_sources(offers: DataFrame, rtp: DataFrame) -> DataFrame:
    """The ssrcs that reached announced media: capture, dst_ip, dst_port, payload_types, ssrc.

    One row per ssrc and announced endpoint with its payload types, however many
    calls announce them: a list for each call would grow with calls times sources.
    """
    wanted = _targets(offers).filter("dst_ip is not null").select(*_ENDPOINT, "payload_types").distinct()
    seen = rtp.select(*_ENDPOINT, "pt", "ssrc").distinct()
    return seen.join(wanted.withColumn("pt", F.explode("payload_types")), [*_ENDPOINT, "pt"]).select(*_ENDPOINT, "payload_types", "ssrc").distinct()


def media_flows(offers: DataFrame, rtp: DataFrame, key: list[str]) -> DataFrame:
    """Announced media (key, call_id, index, address, port, payload_types) with the RTP packets that reached them.

    Packets count if their destination and payload type are those announced.
    Columns: packets, first and last packet and time, sources (how many ssrcs;
    ``media_sources`` lists them), quality: hold (an address of zeros),
    no_address, candidate or none; shared: other calls announce the endpoint too.
    """
    from tracewell.functions.text import unspecified

    flows = rtp.groupBy("capture", "dst_ip", "dst_port", "pt").agg(
        F.count(F.lit(1)).alias("n"), F.min("number").alias("a"), F.max("number").alias("b"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1")
    )
    place = ["capture", *key, "call_id", "index", "address", "port", "payload_types"]
    target = _targets(offers)
    sums = target.withColumn("pt", F.explode_outer("payload_types")).join(flows, [*_ENDPOINT, "pt"], "left").groupBy(*place, "dst_ip", "dst_port").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("packets"), F.min("a").alias("first_packet"), F.max("b").alias("last_packet"), F.min("t0").alias("first_us"), F.max("t1").alias("last_us"),
    )
    counts = media_sources(offers, rtp).groupBy(*_ENDPOINT, "payload_types").agg(F.count(F.lit(1)).alias("sources"))
    joined = sums.join(counts, [*_ENDPOINT, "payload_types"], "left").drop("dst_ip", "dst_port", "payload_types").withColumn("sources", F.coalesce("sources", F.lit(0)))
    is_address = F.col("address").rlike(_ADDRESS)
    calls = joined.groupBy("capture", "address", "port").agg((F.count_distinct("call_id") > 1).alias("shared"))
    quality = F.when(~F.coalesce(is_address, F.lit(False)), "no_address").when(unspecified(F.col("address")), "hold").when(F.col("packets") > 0, "candidate").otherwise("none")
    return joined.join(calls, ["capture", "address", "port"]).withColumn("quality", quality)
