"""RTSP on reassembled streams: requests and responses, sessions, tracks and the channels and ports they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import sdp
from tracewell.operators.tcp import STREAM

#: Both directions of one connection.
CONNECTION = ["capture", "interface", "ends", "connection"]


def header(text: Column, name: str) -> Column:
    """The first value of a header; null if there is none."""
    value = F.regexp_extract(text, rf"(?im)^{name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(text.rlike(rf"(?im)^{name}[ \t]*:"), value)


def pair(transport: Column, name: str, i: int) -> Column:
    """The first (0) or second (1) number of ``name=a-b`` in a Transport header."""
    value = F.try_element_at(sdp.parameters(transport), F.lit(name))
    return F.get(F.split(value, "-"), i).try_cast("int")


def observed(messages: DataFrame) -> DataFrame:
    """RTSP messages with their parts: method and uri of requests, status and reason of responses, headers, body."""
    text = F.decode("data", "UTF-8")
    rows = messages.filter("kind != 'interleaved'").withColumn("text", text)
    head = F.substring_index("text", "\r\n\r\n", 1)
    start = F.regexp_extract(head, r"^([^\r\n]*)", 1)
    response = start.startswith("RTSP/")
    ends = [F.concat_ws("|", f"{side}_ip", F.lpad(F.col(f"{side}_port").cast("string"), 5, "0")) for side in ("src", "dst")]
    return rows.select(
        "capture",
        "interface",
        F.array_join(F.array_sort(F.array(*ends)), " ").alias("ends"),
        *STREAM[2:],
        "number",
        "ts_us",
        response.alias("response"),
        F.when(~response, F.get(F.split(start, r"\s+"), 0)).alias("method"),
        F.when(~response, F.get(F.split(start, r"\s+"), 1)).alias("uri"),
        F.when(response, F.coalesce(F.regexp_extract(start, r"^\S+\s+(\d{1,5})", 1).try_cast("int"), F.lit(0))).alias("status"),
        F.when(response, F.regexp_extract(start, r"^\S+ \S+ (.*)$", 1)).alias("reason"),
        header(head, "cseq").alias("cseq"),
        F.trim(F.substring_index(header(head, "session"), ";", 1)).alias("session"),
        header(head, "transport").alias("transport"),
        header(head, "authorization").isNotNull().alias("authorized"),
        header(head, "server").alias("server"),
        header(head, "content-base").alias("content_base"),
        F.filter(F.split(header(head, "public"), r"\s*,\s*"), lambda m: m != "").alias("public_methods"),
        (F.col("kind") == "rtsp_cut").alias("cut"),
        F.when(
            (header(head, "content-type").rlike("(?i)application/sdp") | F.col("text").rlike(r"(?s)\r\n\r\nv=0")),
            F.substring(F.col("text"), F.length(head) + 5, F.length("text")),
        ).alias("sdp"),
        F.octet_length("data").alias("size"),
        F.md5(F.substring(F.col("text"), F.length(head) + 5, F.length("text"))).alias("body_md5"),
    )


def transactions(rows: DataFrame) -> DataFrame:
    """Requests with their responses: equal CSeq on one connection, the response takes the latest open request.

    A request that another one with its CSeq replaces is left out, as is a
    response without a request. Requests without a response have status 0.
    """
    w = Window.partitionBy(*CONNECTION, "cseq").orderBy("number", "response")
    asked = rows.filter("cseq is not null")
    previous = {c: F.lag(c).over(w).alias("_" + c) for c in ("response", "method", "uri", "ts_us", "transport", "src_ip", "dst_ip", "number")}
    joined = asked.select("*", *previous.values(), F.lead("response").over(w).alias("_after"))
    answered = joined.filter("response and _response = false").select(
        *CONNECTION,
        F.col("cseq").try_cast("bigint").alias("cseq"),
        F.col("_method").alias("method"),
        F.col("_uri").alias("uri"),
        "status",
        "reason",
        F.expr("(ts_us - _ts_us) div 1000").alias("elapsed_ms"),
        F.col("_number").alias("request_packet"),
        F.col("number").alias("response_packet"),
        F.coalesce("transport", "_transport").alias("transport"),
        F.col("_transport").alias("request_transport"),
        F.col("_src_ip").alias("client_ip"),
        F.col("_dst_ip").alias("server_ip"),
        "session",
    )
    pending = joined.filter("not response and _after is null").select(
        *CONNECTION,
        F.col("cseq").try_cast("bigint").alias("cseq"),
        "method",
        "uri",
        F.lit(0).alias("status"),
        F.lit("no response").alias("reason"),
        F.lit(0).cast("bigint").alias("elapsed_ms"),
        F.col("number").alias("request_packet"),
    )
    return answered.unionByName(pending, allowMissingColumns=True)


def retried(found: DataFrame) -> DataFrame:
    """Transactions with ``accepted_later``: for status 401, whether the method succeeds later on the connection."""
    w = Window.partitionBy(*CONNECTION, "method").orderBy(F.desc("request_packet")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.bool_or((F.col("status") > 0) & (F.col("status") < 300)).over(w), F.lit(False))
    return found.withColumn("accepted_later", F.when(F.col("status") == 401, later))


def descriptions(rows: DataFrame) -> DataFrame:
    """Session descriptions of successful responses and of ANNOUNCE, with the last Content-Base at that time."""
    w = Window.partitionBy(*CONNECTION).orderBy("number", "response")
    based = rows.withColumn("base", F.last("content_base", True).over(w))
    return based.filter("sdp is not null and (status = 200 or method = 'ANNOUNCE')").select(*CONNECTION, "number", "base", "sdp")


def bindings(rows: DataFrame) -> DataFrame:
    """What each successful SETUP agreed on: the track, its channels or ports.

    The track is the first whose control is the request's address or its last
    part, or the only track, of the description that was last seen before.
    """
    setups = transactions(rows).filter("status = 200 and method = 'SETUP'")
    seen = descriptions(rows)
    last = (
        setups.select(*CONNECTION, "response_packet")
        .join(seen, CONNECTION)
        .filter("number <= response_packet")
        .groupBy(*CONNECTION, "response_packet")
        .agg(F.max_by(F.struct("sdp", "base"), "number").alias("last"))
        .select(*CONNECTION, "response_packet", "last.*")
    )
    key = [*CONNECTION, "response_packet"]
    tracks = sdp.media(last, [*key, "base"], "sdp")
    alone = F.count(F.lit(1)).over(Window.partitionBy(*key)) == 1
    tracks = tracks.withColumn("alone", alone).select(*key, "index", "kind", "codecs", "payload_types", "control", "frame_rate", "frame_size", "alone")
    fits = (F.col("control") != "*") & (F.col("control") != "") & (
        (F.col("uri") == F.col("control")) | F.col("uri").endswith(F.concat(F.lit("/"), F.col("control")))
    )
    w = Window.partitionBy(*key).orderBy(F.desc("fits"), "index")
    matched = (
        setups.join(tracks, key)
        .withColumn("fits", F.coalesce(fits, F.lit(False)))
        .filter("fits or alone")
        .withColumn("rn", F.row_number().over(w))
        .filter("rn = 1")
    )
    port = lambda name, i: F.coalesce(pair(F.col("transport"), name, i), pair(F.col("request_transport"), name, i))
    return matched.select(
        *CONNECTION,
        "request_packet",
        "response_packet",
        "session",
        "index",
        "kind",
        "codecs",
        "control",
        "frame_rate",
        "frame_size",
        F.when(F.lower("transport").contains("tcp"), "tcp").otherwise("udp").alias("transport"),
        pair(F.col("transport"), "interleaved", 0).alias("rtp_channel"),
        pair(F.col("transport"), "interleaved", 1).alias("rtcp_channel"),
        "client_ip",
        "server_ip",
        port("client_port", 0).alias("client_port"),
        F.coalesce(port("client_port", 1), port("client_port", 0) + 1).alias("client_rtcp_port"),
        pair(F.col("transport"), "server_port", 0).alias("server_port"),
        F.coalesce(pair(F.col("transport"), "server_port", 1), pair(F.col("transport"), "server_port", 0) + 1).alias("server_rtcp_port"),
    )


def sessions(rows: DataFrame) -> DataFrame:
    """One row per connection: server, base, methods, session, whether a request carried credentials, errors."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("number"))).alias(c)
    return rows.groupBy(*CONNECTION).agg(
        F.bool_or("response").alias("connected"),
        F.bool_or("authorized").alias("authenticated"),
        *[last(c) for c in ("server", "content_base", "public_methods")],
        F.max_by("session", F.when(F.col("session").isNotNull() & (F.col("status") < 300), F.col("number"))).alias("session"),
        F.bool_or("cut").alias("cut_header"),
        F.min("number").alias("first_packet"),
        F.max("number").alias("last_packet"),
    )


def _place(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, connection: Column, channel: Column, ends: Column | None = None) -> Column:
    """Where a packet arrives: a channel of a connection, or a port that an address sends to."""
    sides = [F.concat_ws("|", ip, F.lpad(port.cast("string"), 5, "0")) for ip, port in ((src_ip, src_port), (dst_ip, dst_port))]
    both = F.array_join(F.array_sort(F.array(*sides)), " ") if ends is None else ends
    return F.when(channel >= 0, F.concat_ws("/", both, connection, channel)).otherwise(F.concat_ws(">", src_ip, sides[1]))


def bound(rows: DataFrame, agreed: DataFrame) -> DataFrame:
    """Rows of flows with ``binding``, the latest one of ``bindings`` before them that fits; null without one.

    A binding to a channel fits what comes on it; one to a port fits datagrams of
    the server's address to it, from the server's port if that was agreed on and
    else from any. Rows need number, the addresses and ports, connection and
    channel (-1 for datagrams). Bindings and rows are merged in one shuffle.
    """
    binding = F.struct(*[c for c in agreed.columns if c not in ("capture", "interface")])
    common = ["capture", "interface", F.col("response_packet").alias("number"), binding.alias("_new")]
    no_port, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    channels = agreed.filter("rtp_channel is not null").select(
        *common, _place(no_text, no_port, no_text, no_port, F.col("connection"), F.col("rtp_channel"), F.col("ends")).alias("_place"), no_port.alias("_port")
    )
    ports = agreed.filter("rtp_channel is null and client_port is not null").select(
        *common,
        _place(F.col("server_ip"), no_port, F.col("client_ip"), F.col("client_port"), F.lit(0), F.lit(-1)).alias("_place"),
        F.col("server_port").cast("bigint").alias("_port"),
    )
    place = _place(*map(F.col, ("src_ip", "src_port", "dst_ip", "dst_port", "connection", "channel")))
    some = rows.withColumn("_place", place).withColumn("_port", F.when(F.col("channel") < 0, F.col("src_port").cast("bigint"))).withColumn("_row", F.lit(1))
    both = some.unionByName(channels.unionByName(ports), allowMissingColumns=True)
    key = ["capture", "interface", "_place"]
    latest = lambda value, *more: F.last(value, True).over(Window.partitionBy(*key, *more).orderBy("number", F.asc_nulls_first("_row")))
    new = F.when(F.col("_new").isNotNull(), F.struct("number", F.col("_new").alias("binding")))
    found = both.withColumn("_open", latest(F.when(F.col("_port").isNull(), new))).withColumn("_given", latest(F.when(F.col("_port").isNotNull(), new), "_port"))
    later = F.col("_open.number") > F.coalesce("_given.number", F.lit(-1))
    chosen = F.when(F.coalesce(later, F.lit(False)), F.col("_open.binding")).otherwise(F.col("_given.binding"))
    return found.withColumn("binding", chosen).filter("_row = 1").select(*rows.columns, "binding")


def codec_of(rtp: DataFrame, agreed: DataFrame) -> DataFrame:
    """RTP packets with the codec, clock and channels that their binding's track maps their payload type to.

    Without a mapping a static payload type tells them; otherwise they are null.
    """
    return with_codec(bound(rtp, agreed)).drop("binding")


def with_codec(rows: DataFrame) -> DataFrame:
    mapped = F.get(F.filter("binding.codecs", lambda c: c["payload_type"] == F.col("pt")), 0)
    names = {"codec": "codec", "clock": "clock_rate", "channels": "channels"}
    return rows.withColumns({name: F.coalesce(mapped[field], sdp.static_value(F.col("pt"), field)) for name, field in names.items()})


def merged_sessions(found: DataFrame, key: list[str], order: str) -> DataFrame:
    """Sessions of one capture as one: flags of any, the first server and base, all methods in the order they came, all session names.

    several: the capture holds more than one session.
    """
    sorted_rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce("public_methods", F.array().cast("array<string>")).alias("m"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return found.groupBy(*key).agg(
        F.bool_or("connected").alias("connected"), F.bool_or("authenticated").alias("authenticated"), first("server"), first("content_base"),
        F.array_distinct(F.flatten(F.transform(sorted_rows, lambda r: r["m"]))).alias("public_methods"),
        F.array_sort(F.collect_set("session")).alias("sessions"), (F.count_distinct("session") > 1).alias("several"),
    )
