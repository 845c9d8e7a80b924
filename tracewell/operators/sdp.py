"""Session descriptions as tables of media sections, and the comparison of offers with answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the audio and video profile: payload type, codec, clock rate, channels, kind.
STATIC_TYPES = [
    (0, "PCMU", 8000, 1, "audio"),
    (3, "GSM", 8000, 1, "audio"),
    (4, "G723", 8000, 1, "audio"),
    (5, "DVI4", 8000, 1, "audio"),
    (6, "DVI4", 16000, 1, "audio"),
    (8, "PCMA", 8000, 1, "audio"),
    (9, "G722", 8000, 1, "audio"),
    (10, "L16", 44100, 1, "audio"),
    (11, "L16", 44100, 1, "audio"),
    (14, "MPA", 90000, 1, "audio"),
    (18, "G729", 8000, 1, "audio"),
    (26, "JPEG", 90000, None, "video"),
    (31, "H261", 90000, None, "video"),
    (32, "MPV", 90000, None, "video"),
    (33, "MP2T", 90000, None, "video"),
    (34, "H263", 90000, None, "video"),
]
_STATIC_FIELDS = ["codec", "clock_rate", "channels", "kind"]
#: Video codecs that are analysed.
VIDEO_CODECS = ["h264", "h265", "hevc"]
AUDIO_CODECS = ["pcmu", "pcma", "g722", "g723", "g729", "l16", "mpeg4-generic", "mp4a-latm", "opus"]


def static_value(payload_type: Column, field: str) -> Column:
    """codec, clock_rate, channels or kind of a static payload type; null for others."""
    i = _STATIC_FIELDS.index(field) + 1
    table = F.create_map(*[F.lit(x) for row in STATIC_TYPES if row[i] is not None for x in (row[0], row[i])])
    return F.try_element_at(table, payload_type.cast("int"))


def parameters(text: Column, separator: str = ";") -> Column:
    """``key=value`` parts as a map with lower-case keys; parts without ``=`` are left out, of equal keys the last counts."""
    parts = F.filter(F.split(text, separator), lambda p: F.instr(p, "=") > 0)
    key = lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))
    pairs = F.transform(parts, lambda p, i: F.struct(key(p).alias("k"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def resolve_control(base: Column, control: Column) -> Column:
    """A track's address: absolute ones as they are, others below ``base``; null without either."""
    absolute = control.rlike(r"(?i)^rtsps?://")
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(control, "^/+", ""))
    return F.when(absolute, control).when(control == "*", base).when(control != "", joined)


def session_from_trace(lines: DataFrame, key: list[str], order: str, line: str) -> DataFrame:
    """The session description inside a trace log, per key: the ``x=`` lines after the first one that ends in ``SDP:``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    text = F.rtrim(F.regexp_replace(F.col(line), r"\s+$", ""))
    rows = lines.withColumn("_text", text)
    begun = F.min(F.when(F.col("_text").endswith("SDP:"), F.col(order))).over(Window.partitionBy(*key))
    inside = rows.withColumn("_begun", begun).filter(F.col(order) > F.col("_begun"))
    stopped = F.max((~F.col("_text").rlike(r"^[^\[]=")).cast("int")).over(w)
    kept = inside.withColumn("_stopped", stopped).filter("_stopped = 0")
    return kept.groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_text"))), lambda x: x["_text"]), "\n").alias("sdp")
    )


def _attribute(section: Column, name: str) -> Column:
    value = F.regexp_extract(section, rf"(?m)^a={name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def media(descriptions: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per m-line: key, index (from 0), kind, port, protocol, payload_types, address, codec, clock_rate, control, direction.

    What a section lacks (address, direction) comes from the session part.
    codec and clock_rate are those of the first payload type, null if there is no map.
    """
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r", "")), r"\nm=")
    rows = descriptions.select(*key, parts.alias("parts")).select(
        *key, F.element_at("parts", 1).alias("session"), F.posexplode(F.slice("parts", F.lit(2), F.size("parts"))).alias("index", "section")
    )
    line = lambda i: F.regexp_extract("section", r"^(\w+) (\d+)(?:/\d+)? (\S+)([ \d]*)", i)
    types = F.filter(F.split(F.trim(line(4)), r"\s+"), lambda x: x != "")
    address = lambda c: F.regexp_extract(c, r"(?m)^c=IN IP[46] ([^\s/]+)", 1)
    direction = lambda c: F.regexp_extract(c, r"(?m)^a=(sendrecv|sendonly|recvonly|inactive)$", 1)
    first = F.get(types, 0)
    maps = F.regexp_extract_all("section", F.lit(r"(?m)^a=rtpmap:(\d+ [^\n]+)"), F.lit(1))
    mapped = F.get(F.filter(maps, lambda m: F.substring_index(m, " ", 1) == first), 0)
    names = F.split(F.substring_index(mapped, " ", -1), "/")
    rates = lambda m: F.split(F.substring_index(m, " ", -1), "/")
    formats = F.regexp_extract_all("section", F.lit(r"(?m)^a=fmtp:(\d+ [^\n]+)"), F.lit(1))
    of_type = lambda m: F.filter(formats, lambda f: F.substring_index(f, " ", 1) == F.substring_index(m, " ", 1))
    codecs = F.transform(
        F.filter(maps, lambda m: F.get(rates(m), 1).try_cast("int") > 0),
        lambda m: F.struct(
            F.substring_index(m, " ", 1).cast("int").alias("payload_type"),
            F.upper(F.get(rates(m), 0)).alias("codec"),
            F.get(rates(m), 1).try_cast("int").alias("clock_rate"),
            F.get(rates(m), 2).try_cast("int").alias("channels"),
            parameters(F.regexp_replace(F.get(of_type(m), 0), r"^\d+ ", "")).alias("parameters"),
        ),
    )
    either = lambda f: F.when(f("section") != "", f("section")).when(f("session") != "", f("session"))
    return rows.select(
        *key,
        "index",
        line(1).alias("kind"),
        line(2).try_cast("int").alias("port"),
        line(3).alias("protocol"),
        F.transform(types, lambda x: x.cast("int")).alias("payload_types"),
        either(address).alias("address"),
        F.get(names, 0).alias("codec"),
        F.get(names, 1).try_cast("int").alias("clock_rate"),
        _attribute(F.col("section"), "control").alias("control"),
        codecs.alias("codecs"),
        _attribute(F.col("section"), "range").alias("range"),
        _attribute(F.col("section"), "framerate").alias("frame_rate"),
        F.regexp_replace(_attribute(F.col("section"), "framesize"), r"^\S+\s+", "").alias("frame_size"),
        F.coalesce(either(direction), F.lit("sendrecv")).alias("direction"),
    )


def answers(offers: DataFrame, replies: DataFrame, key: list[str]) -> DataFrame:
    """Media sections of offers with those of their answers, by position, and what is wrong with them.

    finding: missing_media or extra_media (the numbers of sections differ),
    kind_mismatch (kind or protocol), payload_mismatch (a payload type that was
    not offered), direction_mismatch, or null. A refused section (port 0) has
    none of the last two.
    """
    fields = ["kind", "protocol", "port", "payload_types", "direction"]
    reply = replies.select(*key, "index", *[F.col(c).alias("r_" + c) for c in fields])
    joined = offers.join(reply, [*key, "index"], "full")
    reverse = {"sendonly": ["recvonly", "inactive"], "recvonly": ["sendonly", "inactive"], "inactive": ["inactive"]}
    against = F.lit(False)
    for offered, allowed in reverse.items():
        against = against | (F.col("direction") == offered) & ~F.col("r_direction").isin(*allowed)
    finding = (
        F.when(F.col("r_kind").isNull(), "missing_media")
        .when(F.col("kind").isNull(), "extra_media")
        .when((F.col("r_kind") != F.col("kind")) | (F.col("r_protocol") != F.col("protocol")), "kind_mismatch")
        .when(F.col("r_port") == 0, None)
        .when(F.size(F.array_except("r_payload_types", "payload_types")) > 0, "payload_mismatch")
        .when(against, "direction_mismatch")
    )
    return joined.select(*key, "index", F.coalesce("kind", "r_kind").alias("kind"), finding.alias("finding"))


def selected_tracks(sections: DataFrame, key: list[str]) -> DataFrame:
    """The first payload type of each audio or video section whose codec is analysed, mapped or static.

    ``key`` may name more columns of the sections, which are kept.
    """
    mapped = lambda p: F.get(F.filter("codecs", lambda c: c["payload_type"] == p), 0)
    of = lambda p: F.struct(
        p.alias("payload_type"),
        F.coalesce(mapped(p)["codec"], F.when(static_value(p, "kind") == "audio", static_value(p, "codec"))).alias("codec"),
        F.coalesce(mapped(p)["clock_rate"], F.when(static_value(p, "kind") == "audio", static_value(p, "clock_rate"))).alias("clock_rate"),
    )
    supported = lambda t: F.when(F.col("kind") == "video", F.lower(t["codec"]).isin(VIDEO_CODECS)).otherwise(
        F.lower(t["codec"]).isin(AUDIO_CODECS) | F.lower(t["codec"]).startswith("g726")
    )
    rows = sections.filter(F.col("kind").isin("audio", "video"))
    rows = rows.withColumn("track", F.get(F.filter(F.transform("payload_types", of), supported), 0))
    return rows.filter("track is not null").select(*key, "index", "kind", "track.*", "control")
