"""Queries of picture and sound: encoded parameter sets and units read back, audio timelines, events and alignment."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import cents, micros
from tracewell.operators import audio, parameter_sets, sync, video
from tracewell.operators.rtcp import bytes_of
from tracewell.queries import dealt, query, table


def u(value, n: int) -> Column:
    """A number as ``n`` bits of text."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.lpad(F.bin(value.cast("bigint")), n, "0")


def ue(value) -> Column:
    """A number as bits of text with its length before it as zeros."""
    value = value if isinstance(value, Column) else F.lit(value)
    bits = F.bin(value.cast("bigint") + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(bits) - 1), bits)


def packed(*bits: Column) -> Column:
    """Bits of text as bytes, ended by a one and zeros, with escapes."""
    # Seven more zeros fill the last byte; what is left of them is no whole byte and goes. No part of the text is used twice,
    # as Spark would put it together again for each use.
    four = F.regexp_extract_all(F.concat(*bits, F.lit("10000000")), F.lit("(?:[01]{8}){1,4}"), F.lit(0))
    digits = F.transform(four, lambda b: F.lpad(F.conv(b, 2, 16), (F.length(b) / 4).cast("int"), F.lit("0")))
    return parameter_sets.with_escapes(F.unhex(F.array_join(digits, "")))


def _unit(header: int | Column, body: Column) -> Column:
    return F.concat(bytes_of(header if isinstance(header, Column) else F.lit(header), 1), body)


def _parts(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")


def _h264_units(spark, sf_dir):
    """Parts as four units each: sequence and picture parameters, a slice and a timing message."""
    size, k = F.col("p_size"), F.col("p_partkey")
    crop = F.when(k % 3 == 0, F.concat(F.lit("1"), ue(0), ue(1), ue(0), ue(2))).otherwise("0")
    hrd = F.concat(ue(0), u(0, 4), u(1, 4), ue(size), ue(size * 2), u(1, 1), u(9, 5), u(7, 5), u(5, 5), u(0, 5))
    timing = F.concat(F.lit("1"), F.lit("0000"), F.lit("1"), u(1000, 32), u(size * 2000, 32), F.lit("1"), F.lit("1"), hrd, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"))
    usable = F.when(k % 2 == 0, timing).otherwise("0")
    sps = packed(
        u(66, 8), u(0, 8), u(30, 8), ue(k % 4), ue(1), ue(2), ue(size % 5), u(0, 1), ue(size + 1), ue(size), F.lit("11"), crop, usable
    )
    pps = packed(ue(k % 7), ue(k % 4), u(k % 2, 1), u(0, 1), ue(0), ue(0), ue(0), u(0, 1), u(0, 2), ue(size * 2 - 1), ue(0), ue(0), u(1, 1), u(0, 2))
    piece = packed(ue(size * 3), ue(7), ue(k % 7), u(5, 4))
    message = F.concat(F.lit(bytearray([1, 2])), F.unhex(F.lpad(F.hex((size % 256) * 256 + (k % 64) * 4), 4, "0")), F.lit(bytearray([0x80])))
    units = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("data")) for i, c in enumerate((_unit(0x67, sps), _unit(0x68, pps), _unit(0x65, piece), _unit(0x06, message)))])
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("part"), F.inline(units))


@query(
    "q82_h264_parameters",
    """
WITH p AS (SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS s FROM part)
SELECT part, 'sps' AS unit, part % 4 AS id, NULL AS sps_id, NULL AS pps_id, 16 * (s + 2) - CASE WHEN part % 3 = 0 THEN 2 ELSE 0 END AS width,
       16 * (s + 1) - CASE WHEN part % 3 = 0 THEN 4 ELSE 0 END AS height, CASE WHEN part % 2 = 0 THEN s * 1000 END AS fps_milli, s % 5 AS reference_frames, 32 AS max_frame_num,
       CASE WHEN part % 2 = 0 THEN (s + 1) * 64 END AS bit_rate_bps, CASE WHEN part % 2 = 0 THEN (s * 2 + 1) * 32 END AS cpb_size_bits, NULL AS initial_qp, NULL AS first_mb, NULL AS slice_type, NULL AS entropy_coding, NULL AS idr FROM p
UNION ALL SELECT part, 'pps', part % 7, part % 4, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 26 + s, NULL, NULL, part % 2 = 1, NULL FROM p
UNION ALL SELECT part, 'slice', NULL, NULL, part % 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, s * 3, 2, NULL, TRUE FROM p
""",
)
def q82(spark, sf_dir):
    rows = parameter_sets.parameters(_h264_units(spark, sf_dir), ["part"])
    names = ["id", "sps_id", "pps_id", "width", "height", "fps_milli", "reference_frames", "max_frame_num", "bit_rate_bps", "cpb_size_bits", "initial_qp", "first_mb", "slice_type"]
    return rows.select("part", "unit", *names, "entropy_coding", "idr")


@query(
    "q83_h265_parameters",
    """
WITH p AS (SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS s FROM part)
SELECT part, 'sps' AS unit, part % 4 AS id, NULL AS sps_id, NULL AS pps_id, 16 * s - CASE WHEN part % 3 = 0 THEN 6 ELSE 0 END AS width,
       8 * s - CASE WHEN part % 3 = 0 THEN 2 ELSE 0 END AS height, 1 + part % 2 AS profile_idc, 93 AS level_idc, 1 + part % 3 AS sub_layers, part % 16 AS vps_id,
       8 + part % 3 AS bit_depth_luma, s + 1 AS buffered_frames, s AS reorder_frames, NULL AS first_slice FROM p
UNION ALL SELECT part, 'pps', part % 7, part % 4, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT part, 'slice', NULL, NULL, part % 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM p
""",
)
def q83(spark, sf_dir):
    size, k = F.col("p_size"), F.col("p_partkey")
    layers = k % 3
    present = F.when(layers > 0, F.concat(F.repeat(F.lit("01"), layers.cast("int")), F.repeat(F.lit("00"), (8 - layers).cast("int")), F.repeat(F.lit("01010101"), layers.cast("int")))).otherwise("")
    crop = F.when(k % 3 == 0, F.concat(F.lit("1"), ue(1), ue(2), ue(0), ue(1))).otherwise("0")
    sps = packed(
        u(k % 16, 4), u(layers, 3), F.lit("1"), u(1 + k % 2, 8), F.repeat(F.lit("0"), 80), u(93, 8), present, ue(k % 4), ue(1), ue(size * 16), ue(size * 8), crop,
        ue(k % 3), ue(0), ue(4), F.lit("0"), ue(size), ue(size), ue(0),
    )
    header = lambda kind, body: F.concat(F.lit(bytearray([kind << 1, 1])), body)
    units = (header(33, sps), header(34, packed(ue(k % 7), ue(k % 4))), header(19, packed(F.lit("10"), ue(k % 7))))
    rows = _parts(spark, sf_dir).select(F.col("p_partkey").alias("part"), F.explode(F.array(*units)).alias("data"))
    found = parameter_sets.parameters(rows, ["part"], "h265")
    names = ["id", "sps_id", "pps_id", "width", "height", "profile_idc", "level_idc", "sub_layers", "vps_id", "bit_depth_luma", "buffered_frames", "reorder_frames"]
    return found.select("part", "unit", *names, "first_slice")


@query(
    "q84_parameter_changes",
    """
WITH p AS (SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS s, p_partkey % 4 AS id, 16 * (p_size + 2) - CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS w, p_size % 5 AS r FROM part),
l AS (SELECT *, lag(w) OVER o AS w0, lag(r) OVER o AS r0 FROM p WINDOW o AS (PARTITION BY id ORDER BY part))
SELECT part, id, concat_ws(',', CASE WHEN w <> w0 THEN 'width' END, CASE WHEN r <> r0 THEN 'reference_frames' END) AS changed FROM l WHERE w <> w0 OR r <> r0
""",
)
def q84(spark, sf_dir):
    sets = parameter_sets.parameters(_h264_units(spark, sf_dir), ["part"]).filter("unit = 'sps'")
    found = parameter_sets.changed_fields(sets, [], "part", ["width", "reference_frames"])
    return found.select("part", "id", F.array_join("changed", ",").alias("changed"))


@query(
    "q85_dangling_sets",
    """
WITH p AS (SELECT p_partkey AS part FROM part WHERE p_partkey % 5 <> 1),
first AS (SELECT part % 4 AS id, min(part) AS lo FROM p GROUP BY 1)
SELECT p_partkey AS part, 'pps' AS unit, 'sps' AS missing FROM part LEFT JOIN first ON id = p_partkey % 4 WHERE lo IS NULL OR lo > p_partkey
""",
)
def q85(spark, sf_dir):
    """Parts whose sequence parameters are lost (one in five): their picture parameters refer to those of others."""
    units = _h264_units(spark, sf_dir).filter("not (i = 0 and part % 5 = 1)")
    sets = parameter_sets.parameters(units, ["part", "i"]).withColumn("at", F.col("part") * 4 + F.col("i"))
    return parameter_sets.dangling(sets, [], "at").filter("unit = 'pps'").select(F.floor(F.col("at") / 4).alias("part"), "unit", "missing")


@query(
    "q86_timing_messages",
    """
SELECT p_partkey AS part, 'pic_timing' AS message, (p_size * 256 + p_partkey % 64 * 4) // 256 AS removal_delay, (p_size * 256 + p_partkey % 64 * 4) // 4 % 64 AS output_delay
FROM part WHERE p_partkey % 2 = 0
""",
)
def q86(spark, sf_dir):
    units = _h264_units(spark, sf_dir).filter("part % 2 = 0")
    sets = parameter_sets.parameters(units, ["part", "i"])
    return parameter_sets.timing_messages(units, sets, ["part"], "i").select("part", "message", "removal_delay", "output_delay")


@query(
    "q87_stream_summary",
    """
SELECT p_partkey AS part, 'Baseline' AS profile, 30 AS level_idc, 16 * (p_size + 2) - CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS width,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS frame_rate, 'sps,pps,idr_slice,sei' AS names
FROM part
""",
)
def q87(spark, sf_dir):
    units = _h264_units(spark, sf_dir)
    summary = parameter_sets.stream_summary(parameter_sets.parameters(units, ["part", "i"]), ["part"], "i", "h264")
    named = parameter_sets.inspected(units, ["part", "i"], "h264").groupBy("part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), ",").alias("names")
    )
    # Both sides grow with the parts: sorted by part they meet, neither is sent to the driver.
    return summary.join(named.hint("merge"), "part").select("part", "profile", "level_idc", "width", "frame_rate", "names")


def _fragments(spark, sf_dir, h265: bool):
    """Messages of conversations as units of 60 bytes of fragments, each conversation a flow; short ones go in one packet."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    pieces = rows.select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("text") / 60).cast("int"), F.lit(1)) - 1)).alias("i"),
        F.greatest(F.ceil(F.octet_length("text") / 60).cast("int"), F.lit(1)).alias("n"),
    )
    body = F.expr("substring(text, i * 60 + 1, 60)")
    edge = F.when(F.col("i") == 0, 0x80).otherwise(0) + F.when(F.col("i") == F.col("n") - 1, 0x40).otherwise(0)
    if h265:
        single, fragment = F.concat(F.lit(bytearray([2, 1])), body), F.concat(F.lit(bytearray([49 << 1, 1])), bytes_of(edge + 1, 1), body)
    else:
        single, fragment = F.concat(F.lit(bytearray([0x41])), body), F.concat(F.lit(bytearray([0x5C])), bytes_of(edge + 1, 1), body)
    order = Window.partitionBy("conv_id").orderBy("turn", "i")
    return pieces.select(
        F.concat(F.lit("c"), "conv_id").alias("capture"), F.lit("0").alias("interface"), F.lit("a").alias("src_ip"), F.lit(1).alias("src_port"), F.lit("b").alias("dst_ip"),
        F.lit(2).alias("dst_port"), F.lit(0).alias("connection"), F.lit(-1).alias("channel"), F.col("conv_id").alias("ssrc"), F.col("turn").alias("rtp_ts"),
        F.row_number().over(order).cast("bigint").alias("ext"), (F.col("i") == F.col("n") - 1).alias("marker"),
        F.when(F.col("n") == 1, single).otherwise(fragment).alias("body"),
    ).filter("not (ssrc % 4 = 1 and ext = 2)")


_UNITS = """
WITH c AS (SELECT conv_id, turn, encode(coalesce(text, '')) AS t FROM conversations),
n AS (SELECT *, greatest((octet_length(t) + 59) // 60, 1) AS n, CAST(sum(greatest((octet_length(t) + 59) // 60, 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS last FROM c),
b AS (SELECT *, last - n + 1 AS first, conv_id % 4 = 1 AND 2 BETWEEN last - n + 1 AND last AS hurt FROM n)
SELECT conv_id, turn, first AS first_seq, last AS last_seq, TRUE AS complete, sha256(unhex('{header}') || t) AS digest, {extra}
FROM b WHERE NOT hurt
"""


@query("q88_h264_units", _UNITS.replace("{header}", "41").replace("{extra}", "1 AS type"))
def q88(spark, sf_dir):
    units = video.depacketise(_fragments(spark, sf_dir, False)).filter("complete")
    return units.select(
        F.col("ssrc").alias("conv_id"), F.col("rtp_ts").alias("turn"), "first_seq", "last_seq", "complete", F.sha2("data", 256).alias("digest"),
        video.h264_type(F.col("data")).alias("type"),
    )


@query("q89_h265_units", _UNITS.replace("{header}", "0201").replace("{extra}", "1 AS type"))
def q89(spark, sf_dir):
    units = video.depacketise(_fragments(spark, sf_dir, True), "h265").filter("complete")
    return units.select(
        F.col("ssrc").alias("conv_id"), F.col("rtp_ts").alias("turn"), "first_seq", "last_seq", "complete", F.sha2("data", 256).alias("digest"),
        video.h265_type(F.col("data")).alias("type"),
    )


@query(
    "q90_unit_ranges",
    """
WITH c AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n FROM conversations)
SELECT conv_id, turn, CAST(sum(n + 4) OVER w AS BIGINT) - n - 4 AS start, CAST(sum(n + 4) OVER w AS BIGINT) AS "end" FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""",
)
def q90(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return parameter_sets.unit_ranges(units, ["conv_id"], "turn").select("conv_id", "turn", "start", "end")


def _audio_packets(spark, sf_dir):
    """Events as audio packets of their users, 160 clock units each, some early, some late, some empty."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    moved = F.when(F.col("event_id") % 7 == 0, 80).when(F.col("event_id") % 11 == 0, -40).otherwise(0)
    rows = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w) - 1)
    return rows.select(
        "user_id", "event_id", F.pmod(F.lit((1 << 32) - 1000) + F.col("i") * 160 + moved, F.lit(1 << 32)).cast("bigint").alias("rtp_ts"), F.lit(160).alias("frames"),
        F.when(F.col("event_id") % 13 == 0, 0).otherwise(160).alias("size"),
    )


_AUDIO = """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
                  CASE WHEN event_id % 7 = 0 THEN 80 WHEN event_id % 11 = 0 THEN -40 ELSE 0 END AS moved, CASE WHEN event_id % 13 = 0 THEN 0 ELSE 160 END AS size FROM events),
p AS (SELECT *, i * 160 + moved AS t, first_value(i * 160 + moved) OVER w AS t0, lag(i * 160 + moved) OVER w AS before, lead(i * 160 + moved) OVER w AS after FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""


@query(
    "q91_audio_timestamp_issues",
    _AUDIO
    + """, d AS (SELECT *, t - before - 160 AS delta, before + 160 AS expected FROM p)
SELECT user_id, event_id, CASE WHEN delta > 0 THEN 'timestamp_gap' ELSE 'timestamp_overlap' END AS kind, delta, abs(delta) * 1000 // 8000 AS duration_ms,
       (least(t, expected) - t0 + 4294967296) % 4294967296 * 1000 // 8000 AS media_start_ms, (greatest(t, expected) - t0 + 4294967296) % 4294967296 * 1000 // 8000 AS media_end_ms
FROM d WHERE delta <> 0
""",
)
def q91(spark, sf_dir):
    found = audio.timestamp_issues(_audio_packets(spark, sf_dir), ["user_id"], "event_id", F.lit(8000))
    return found.select("user_id", "event_id", "kind", "delta", "duration_ms", "media_start_ms", "media_end_ms")


@query(
    "q92_audio_sample_mapping",
    _AUDIO
    + """, m AS (SELECT *, t - t0 AS s, CASE WHEN after > t THEN after - t0 ELSE t - t0 + coalesce(CASE WHEN t > before THEN t - before END, size) END AS f,
       coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM p)
SELECT user_id, event_id, CAST(o AS BIGINT) AS encoded_offset, size AS encoded_size, s * 2 AS pcm_start, f * 2 AS pcm_end FROM m WHERE size > 0
""",
)
def q92(spark, sf_dir):
    # No packet is before its flow's first one here.
    found = audio.sample_mapping(_audio_packets(spark, sf_dir), ["user_id"], "event_id", F.lit(8000), F.lit(16_000))
    return found.select("user_id", "event_id", "encoded_offset", "encoded_size", "pcm_start", "pcm_end")


def _tracks(spark, sf_dir):
    pcm = F.transform("embedding", lambda x: F.round(x.cast("double") * 30_000).cast("smallint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(2).alias("channels"), F.lit(160).alias("rate"), pcm.alias("pcm"))


@query(
    "q93_level_series",
    """
WITH s AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
v AS (SELECT vec_id, CAST(round(CAST(x AS DOUBLE) * 30000) AS BIGINT) AS x, i // 2 // 16 AS w, i % 2 + 1 AS channel FROM s)
SELECT vec_id, w AS "window", w * 100 AS offset_ms, channel, CASE WHEN max(abs(x)) > 0 THEN CAST(round(20000 * log10(max(abs(x)) / 32768)) AS BIGINT) END AS peak_dbfs_milli,
       CASE WHEN sum(x * x) > 0 THEN CAST(round(20000 * log10(sqrt(sum(x * x) / count(*)) / 32768)) AS BIGINT) END AS rms_dbfs_milli
FROM v GROUP BY vec_id, w, channel
""",
)
def q93(spark, sf_dir):
    return audio.level_series(_tracks(spark, sf_dir), "vec_id")


@query(
    "q94_channel_level_difference",
    """
WITH s AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
v AS (SELECT vec_id, CAST(round(CAST(x AS DOUBLE) * 30000) AS BIGINT) AS x, i // 2 // 16 AS w, i % 2 + 1 AS channel FROM s),
l AS (SELECT vec_id, w, channel, CAST(round(20000 * log10(sqrt(sum(x * x) / count(*)) / 32768)) AS BIGINT) AS l FROM v GROUP BY vec_id, w, channel),
c AS (SELECT vec_id, channel, avg(l) AS a FROM l GROUP BY vec_id, channel)
SELECT vec_id, CAST(round(max(a) - min(a)) AS BIGINT) AS level_difference_milli FROM c GROUP BY vec_id
""",
)
def q94(spark, sf_dir):
    return audio.level_difference(audio.level_series(_tracks(spark, sf_dir), "vec_id"), "vec_id")


@query(
    "q95_opus_and_raw_codecs",
    """
WITH c AS (SELECT c_custkey, CAST('0x' || substr(md5(c_name), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(c_name), 3, 2) AS INTEGER) AS b FROM customer)
SELECT c_custkey, least(CASE WHEN a // 8 >= 16 THEN 120 * pow(2, a // 8 % 4) WHEN a // 8 >= 12 THEN 480 * pow(2, a // 8 % 2) ELSE 480 * pow(2, a // 8 % 4) END
         * CASE WHEN a % 4 = 0 THEN 1 WHEN a % 4 < 3 THEN 2 ELSE b % 64 END, 5760)::BIGINT AS samples,
       CASE c_custkey % 4 WHEN 0 THEN 'g722' WHEN 1 THEN 'g726' WHEN 2 THEN 'g729' END AS format, CASE c_custkey % 4 WHEN 1 THEN 3 END AS code_bits,
       CASE c_custkey % 4 WHEN 0 THEN 16000 WHEN 1 THEN 8000 WHEN 2 THEN 8000 END AS decoded_rate
FROM c
""",
)
def q95(spark, sf_dir):
    k = F.col("c_custkey")
    codec = F.when(k % 4 == 0, "G722").when(k % 4 == 1, "AAL2-G726-24").when(k % 4 == 2, "G729A").otherwise("PCMU")
    raw = audio.raw_codec(codec, F.lit(8000))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", audio.opus_samples(F.unhex(F.md5("c_name"))).alias("samples"), raw["format"].alias("format"), raw["code_bits"].alias("code_bits"),
        raw["decoded_rate"].alias("decoded_rate"),
    )


@query(
    "q96_aac_units",
    """
WITH c AS (SELECT conv_id, turn, encode(left(coalesce(text, ''), 100)) AS t FROM conversations), u AS (SELECT *, octet_length(t) AS n FROM c WHERE octet_length(t) > 1),
s AS (SELECT conv_id, turn, k AS unit, CASE k WHEN 0 THEN n // 2 ELSE n - n // 2 END AS size, CASE k WHEN 0 THEN 1 ELSE n // 2 + 1 END AS f, t FROM u, (VALUES (0), (1)) v(k))
SELECT conv_id, turn, unit, size + 7 AS bytes, sha256(unhex(substr(hex(t), f * 2 - 1, size * 2))) AS digest, 'fff15080' AS head FROM s
""",
)
def q96(spark, sf_dir):
    text = F.encode(F.left(F.coalesce("text", F.lit("")), F.lit(100)), "UTF-8")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t")).filter("octet_length(t) > 1")
    half = F.floor(F.octet_length("t") / 2)
    body = F.concat(F.lit(bytearray([0, 32])), bytes_of(half * 8, 2), bytes_of((F.octet_length("t") - half) * 8, 2), F.col("t"))
    config = F.create_map(F.lit("config"), F.lit("1210"), F.lit("sizelength"), F.lit("13"))
    packets = rows.select("conv_id", "turn", body.alias("body"), config.alias("parameters"), F.lit(44_100).alias("clock"), F.lit(2).alias("channels"))
    data = F.col("data")
    return audio.aac_units(packets, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("unit").cast("bigint"), F.octet_length(data).cast("bigint").alias("bytes"),
        F.sha2(F.expr("substring(data, 8)"), 256).alias("digest"), F.lower(F.hex(F.expr("substring(data, 1, 4)"))).alias("head"),
    )


@query(
    "q97_rising_events",
    """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS v, lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
c AS (SELECT * FROM e WHERE v >= 5000 AND v - before >= 2000),
pick AS (
  SELECT user_id, min(us) AS us FROM c GROUP BY user_id
  UNION ALL
  SELECT p.user_id, (SELECT min(c.us) FROM c WHERE c.user_id = p.user_id AND c.us >= p.us + 43200000000) AS us FROM pick p
  WHERE (SELECT min(c.us) FROM c WHERE c.user_id = p.user_id AND c.us >= p.us + 43200000000) IS NOT NULL)
SELECT user_id, us, v, before FROM pick JOIN c USING (user_id, us)
""",
)
def q97(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("us"), cents("value").alias("v"))
    return sync.rising(rows, ["user_id"], "us", "v", F.col("v") - F.col("before") >= 2000, 5000, 43_200_000_000)


@query(
    "q98_sync_summary",
    """
WITH p AS (SELECT user_id, epoch_us(ts) AS at_us, event_id % 100 - 50 AS o FROM events WHERE event_type = 'purchase'),
l AS (SELECT user_id, count(*) AS pairs, list_sort(list(o)) AS s, CASE WHEN max(at_us) <> min(at_us) THEN max_by(o, at_us) - min_by(o, at_us) END AS drift_ms FROM p GROUP BY user_id)
SELECT user_id, pairs, s[pairs // 2 + 1] AS median_ms, drift_ms, CASE WHEN pairs = 1 THEN 45 WHEN pairs = 2 THEN 75 WHEN s[-1] - s[1] <= 80 THEN 95 ELSE 80 END AS confidence FROM l
""",
)
def q98(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return sync.sync_summary(pairs.select("user_id", micros("ts").alias("a_at"), (F.col("event_id") % 100 - 50).alias("offset_ms")), ["user_id"])


@query(
    "q99_content_alignment",
    """
WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS l FROM embeddings WHERE label IS NOT NULL),
a AS (SELECT label, idx - 3 AS idx, l FROM v WHERE idx BETWEEN 3 AND 32), b AS (SELECT label, idx, l FROM v WHERE idx < 30),
n AS (SELECT label, least(max(CASE WHEN t = 0 THEN idx + 1 END), max(CASE WHEN t = 1 THEN idx + 1 END)) AS shorter FROM (SELECT label, idx, 0 AS t FROM a UNION ALL SELECT label, idx, 1 FROM b) GROUP BY label HAVING count(DISTINCT t) = 2),
m AS (SELECT label, greatest(shorter // 3, 4) AS least, least(60, shorter - greatest(shorter // 3, 4)) AS most FROM n WHERE shorter >= 4),
s AS (SELECT a.label, b.idx - a.idx AS shift, m.least, count(*) AS n, sum(list_sum(list_transform(range(1, 65), lambda i: abs(a.l[i] - b.l[i])))) / (count(*) * 64) / 255 AS e
      FROM a JOIN b ON a.label = b.label JOIN m ON m.label = a.label WHERE abs(b.idx - a.idx) <= m.most GROUP BY 1, 2, 3 HAVING count(*) >= m.least)
SELECT label, min_by(shift, (e, shift)) AS shift, min_by(shift, (e, shift)) * 500 AS offset_ms, CAST(round(min(e) * 1000) AS BIGINT) AS error_milli, CAST(round(max(e) FILTER (shift = 0) * 1000) AS BIGINT) AS zero_error_milli
FROM s GROUP BY label
""",
)
def q99(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    luma = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000))
    rows = table(spark, sf_dir, "embeddings").filter("label is not null").select("label", (F.row_number().over(w) - 1).alias("idx"), luma.alias("luma"))
    source = rows.filter("idx between 3 and 32").withColumn("idx", F.col("idx") - 3)
    return sync.alignment(source, rows.filter("idx < 30"), ["label"], 2)


@query(
    "q100_loudness_log",
    """
SELECT o_orderkey, CAST(o_orderkey % 40 - 60 AS BIGINT) * 1000 + 500 AS integrated_milli, (o_orderkey % 9) * 1000 + 200 AS range_milli, -(o_orderkey % 5) * 1000 - 100 AS peak_milli,
       CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 30 - 70) * 1000 END AS momentary_milli, o_orderkey % 1000 AS frames, o_orderkey * 7 AS duration_ms, o_orderkey % 50 + 0.25 AS metric
FROM orders
""",
)
def q100(spark, sf_dir):
    """Orders as logs: a loudness series and its summary, progress reports and a metric, each with an earlier value."""
    k = F.col("o_orderkey")
    momentary = F.when(k % 3 == 0, "-120.7").otherwise((k % 30 - 70).cast("string"))
    log = [
        F.lit("Summary:"), F.lit("  I: -1.0 LUFS"), F.concat(F.lit("[Parsed_ebur128] t: 0.1  M: "), momentary, F.lit(" S: -30.0 I: -25.0 LUFS")), F.lit("frame=1"), F.lit("out_time_us=5"),
        F.lit("PSNR average:1.5 min:1"), F.concat(F.lit("frame= "), k % 1000), F.concat(F.lit("out_time_us="), k * 7000 + 999), F.concat(F.lit("x average: "), k % 50, F.lit(".25, max:9")),
        F.lit("[x] Summary:"), F.lit(""), F.lit("  Integrated loudness:"), F.concat(F.lit("    I:         "), k % 40 - 60 + 0.5, F.lit(" LUFS")), F.lit("  Loudness range:"),
        F.concat(F.lit("    LRA:  "), k % 9 + 0.2, F.lit(" LU")), F.lit("  True peak:"), F.concat(F.lit("    Peak: "), -(k % 5) - 0.1, F.lit(" dBFS")),
    ]
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*log)).alias("no", "line"))
    key = ["o_orderkey"]
    series = sync.loudness_series(lines, key, "no", "line").select("o_orderkey", "momentary_milli")
    progress = sync.last_progress(lines, key, "no", "line")
    metric = sync.last_metric(lines, key, "no", "line", "average:").withColumnRenamed("value", "metric")
    return sync.loudness_summary(lines, key, "no", "line").join(series, key).join(progress, key).join(metric, key)


@query(
    "q101_run_boundaries",
    """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type FROM events),
v AS (SELECT *, lag(i) OVER w AS p, lead(i) OVER w AS n FROM e WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, event_id, coalesce(p <> i - 1, TRUE) AS begins, coalesce(n <> i + 1, TRUE) AS ends FROM v WHERE coalesce(p <> i - 1, TRUE) OR coalesce(n <> i + 1, TRUE)
""",
)
def q101(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("i"))
    found = sync.run_boundaries(rows.filter("event_type in ('view', 'click')"), ["user_id"], "i")
    return found.select("user_id", "event_id", "begins", "ends")




@query(
    "q128_h265_frames",
    """
WITH p AS (SELECT p_partkey AS k, p_partkey // 10 AS g, p_partkey % 10 AS i FROM part)
SELECT g, i + 1 AS frame, k AS rtp_ts, CASE WHEN i % 4 = 1 THEN 4 ELSE 1 END AS units, i % 4 = 1 AS idr, i % 4 = 1 AS sps, i % 3 <> 0 AS has_marker, i % 3 = 0 AND i < 9 AND k < (SELECT max(p_partkey) FROM part) AS missing_marker
FROM p
""",
)
def q128(spark, sf_dir):
    """Tens of parts as flows of frames: every fourth begins with its parameter sets, every third lacks its marker."""
    units = _h265_frames(spark, sf_dir)
    return video.access_units(units, ["g"], "h265").select("g", "frame", "rtp_ts", "units", "idr", "sps", "has_marker", "missing_marker")


def _h265_frames(spark, sf_dir):
    k, i = F.col("p_partkey"), F.col("p_partkey") % 10
    kinds = F.when(i % 4 == 1, F.array(*map(F.lit, (32, 33, 34, 19)))).otherwise(F.array(F.lit(1)))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("g"), k.alias("rtp_ts"), i.alias("i"), F.posexplode(kinds).alias("u", "kind"))
    seq = F.col("rtp_ts") * 10 + F.col("u")
    return rows.select(
        "g", "rtp_ts", seq.alias("first_seq"), seq.alias("last_seq"), F.lit(True).alias("complete"), ((F.col("i") % 3 != 0) & (F.col("kind").isin(1, 19))).alias("marker"),
        F.lit(None).cast("string").alias("issue"), F.concat(bytes_of(F.col("kind") * 2, 1), F.lit(bytearray(b"\x01\x80"))).alias("data"),
    )


@query(
    "q129_h265_gops",
    """
WITH p AS (SELECT p_partkey // 10 AS g, p_partkey % 10 AS i FROM part), f AS (SELECT g, count(*) AS frames, count(*) FILTER (i % 4 = 1) AS idr_frames, min(i) FILTER (i % 4 = 1) + 1 AS first_idr_frame FROM p GROUP BY g)
SELECT g, frames, idr_frames, first_idr_frame, CASE WHEN idr_frames > 1 THEN 4 END AS average_gop_frames, CASE WHEN idr_frames > 1 THEN 4 END AS maximum_gop_frames,
       CASE WHEN idr_frames > 0 THEN TRUE END AS vps_before_idr, frames + 3 * idr_frames AS units FROM f
""",
)
def q129(spark, sf_dir):
    units = _h265_frames(spark, sf_dir)
    gops = video.gop_statistics(video.access_units(units, ["g"], "h265"), ["g"])
    counts = video.unit_histogram(units, ["g"], "h265").groupBy("g").agg(F.sum("n").alias("units"))
    names = ["frames", "idr_frames", "first_idr_frame", "average_gop_frames", "maximum_gop_frames", "vps_before_idr", "units"]
    return gops.join(counts, "g").select("g", *names)


@query(
    "q130_frame_documents",
    """
SELECT p_partkey AS part, '{"frame":' || p_partkey || ',"units":[{"type":7,"name":"sps","ref_idc":3},{"type":8,"name":"pps","ref_idc":3},{"type":5,"name":"idr_slice","ref_idc":3},{"type":6,"name":"sei","ref_idc":0}]}' AS document FROM part
""",
)
def q130(spark, sf_dir):
    shown = parameter_sets.inspected(_h264_units(spark, sf_dir), ["part", "i"], "h264").select("part", "i", "type", "name", "ref_idc")
    return video.frame_documents(shown, [], "part", "i")


@query(
    "q131_merged_ranges",
    """
WITH l AS (SELECT l_suppkey AS flow, epoch_us(l_shipdate) // 86400000000 AS s, epoch_us(l_shipdate) // 86400000000 + l_linenumber AS e FROM lineitem),
n AS (SELECT *, max(e) OVER (PARTITION BY flow ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM l),
g AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS r FROM n)
SELECT flow, min(s) AS start, max(e) AS "end", count(*) AS frames FROM g GROUP BY flow, r
""",
)
def q131(spark, sf_dir):
    day = F.floor(micros("l_shipdate") / 86_400_000_000)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("flow"), day.alias("start"), (day + F.col("l_linenumber")).alias("end"))
    return video.merged_ranges(rows, ["flow"])


@query(
    "q132_channel_quality",
    """
WITH s AS (SELECT vec_id, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 30000) AS BIGINT) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
v AS (SELECT vec_id, i % 2 + 1 AS channel, x, (x >= 0) <> (lag(x) OVER (PARTITION BY vec_id, i % 2 ORDER BY i) >= 0) AS crossed FROM s),
a AS (SELECT vec_id, channel, max(abs(x)) AS p, sqrt(sum(x * x) / count(*)) AS r, count(*) FILTER (abs(x) <= 328) * 1000000 // count(*) AS silent_ppm, count(*) FILTER (abs(x) >= 32600) * 1000000 // count(*) AS clipped_ppm,
             count(*) FILTER (crossed) * 1000000 // (count(*) - 1) AS crossings_ppm FROM v GROUP BY 1, 2)
SELECT vec_id, channel, CASE WHEN p > 0 THEN CAST(round(20000 * log10(p / 32768)) AS BIGINT) END AS peak_dbfs_milli, CASE WHEN r > 0 THEN CAST(round(20000 * log10(r / 32768)) AS BIGINT) END AS rms_dbfs_milli,
       CASE WHEN r > 0 THEN CAST(round(20000 * log10(p / r)) AS BIGINT) END AS crest_milli, silent_ppm, clipped_ppm, crossings_ppm FROM a
""",
)
def q132(spark, sf_dir):
    return audio.channel_quality(_tracks(spark, sf_dir), "vec_id")


@query(
    "q133_dynamic_range",
    """
WITH s AS (SELECT vec_id % 20 AS g, vec_id, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 30000) AS BIGINT) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
w AS (SELECT g, vec_id, i // 2 // 16 AS w, i % 2 AS c, CAST(round(20000 * log10(sqrt(sum(x * x) / count(*)) / 32768)) AS BIGINT) AS l FROM s GROUP BY ALL),
l AS (SELECT g, list_sort(list(l)) AS l FROM w WHERE l >= -60000 GROUP BY g)
SELECT g, CASE WHEN len(l) >= 10 THEN l[len(l) * 95 // 100 + 1] - l[len(l) // 10 + 1] END AS dynamic_range_milli FROM l
""",
)
def q133(spark, sf_dir):
    series = audio.level_series(_tracks(spark, sf_dir), "vec_id").withColumn("g", F.col("vec_id") % 20)
    return audio.dynamic_range(series, "g")


@query(
    "q134_even_positions",
    """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, n, array_to_string(CASE WHEN n >= 3 THEN [0, (n - 1) // 2, n - 1] ELSE list_transform(range(0, n), lambda i: CASE WHEN n > 1 THEN i * (n - 1) // (n - 1) ELSE 0 END) END, ',') AS positions FROM c
""",
)
def q134(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("o_custkey", "n", F.array_join(audio.evenly(F.least("n", F.lit(3)).cast("int"), F.col("n") - 1), ",").alias("positions"))
