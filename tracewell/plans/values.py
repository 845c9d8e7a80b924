"""Queries of scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scalar as S
from tracewell.functions import text as T
from tracewell.functions.scalar import cents, micros
from tracewell.operators.rtcp import bytes_of
from tracewell.operators.sdp import parameters
from tracewell.queries import query, table


@query(
    "q74_text_functions",
    r"""
SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) END AS rest, left(url, 20) AS head,
       CASE WHEN contains(url, '/') THEN regexp_extract(url, '^([\s\S]*)/[^/]*$', 1) END AS before, regexp_extract(url, '([^/]*)$', 1) AS after,
       md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5,
       CASE WHEN url IS NOT NULL THEN coalesce(list_aggregate(list_transform(regexp_extract_all(regexp_extract(url, '[^/]*$'), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 12, '0') ELSE p END), 'string_agg', ''), '') END AS natural_key,
       url AS looked_up
FROM pages
""",
)
def q74(spark, sf_dir):
    url = F.col("url")
    before, after = T.split_last(url, "/")
    message = F.concat(F.lit("GET / HTTP/1.1\r\nx-Other: 1\r\nX-Location :  "), url, F.lit(" \r\n\r\n"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.strip_prefix(url, "http://").alias("rest"), T.first_characters(url, 20).alias("head"), before.alias("before"), after.alias("after"),
        F.md5(T.escape_markup(F.col("html"))).alias("escaped_md5"), T.natural_key(after).alias("natural_key"),
        T.header_value(message, "x-location", "l").alias("looked_up"),
    )


@query(
    "q75_formatters",
    """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v % 7 = 0 THEN 'not run' WHEN v % 50000 >= 1000 THEN printf('%.2f', v % 50000 / 1000.0) || ' s' ELSE (v % 50000) || ' ms' END AS duration,
       CASE WHEN v >= 1000000 THEN printf('%.2f', v / 1000000.0) || ' Mbps' ELSE printf('%.0f', v / 1000.0) || ' Kbps' END AS rate,
       CASE WHEN v % 30000 < 1000 THEN CAST(v % 30000 AS VARCHAR) WHEN v % 30000 >= 10000 OR v % 30000 % 1000 = 0 THEN printf('%.0f', v % 30000 / 1000.0) || 'k'
            ELSE printf('%.1f', v % 30000 / 1000.0) || 'k' END AS frequency
FROM o
""",
)
def q75(spark, sf_dir):
    v = F.col("v")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("v"))
    return rows.select(
        "o_orderkey", T.format_duration(F.when(v % 7 != 0, v % 50_000)).alias("duration"), T.format_bit_rate(v).alias("rate"),
        T.format_frequency(v % 30_000).alias("frequency"),
    )


@query(
    "q76_validation",
    r"""
WITH p AS (SELECT page_id, url, page_id % 7 AS k FROM pages),
v AS (SELECT page_id, url, CASE k WHEN 0 THEN 'stream-' || page_id WHEN 1 THEN 'a b' WHEN 2 THEN '' WHEN 3 THEN 'x/' || page_id || '.json' WHEN 4 THEN 'con.txt' WHEN 5 THEN 'org.tool-' || page_id ELSE '../up.' END AS t,
  CASE k WHEN 0 THEN 'rtsp://u:pw' || page_id || '@cam/s' WHEN 1 THEN 'rtsp:///x' WHEN 2 THEN 'not a url' ELSE url END AS u FROM p)
SELECT page_id, regexp_full_match(t, '[0-9A-Za-z_-]{1,80}') AS stream_id,
       length(t) <= 240 AND len(list_filter(string_split(t, '/'), lambda x: NOT (regexp_full_match(x, '[0-9A-Za-z._-]*[0-9A-Za-z_-]') AND NOT regexp_full_match(upper(x), '(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([.].*)?')))) = 0 AS path,
       length(t) <= 128 AND regexp_full_match(t, '[0-9a-z-]{1,63}([.][0-9a-z-]{1,63})+') AS package_id,
       CASE WHEN u = 'not a url' THEN 'invalid' WHEN u = 'rtsp:///x' THEN 'host' WHEN starts_with(u, 'rtsp://') THEN NULL ELSE 'scheme' END AS url_error,
       CASE WHEN starts_with(u, 'rtsp://u:') THEN 'rtsp://u:REDACTED@cam/s' ELSE u END AS redacted,
       CASE WHEN starts_with(u, 'rtsp://u:') THEN 'open rtsp://u:REDACTED@cam/s with REDACTED' WHEN u = 'rtsp:///x' OR u = 'not a url' OR NOT starts_with(u, 'rtsp') THEN 'open <redacted-url> with pw' || page_id END AS safe_text
FROM v
""",
)
def q76(spark, sf_dir):
    k, page = F.col("page_id") % 7, F.col("page_id").cast("string")
    t = F.when(k == 0, F.concat(F.lit("stream-"), page)).when(k == 1, "a b").when(k == 2, "").when(k == 3, F.concat(F.lit("x/"), page, F.lit(".json")))
    t = t.when(k == 4, "con.txt").when(k == 5, F.concat(F.lit("org.tool-"), page)).otherwise("../up.")
    u = F.when(k == 0, F.concat(F.lit("rtsp://u:pw"), page, F.lit("@cam/s"))).when(k == 1, "rtsp:///x").when(k == 2, "not a url").otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", t.alias("t"), u.alias("u"))
    text = F.concat(F.lit("open "), F.col("u"), F.lit(" with pw"), F.col("page_id"))
    return rows.select(
        "page_id", T.valid_stream_id(F.col("t")).alias("stream_id"), T.valid_relative_path(F.col("t")).alias("path"), T.valid_package_id(F.col("t")).alias("package_id"),
        T.rtsp_url_error(F.col("u")).alias("url_error"), T.redact_url(F.col("u")).alias("redacted"), T.redact_text(text, F.col("u")).alias("safe_text"),
    )


@query(
    "q77_json",
    """
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(k AS DOUBLE) AS plain, CAST(k AS DOUBLE) AS quoted, CAST(NULL AS DOUBLE) AS wrong, event_type AS deep,
       '{"user":"' || user_id || '","Api-Password":"[REDACTED]","list":[{"secret":"[REDACTED]","n":' || k || '}],"url":"http://h/p"}' AS redacted,
       '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS built
FROM e
""",
)
def q77(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    nested = F.concat(F.lit('{"a":{"b c":"'), "event_type", F.lit('"},"q":"'), "k", F.lit('","w":"x1"}'))
    secret = F.concat(
        F.lit('{"user":"'), "user_id", F.lit('","Api-Password":{"x":1},"list":[{"secret":"s","n":'), "k", F.lit('}],"url":"http://me:pw@h/p"}')
    )
    return rows.select(
        "event_id", T.tolerant_number(T.json_at(F.col("props"), "k")).alias("plain"), T.tolerant_number(T.json_at(nested, "q")).alias("quoted"),
        T.tolerant_number(T.json_at(nested, "w")).alias("wrong"), T.json_at(nested, "a", "b c").alias("deep"), T.redact_json(secret).alias("redacted"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("built"),
    )


@query(
    "q78_time_and_math",
    """
WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, value, min(epoch_us(ts)) OVER () + 1000000 AS base FROM events)
SELECT event_id, us * 1000 // 1000 AS decimal_ticks, us // 1000000 * 1000000 + us % 1000000 * 1024 // 1000000 * 1000000 // 1024 AS binary_ticks,
       us // 1000000 * 1000000 + (((us % 1000000) << 32) // 1000000 * 1000000 >> 32) AS ntp, greatest(us - base, 0) // 1000 AS offset_ms,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, CASE WHEN event_id % 31 < 28 THEN make_timestamp(2023, 2, CAST(event_id % 31 + 1 AS BIGINT), 1, 2, 3.0) END AS made,
       least(greatest(value, 10.0), 100.0) AS clamped, round(sqrt(value * value + 9), 6) AS magnitude, round(value * cos(0.5) - 3 * sin(0.5), 6) AS turned_x,
       CASE WHEN value > 0 THEN CAST(round(20000 * log10(value / 32768)) AS BIGINT) END AS dbfs_milli, round(2595 * log10(1 + value / 700), 6) AS mel
FROM e
""",
)
def q78(spark, sf_dir):
    us, value = F.col("us"), F.col("value")
    rows = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    base = rows.agg((F.min("us") + 1_000_000).alias("base"))
    rows = rows.crossJoin(F.broadcast(base))  # one row
    binary = F.floor(us / 1_000_000) * 1024 + F.floor(us % 1_000_000 * 1024 / 1_000_000)
    fraction = F.expr("shiftleft(us % 1000000, 32) div 1000000")
    return rows.select(
        "event_id", S.ticks_to_micros(us * 1000, 10, 9).alias("decimal_ticks"), S.ticks_to_micros(binary, 2, 10).alias("binary_ticks"),
        S.ntp_to_micros(F.expr("us div 1000000"), fraction).alias("ntp"), S.offset_ms(us, F.col("base")).alias("offset_ms"), S.rfc3339(F.col("ts")).alias("rfc3339"),
        S.utc_of_parts(F.lit(2023), F.lit(2), (F.col("event_id") % 31 + 1).cast("int"), F.lit(1), F.lit(2), F.lit(3).cast("decimal(8,6)")).alias("made"),
        S.clamp(value, 10.0, 100.0).alias("clamped"), F.round(S.magnitude(value, F.lit(3.0)), 6).alias("magnitude"),
        F.round(S.turned(value, F.lit(3.0), F.lit(0.5))[0], 6).alias("turned_x"), S.dbfs_milli(value).alias("dbfs_milli"), F.round(S.mel(value), 6).alias("mel"),
    )


@query(
    "q79_arrays_and_maps",
    """
SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: abs(CAST(embedding[i + 1] AS DOUBLE) - embedding[i]))), 6) AS total_step, 63 AS pairs,
       CAST(label AS VARCHAR) AS found, CAST(NULL AS VARCHAR) AS missing, 3 AS entries, vec_id || '=x' AS odd
FROM embeddings
""",
)
def q79(spark, sf_dir):
    steps = S.adjacent(F.col("embedding").cast("array<double>"))
    found = parameters(F.concat(F.lit("Label= 1; LABEL="), "label", F.lit(" ;flag;b=2;odd="), "vec_id", F.lit("=x")))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.aggregate(steps, F.lit(0.0), lambda a, p: a + F.abs(p["b"] - p["a"])), 6).alias("total_step"), F.size(steps).alias("pairs"),
        F.try_element_at(found, F.lit("label")).alias("found"), F.try_element_at(found, F.lit("flag")).alias("missing"), F.size(found).alias("entries"),
        F.try_element_at(found, F.lit("odd")).alias("odd"),
    )


@query(
    "q80_binary",
    """
WITH c AS (SELECT c_custkey, unhex(md5(c_name)) AS d, md5(c_name) AS h, CAST(c_custkey % 90 AS BIGINT) AS p FROM customer),
b AS (SELECT *, list_transform(range(1, 33), lambda i: CAST('0x' || h[i] AS INTEGER)) AS n FROM c),
t AS (SELECT *, flatten(list_transform(n, lambda x: [x // 8 % 2, x // 4 % 2, x // 2 % 2, x % 2])) AS bits FROM b)
SELECT c_custkey, CAST(list_reduce(list_transform(range(0, 13), lambda i: bits[p + 1 + i]), lambda a, x: a * 2 + x) AS BIGINT) AS field,
       CASE WHEN p + 40 <= 128 THEN CAST(list_reduce(list_transform(bits[p + 1:p + 40], lambda x: CAST(x AS BIGINT)), lambda a, x: a * 2 + x) AS BIGINT) END AS wide,
       CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(bits, lambda x: CAST(x AS BIGINT))),
         lambda a, x: xor(a * 2 % 4294967296, CASE WHEN (a // 2147483648) <> x THEN 79764919 ELSE 0 END)) AS BIGINT) AS crc,
       upper(h) AS hexed, sha256(d) AS digest, lpad(upper(to_hex(c_custkey)), 8, '0') AS number,
       '00000000  ' || upper(array_to_string(list_transform(range(1, 17), lambda i: h[2 * i - 1:2 * i]), ' ')) || chr(10) || '00000010  ' || upper(array_to_string(list_transform(range(1, 5), lambda i: h[2 * i - 1:2 * i]), ' ')) AS dump,
       CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || (c_custkey % 250) || ':554' ELSE '[2001:db8::' || (c_custkey % 250) || ']:554' END AS endpoint,
       c_custkey % 4 = 0 AS unspecified
FROM t
""",
)
def q80(spark, sf_dir):
    k = F.col("c_custkey")
    data, at = F.unhex(F.md5("c_name")), (k % 90).cast("int")
    ip = F.when(k % 2 == 0, F.concat(F.lit("10.0.0."), k % 250)).otherwise(F.concat(F.lit("2001:db8::"), k % 250))
    zero = F.when(k % 4 == 0, F.when(k % 8 == 0, "::").otherwise("0.0.0.0")).otherwise(ip)
    twice = F.concat(data, F.substring(data, 1, 4))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.bit_field(data, at, 13).alias("field"), S.bit_field(data, at, 40).alias("wide"), S.crc32_msb(data).alias("crc"), F.hex(data).alias("hexed"),
        F.sha2(data, 256).alias("digest"), F.hex(bytes_of(k, 4)).alias("number"), T.hex_dump(twice, F.lit(0), 4096).alias("dump"),
        T.endpoint(ip, F.lit(554)).alias("endpoint"), T.unspecified(zero).alias("unspecified"),
    )


@query(
    "q81_rates_and_sizes",
    """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_size * 1000 / 1001.0 ELSE p_size + 0.5 END AS rate, p_size * 16 AS width,
       CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 9 END AS height, p_partkey % 5 = 0 AS bad_size, p_size % 3 <> 2 AS bad_rate,
       starts_with(p_brand, 'Brand#1') AS same_namespace
FROM part
""",
)
def q81(spark, sf_dir):
    size, k = F.col("p_size"), F.col("p_partkey")
    rate = F.when(size % 3 == 0, F.concat(size, F.lit("/0"))).when(size % 3 == 1, F.concat(size * 1000, F.lit("/1001"))).otherwise(F.concat(size, F.lit(".5")))
    sign = F.when(k % 3 == 0, "x").when(k % 3 == 1, "-").otherwise("×")
    text = F.concat(F.lit("97 "), size * 16, sign, F.when(k % 5 == 0, F.lit(0)).otherwise(size * 9))
    width, height = T.dimensions(text)
    space = F.concat(F.lit("http://ns/"), F.left("p_brand", F.lit(7)), F.lit("//"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.frame_rate(rate).alias("rate"), width.alias("width"), height.alias("height"), T.invalid_dimensions(text).alias("bad_size"),
        T.invalid_rate(rate).alias("bad_rate"), T.same_namespace(space, F.lit("http://ns/Brand#1")).alias("same_namespace"),
    )
