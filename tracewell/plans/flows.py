"""Flow queries: users are flows, event ids are arrival order, order lines are sequence numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.scalar import cents, micros, milli
from tracewell.operators import hot_flows as H
from tracewell.operators import sequence as S
from tracewell.queries import query, table

HOUR = 3_600_000_000


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", micros("ts").alias("us"), cents("value").alias("size"), "props"
    )


def lines(spark, sf_dir):
    """Order lines by arrival; ties are broken by all columns, as no key is unique."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("flow"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
        micros("l_shipdate").alias("us"),
        "l_partkey",
        "l_suppkey",
        cents("l_extendedprice").alias("price"),
    )


ARRIVAL = ["us", "l_partkey", "l_suppkey", "seq", "price"]
LINES = """
WITH l AS (SELECT l_orderkey AS flow, CAST(l_linenumber AS BIGINT) AS seq, epoch_us(l_shipdate) AS us, l_partkey, l_suppkey,
                  CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem),
c AS (SELECT *, row_number() OVER (PARTITION BY flow, seq ORDER BY us, l_partkey, l_suppkey, seq, price) AS copy FROM l),
"""


@query(
    "q01_flow_stats_peak_rate",
    """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS size FROM events),
b AS (SELECT user_id, (us - min(us) OVER (PARTITION BY user_id)) // 3600000000 AS b, us, size FROM e),
s AS (SELECT user_id, b, count(*) AS n, sum(size) AS s, min(us) AS lo, max(us) AS hi FROM b GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS total, CAST(max(s) AS BIGINT) AS peak, max(hi) - min(lo) AS span
FROM s GROUP BY user_id
""",
)
def q01(spark, sf_dir):
    return S.tumbling_peak(events(spark, sf_dir), ["user_id"], "us", "size", HOUR)


@query(
    "q02_seq_dedupe",
    LINES + "x AS (SELECT 1) SELECT flow, seq, us, l_partkey, l_suppkey, price FROM c WHERE copy = 1",
)
def q02(spark, sf_dir):
    return S.first_copies(lines(spark, sf_dir), ["flow", "seq"], ARRIVAL)


@query(
    "q03_sequence_statistics",
    LINES
    + """
u AS (SELECT *, CASE WHEN copy = 1 THEN seq END AS u FROM c),
w AS (SELECT *, max(u) OVER (PARTITION BY flow ORDER BY us, l_partkey, l_suppkey, seq, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             first_value(u IGNORE NULLS) OVER (PARTITION BY flow ORDER BY us, l_partkey, l_suppkey, seq, price) AS f FROM u)
SELECT flow, count(*) AS packets, count(u) AS uniques, count(*) - count(u) AS duplicates,
       max(u) - min(f) + 1 - count(*) FILTER (u >= f) AS lost,
       coalesce(max(CASE WHEN copy = 1 AND seq > before THEN seq - before - 1 END), 0) AS max_gap,
       count(*) FILTER (copy = 1 AND NOT (before IS NULL OR seq > before)) AS out_of_order
FROM w GROUP BY flow
""",
)
def q03(spark, sf_dir):
    return S.sequence_statistics(lines(spark, sf_dir), ["flow"], ARRIVAL, "seq")


@query(
    "q05_seq_unwrap",
    """
WITH e AS (SELECT user_id, event_id, (event_id * 37) % 256 AS seq FROM events),
s AS (SELECT *, coalesce(((seq - lag(seq) OVER w + 128 + 256) % 256) - 128, seq) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, seq, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS ext FROM s
""",
)
def q05(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", ((F.col("event_id") * 37) % 256).alias("seq"))
    return S.unwrap(rows, ["user_id"], ["event_id"], "seq", 256)


@query(
    "q06_jitter",
    """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
d AS (SELECT *, ms - lag(ms) OVER w AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
j AS (SELECT *, abs(d - lag(d) OVER w) AS j, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, CAST(round(coalesce(sum(j * pow(15.0 / 16, n - rn) / 16), 0)) AS BIGINT) AS jitter_ms FROM j GROUP BY user_id
""",
)
def q06(spark, sf_dir):
    w = S._window(["user_id"], ["event_id"])
    rows = events(spark, sf_dir).withColumn("ms", F.floor(F.col("us") / 1000))
    rows = rows.withColumn("d", F.col("ms") - F.lag("ms").over(w)).withColumn("dd", F.col("d") - F.lag("d").over(w))
    out = S.jitter(rows, ["user_id"], ["event_id"], F.col("dd").cast("double"))
    return out.select("user_id", F.round("jitter").cast("bigint").alias("jitter_ms"))


@query(
    "q07_ts_rollback",
    LINES
    + """
m AS (SELECT *, max(seq) OVER (PARTITION BY flow ORDER BY seq, us, l_partkey, l_suppkey, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM l),
a AS (SELECT *, h IS NULL OR seq > h AS ahead FROM m),
b AS (SELECT *, last_value(CASE WHEN ahead THEN us END IGNORE NULLS) OVER (PARTITION BY flow ORDER BY seq, us, l_partkey, l_suppkey, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a)
SELECT flow, count(*) FILTER (ahead AND us < last) AS rollbacks FROM b GROUP BY flow
""",
)
def q07(spark, sf_dir):
    order = ["seq", "us", "l_partkey", "l_suppkey", "price"]
    before = S._window(["flow"], order).rowsBetween(S.Window.unboundedPreceding, -1)
    rows = lines(spark, sf_dir).withColumn("high", F.max("seq").over(before))
    ahead = F.col("high").isNull() | (F.col("seq") > F.col("high"))
    return S.rollbacks(rows, ["flow"], order, ahead, "us")


@query(
    "q08_attribute_change_count",
    """
WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, count(*) FILTER (b IS NOT NULL AND b <> event_type) AS changes FROM e GROUP BY user_id
""",
)
def q08(spark, sf_dir):
    return S.changes(events(spark, sf_dir), ["user_id"], ["event_id"], "event_type")


@query(
    "q09_restart_stages",
    """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS size FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) > 43200000000 THEN 1 ELSE 0 END AS st FROM e),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS stage FROM g)
SELECT user_id, CAST(stage AS BIGINT) AS stage, count(*) AS n, CAST(sum(size) AS BIGINT) AS total, min(event_id) AS first, max(event_id) AS last
FROM s GROUP BY user_id, stage
""",
)
def q09(spark, sf_dir):
    staged = S.stages(events(spark, sf_dir), ["user_id"], ["event_id"], "us", 12 * HOUR)
    return staged.groupBy("user_id", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("event_id").alias("first"), F.max("event_id").alias("last")
    )


@query(
    "q10_first_n_events_per_flow",
    """
SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn, n > 5 AS truncated FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE rn <= 5
""",
)
def q10(spark, sf_dir):
    return S.heads(events(spark, sf_dir), ["user_id"], ["event_id"], 5).select("user_id", "event_id", "rn", "truncated")


@query(
    "q11_level_jump",
    """
WITH d AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(total) OVER (PARTITION BY event_type ORDER BY day) AS before FROM d)
SELECT event_type, day, total, before FROM l WHERE before > 0 AND (4 * total >= 5 * before OR 5 * total <= 4 * before)
""",
)
def q11(spark, sf_dir):
    days = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.sum("size").alias("total"))
    w = S._window(["event_type"], ["day"])
    return days.withColumn("before", F.lag("total").over(w)).filter(
        "before > 0 and (4 * total >= 5 * before or 5 * total <= 4 * before)"
    )


@query(
    "q12_silence_intervals",
    """
WITH e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
q AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e WHERE size < 2000)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM q GROUP BY user_id, island HAVING count(*) >= 2
""",
)
def q12(spark, sf_dir):
    quiet = S.runs(events(spark, sf_dir), ["user_id"], ["event_id"], F.col("size") < 2000, "event_id")
    return quiet.filter("length >= 2")


@query(
    "q32_cseq_regression",
    LINES
    + """
h AS (SELECT flow, seq, max(seq) OVER (PARTITION BY flow ORDER BY us, l_partkey, l_suppkey, seq, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM l)
SELECT flow, count(*) FILTER (seq < high) AS regressions FROM h GROUP BY flow
""",
)
def q32(spark, sf_dir):
    return S.regressions(lines(spark, sf_dir), ["flow"], ARRIVAL, "seq")


@query(
    "q38_gop_stats",
    """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
d AS (SELECT user_id, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS d FROM e WHERE event_type = 'purchase')
SELECT user_id, count(*) AS keys, CAST(sum(d) AS BIGINT) // count(d) AS mean_gop, max(d) AS max_gop FROM d GROUP BY user_id HAVING count(d) > 0
""",
)
def q38(spark, sf_dir):
    w = S._window(["user_id"], ["event_id"])
    keys = events(spark, sf_dir).withColumn("i", F.row_number().over(w).cast("bigint")).filter("event_type = 'purchase'")
    gaps = keys.withColumn("d", F.col("i") - F.lag("i").over(w))
    out = gaps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("keys"), F.expr("sum(d) div count(d)").alias("mean_gop"), F.max("d").alias("max_gop")
    )
    return out.filter("mean_gop is not null")


@query(
    "q41_frame_sessionize",
    """
WITH e AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS size,
           sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS unit FROM events)
SELECT user_id, CAST(unit AS BIGINT) AS unit, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY 1, 2
""",
)
def q41(spark, sf_dir):
    cut = S.units(events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    return cut.groupBy("user_id", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("event_id").alias("first"), F.max("event_id").alias("last")
    )


@query(
    "q42_cumulative_offset",
    """
SELECT o_custkey, o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS elapsed
FROM orders
""",
)
def q42(spark, sf_dir):
    w = S._window(["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.sum(cents("o_totalprice")).over(w).alias("elapsed")
    )


@query(
    "q45_index_percentile",
    """
WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS size FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_type, max(size) FILTER (i = n * 10 // 100) AS p10, max(size) FILTER (i = n * 95 // 100) AS p95 FROM i GROUP BY event_type
""",
)
def q45(spark, sf_dir):
    # Equal values stand as one row with a count, so that a group is as large as its distinct values.
    rows = events(spark, sf_dir).groupBy("event_type", "size").agg(F.count(F.lit(1)).alias("n"))
    w = S._window(["event_type"], ["size"])
    ends = rows.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(S.Window.partitionBy("event_type")))
    at = lambda p: F.expr(f"total * {p} div 100")
    return ends.groupBy("event_type").agg(
        *[F.min(F.when(F.col("upto") > at(p), F.col("size"))).alias(f"p{p}") for p in (10, 95)]
    )


@query(
    "q56_leaky_bucket",
    """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, epoch_us(ts) // 60000000 AS t, CAST(round(value * 100) AS BIGINT) AS size FROM events),
b AS (
  SELECT user_id, i, t, greatest(60000 - size, 0) AS "full", CASE WHEN size > 60000 THEN 1 ELSE 0 END AS underflows, greatest(60000 - size, 0) AS lowest FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, e.t, greatest(least(60000, b."full" + (e.t - b.t) * 20) - size, 0), underflows + CASE WHEN least(60000, b."full" + (e.t - b.t) * 20) < size THEN 1 ELSE 0 END,
         least(lowest, greatest(least(60000, b."full" + (e.t - b.t) * 20) - size, 0))
  FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT user_id, max_by("full", i) AS "full", max_by(underflows, i) AS underflows, max_by(lowest, i) AS lowest FROM b GROUP BY user_id
""",
)
def q56(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("at", F.floor(F.col("us") / 60_000_000))
    return S.leaky_bucket(rows, ["user_id"], ["event_id"], "at", "size", 20, 60_000)


@query(
    "q59_stride_downsample",
    """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM e WHERE (rn - 1) % CAST(ceil(n / 10.0) AS BIGINT) = 0
""",
)
def q59(spark, sf_dir):
    return S.every_nth(events(spark, sf_dir), ["user_id"], ["event_id"], 10).select("user_id", "event_id")


@query(
    "q04_seq_out_of_order_events",
    """
WITH e AS (SELECT user_id, event_id, (event_id * 7919) % 1009 AS seq FROM events),
h AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e)
SELECT user_id, count(*) FILTER (seq < high) AS regressions FROM h GROUP BY user_id
""",
)
def q04(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seq", (F.col("event_id") * 7919) % 1009)
    return S.regressions(rows, ["user_id"], ["event_id"], "seq")


@query(
    "q55_json_props",
    """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type
""",
)
def q55(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max")
    )


@query(
    "q141_hot_flows",
    """
WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id + 1 END AS flow, event_id AS n, CASE event_id % 7 WHEN 3 THEN event_id + 20 ELSE event_id + 60 END // 2 AS seq, (event_id * 37) % 256 AS w, epoch_us(ts) // 3600000000 * (event_id % 5 + 90) AS us FROM events),
s AS (SELECT *, coalesce(((w - lag(w) OVER o + 128 + 256) % 256) - 128, w) AS step, row_number() OVER (PARTITION BY flow, seq ORDER BY n) AS copy FROM e WINDOW o AS (PARTITION BY flow ORDER BY n)),
u AS (SELECT *, CASE WHEN copy = 1 THEN seq END AS u FROM s),
b AS (SELECT *, max(u) OVER (PARTITION BY flow ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(u IGNORE NULLS) OVER (PARTITION BY flow ORDER BY n) AS f,
             max(seq) OVER (PARTITION BY flow ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM u),
a AS (SELECT *, last_value(CASE WHEN high IS NULL OR seq > high THEN us END IGNORE NULLS) OVER (PARTITION BY flow ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM b)
SELECT flow, count(*) AS packets, count(u) AS uniques, count(*) - count(u) AS duplicates, max(u) - min(f) + 1 - count(*) FILTER (u >= f) AS lost,
       coalesce(max(CASE WHEN copy = 1 AND seq > before THEN seq - before - 1 END), 0) AS max_gap, count(*) FILTER (copy = 1 AND NOT (before IS NULL OR seq > before)) AS out_of_order,
       count(*) FILTER ((high IS NULL OR seq > high) AND us < clock) AS rollbacks, CAST(sum(step) AS BIGINT) AS last_ext
FROM a GROUP BY flow
""",
)
def q141(spark, sf_dir):
    """Events with half of them in one flow, by pieces of 500 events."""
    n = F.col("event_id")
    rows = events(spark, sf_dir).select(
        F.when(n % 2 == 0, 0).otherwise(F.col("user_id") + 1).alias("flow"), n.alias("n"), F.floor(F.when(n % 7 == 3, n + 20).otherwise(n + 60) / 2).alias("seq"), ((n * 37) % 256).alias("w"),
        (F.floor(F.col("us") / HOUR) * (n % 5 + 90)).alias("us"),
    )
    statistics = H.sequence_statistics(rows, ["flow"], "n", "seq", 500)
    back = H.rollbacks(rows, ["flow"], "n", "seq", "us", width=500)
    last = H.unwrap(rows, ["flow"], "n", "w", 256, width=500).groupBy("flow").agg(F.max_by("ext", "n").alias("last_ext"))
    return statistics.join(back, "flow").join(last, "flow")
