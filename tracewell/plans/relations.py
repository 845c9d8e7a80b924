"""Join, rollup and rule queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import cents, micros
from tracewell.operators import intervals
from tracewell.operators import joins as J
from tracewell.operators import rollups as R
from tracewell.operators import sequence as S
from tracewell.plans.flows import events
from tracewell.queries import query, table
from tracewell.rules.engine import Rule, findings

HOUR = 3_600_000_000
E_SQL = "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS size FROM events)"


@query(
    "q13_stream_search",
    """
SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), 'nation_1') AND contains(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), 'build')
""",
)
def q13(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.lower(F.concat_ws(" ", "c_name", "n_name", "c_mktsegment"))
    return joined.filter(text.contains("nation_1") & text.contains("build")).select("c_custkey", "c_name", "n_name")


@query(
    "q14_interval_overlap_filter",
    """
WITH s AS (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, epoch_us(lo) AS lo, epoch_us(hi) AS hi FROM s WHERE hi >= TIMESTAMP '1998-03-01' AND lo < TIMESTAMP '1998-04-01'
""",
)
def q14(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi")
    )
    inside = spans.filter("hi >= timestamp_ntz'1998-03-01' and lo < timestamp_ntz'1998-04-01'")
    return inside.select("l_orderkey", micros("lo").alias("lo"), micros("hi").alias("hi"))


@query(
    "q15_request_response_pair",
    """
WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
q AS (SELECT * FROM c WHERE role = 'user')
SELECT q.conv_id, q.turn, (SELECT min(a.turn) FROM c a WHERE a.conv_id = q.conv_id AND a.turn > q.turn AND a.role = 'assistant'
   AND a.turn < coalesce((SELECT min(u.turn) FROM c u WHERE u.conv_id = q.conv_id AND u.turn > q.turn AND u.role = 'user'), 1000000000)) AS answer,
  CASE WHEN EXISTS (SELECT 1 FROM c a WHERE a.conv_id = q.conv_id AND a.turn > q.turn AND a.role = 'assistant'
   AND a.turn < coalesce((SELECT min(u.turn) FROM c u WHERE u.conv_id = q.conv_id AND u.turn > q.turn AND u.role = 'user'), 1000000000)) THEN 200 ELSE 0 END AS status
FROM q
""",
)
def q15(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    seen = rows.withColumns(
        {
            "a": J.next_after(rows, ["conv_id"], ["turn"], reply, "turn"),
            "u": J.next_after(rows, ["conv_id"], ["turn"], user, "turn"),
        }
    )
    answer = F.when(F.col("a") < F.coalesce("u", F.lit(1 << 60)), F.col("a"))
    return seen.filter(user).select(
        "conv_id", "turn", answer.alias("answer"), F.when(answer.isNotNull(), 200).otherwise(0).alias("status")
    )


@query(
    "q16_latest_binding_asof",
    E_SQL
    + """
SELECT user_id, event_id, (SELECT max(b.event_id) FROM e b WHERE b.user_id = p.user_id AND b.event_id < p.event_id AND b.event_type = 'signup') AS binding
FROM e p WHERE event_type = 'purchase'
""",
)
def q16(spark, sf_dir):
    rows = events(spark, sf_dir)
    bound = rows.withColumn("binding", J.last_before(rows, ["user_id"], ["event_id"], F.col("event_type") == "signup", "event_id"))
    return bound.filter("event_type = 'purchase'").select("user_id", "event_id", "binding")


@query(
    "q17_unique_match_only",
    """
SELECT p_partkey, min(s_suppkey) AS s_suppkey FROM part JOIN supplier ON p_size = s_nationkey GROUP BY p_partkey HAVING count(*) = 1
""",
)
def q17(spark, sf_dir):
    # Suppliers are reduced to those whose nation is unique before the join.
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.min("s_suppkey").alias("s_suppkey"), F.count(F.lit(1)).alias("n")
    ).filter("n = 1")
    return table(spark, sf_dir, "part").join(suppliers, F.col("p_size") == F.col("s_nationkey")).select("p_partkey", "s_suppkey")


@query(
    "q18_session_fallback",
    """
SELECT c_custkey, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), -1) AS session FROM customer
""",
)
def q18(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    joined = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("last", F.lit(-1)).alias("session"))


@query(
    "q19_next_after",
    E_SQL
    + """
SELECT user_id, event_id, (SELECT min(b.event_id) FROM e b WHERE b.user_id = p.user_id AND b.event_id > p.event_id AND b.event_type = 'purchase') AS recovery
FROM e p WHERE event_type = 'error'
""",
)
def q19(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = rows.withColumn("recovery", J.next_after(rows, ["user_id"], ["event_id"], F.col("event_type") == "purchase", "event_id"))
    return found.filter("event_type = 'error'").select("user_id", "event_id", "recovery")


@query(
    "q20_recovery_windows",
    """
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, i, (SELECT min(b.i) FROM e b WHERE b.user_id = p.user_id AND b.i > p.i AND b.event_type = 'purchase') AS ra FROM e p WHERE event_type = 'error')
SELECT user_id, i, ra, ra - i AS frames,
       EXISTS (SELECT 1 FROM e v WHERE v.user_id = r.user_id AND v.event_type = 'view' AND v.i BETWEEN r.ra AND r.ra + 3) AS visual
FROM r
""",
)
def q20(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf_dir).withColumn("i", F.row_number().over(w).cast("bigint"))
    ahead = w.rowsBetween(0, 3)
    # Whether a view follows is settled at the random access itself, then looked up with it.
    marked = rows.withColumn("view_near", F.max((F.col("event_type") == "view").cast("int")).over(ahead))
    found = marked.withColumn("access", F.struct("i", "view_near"))
    pair = J.next_after(found, ["user_id"], ["event_id"], F.col("event_type") == "purchase", "access")
    found = found.withColumn("ra", pair).filter("event_type = 'error'")
    return found.select(
        "user_id", "i", F.col("ra.i").alias("ra"), (F.col("ra.i") - F.col("i")).alias("frames"),
        F.coalesce(F.col("ra.view_near") == 1, F.lit(False)).alias("visual"),
    )


@query(
    "q21_nearest_neighbour",
    E_SQL
    + """,
c AS (SELECT x.user_id, x.event_id, y.event_id AS nearest, abs(x.us - y.us) AS distance,
             row_number() OVER (PARTITION BY x.event_id ORDER BY abs(x.us - y.us), y.us) AS rn
      FROM e x JOIN e y ON x.user_id = y.user_id AND y.event_type = 'click' WHERE x.event_type = 'error')
SELECT e.user_id, e.event_id, nearest, distance FROM e LEFT JOIN c ON c.event_id = e.event_id AND rn = 1 WHERE event_type = 'error'
""",
)
def q21(spark, sf_dir):
    rows = events(spark, sf_dir)
    near = J.nearest(rows, ["user_id"], ["us", "event_id"], "us", F.col("event_type") == "click", "event_id")
    return near.filter("event_type = 'error'").select("user_id", "event_id", "nearest", "distance")


@query(
    "q22_greedy_pairing",
    """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_type, event_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e WHERE event_type = 'purchase'),
t AS (SELECT * FROM e WHERE event_type = 'click'),
g AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS distance FROM o
  UNION ALL
  SELECT user_id, i, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, a, b, distance
  FROM (SELECT g.user_id, o.i, any_value(g.used) AS used, any_value(o.event_id) AS a, min_by(t.event_id, (abs(t.us - o.us), t.us, t.event_id)) AS b, min(abs(t.us - o.us)) AS distance
        FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1
        LEFT JOIN t ON t.user_id = g.user_id AND abs(t.us - o.us) <= 7200000000 AND NOT list_contains(g.used, t.event_id)
        GROUP BY g.user_id, o.i))
SELECT user_id, a, b, distance FROM g WHERE b IS NOT NULL
""",
)
def q22(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "us", "event_type", "event_id")
    return J.greedy_pairs(rows, ["user_id"], "us", "event_type", "purchase", "click", "event_id", 2 * HOUR)


@query(
    "q23_mutual_nearest_pairing",
    E_SQL
    + """,
d AS (SELECT p.user_id, p.event_id AS a, c.event_id AS b, abs(p.us - c.us) AS distance, p.us AS pu, c.us AS cu
      FROM e p JOIN e c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click'),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, cu) AS ra, row_number() OVER (PARTITION BY b ORDER BY distance, pu) AS rb FROM d)
SELECT user_id, a, b, distance FROM r WHERE ra = 1 AND rb = 1 AND distance <= 7200000000
""",
)
def q23(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "us", "event_type", "event_id")
    return J.mutual_nearest(rows, ["user_id"], ["us", "event_id"], "us", "event_type", "purchase", "click", "event_id", 2 * HOUR)


@query(
    "q24_interval_containment",
    """
SELECT year(l_shipdate) AS y, quarter(l_shipdate) AS q, count(*) AS n, count(DISTINCT l_orderkey) AS flows FROM lineitem GROUP BY 1, 2
""",
)
def q24(spark, sf_dir):
    # Quarters are regular intervals: containment is arithmetic, not a join.
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("flows")
    )


@query(
    "q25_interval_overlap_first_last",
    E_SQL
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e),
i AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n WHERE size < 2000) GROUP BY user_id, g HAVING count(*) >= 2)
SELECT i.user_id, lo, hi, min(event_id) AS first_packet, max(event_id) AS last_packet, count(*) AS packets
FROM i JOIN e ON e.user_id = i.user_id AND e.us BETWEEN lo - 3600000000 AND hi + 3600000000 GROUP BY 1, 2, 3
""",
)
def q25(spark, sf_dir):
    rows = events(spark, sf_dir)
    quiet = S.runs(rows, ["user_id"], ["event_id"], F.col("size") < 2000, "us").filter("length >= 2")
    spans = quiet.select("user_id", F.col("first").alias("lo"), F.col("last").alias("hi"))
    wide = spans.withColumns({"start": F.col("lo") - HOUR, "end": F.col("hi") + HOUR})
    found = intervals.first_and_last(wide, rows, ["user_id"], ["lo", "hi"], "start", "end", "us", "event_id")
    return found.filter("points > 0").select("user_id", "lo", "hi", F.col("first").alias("first_packet"), F.col("last").alias("last_packet"), F.col("points").alias("packets"))


@query(
    "q26_cross_pair_filter",
    """
WITH s AS (SELECT DISTINCT c_mktsegment FROM customer)
SELECT r_name, s.c_mktsegment, (SELECT count(*) FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c.c_mktsegment = s.c_mktsegment) AS n
FROM region, s WHERE length(r_name) <= length(s.c_mktsegment)
""",
)
def q26(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    counts = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n")
    )
    # Both sides are vocabularies: five regions at any scale, five segments. Without an equality one side has to be sent to all.
    pairs = F.broadcast(table(spark, sf_dir, "region")).join(
        customers.select("c_mktsegment").distinct(), F.length("r_name") <= F.length("c_mktsegment")
    )
    joined = pairs.join(counts, (pairs["r_regionkey"] == counts["n_regionkey"]) & (pairs["c_mktsegment"] == counts["c_mktsegment"]), "left")
    return joined.select("r_name", pairs["c_mktsegment"], F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "q27_semi_flag",
    "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer",
)
def q27(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    joined = table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.col("o_custkey").isNotNull().alias("urgent"))


@query(
    "q28_anti_null_safe",
    """
SELECT c_custkey FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey IS NOT DISTINCT FROM c_custkey AND o_orderpriority = '1-URGENT')
""",
)
def q28(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    customers = table(spark, sf_dir, "customer")
    return customers.join(urgent, customers["c_custkey"].eqNullSafe(urgent["o_custkey"]), "left_anti").select("c_custkey")


@query(
    "q29_self_shared_endpoint",
    """
SELECT p_partkey, p_brand, p_size, p_type FROM part p WHERE EXISTS (
  SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size = p.p_size AND q.p_type <> p.p_type)
""",
)
def q29(spark, sf_dir):
    w = Window.partitionBy("p_brand", "p_size")
    shared = table(spark, sf_dir, "part").withColumn("other", F.min("p_type").over(w) != F.max("p_type").over(w))
    return shared.filter("other").select("p_partkey", "p_brand", "p_size", "p_type")


@query(
    "q30_transaction_rollup",
    """
SELECT o_orderkey, any_value(o_orderstatus) AS status, count(l_orderkey) AS messages, count(*) FILTER (l_returnflag = 'R') AS retransmissions,
       epoch_us(min(l_shipdate)) - epoch_us(any_value(o_orderdate)) AS latency, epoch_us(max(l_shipdate)) AS last
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""",
)
def q30(spark, sf_dir):
    # Lines are summed up before the join, so that orders meet one row each.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("l_returnflag") == "R").alias("retransmissions"),
        F.min("l_shipdate").alias("lo"),
        F.max("l_shipdate").alias("hi"),
    )
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("retransmissions", F.lit(0)).alias("retransmissions"),
        (micros("lo") - micros("o_orderdate")).alias("latency"),
        micros("hi").alias("last"),
    )


@query(
    "q31_dialog_state",
    """
SELECT conv_id, CASE WHEN max(CASE WHEN role = 'assistant' THEN turn END) > max(CASE WHEN role = 'user' THEN turn END) THEN 'confirmed'
                     WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'early' WHEN count(*) FILTER (role = 'user') > 0 THEN 'calling' ELSE 'idle' END AS state,
       min(turn) AS first, max(turn) AS last, count(*) AS messages FROM conversations GROUP BY conv_id
""",
)
def q31(spark, sf_dir):
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("turn")))
    state = F.when(of("assistant") > of("user"), "confirmed").when(of("assistant").isNotNull(), "early").when(
        of("user").isNotNull(), "calling"
    ).otherwise("idle")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        state.alias("state"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("messages")
    )


@query(
    "q33_bool_rollup_status",
    """
SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'completed' WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'failed' END AS status, count(*) AS n
FROM orders GROUP BY o_custkey
""",
)
def q33(spark, sf_dir):
    return R.status(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query(
    "q34_health_score",
    """
SELECT user_id, CAST(greatest(0, 100 - sum(CASE event_type WHEN 'error' THEN 7 WHEN 'signup' THEN 2 ELSE 0 END)) AS BIGINT) AS score FROM events GROUP BY user_id
""",
)
def q34(spark, sf_dir):
    weight = F.when(F.col("event_type") == "error", 7).when(F.col("event_type") == "signup", 2).otherwise(0)
    return R.health(events(spark, sf_dir), ["user_id"], weight)


@query(
    "q35_risk_topk_page",
    """
SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS risk, count(*) AS packets FROM lineitem GROUP BY l_suppkey
ORDER BY risk DESC, packets DESC, l_suppkey LIMIT 10 OFFSET 10
""",
)
def q35(spark, sf_dir):
    risk = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("risk"), F.count(F.lit(1)).alias("packets")
    )
    return risk.orderBy(F.desc("risk"), F.desc("packets"), "l_suppkey").offset(10).limit(10)


@query(
    "q36_timeline_union",
    """
SELECT 'order' AS layer, o_orderkey AS key, epoch_us(o_orderdate) AS us, o_orderstatus AS kind FROM orders
UNION ALL SELECT 'event', event_id, epoch_us(ts), event_type FROM events
UNION ALL SELECT 'line', l_orderkey, CASE WHEN l_linestatus = 'F' THEN epoch_us(l_shipdate) END, l_returnflag FROM lineitem
""",
)
def q36(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("layer"), F.col("o_orderkey").alias("key"), micros("o_orderdate").alias("us"), F.col("o_orderstatus").alias("kind")
    )
    some = events(spark, sf_dir).select(F.lit("event").alias("layer"), F.col("event_id").alias("key"), "us", F.col("event_type").alias("kind"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("line").alias("layer"),
        F.col("l_orderkey").alias("key"),
        F.when(F.col("l_linestatus") == "F", micros("l_shipdate")).alias("us"),
        F.col("l_returnflag").alias("kind"),
    )
    return orders.unionByName(some).unionByName(lines).orderBy(F.asc_nulls_last("us"), "layer", "key")


@query("q37_histogram_map", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def q37(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q39_param_change_fields",
    """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> s THEN 'o_orderstatus' END, CASE WHEN o_orderpriority <> p THEN 'o_orderpriority' END) AS changed
FROM o WHERE o_orderstatus <> s OR o_orderpriority <> p
""",
)
def q39(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return R.changed_fields(orders, ["o_custkey"], ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select(
        "o_custkey", "o_orderkey", "changed"
    )


@query(
    "q40_dangling_reference",
    """
SELECT l_orderkey, count(*) AS dangling FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderdate <= l_shipdate
WHERE o_orderkey IS NULL GROUP BY l_orderkey
""",
)
def q40(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    seen = (lines["l_orderkey"] == orders["o_orderkey"]) & (orders["o_orderdate"] <= lines["l_shipdate"])
    return lines.join(orders, seen, "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("dangling"))


@query(
    "q43_data_quality_reasons",
    """
WITH o AS (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS lo FROM orders GROUP BY 1),
f AS (SELECT c_custkey, coalesce(n, 0) AS n, lo, c_acctbal FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, concat_ws(',', CASE WHEN n < 5 THEN 'few_packets' END, CASE WHEN lo < 10000 THEN 'short' END, CASE WHEN c_acctbal < 0 THEN 'negative' END) AS reasons,
       NOT (n < 5 OR coalesce(lo < 10000, false) OR c_acctbal < 0) AS sufficient FROM f
""",
)
def q43(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"))
    facts = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    tests = {
        "few_packets": F.coalesce("n", F.lit(0)) < 5,
        "short": F.col("lo") < 10000,
        "negative": F.col("c_acctbal") < 0,
    }
    return R.reasons(facts, tests).select("c_custkey", "reasons", "sufficient")


@query(
    "q44_severity_cap",
    """
WITH s AS (SELECT user_id, count(*) AS n, max(CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 ELSE 1 END) AS sev FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n < 60 THEN least(sev, 2) ELSE sev END AS severity, CASE WHEN n < 60 THEN 55 ELSE 90 END AS confidence FROM s
""",
)
def q44(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "signup", 3).otherwise(1)
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(severity).alias("s"))
    return rows.select(
        "user_id",
        F.when(F.col("n") < 60, F.least("s", F.lit(2))).otherwise(F.col("s")).alias("severity"),
        F.when(F.col("n") < 60, 55).otherwise(90).alias("confidence"),
    )


@query(
    "q46_weighted_mean",
    """
SELECT l_suppkey, CAST(sum(CAST(round(l_discount * 100) AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) // CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS mean_pct,
       min(CAST(round(l_discount * 100) AS BIGINT)) AS lo, max(CAST(round(l_discount * 100) AS BIGINT)) AS hi
FROM lineitem GROUP BY l_suppkey
""",
)
def q46(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", cents("l_discount").alias("d"), cents("l_extendedprice").alias("a"))
    return rows.groupBy("l_suppkey").agg(
        F.expr("sum(d * a) div sum(a)").alias("mean_pct"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )


@query(
    "q50_drift_ppm",
    """
WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) // 1000000 AS t, CAST(round(o_totalprice * 100) AS BIGINT) AS p,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders),
s AS (SELECT o_custkey, max(t) FILTER (z = 1) - max(t) FILTER (a = 1) AS dt, max(p) FILTER (z = 1) - max(p) FILTER (a = 1) AS dp FROM o GROUP BY 1)
SELECT o_custkey, dt, dp, CAST(round((dp / dt - 1) * 1000000) AS BIGINT) AS drift_ppm FROM s WHERE dt > 0
""",
)
def q50(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.struct("o_orderdate", "o_orderkey").alias("at"),
        F.struct(F.floor(micros("o_orderdate") / 1_000_000).alias("t"), cents("o_totalprice").alias("p")).alias("v"),
    )
    ends = rows.groupBy("o_custkey").agg(F.min_by("v", "at").alias("a"), F.max_by("v", "at").alias("z"))
    steps = ends.select("o_custkey", (F.col("z.t") - F.col("a.t")).alias("dt"), (F.col("z.p") - F.col("a.p")).alias("dp"))
    return steps.filter("dt > 0").withColumn("drift_ppm", F.round((F.col("dp") / F.col("dt") - 1) * 1_000_000).cast("bigint"))


@query(
    "q54_alias_redaction",
    """
WITH f AS (SELECT n_regionkey, c_nationkey, min(c_custkey) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, c_nationkey, 'host-' || lpad(CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY f, c_nationkey) AS VARCHAR), 4, '0') AS alias FROM f
""",
)
def q54(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.aliases(rows, "c_nationkey", "c_custkey", ["n_regionkey"], "host-")


@query(
    "q57_ordered_distinct_union",
    """
WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM f GROUP BY user_id
""",
)
def q57(spark, sf_dir):
    return R.ordered_distinct(events(spark, sf_dir), ["user_id"], ["event_id"], "event_type", "kinds")


FLOW_RULES = [
    Rule("FLOW-001", "transport", "critical", 95, "errors * 4 > n", ("errors", "n")),
    Rule("FLOW-002", "transport", "high", 80, "switches * 10 > n * 8", ("switches",)),
    Rule("FLOW-003", "timing", "medium", 70, "longest_gap > 86400000000", ("longest_gap",)),
    Rule("FLOW-004", "content", "low", 60, "purchases = 0", (), False),
]


@query(
    "q58_rule_findings",
    E_SQL
    + """,
g AS (SELECT *, us - lag(us) OVER w AS gap, event_type <> lag(event_type) OVER w AS sw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases,
             count(*) FILTER (sw) AS switches, max(gap) AS longest_gap FROM g GROUP BY user_id),
r AS (
  SELECT user_id, n, 0 AS ordinal, 'FLOW-001' AS rule_id, 'transport' AS category, 4 AS s, 95 AS c, true AS cap, 'errors=' || errors || ';n=' || n AS ev FROM f WHERE errors * 4 > n
  UNION ALL SELECT user_id, n, 1, 'FLOW-002', 'transport', 3, 80, true, 'switches=' || switches FROM f WHERE switches * 10 > n * 8
  UNION ALL SELECT user_id, n, 2, 'FLOW-003', 'timing', 2, 70, true, 'longest_gap=' || longest_gap FROM f WHERE longest_gap > 86400000000
  UNION ALL SELECT user_id, n, 3, 'FLOW-004', 'content', 1, 60, false, '' FROM f WHERE purchases = 0)
SELECT user_id, ordinal, rule_id, category, ['info', 'low', 'medium', 'high', 'critical'][1 + CASE WHEN cap AND n < 60 THEN least(s, 2) ELSE s END] AS severity,
       CASE WHEN cap AND n < 60 THEN least(c, 55) ELSE c END AS confidence, ev || CASE WHEN cap AND n < 60 THEN ';insufficient sample' ELSE '' END AS evidence
FROM r
""",
)
def q58(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf_dir).withColumn("gap", F.col("us") - F.lag("us").over(w)).withColumn(
        "switch", F.col("event_type") != F.lag("event_type").over(w)
    )
    facts = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if("switch").alias("switches"),
        F.max("gap").alias("longest_gap"),
    )
    return findings(facts, FLOW_RULES, ["user_id"], F.col("n") >= 60)


@query(
    "q60_cross_run_compare",
    """
WITH m AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS before, count(*) FILTER (l_returnflag = 'R') AS after FROM lineitem GROUP BY 1)
SELECT l_suppkey, before, after, CASE WHEN before = 0 OR after = 0 THEN 'missing' WHEN after * 10 > before * 12 THEN 'worse' WHEN after * 12 < before * 10 THEN 'better' ELSE 'same' END AS conclusion FROM m
""",
)
def q60(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("before"), F.count_if(F.col("l_returnflag") == "R").alias("after")
    )
    conclusion = (
        F.when((F.col("before") == 0) | (F.col("after") == 0), "missing")
        .when(F.col("after") * 10 > F.col("before") * 12, "worse")
        .when(F.col("after") * 12 < F.col("before") * 10, "better")
        .otherwise("same")
    )
    return runs.withColumn("conclusion", conclusion)
