"""Allow and block rules over urls: expand, equi-join on short hashes, confirm.

Every url is expanded into (host suffix, path prefix) expressions, one for each
pair of a label count and a path length that some rule has. The expressions are
joined with the rules on the first bytes of their SHA-256; the full digest then
confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More rules than this are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 10_000
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_rows(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, int, int]]:
    rows = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        rows.append((rule, verdict, host, host.count(".") + 1, len(slash + path)))
    return rows


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by ``rules``: (verdict, "host/path").

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path; the longest fitting rule wins, then the alphabetically first. A
    rule given with both verdicts allows. Without a fitting rule the verdict is ``default``. Null urls and urls
    without ``://`` have an empty host and path and fit no rule. Equal rows
    (same page_id and url) each get a row; other columns are ignored, whatever
    their names. Urls of any length are judged whole, an empty table gives no
    row, and without rules all urls get the default.

    Returns page_id, host, path, rule, verdict.
    """
    spark = pages.sparkSession
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = _rule_rows(list(dict.fromkeys(rules)))
    shapes = sorted({(labels, length) for *_, labels, length in rows})
    table = spark.createDataFrame([(r, v) for r, v, *_ in rows], "rule string, rule_verdict string")
    table = table.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    table = table.groupBy("short", "digest", "rule").agg(F.min("rule_verdict").alias("rule_verdict"))
    if len(rows) <= BROADCAST_RULES:
        table = F.broadcast(table)

    labels = F.split("host", r"\.")
    table_of = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(length).alias("length")) for n, length in shapes])
    fitting = F.filter(table_of, lambda s: (s["n"] <= F.size(labels)) & (s["length"] <= F.length("path")))
    expressions = F.transform(
        fitting,
        lambda s: F.concat(F.array_join(F.slice(labels, -s["n"], s["n"]), "."), F.substring(F.col("path"), F.lit(1), s["length"])),
    )
    # Equal (page, host, path) rows travel as one row with a count.
    unique = judged.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    expanded = unique.select("*", F.explode(F.array_append(expressions, "")).alias("expression"))
    expanded = expanded.withColumn("digest_of", F.sha2("expression", 256)).withColumn(
        "short", F.substring("digest_of", 1, PREFIX_HEX)
    )
    hit = expanded.join(table, "short", "left").withColumn("fits", F.col("digest_of") == F.col("digest"))
    best = hit.groupBy("page_id", "host", "path", "copies").agg(
        F.min(
            F.when(F.col("fits"), F.struct((-F.length("rule")).alias("n"), F.col("rule"), F.col("rule_verdict")))
        ).alias("best")
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
