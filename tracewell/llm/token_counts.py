"""Exact length histogram and its suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut

BLOCK = 1024


def length_table(lengths: DataFrame) -> DataFrame:
    """Answers for every context limit, from a column n_tokens.

    One row per length that occurs, in which it also stands for the limit:
    n_docs and docs_at_least and tokens_at_least (documents of at least this
    length), truncated_tokens (all documents cut to this length), total_docs,
    total_tokens, and quantile (share of documents no longer than this).
    Limits between two lengths follow from the next longer row. Null lengths
    are left out; an empty table gives no row.

    Sums run from the longest length down: inside blocks of lengths first, then
    over the few block totals, so that no task gets all rows.
    """
    counted = lengths.filter("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    histogram = cut(counted).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = histogram.groupBy("block").agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")
    )
    everything = Window.orderBy(F.desc("block"))
    later = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), zero).alias("later_docs"),
        F.coalesce(F.sum("tokens").over(later), zero).alias("later_tokens"),
        F.sum("docs").over(whole).alias("total_docs"),
        F.sum("tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    docs = F.col("later_docs") + F.col("inside_docs")
    tokens = F.col("later_tokens") + F.col("inside_tokens")
    return (
        histogram.withColumn("inside_docs", F.sum("n_docs").over(inside))
        .withColumn("inside_tokens", F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
        .join(blocks, "block")
        .select(
            "n_tokens",
            "n_docs",
            docs.alias("docs_at_least"),
            tokens.alias("tokens_at_least"),
            (F.col("total_tokens") - tokens + docs * F.col("n_tokens")).alias("truncated_tokens"),
            "total_docs",
            "total_tokens",
            ((F.col("total_docs") - docs + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        )
    )
