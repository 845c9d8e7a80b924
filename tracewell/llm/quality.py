"""Quality rules: counting rules and a hashed n-gram log-likelihood ratio.

Words are ``[^\\x20\\x09-\\x0D]+``. Unigrams and bigrams fall into ``buckets``
hash buckets; two multinomials over the buckets are estimated, one from trusted
documents and one from the whole corpus. A document's score is the mean over
its n-grams of log p(trusted) - log p(corpus): every document is compared with
one fixed threshold, nothing is sampled or drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, let, quoted, words

BUCKETS = 1 << 16
#: Trusted documents used at most, those with the smallest hash of doc_id.
TRUSTED_ROWS = 10_000
THRESHOLD = -0.1
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
WORD = r"[^ \t-\r]"


def _covered_by_repeats(hashes: Column) -> Column:
    """How many words lie in 3-word windows that occur at least twice.

    Window hashes are packed above their positions and sorted as longs, so
    equal windows become neighbours; full hashes confirm. The positions found
    are sorted, and each adds the words that the one before did not cover.
    Texts whose windows all differ skip the sort.
    """

    def windows(h: Column) -> Column:
        # The last two positions hash fewer than three words and so equal no window.
        return F.transform(h, lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)))

    def found(w: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(F.size(w).cast("bigint")))) - 1
        return let(
            mask,
            lambda m: let(
                F.sort_array(F.transform(w, lambda h, i: h.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("bigint")))),
                lambda packed: let(
                    F.transform(packed, lambda p: p.bitwiseAND(m).cast("int")),
                    lambda at: F.sort_array(
                        F.filter(
                            at,
                            lambda p, i: (F.get(w, p) == F.coalesce(F.get(w, F.get(at, i - 1)), p - 1))
                            | (F.get(w, p) == F.coalesce(F.get(w, F.get(at, i + 1)), p - 1)),
                        )
                    ),
                ),
            ),
        )

    def cover(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, i - 1)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    return let(
        windows(hashes),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(found(w), cover)),
    ).cast("bigint")


def _pairs(words_column: str) -> Column:
    """Each word w with its follower v, null after the last: the unigrams and bigrams of a text."""
    return F.arrays_zip(F.col(words_column).alias("w"), F.slice(words_column, F.lit(2), F.size(words_column)).alias("v"))


def _buckets(pair: str, buckets: int) -> Column:
    """The bucket of a word, and of the bigram that it begins unless the text ends there."""
    mask = F.lit(buckets - 1).cast("bigint")
    one = F.xxhash64(f"{pair}.w").bitwiseAND(mask).cast("int")
    two = F.xxhash64(F.lit(2), f"{pair}.w", f"{pair}.v").bitwiseAND(mask).cast("int")
    return F.when(F.col(f"{pair}.v").isNull(), F.array(one)).otherwise(F.array(one, two))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Up to ``rows`` documents that are labelled good and never toxic."""
    good = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .filter("q = 1 and t = 0")
    )
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")


def fit_log_ratios(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> DataFrame | None:
    """(bucket, micro): log p(trusted) - log p(corpus) in millionths; None without trusted n-grams.

    Corpus counts cover all rows. The table has a row per bucket that occurs,
    ``buckets`` at most however large the corpus is, so it can be broadcast.
    """
    flagged = documents.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("in_target"))), "doc_id", "left"
    )
    pairs = flagged.select("in_target", words(F.col("text")).alias("_words")).select(
        "in_target", F.explode(_pairs("_words")).alias("pair")
    )
    each = pairs.select("in_target", F.explode(_buckets("pair", buckets)).alias("bucket"))
    counts = cut(each.groupBy("bucket").agg(F.count("in_target").alias("t"), F.count(F.lit(1)).alias("r")))
    total = counts.agg(F.sum("t").alias("t"), F.sum("r").alias("r")).first()
    if not total["t"]:
        return None
    offset = math.log(total["r"] + smooth * buckets) - math.log(total["t"] + smooth * buckets)
    ratio = F.log(F.col("t") + smooth) - F.log(F.col("r") + smooth) + offset
    return counts.select("bucket", F.round(1e6 * ratio).cast("bigint").alias("micro"))


def quality_verdicts(
    documents: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """One row per distinct (doc_id, text) of ``documents`` with its counts and verdict.

    Columns: doc_id, text_hash (xxhash64 of the text), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, copies (equal rows), score,
    base_failed, kept. Null texts have no words and fail. ``base_failed``:
    fewer than 50 words, or more than half of the words in 3-word windows that
    repeat. ``kept``: not failed, and a score of at least ``threshold``;
    without trusted documents the score is null and the counting rules alone
    decide. A null doc_id is an id like any other. Other columns play no part;
    an empty table gives no row. ``buckets`` has to be a power of two.
    """
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("buckets has to be a power of two")
    ratios = fit_log_ratios(documents, trusted_ids(labels, trusted_rows), buckets)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counts = {
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": let(F.transform("_words", lambda w: F.xxhash64(w)), _covered_by_repeats),
    }
    keys = ["doc_id", "text_hash", *counts]
    counted = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("_words"))
    counted = counted.select("doc_id", "text_hash", *[c.alias(name) for name, c in counts.items()], "_words")
    if ratios is None:
        ratios = documents.sparkSession.createDataFrame([], "bucket int, micro bigint")
    # The n-grams of a text stand in one task, so that each sends one sum.
    summed = (
        counted.select(*keys, F.explode_outer(_pairs("_words")).alias("pair"))
        .select(*keys, F.explode(_buckets("pair", buckets)).alias("bucket"))
        .join(F.broadcast(ratios), "bucket", "left")
        .groupBy(*keys)
        .agg(F.sum("micro").alias("micro"), F.count(F.lit(1)).alias("ngrams"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    each = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return (
        summed.withColumn("copies", (F.col("ngrams") / each).cast("bigint"))
        .withColumn("score", F.col("micro") / (F.lit(1e6) * F.col("ngrams")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True)))
        .drop("micro", "ngrams")
    )


def quality_filter(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``documents`` whose verdict is to keep them, with all their columns, whatever these are named.

    Equal rows share their verdict: all stay or none. Null texts go.
    """
    kept = quality_verdicts(documents, labels, **settings).filter("kept")
    rows = documents.select(F.struct(*map(quoted, documents.columns)).alias("row"), F.xxhash64("text").alias("hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return rows.join(kept.select("doc_id", "text_hash"), same, "left_semi").select("row.*")
