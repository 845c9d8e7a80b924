"""Requests and their answers in a stream: a request without an answer comes out once its time is over.

Both sides carry a watermark, and an answer has to come within a fixed time, so
that Spark can drop what waits and name what stayed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.rtsp import CONNECTION

SIP_KEY = ["capture", "call_id", "branch", "cseq", "method"]


def split_by(messages: DataFrame, answers: Column, late: str) -> tuple[DataFrame, DataFrame]:
    """Requests and answers among messages (ts), both with the watermark of all of them: it goes on though nobody answers.

    The test names the time, as else it would be applied before the time is looked at.
    """
    rows = messages.withWatermark("ts", late)
    return tuple(rows.filter(F.when(F.col("ts").isNotNull(), test)) for test in (~answers, answers))


def answered(requests: DataFrame, answers: DataFrame, key: list[str], within: str) -> DataFrame:
    """Requests (key, asked_at) with the first answer (key, answered_at) to each within ``within``; null columns without one.

    Of requests and of answers with one key inside the watermark's delay the
    first counts, the others are its copies. Rows older than that behind the
    newest are dropped. A key with a null meets nothing.
    """
    asked, told = requests.dropDuplicatesWithinWatermark(key), answers.dropDuplicatesWithinWatermark(key)
    told = told.select(*[F.col(c).alias("_" + c) for c in key], *[c for c in told.columns if c not in key])
    equal = [F.col(c) == F.col("_" + c) for c in key]
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    condition = in_time
    for part in equal:
        condition = condition & part
    return asked.join(told, condition, "left_outer").drop(*["_" + c for c in key])


def _elapsed_ms() -> Column:
    return F.expr("(unix_micros(answered_at) - unix_micros(asked_at)) div 1000")


def live_rtsp_transactions(observed: DataFrame, within: str = "32 seconds", late: str = "10 seconds") -> DataFrame:
    """Transactions of RTSP messages in a stream (``rtsp.observed``), as ``rtsp.transactions`` has them.

    Requests without an answer in time have status 0. A request that is sent
    again with its CSeq keeps its first time; in a batch it would have its last.
    """
    rows = observed.filter("cseq is not null").withColumn("cseq", F.col("cseq").try_cast("bigint")).withColumn("ts", F.timestamp_micros("ts_us"))
    key = [*CONNECTION, "cseq"]
    requests, answers = split_by(rows, F.col("response"), late)
    asked = requests.select(*key, F.col("ts").alias("asked_at"), "method", "uri", F.col("number").alias("request_packet"))
    told = answers.select(*key, F.col("ts").alias("answered_at"), "status", "reason", F.col("number").alias("response_packet"), "session")
    return answered(asked, told, key, within).select(
        *key, "method", "uri", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("reason", F.lit("no response")).alias("reason"),
        F.coalesce(_elapsed_ms(), F.lit(0)).cast("bigint").alias("elapsed_ms"), "request_packet", "response_packet", "session", "asked_at",
    )


def live_sip_transactions(messages: DataFrame, within: str = "32 seconds", late: str = "10 seconds") -> DataFrame:
    """Transactions of SIP messages in a stream (``sip.messages``): the request's first packet and its first final answer, null without one in time."""
    rows = messages.withColumn("ts", F.timestamp_micros("ts_us"))
    requests, answers = split_by(rows.filter("status is null or status >= 200"), F.col("status").isNotNull(), late)
    asked = requests.select(*SIP_KEY, F.col("ts").alias("asked_at"), F.col("packet").alias("request_packet"), "source", "destination")
    told = answers.select(*SIP_KEY, F.col("ts").alias("answered_at"), F.col("status").alias("final_status"), F.col("packet").alias("response_packet"))
    return answered(asked, told, SIP_KEY, within).select(
        *SIP_KEY, "final_status", F.floor(_elapsed_ms()).alias("final_ms"), "request_packet", "response_packet", "source", "destination", "asked_at"
    )


def without_answer(transactions: DataFrame) -> DataFrame:
    """The transactions of either kind that nobody answered."""
    return transactions.filter("response_packet is null")
