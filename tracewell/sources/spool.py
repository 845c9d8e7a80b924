"""RTP packets kept between two passes, as Parquet by capture, so that the second reads only the flows it wants."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_spool(rtp: DataFrame, folder: str, buckets: int = 64) -> None:
    """Packets dealt by flow into ``buckets`` folders, sorted by flow and arrival inside files."""
    flow = [c for c in ("capture", "interface", "src_ip", "src_port", "dst_ip", "dst_port", "connection", "channel", "ssrc") if c in rtp.columns]
    dealt = rtp.withColumn("bucket", F.pmod(F.xxhash64(*flow), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("bucket", *flow, "number").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_spool(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("bucket")


def spooled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet to the folder in ``spark.checkpoint.dir`` and read again.

    Cuts the plan between passes over the same rows: each pass reads only its
    columns, and a lost executor costs a task. Off one machine the setting is
    required. The files stay until the folder is cleared.
    """
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spool-")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
