"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t-\r]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text; an empty array where it is null or has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(name: str) -> str:
    """A column's name as it may stand in an expression."""
    return "`" + name.replace("`", "``") + "`"


#: Makes Spark delete a query's shuffle files when the query ends, instead of when the driver's memory is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is the one in ``spark.checkpoint.dir``. Where there is none, a
    temporary one is set if Spark runs on this machine alone; on a cluster that
    is an error. The shuffle files that made ``df`` are deleted once it is
    written, as nothing reads them again. Spark deletes a checkpoint once nothing
    refers to it if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
