"""Corpus preparation: each stage's Parquet output is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.bpe import encode_documents
from tracewell.llm.common import cut, quoted, read
from tracewell.llm.line_dedup import passage_dedup
from tracewell.llm.minhash import near_groups, text_key
from tracewell.llm.mixing import mix
from tracewell.llm.quality import quality_filter
from tracewell.llm.queries import PATTERN, RANKS, WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null, empty and short texts fail; equal rows stay or go together; rows
    without a doc_id are judged like others. Texts are judged whole. An empty
    table stays empty. Columns stay as they are, whatever their names.
    """
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without passages of two or more lines that stand in an earlier one; n_chars follows.

    Chunks of lines, ended by a rolling hash over line hashes as in op8, are
    compared byte by byte first, then neighbouring lines outside repeated chunks.
    Of equal passages that of the smallest (doc_id, text hash, line) stays.
    Null texts stay null and have a null n_chars; rows without a doc_id stay as
    they are; repeated rows are one document. An empty table stays empty. A
    column n_removed of the table is left out of the comparison and kept.
    """
    row = F.struct(*map(quoted, docs.columns)).alias("row")
    cleaned = passage_dedup(docs.select("doc_id", "text", row))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return cleaned.select(*[new.get(n, F.col(f"row.{quoted(n)}")).alias(n) for n in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, of equal rows with one id only one.

    Rows without a doc_id, which can't be told apart, all stay. Texts without
    words are no copies of each other; of each doc_id, one of each such text
    stays. Of rows with one doc_id and one text, the one whose other columns
    come first stays. An empty table stays empty; columns stay as they are.
    """
    alone = F.col("group_id").isNull()
    kept = (
        near_groups(docs.select("doc_id", "text"))
        .filter("doc_id is not null")
        .groupBy("group_id", F.when(alone, F.col("doc_id")).alias("_doc"), F.when(alone, F.col("text_key")).alias("_key"))
        .agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
        .select("least.*")
    )
    row = F.struct(*map(quoted, docs.columns)).alias("row")
    others = [F.col(f"row.{quoted(n)}") for n in docs.columns if n not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", "text_key").orderBy(*(others or [F.lit(0)]))
    with_id = (
        docs.filter("doc_id is not null")
        .select(row, "doc_id", text_key())
        .join(kept, ["doc_id", "text_key"], "left_semi")
        .withColumn("number", F.row_number().over(first))
        .filter("number = 1")
    )
    return with_id.select("row.*").unionByName(docs.filter("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture in its order, with their places: slot and in_block.

    The mixture ends at the first place that a source named in the weights can't
    fill; documents with a later place are left out. Up to there each source has
    its share to within one block, but for other sources that ran out before. A
    null source is a source; texts play no part; repeated rows and rows without
    a doc_id each have a place. An empty table stays empty. Columns named slot
    and in_block are replaced, others stay.
    """
    names = ("__mixture_block", "slot", "in_block")
    return mix(docs, WEIGHTS, filled=True, names=names).drop(names[0]).orderBy("slot", "in_block")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its place and digests of the ids and of what they decode to.

    Null and empty texts have no tokens; every row is encoded whole and for
    itself. Rows are told apart and ordered by slot and in_block. An empty table
    stays empty; columns other than those returned are left out.
    """
    return encode_documents(docs, RANKS, PATTERN, ["doc_id", "lang", "source", "slot", "in_block"], ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near),
    ("source mixing", mixture),
    ("byte-level BPE", encoded),
]
#: SQL can't express the hashed quality model, MinHash candidates and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; between them checkpoints stand for the files, as stages read their input several times."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs
