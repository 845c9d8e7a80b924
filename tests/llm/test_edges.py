"""Edge cases of the corpus operators: long texts, clashing names, repeated rows, ties, odd settings."""


import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, common, embedding_dedup, minhash, quality, substring_dedup, url_filter
from tracewell.llm.queries import PATTERN, RANKS

LONG = " ".join(f"w{i}" for i in range(60_000))
CLASHES = ["_id", "_hash", "id", "row", "hash", "text_hash", "text_key", "kept", "start", "n", "key", "group", "runs", "band", "component", "_words", "bucket", "n_words", "a.b"]


def wide(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def test_quality_filter_leaves_columns_of_any_name(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    good = " ".join(f"w{i}" for i in range(80))
    docs = wide(spark, [(1, good), (1, good), (2, good + " x"), (3, "short"), (4, None), (5, LONG), (None, good)])
    out = quality.quality_filter(docs, labels, threshold=-99.0)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 2, 5]
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    verdicts = {(r.doc_id, r.n_words): r.copies for r in quality.quality_verdicts(docs, labels).collect()}
    assert verdicts[5, 60_000] == 1 and verdicts[1, 80] == 2
    with pytest.raises(ValueError):
        quality.quality_verdicts(docs, labels, buckets=1000)


def test_very_long_texts_and_clashing_names_in_dedup(spark):
    docs = wide(spark, [(1, LONG), (2, "head " + LONG + " tail"), (3, "head tail")])
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    assert found == {1: (60_000, 0, LONG), 2: (60_002, 60_000, "head tail"), 3: (2, 0, "head tail")}
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3}


def test_encoding_replaces_only_its_own_columns(spark):
    docs = wide(spark, [(1, "a b"), (1, "a b"), (None, None)]).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("x"))
    out = bpe.encode_documents(docs, RANKS, PATTERN, ["doc_id", "ids", "n_tokens", "a.b"], ids=True)
    assert out.columns == ["doc_id", "a.b", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted((r.doc_id or 0, r.n_tokens, r["a.b"]) for r in out.collect()) == [(0, 0, "own a.b"), (1, 2, "own a.b"), (1, 2, "own a.b")]
    assert bpe.encode_documents(docs.limit(0), RANKS, PATTERN, ["doc_id"]).count() == 0
    assert sorted(r.n_tokens for r in bpe.token_counts(docs, RANKS, PATTERN).collect()) == [0, 2, 2]


def test_vectors_at_the_limit_and_repeated_ids(spark):
    at, below = [0.98, (1 - 0.98**2) ** 0.5], [0.979, (1 - 0.979**2) ** 0.5]
    rows = [(1, [1.0, 0.0], 1), (2, at, 1), (3, below, 1), (4, [1.0, 0.0], 2), (9, [0.0, 1.0], 1), (9, [0.0, 1.0], 1)]
    out = {(r.vec_id): (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out[4] == (0, 4) and out[1][0] == 1 and out[2] == (2, 1) and out[3] == (1, 1) and out[9] == (2, 9)
    odd = [(1, [5e-324, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1e300, 1e290], 1), (4, [0.0, 1e308], 1)]
    out = embedding_dedup.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_urls_with_odd_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "r"), (2, None, "r")], "page_id long, url string, verdict string")
    both = url_filter.url_verdicts(pages, [("block", "org/x"), ("allow", "org/x"), ("block", "org/"), ("block", "org/")]).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in both) == [(1, "org/x", "allow"), (2, None, "allow")]
    none = url_filter.url_verdicts(pages, [], default="block").collect()
    assert {(r.page_id, r.host, r.rule, r.verdict) for r in none} == {(1, "a.org", None, "block"), (2, "", None, "block")}
    many = [("block", f"h{i}.org/{'p' * (i % 40)}") for i in range(3000)] + [("allow", "a.org/")]
    assert {r.rule for r in url_filter.url_verdicts(pages, many).collect()} == {"a.org/", None}
    long = spark.createDataFrame([(3, "http://a.org/" + "y/" * 50_000)], "page_id long, url string")
    row = url_filter.url_verdicts(long, many).first()
    assert (row.rule, len(row.path)) == ("a.org/", 100_001)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda name, default: default)

    class Session:
        sparkContext, conf = Context, Conf

    class Frame:
        sparkSession = Session

    with pytest.raises(ValueError):
        common.cut(Frame)
