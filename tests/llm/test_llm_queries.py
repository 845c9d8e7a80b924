"""The registered corpus queries against their SQL on the smallest tables."""

import hashlib

import duckdb
import pytest

from tracewell.llm.queries import ORACLES, PATTERN, QUERIES, RANKS

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_corpus_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    got = sql.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    assert rows == sorted(tuple(str(dict(zip(columns, r))[c]) for c in names) for r in got.fetchall())


def library():
    import base64

    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_encoding_query_against_the_library(spark):
    encode, digest = library(), lambda data: hashlib.sha256(data).hexdigest()
    want = {}
    for doc_id, text in texts(spark):
        ids = encode(text)
        want[doc_id] = (len(ids), digest(" ".join(map(str, ids)).encode()), digest(text.encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe_round_trip"](spark, DATA).collect()} == want


def test_token_count_query_against_the_library(spark):
    encode = library()
    lengths = sorted(len(encode(text)) for _, text in texts(spark))
    got = {r.n_tokens: r for r in QUERIES["op7_token_counts"](spark, DATA).collect()}
    assert got.keys() == set(lengths)
    for n, r in got.items():
        longer = [x for x in lengths if x >= n]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.total_docs, r.total_tokens) == (lengths.count(n), len(longer), sum(longer), len(lengths), sum(lengths))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and abs(r["quantile"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
