"""The pipeline and each of its stages against the same steps written out in Python."""

import collections
import hashlib
import math
import re
from fractions import Fraction

import pytest
import tiktoken.load
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import base_counts, closure, shingles, spark_hash, words_of
from tracewell.llm import quality
from tracewell.llm.queries import PATTERN, RANKS, WEIGHTS

DATA = "/root/testdata/sf0.01"
OWN = ["row", "id", "hash", "of", "key", "number", "group_id", "text_key", "removed", "n_removed", "block", "a.b", "_doc", "least"]
LONG = " ".join(f"w{i}" for i in range(40_000))


def brute_quality(docs, labels):
    trusted = {i for i, q, t in labels}
    good = {i for i in trusted if all(q == 1 and not t for j, q, t in labels if j == i)}
    buckets = quality.BUCKETS

    def grams(text):
        w = words_of(text)
        return [spark_hash(x) & (buckets - 1) for x in w] + [spark_hash(2, a, b) & (buckets - 1) for a, b in zip(w, w[1:])]

    each = [grams(d["text"]) for d in docs]
    raw, target = collections.Counter(), collections.Counter()
    for d, g in zip(docs, each):
        raw.update(g)
        if d["doc_id"] in good:
            target.update(g)
    total_r, total_t = sum(raw.values()), sum(target.values())
    out = []
    for d, g in zip(docs, each):
        n, *_, repeat = base_counts(d["text"])
        ratio = lambda b: math.log((target[b] + 1) / (total_t + buckets)) - math.log((raw[b] + 1) / (total_r + buckets))
        if n >= 50 and 100 * repeat <= 50 * n and (not total_t or sum(map(ratio, g)) / len(g) >= quality.THRESHOLD):
            out.append(d)
    return out


def brute_lines(docs):
    first, found = {}, []
    for d in sorted((d for d in docs if d["doc_id"] is not None), key=lambda d: d["doc_id"]):
        lines = (d["text"] or "").split("\n")
        at = [i for i, x in enumerate(lines) if re.search(r"[^ \t-\r]", x)]
        for a, b in zip(at, at[1:]):
            place = (d["doc_id"], d["text"], a)
            key = tuple(lines[a : b + 1])
            if first.setdefault(key, place) != place:
                found.append((d["doc_id"], a, b))
    gone = collections.defaultdict(set)
    for i, a, b in found:
        gone[i] |= set(range(a, b + 1))
    out = []
    for d in docs:
        text = d["text"]
        if gone[d["doc_id"]]:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[d["doc_id"]])
        out.append({**d, "text": text, "n_chars": None if text is None else len(text)})
    return out


def brute_near(docs):
    sets = {d["doc_id"]: shingles(d["text"], 5) for d in docs}
    ids = sorted(sets)
    linked = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= 80 * large and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked.append((a, b))
    root = closure(ids, linked)
    return [d for d in docs if root[d["doc_id"]] == d["doc_id"]]


def brute_mixture(docs, block=16):
    name = lambda d: "n" if d["source"] is None else "s" + d["source"]
    queues = collections.defaultdict(list)
    for d in sorted(docs, key=lambda d: (hashlib.md5(str(d["doc_id"]).encode()).hexdigest(), d["doc_id"])):
        queues[name(d)].append(d)
    given = {"s" + s: Fraction(str(w)) for s, w in WEIGHTS.items() if "s" + s in queues}
    rest = (1 - sum(given.values())) / max(len(queues) - len(given), 1)
    weight = {s: given.get(s, rest) for s in queues}
    weight = {s: w / sum(weight.values()) for s, w in weight.items()}
    taken, out = collections.Counter(), []
    for slot in range(10**6):
        ready = [s for s in queues if math.floor(taken[s] / weight[s]) <= slot]
        s = min(ready, key=lambda s: (math.ceil((taken[s] + 1) / weight[s]), s))
        j = taken[s]
        taken[s] += 1
        if s in given and (j + 1) * block > len(queues[s]) or not given and slot > len(docs):
            break
        out += [{**d, "slot": slot, "in_block": i} for i, d in enumerate(queues[s][j * block : (j + 1) * block])]
    return out


def brute_encoded(docs):
    ranks = tiktoken.load.load_tiktoken_bpe(RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [{**d, "ids": library.encode_ordinary(d["text"] or "")} for d in docs]


def rows_of(df, names=None):
    names = names or df.columns
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def test_the_pipeline_gives_the_rows_of_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = [r.asDict() for r in docs.collect()]
    sizes = [len(want)]
    steps = [lambda d: brute_quality(d, labels), brute_lines, brute_near, brute_mixture, brute_encoded]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        docs, want = stage(spark, docs, DATA).persist(), step(want)
        names = [n for n in docs.columns if n in want[0]]
        assert set(want[0]) <= {*docs.columns, "text", "n_chars"}, name
        assert rows_of(docs, names) == sorted(tuple(str(r[n]) for n in names) for r in want), name
        sizes.append(len(want))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[3] > sizes[4] > 0
    last = [(r.slot, r.in_block) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(last) == sorted((r["slot"], r["in_block"]) for r in want)


ROWS = [
    (1, LONG, "src0"), (1, LONG, "src0"), (2, "", "src1"), (3, None, None), (None, "no id\nat all", "src0"), (None, "no id\nat all", "src0"),
    (4, LONG + " and more", "src1"), (5, "a\nb\nc", "x"), (6, "a\nb\nc", ""), (7, "x\na\nb", "src2"), (7, "a\nb\ny", "src2"), (8, "   \n\t\n", "x"),
]


def odd_documents(spark):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in OWN]).repartition(3)


EXPECTED = {
    "quality rules": [(1, 40_000), (1, 40_000), (4, 40_002)],
    "line dedup": [(None, 4), (None, 4), (1, 40_000), (1, 40_000), (2, 0), (3, 0), (4, 40_002), (5, 3), (6, 0), (7, 1), (7, 1), (8, 0)],
    "minhash near-dedup": [(None, 4), (None, 4), (1, 40_000), (2, 0), (3, 0), (5, 3), (7, 3), (7, 3), (8, 0)],
}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:3])
def test_stages_on_odd_rows(spark, name, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns
    rows = out.collect()
    found = sorted(((r.doc_id, len(words_of(r.text))) for r in rows), key=lambda x: (x[0] or 0, x[1]))
    assert found == EXPECTED[name]
    assert all(r[n] == f"own {n}" for r in rows for n in OWN)
    assert all(r.n_chars == (None if r.text is None and name == "line dedup" else len(r.text or "")) for r in rows)


def test_mixture_and_encoding_on_odd_rows(spark):
    docs = odd_documents(spark)
    many = docs.withColumn("source", F.coalesce("source", F.lit("other")))
    for _ in range(5):
        many = many.unionByName(many)
    out = corpus_pipeline.mixture(spark, many, DATA)
    assert out.columns == [*docs.columns, "slot", "in_block"]
    rows = out.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in OWN)
    places = [(r.slot, r.in_block) for r in rows]
    assert places == sorted(set(places))
    tokens = corpus_pipeline.encoded(spark, out, DATA)
    assert tokens.columns == ["doc_id", "lang", "source", "slot", "in_block", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(r.n_tokens == len(r.ids) for r in tokens.collect()) and tokens.count() == len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    docs = odd_documents(spark).limit(0).withColumn("slot", F.lit(1).cast("bigint")).withColumn("in_block", F.lit(1).cast("bigint"))
    assert stage(spark, docs, DATA).count() == 0
