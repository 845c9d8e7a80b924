"""Corpus operators against brute force on small tables with nulls, repeats, ties and clashing names."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import bpe, components, embedding_dedup, line_dedup, minhash, mixing, quality, substring_dedup, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, n string, key string, block string, kept string"


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, len(t or ""), "x", "y", "z", "b", "k") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_texts(seed, n=30, vocabulary=40):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(vocabulary)]
    base = [[random.choice(vocabulary) for _ in range(random.choice([0, 1, 2, 30, 80, 200]))] for _ in range(n)]
    for i in range(n // 2):
        copy = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            if copy:
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
        base.append(copy)
    base.append(["a"] * 400)
    base.append(["a"] * 300)
    texts = [random.choice([" ", "\n", " \t"]).join(w) for w in base]
    return texts + [None, "", " \n ", texts[0], texts[5]]


# Quality


def base_counts(text):
    words = words_of(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def spark_hash(*words, seed=42):
    value = seed
    for w in words:
        data = w.to_bytes(4, "little") if isinstance(w, int) else w.encode()
        value = xxhash.xxh64(data, seed=value).intdigest()
    return value


def test_quality_against_brute_force(spark):
    texts = some_texts(1) + ["junk!! " * 60 + " ".join(f"u{i}!!" for i in range(90)), "ä ö | # " + " ".join(f"ß{i}" for i in range(60))]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20)] + [(21, 1, 1), (22, 0, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    buckets = 1 << 8
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, labels, buckets).collect()}

    def grams(text):
        w = words_of(text)
        hashes = [spark_hash(x) for x in w] + [spark_hash(2, a, b) for a, b in zip(w, w[1:])]
        return [h & (buckets - 1) for h in hashes]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i < 20:
            target.update(grams(t))
    total_r, total_t = sum(raw.values()), sum(target.values())
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t)
        n, repeat = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        if g := grams(t):
            ratio = lambda b: math.log((target[b] + 1) / (total_t + buckets)) - math.log((raw[b] + 1) / (total_r + buckets))
            score = sum(map(ratio, g)) / len(g)
            assert r.score == pytest.approx(score, abs=1e-5)
            if abs(score - quality.THRESHOLD) > 1e-4:
                assert r.kept == (not r.base_failed and score >= quality.THRESHOLD)


def test_quality_of_empty_tables_and_repeated_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_verdicts(table(spark, []), labels).count() == 0
    good = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [good, good, "", None], ids=[1, 1, None, None])
    rows = quality.quality_verdicts(docs, labels).collect()
    assert sorted((r.doc_id or -1, r.copies, r.kept) for r in rows) == [(-1, 1, False), (-1, 1, False), (1, 2, True)]
    assert quality.quality_filter(docs, labels).count() == 2


# Substring dedup


def test_substrings_against_brute_force(spark):
    random.seed(5)
    texts = some_texts(2, vocabulary=3000)
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [f"{' '.join(random.choices('abcdefgh', k=9))} {passage} tail{i}" for i in range(12)] + ["x " * 49 + "y", passage[:40]]
    ids = random.sample(range(1000), len(texts))
    seen = {}
    for i, t in zip(ids, texts):
        w = words_of(t)
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            seen[k] = min(seen.get(k, i), i)
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, texts, ids)).collect()}
    for i, t in zip(ids, texts):
        w = words_of(t)
        gone = {s + k for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] < i for k in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (out[i].n_words, out[i].n_removed, out[i].kept_text) == (len(w), len(gone), kept)
        assert out[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_large_groups_give_the_same_result(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"r{i}x{k}" for k in range(20)) + " " + passage + f" end{i} " + " ".join(f"q{i}x{k}" for k in range(20)) for i in range(15)]
    usual = sorted(substring_dedup.substring_dedup(table(spark, texts)).collect())
    monkeypatch.setattr(substring_dedup, "GROUP", 2)
    assert sorted(substring_dedup.substring_dedup(table(spark, texts)).collect()) == usual
    assert [r.n_removed for r in usual] == [0] + [60] * 14


def test_substrings_without_rows_or_ids(spark):
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = substring_dedup.substring_dedup(table(spark, [text, text, text], ids=[None, 4, 9])).collect()
    assert {(r.doc_id, r.n_removed) for r in rows} == {(None, 0), (4, 0), (9, 60)}


# BPE and token counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def random_text(n):
    kinds = ["abcdefgh etaoinsr", "   \n\t\r", " 0123456789", "éüñ日本語😀ßıſ", "!!--==..,,''s't", "\x85\xa0\u2003\x1c"]
    return "".join(random.choice(random.choice(kinds)) for _ in range(n))


def test_encoding_equals_the_library(encoder, reference):
    random.seed(2)
    for i in range(1500):
        text = random_text(random.randint(0, 80))
        assert encoder.encode(text) == reference.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_appends_and_edits_near_the_change(encoder, reference):
    random.seed(3)
    for _ in range(300):
        raw = random_text(random.randint(1, 60)).encode()
        prefix = bpe.PrefixTable(encoder.vocabulary, raw[:7])
        prefix.append(raw[7:])
        assert list(prefix.tokens()) == reference._encode_single_piece(raw)
        a = random.randint(0, len(raw))
        b = random.randint(a, len(raw))
        prefix.replace(a, b, b"new")
        assert list(prefix.tokens()) == reference._encode_single_piece(raw[:a] + b"new" + raw[b:])
    long = bpe.PrefixTable(encoder.vocabulary, b"abcd " * 400)
    assert long.replace(10, 12, b"x") < 400


def test_documents_are_encoded_whole(spark, reference):
    texts = ["hello world", None, "", "x" * 30_000, "a b " * 5000]
    rows = bpe.encode_documents(table(spark, texts), RANKS, public_tokenizers.PATTERN, ["doc_id"], ids=True).collect()
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_length_table(spark):
    random.seed(4)
    lengths = [random.choice([0, 1, 5, 1023, 1024, 1025, 5000, random.randint(0, 9000)]) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    rows = token_counts.length_table(df).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        more = [x for x in lengths if x >= r.n_tokens]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(r.n_tokens), len(more), sum(more))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    assert token_counts.length_table(df.limit(0)).count() == 0


# MinHash


def shingles(text, width):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words_of(text)]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def closure(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width,block", [(2, 512), (5, 512), (2, 4)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    texts = some_texts(7, n=40, vocabulary=500) + ["One two THREE", "one TWO three", "lonely"]
    random.seed(8)
    base = [f"b{i}" for i in range(120)]
    for _ in range(25):  # a family of copies of copies
        base = list(base)
        base[random.randrange(len(base))] = f"c{random.random()}"
        texts.append(" ".join(base))
    ids = random.sample(range(5000), len(texts))
    sets = {i: shingles(t, width) for i, t in zip(ids, texts)}
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = closure(ids, linked)
    out = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts, ids), width, 80).collect()}
    assert {i: r.component_id for i, r in out.items()} == expected
    assert all(r.n_shingles == len(sets[i]) and r.kept == (expected[i] == i) for i, r in out.items())


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    rows = minhash.near_duplicates(table(spark, ["a b", "a b", None], ids=[None, 3, 4])).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in rows) == [(-1, True), (3, True), (4, True)]


def test_estimates_are_corrected_for_chance(spark):
    random.seed(1)
    pool = np.array([random.getrandbits(63) for _ in range(3000)], np.uint64)
    one, two = np.sort(pool[:2000]), np.sort(pool[500:2500])  # similarity 0.6
    three = np.sort(np.array([random.getrandbits(63) for _ in range(2000)], np.uint64))
    packed, _ = minhash.signatures(np.concatenate([one, two, three]), np.array([0, 2000, 4000]))
    row = spark.createDataFrame([tuple(x.tolist() for x in packed)], "a array<long>, b array<long>, c array<long>")
    r = row.select(minhash.estimate(F.col("a"), F.col("b")).alias("ab"), minhash.estimate(F.col("a"), F.col("c")).alias("ac"), minhash.estimate(F.col("a"), F.col("a")).alias("aa")).first()
    assert r.aa == 1 and abs(r.ab - 0.6) < 0.15 and abs(r.ac) < 0.15


def test_components(spark):
    random.seed(9)
    links = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101), (7, 7)] + [(random.randint(200, 300), random.randint(200, 300)) for _ in range(70)]
    ids = {x for p in links if p[0] != p[1] for x in p}
    expected = closure(ids, [p for p in links if p[0] != p[1]])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component_id for r in got} == expected


# Mixing


def test_frames_deviate_by_less_than_a_block():
    random.seed(6)
    for _ in range(60):
        sources = [f"s{i}" for i in range(random.randint(1, 12))]
        places = mixing.shares(sources, {s: random.random() ** 3 for s in sources[: random.randint(0, len(sources))]}, random.choice([12, 50, 333]))
        order = mixing.frame_order(places)
        frame, taken = len(order), collections.Counter()
        assert frame == sum(places.values())
        for t, (source, block) in enumerate(order, 1):
            assert block == taken[source]
            taken[source] += 1
            assert all(abs(taken[s] * frame - q * t) < frame for s, q in places.items())


def test_mixing_keeps_every_row(spark):
    sources = ["a"] * 90 + ["b"] * 20 + [None] * 7 + [""] * 3
    docs = table(spark, ["t"] * 120, ids=[None, *range(1, 119), 118], sources=sources)
    rows = mixing.mix(docs, {"a": 0.5}, block_docs=2, frame=20).collect()
    assert len(rows) == 120 and len({(r.slot, r.offset) for r in rows}) == 120
    first = [r.source for r in sorted(rows, key=lambda r: (r.slot, r.offset))[:20]]
    assert 8 <= first.count("a") <= 12
    assert mixing.mix(table(spark, []), {}).count() == 0
    assert mixing.mixed(docs, {}).columns == docs.columns
    assert {(r.block, r.start) for r in mixing.mixed(docs, {}).collect()} == {("b", "x")}


def test_mixing_leaves_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_DOCS", 3)
    monkeypatch.setattr(mixing, "FAR_GROUPS", 2)
    taken = ["_k", "k", "digest", "_digest", "group", "_group", "row", "id", "index", "number", "place", "far", "n", "late", "q", "start", "a.b", "slot"]
    docs = table(spark, ["t"] * 50, sources=["a"] * 30 + ["b"] * 20).select("doc_id", "source", *[F.lit(f"own {n}").alias(n) for n in taken])
    rows = mixing.mix(docs, {"a": 0.5}, block_docs=2)
    assert rows.columns == [*[n for n in docs.columns if n != "slot"], "block", "slot", "offset"]
    for r in rows.collect():
        assert all(r[n] == f"own {n}" for n in taken if n != "slot")
    for source, n in (("a", 30), ("b", 20)):
        order = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.block * 2 + r.offset) for r in rows.collect() if r.source == source)
        assert [i for _, i in order] == list(range(n))
    assert [r.slot for r in mixing.mixed(docs, {}).collect()] == ["own slot"] * 50


# Lines


def test_chunks_repeat_across_documents_only_once(spark):
    passage = [f"line {i} of a license" for i in range(30)]
    texts = ["\n".join([f"own {i}", *passage, f"end {i}"]) for i in range(5)] + [None, "", "\n\n\n", "single"] * 2
    out = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert len(out) == len(texts)
    assert out[0].text == texts[0] and out[5].text is None and out[7].text == "\n\n\n"
    for i in range(1, 5):
        left = out[i].text.split("\n")
        assert left[0] == f"own {i}" and left[-1] == f"end {i}" and len(left) < 20 and out[i].n_removed > 0
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


# Vectors


def test_vectors_against_all_pairs(spark):
    random.seed(3)
    rng = np.random.default_rng(3)
    vectors, labels = [], []
    for i in range(150):
        v = rng.normal(size=8) if i % 3 == 0 or not vectors else vectors[rng.integers(len(vectors))] + rng.normal(size=8) * 0.12
        vectors.append(v)
        labels.append(int(rng.integers(2)))
    rows = [(i, [float(x) for x in v], l, "x") for i, (v, l) in enumerate(zip(vectors, labels))]
    rows += [(900, None, 1, "x"), (901, [0.0] * 8, 1, "x"), (902, [float("nan")] * 8, 1, "x"), (903, [1.0, None], 1, "x"), (904, rows[0][1], None, "x"), (905, [], 1, "x"), (906, [1.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string")
    clean = {r.vec_id: (np.array(r.embedding, np.float64), r.label) for r in df.collect() if r.vec_id < 900}
    linked = [(a, b) for a in clean for b in clean if a < b and clean[a][1] == clean[b][1] and clean[a][0] @ clean[b][0] / np.linalg.norm(clean[a][0]) / np.linalg.norm(clean[b][0]) >= 0.98]
    expected = closure([r[0] for r in rows], linked)
    degree = collections.Counter(x for p in linked for x in p)
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert linked and {i: (r.n_links, r.component_id, r.kept) for i, r in out.items()} == {i: (degree[i], c, c == i) for i, c in expected.items()}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_intervals_skip_nothing_near():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(x.T[::-1])]
    i, j = embedding_dedup.join_intervals(x, x, x, x, 0.2, 0.98, True)
    brute = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert set(zip(i.tolist(), j.tolist())) == set(map(tuple, brute.tolist()))


# Urls


def test_urls_against_brute_force(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = ["http://A.Example.ORG/en/12?x", "https://example.org/es/", "https://xexample.org/es/1", "ftp://com/de/", "https://a.com/de", "http://b.com?/de/", "nothing", "", None, "http://É.org/a#b", "x://org", "http://example.org/es/", "http://a\nb.org/", "http://example.org:80/es/"] * 2
    rows = url_filter.url_verdicts(spark.createDataFrame([(i % 14, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string"), rules).collect()
    assert len(rows) == len(urls)

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fit = [(len(r), r, v) for v, r in rules for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id])
