"""Source divergence against a plain computation with whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def expected(rows, min_docs, top):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {key[0] for key in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for each, s in counts if each == lang]

        def shares(many):
            n = Counter()
            for s in many:
                n += Counter({t: counts[lang, s][t] for t in kept})
            total = sum(n.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // total for t in kept}

        own, whole = {s: shares([s]) for s in sources}, shares(sources)
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(whole[t] - own[s][t], t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(items, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(None, t, lang, s, "x", 7) for t, lang, s in rows], "doc_id long, text string, lang string, source string, term string, n int")


def corpus():
    random.seed(11)
    words = ["Alpha", "alpha", "ÄÖ", "äö", "x", "don't", "é1é", "漢字", "🙂", "I_I", "ZZ[z", "ſ", "İ", "a\x00b", " q", "end."]
    rows = [(random.choice([" ", "\n", ""]).join(random.choices(words, k=random.choice([0, 1, 3, 40]))), random.choice(["en", "de", ""]), random.choice(["s1", "s2", "é", "Z", ""])) for _ in range(400)]
    return rows + [(None, None, None), ("", "xx", "a"), ("alpha", "xx", "b"), (None, "yy", "only"), (None, "en", "silent"), ("alpha " * 30_000, "en", "s1")] + [("copy of one", "en", "s2")] * 40


@pytest.mark.parametrize("min_docs,top,places,chunk", [(30, 50, 1 << 18, 1 << 22), (1, 3, 40, 100), (400, 50, 1 << 18, 1 << 22)])
def test_against_plain_counts(spark, monkeypatch, min_docs, top, places, chunk):
    monkeypatch.setattr(divergence, "PLACES", places)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = corpus()
    docs = table(spark, rows).repartition(5)
    if chunk == 100:  # workers don't see what is patched here
        batches = [pa.RecordBatch.from_pylist([{"text": t, "lang": a, "source": s} for t, a, s in rows])]
        whole = [divergence._count(b) for b in batches]
        parts = list(divergence._chunks(iter(batches)))
        sums = [Counter() for _ in range(2)]
        for into, some in zip(sums, (whole, parts)):
            for b in some:
                for r in b.to_pylist():
                    into[r["lang"], r["source"], r["term"], "n"] += r["n"]
                    into[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        assert sums[0] == sums[1] and len(parts) > 50
    out = divergence.source_divergence(docs, min_docs, top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == expected(rows, min_docs, top)


def test_a_broken_hash_joins_nothing():
    text = "aa bb aa cc b bb aaa cc b".encode()
    data = np.frombuffer(text, np.uint8)
    begins, ends, _ = divergence.find_terms(data, np.array([0]))
    groups, firsts = divergence.group_slices(data, begins, ends, lambda slice: 7)
    seen = {}
    for g, b, e in zip(groups.tolist(), begins.tolist(), ends.tolist()):
        assert seen.setdefault(g, text[b:e]) == text[b:e] == text[begins[firsts[g]] : ends[firsts[g]]]
    assert len(seen) == 5


def test_shares_of_large_counts():
    for count, total in [(0, 7), (10**15, 10**15 + 10), (123456789012345, 987654321098765), (2, 7)]:
        assert divergence.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 5) // total


def test_languages_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_LANGS", 1)
    rows = corpus()[:150]
    assert sorted(tuple(r) for r in divergence.source_divergence(table(spark, rows), 5).collect()) == expected(rows, 5, 50)


def test_empty_table(spark):
    assert divergence.source_divergence(table(spark, corpus()).limit(0)).count() == 0
