"""Corpus operators and pipeline stages on the cases of the first review."""

import collections
import random
from fractions import Fraction

import pytest

import corpus_pipeline
from tests.llm.test_operators import table
from tracewell.llm import line_dedup, minhash, mixing, substring_dedup


# Lines


def test_short_passages_leave_later_documents(spark):
    random.seed(11)
    texts, n = [], 0
    for size in [2, 2, 2, 3, 3, 4, 5, 8] * 3:
        passage = "\n".join(f"passage {n} line {k}" + "\n" * (k % 3 == 1 and k + 1 < size) for k in range(size))
        n += 1
        for _ in range(2):
            n += 1
            texts.append(f"own {n}\n{passage}\nend {n}")
    texts += ["x", None, "", "\n", "same\nline\nsame\nline\nother", "one line\nhere", "one line\nthere"]
    docs = table(spark, texts)
    out = {r.doc_id: r for r in line_dedup.passage_dedup(docs).collect()}
    for i in range(0, 48, 2):
        assert out[i].text == texts[i]
        lines = texts[i + 1].split("\n")
        assert out[i + 1].text.split("\n") == [lines[0], lines[-1]]
    assert [out[i].text for i in range(48, 55)] == [*texts[48:52], "same\nline\nother", *texts[53:55]]
    stage = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert {i: (r.text, r.n_chars) for i, r in stage.items()} == {i: (r.text, None if r.text is None else len(r.text)) for i, r in out.items()}


def test_passages_of_one_id_with_two_texts(spark):
    rows = line_dedup.passage_dedup(table(spark, ["p\nq\nr", "u\nv\np\nq", "u\nv\np\nq", "p\nq"], ids=[1, 2, 2, None])).collect()
    twice = sorted((r.doc_id or 0, r.text) for r in rows)
    assert twice == [(0, "p\nq"), (1, "p\nq\nr"), (2, "u\nv"), (2, "u\nv")]
    rows = line_dedup.passage_dedup(table(spark, ["a\nb\nc\nd", "x\ny\nz\na\nb"], ids=[5, 5])).collect()
    assert sum(r.n_removed for r in rows) == 2 and sorted(len(r.text.split("\n")) for r in rows) in ([2, 5], [3, 4])


# Mixing


@pytest.mark.parametrize("n", [3, 20, 200, 500])
def test_shares_keep_to_the_given_weights(n):
    sources = [f"s{i}" for i in range(n)]
    given = {"s0": 0.15, "s1": 0.1, "s2": 0.08}
    if n == 20:
        given["s3"] = 0
    places = mixing.shares(sources, given)
    order = mixing.frame_order(places)
    rest = (1 - Fraction(33, 100)) / max(n - len(given), 1)
    weight = {s: Fraction(str(given[s])) if s in given else rest for s in sources}
    total = sum(weight.values())
    taken = collections.Counter()
    blocks = order * 3 if n <= 20 else order[:3000]
    for t, (source, _) in enumerate(blocks, 1):
        taken[source] += 1
        assert all(abs(taken[s] - weight[s] / total * t) < 1 for s in (*sources[:4], source) if s in weight)


def test_rounded_weights_and_weights_of_nothing():
    places = mixing.shares(["a", "b", "c"], {"a": 0.123456789, "b": 1e-5, "c": 0.3})
    total = 0.123456789 + 1e-5 + 0.3
    assert places["b"] > 0 and abs(places["a"] / sum(places.values()) - 0.123456789 / total) < 1e-5
    assert mixing.shares(["a", "b", "c"], {"a": 1 / 3, "b": 0.5}) == {"a": 2, "b": 3, "c": 1}
    assert mixing.shares(["a", "b"], {"a": 1, "b": 0}) == {"a": 1, "b": 0}
    assert mixing.shares(["a"], {"a": 0}) == {"a": 0}


def test_sources_of_weight_0_take_what_is_left_over(spark):
    docs = table(spark, ["t"] * 26, sources=["a"] * 12 + ["z"] * 7 + ["y"] * 7)
    rows = sorted((r.slot, r.offset, r.source) for r in mixing.mix(docs, {"a": 1, "z": 0, "y": 0}, block_docs=2).collect())
    assert [s for _, _, s in rows] == ["a"] * 12 + ["y", "y", "z", "z"] * 3 + ["y", "z"]
    assert len({r[:2] for r in rows}) == 26


def test_large_patterns_are_not_in_the_plan(spark, monkeypatch):
    docs = table(spark, ["t"] * 60, sources=["a"] * 30 + ["b"] * 30)
    usual = sorted((r.doc_id, r.slot, r.offset) for r in mixing.mix(docs, {"a": 0.3}, block_docs=2).collect())
    monkeypatch.setattr(mixing, "IN_PLAN", 3)
    assert sorted((r.doc_id, r.slot, r.offset) for r in mixing.mix(docs, {"a": 0.3}, block_docs=2).collect()) == usual


# One id with two texts


def test_substrings_of_one_id_with_two_texts(spark):
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    shared, other = run("p", 60), run("q", 70)
    texts = [f"{run('a', 9)} {shared} {run('b', 9)}", f"{run('c', 300)} {shared} {run('d', 40)}", f"{run('e', 55)}", f"{other} {run('f', 5)}", f"{run('g', 90)} {other}"]
    rows = substring_dedup.substring_dedup(table(spark, texts, ids=[1, 2, 2, 2, 3])).collect()
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in rows)
    assert found == [(1, 78, 0), (2, 55, 0), (2, 75, 0), (2, 400, 60), (3, 160, 70)]
    assert {r.kept_text for r in rows if r.n_removed} == {f"{run('c', 300)} {run('d', 40)}", run("g", 90)}


def test_near_duplicates_of_one_id_with_two_texts(spark):
    run = lambda name: " ".join(f"{name}{i}" for i in range(100))
    texts = [run("a"), run("a") + " x", run("b"), run("b") + " y", run("c"), run("b"), run("c") + " z"]
    ids = [3, 5, 5, 7, 5, 9, 4]
    rows = minhash.near_duplicates(table(spark, texts, ids), 2, 80).collect()
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert found == [(3, 99, 3, True), (4, 100, 4, True), (5, 99, 4, False), (5, 99, 5, True), (5, 100, 3, False), (7, 100, 5, False), (9, 99, 5, False)]


# The pipeline's stages


def test_the_mixture_decides_which_documents_stay(spark):
    counts = {"src0": 900, "src1": 200, "src2": 500, "other": 1600, "few": 500, None: 600}
    sources = [s for s, n in counts.items() for _ in range(n)]
    docs = table(spark, ["t"] * len(sources), sources=sources).drop("block")
    out = corpus_pipeline.mixture(spark, docs, "").collect()
    found = collections.Counter(r.source for r in out)
    total = (max(r.slot for r in out) + 1) * 16
    assert {"slot", "in_block"} <= set(out[0].asDict()) and len({(r.slot, r.in_block) for r in out}) == len(out)
    assert [(r.slot, r.in_block) for r in out] == sorted((r.slot, r.in_block) for r in out)
    assert 192 <= found["src1"] <= 200 and len(out) == total
    assert all(abs(found[s] - w * total) < 16 for s, w in corpus_pipeline.WEIGHTS.items())
    assert all(abs(found[s] - 0.67 / 3 * total) < 16 for s in ("other", "few", None))
    assert corpus_pipeline.mixture(spark, docs.filter("source = 'other'"), "").count() == 1600
    tokens = corpus_pipeline.encoded(spark, corpus_pipeline.mixture(spark, docs, ""), "")
    assert {"slot", "in_block"} <= set(tokens.columns)


def test_one_row_of_each_group_of_near_copies_stays(spark):
    run = lambda name: " ".join(f"{name}{i}" for i in range(100))
    texts = [run("a"), run("a"), run("a") + " x", run("a") + " x", run("b"), run("a"), run("a"), None, "", "", run("c"), run("c") + " z"]
    ids = [1, 1, 1, 2, 2, None, None, None, 4, 4, 6, 7]
    docs = table(spark, texts, ids)
    out = corpus_pipeline.near(spark, docs, "")
    assert out.columns == docs.columns
    found = sorted(((r.doc_id or 0), (r.text or "")[:2]) for r in out.collect())
    assert found == [(0, ""), (0, "a0"), (0, "a0"), (1, "a0"), (2, "b0"), (4, ""), (6, "c0")]
