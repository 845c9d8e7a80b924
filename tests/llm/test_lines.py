"""Removal of repeated chunks of lines against the rule written out in Python."""

import hashlib
import random
import re

import pytest

from tracewell.llm import line_dedup

FIELDS = "doc_id long, text string, row string, removed string, id string, of string, n_chunks string, at string"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "m", "i", "o", "c", "a") for i, t in zip(ids, texts)], FIELDS)


def chunks(text, roll, divisor):
    lines = (text or "").split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, chunk = [], []
    for i, line in enumerate(lines):
        chunk.append(line)
        rolled = sum(hashes[i - k] * line_dedup.BASE**k for k in range(roll) if i >= k)
        if rolled % divisor == 0 or i == len(lines) - 1:
            out.append("\n".join(chunk))
            chunk = []
    return out


def counts(chunk, least):
    return sum(bool(re.search(r"[^ \t-\r]", x)) for x in chunk.split("\n")) >= least


def texts_of(seed):
    random.seed(seed)
    passages = [[f"passage {p} line {k}" for k in range(random.choice([1, 2, 3, 5, 12, 40]))] for p in range(12)]
    out = []
    for i in range(60):
        lines = [f"own {i} {k}" for k in range(random.randint(0, 5))]
        for _ in range(random.randint(0, 4)):
            lines += random.choice(passages) + random.choice([[], [""], [f"between {i}"], ["same"] * 3])
        out.append("\n".join(lines))
    return out + ["", None, "\n\n\n", "single", "single", "é\nü\nß\nö\nä\nç\nñ\nø", "é\nü\nß\nö\nä\nç\nñ\nø", out[0], "\n".join(["x", "y"] * 20_000)]


@pytest.mark.parametrize("least,roll,divisor", [(2, 2, 4), (1, 1, 2), (3, 4, 3)])
def test_chunks_against_brute_force(spark, least, roll, divisor):
    texts = texts_of(roll)
    ids = random.sample(range(1000), len(texts))
    seen, want = set(), {}
    for i, text in sorted(zip(ids, texts)):
        found = chunks(text, roll, divisor)
        again = [c in seen or c in found[:k] for k, c in enumerate(found)]
        gone = [a and counts(c, least) for a, c in zip(again, found)]
        seen |= set(found)
        stays = "\n".join(c for c, g in zip(found, gone) if not g)
        want[i] = (text if text is None else stays, 0 if text is None else len(found), sum(gone))
    out = line_dedup.line_dedup(table(spark, texts, ids), least, roll, divisor)
    assert out.columns == [*[f.split()[0] for f in FIELDS.split(", ")], "n_removed"]
    rows = out.collect()
    assert {r.doc_id: (r.text, r.n_chunks, r.n_removed) for r in rows} == want
    assert all((r.row, r.removed, r.id, r.of, r["at"]) == ("r", "m", "i", "o", "a") for r in rows)


def test_one_id_with_two_texts_and_rows_without_id(spark):
    passage = "\n".join(f"line {k}" for k in range(30))
    own = "\n".join(f"unique {k}" for k in range(30))
    texts = [passage, passage, own, own, passage, passage]
    rows = line_dedup.line_dedup(table(spark, texts, [1, 2, 2, 2, None, None])).collect()
    assert sorted((r.doc_id or 0, r.text == own, r.n_removed > 0) for r in rows) == [
        (0, False, False), (0, False, False), (1, False, False), (2, False, True), (2, True, False), (2, True, False),
    ]
    assert all(r.text == passage for r in rows if r.doc_id in (None, 1))
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    def weak(*cols):  # every chunk has one key
        return F.lit(7).cast("bigint") if cols == ("chunk",) else real(*cols)

    real = F.xxhash64
    texts = texts_of(5)
    usual = sorted(map(str, line_dedup.line_dedup(table(spark, texts)).collect()))
    monkeypatch.setattr(F, "xxhash64", weak)
    assert sorted(map(str, line_dedup.line_dedup(table(spark, texts)).collect())) == usual


def passages(texts, ids):
    """The texts that stay, by pairs of neighbouring lines."""
    seen, out = {}, {}
    for i, text in sorted(zip(ids, texts)):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if re.search(r"[^ \t-\r]", x)]
        gone = set()
        for a, b in zip(at, at[1:]):
            if seen.setdefault("\n".join(lines[a : b + 1]), (i, a)) != (i, a):
                gone |= set(range(a, b + 1))
        out[i] = text if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("roll,divisor", [(2, 4), (1, 2), (3, 50)])
def test_passages_are_found_by_chunks_and_beyond_them(spark, monkeypatch, roll, divisor):
    asked, real = [], line_dedup.repeated_chunks
    monkeypatch.setattr(line_dedup, "repeated_chunks", lambda *a: asked.append(a) or real(*a))
    texts = texts_of(7)
    ids = random.sample(range(1000), len(texts))
    rows = line_dedup.passage_dedup(table(spark, texts, ids), roll, divisor).collect()
    assert {r.doc_id: r.text for r in rows} == passages(texts, ids) and len(asked) == 1


def test_pairs_with_colliding_keys_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    def weak(*cols):  # every chunk and pair has one key
        return F.lit(7).cast("bigint") if cols == ("chunk",) else real(*cols)

    real = F.xxhash64
    texts = texts_of(8)
    monkeypatch.setattr(F, "xxhash64", weak)
    rows = line_dedup.passage_dedup(table(spark, texts)).collect()
    assert {r.doc_id: r.text for r in rows} == passages(texts, range(len(texts)))
