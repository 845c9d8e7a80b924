"""Packing against the tokenizer itself, on small and odd tables."""

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing
from tracewell.llm.common import read
from tracewell.llm.queries import PATTERN, QUERIES, TOKENIZER

TEXTS = [None, "", " ", "\n\n  x ", "It's  <|endoftext|> 'sx ''s", "a" * 9000, "é漢字 🙂　 ½", "word " * 5000, "1234 5678\t\n  z", "same", "same", "\0 \x7f"]


def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(documents, pieces, window=2048, tails=1):
    """Every id lies in one piece, sequences have no gaps, and no padding but for powers of two."""
    encode, of, sequences = library(), defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    wanted = defaultdict(list)
    for doc_id, text in documents:
        wanted[doc_id].append(encode(text))
    assert of.keys() == wanted.keys()
    for doc_id, found in of.items():
        if len(wanted[doc_id]) == 1:
            ids, at = wanted[doc_id][0], 0
            for p in sorted(found, key=lambda p: p["start"]):
                part = ids[at : at + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] == len(part) > 0
                assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += p["length"]
            assert at == len(ids)
        else:
            assert sum(p["length"] for p in found) == sum(map(len, wanted[doc_id]))
    short = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or at < window and at & at - 1 == 0
        short += at < window
    assert short <= tails * window.bit_length()


@pytest.mark.parametrize("parts,together", [(1, 64), (7, 64), (7, 2)])
def test_pieces_hold_the_ids_of_the_library(spark, parts, together):
    random.seed(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(random.choice(["alpha", "be ta", "γ", "x1", "\n"]) for _ in range(random.choice([1, 50, 700, 3000])))) for i in range(60)]
    rows += [(None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], "doc_id long, text string, start string, ids string, `a.b` int").repartition(parts)
    out = packing.pack(docs, TOKENIZER, PATTERN, ["doc_id", "a.b"], 1, together=together)
    assert out.columns == ["doc_id", "a.b", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    pieces = [r.asDict() for r in out.collect()]
    assert all(p["a.b"] == 3 and zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)
    check(rows, pieces, tails=-(-parts // together))


def test_at_most_one_cut_for_each_sequence(spark):
    random.seed(5)
    docs = spark.createDataFrame([(i, "word " * random.randint(1, 3000)) for i in range(600)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, TOKENIZER, PATTERN, ["doc_id"], 1, ids=False).collect()
    assert len(pieces) <= 600 + len({p.sequence_id for p in pieces})


def test_small_windows_and_empty_tables(spark):
    docs = spark.createDataFrame(enumerate(TEXTS), "doc_id long, text string")
    out = packing.pack(docs, TOKENIZER, PATTERN, ["doc_id"], 1, window=64, limit=3)
    check(list(enumerate(TEXTS)), [r.asDict() for r in out.collect()], window=64)
    assert packing.pack(docs.limit(0), TOKENIZER, PATTERN, ["doc_id"], 1).count() == 0


def test_pieces_leave_the_caches_and_come_back(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 3)
    with open(TOKENIZER, "rb") as file:
        encoder = packing.Ids(file.read(), PATTERN)
    encode = library()
    for text in ["one two three four five", "one six", "two one one seven eight one", "\U0001f642" * 70]:
        assert list(struct.unpack(f"<{len(encoder.text(text)) // 4}I", encoder.text(text))) == encode(text)[:-1]


def test_stretches_of_many_texts_are_encoded_together():
    random.seed(9)
    parts = ["a", "b1", "é", "漢", "🙂", "½", "'s", "'", "!", "***", ".a", "ö!", "<|endoftext|>", "\0", " ", "  ", "\n", "\n\n", "\t", "\r\n"]
    parts += ["\xa0", "\x85", "\u3000", "\x1c", "\u180e", "\u200b", "\ufeff", "\x0b"]
    texts = [None, *["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(5000)]]
    words = [" ".join(f"w{random.randrange(10**6)}x," for _ in range(50)) for _ in range(400)]
    with open(TOKENIZER, "rb") as file:
        data = file.read()
    encode, encoder, calls = library(), packing.Ids(data, PATTERN), []
    real = encoder.library
    encoder.library = lambda text: calls.append(text) or real(text)
    found = list(encoder.texts(pa.array(words)))
    assert len(calls) <= 4  # one for each piece before
    found += encoder.texts(pa.array(texts))
    found += packing.Ids(data, r"[\s\S]+").texts(pa.array(texts[:100]))
    wanted = [encode(text)[:-1] for text in [*words, *texts, *texts[:100]]]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in found] == wanted


def test_query_over_the_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    documents = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check(documents, [r.asDict() for r in QUERIES["op13_packing"](spark, sf_dir).collect()])
