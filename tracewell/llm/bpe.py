"""Byte-level BPE by prefix dynamic programming, and decoding.

Every byte prefix of a piece has exactly one token that can end its encoding:
the one that may follow the last token of the shorter prefix. Two neighbours
are allowed if undoing their merges never meets a pair that BPE would have
joined earlier. A table of these last tokens gives exact encodings of appended
text, and after an edit only the entries near it are computed again.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import quoted

#: Pieces whose tokens a Python worker keeps; beyond it the memory starts anew.
CACHED_PIECES = 400_000
CACHED_PAIRS = 600_000
ROWS = 256


class Vocabulary:
    """Tokens by rank; ranks 0 to 255 are the single bytes."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        self.tokens = dict(sorted((rank, token) for token, rank in self.ranks.items()))
        self.longest = max(map(len, self.ranks))
        #: Finds all tokens that end at each byte; it takes strings, so bytes stand as Latin-1.
        self.finder = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.finder.add_word(token.decode("latin-1"), (rank, len(token)))
        self.finder.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._allowed: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joined; None for a token that no merge makes."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                rank, at = min(
                    (self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)
                )
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def allowed(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side."""
        key = left << 20 | right
        if (known := self._allowed.get(key)) is not None:
            return known
        below = float("inf")  # merges that come first at this point
        answer = True
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < below:
                answer = False
                break
            # The later merge is undone first; of equal ones, the right one came later.
            left_halves, right_halves = self.halves(left), self.halves(right)
            if left_halves and (left > right or not right_halves):
                below, left = left, left_halves[1]
            elif right_halves:
                below, right = right + 1, right_halves[0]
            else:
                break
        if len(self._allowed) >= CACHED_PAIRS:
            self._allowed.clear()
        self._allowed[key] = answer
        return answer


    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Fill the table of last tokens over the whole piece, then read it from the end."""
        last: list[int] = [-1] * len(piece)
        known, allowed = self._allowed.get, self.allowed
        for end, (token, length) in self.finder.iter(piece.decode("latin-1")):
            if last[end] < 0:
                before = end - length
                if before < 0:
                    last[end] = token
                else:
                    ok = known(last[before] << 20 | token)
                    if ok or (ok is None and allowed(last[before], token)):
                        last[end] = token
        return self.read(last)

    def read(self, last: list[int]) -> tuple[int, ...]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return tuple(reversed(out))


class PrefixTable:
    """The encoding of growing and changing bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last(self, end: int) -> int:
        ranks, data, last, allowed = self.vocabulary.ranks, self.data, self.last, self.vocabulary.allowed
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = ranks.get(data[start:end])
            if token is not None and (start == 0 or allowed(last[start - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        before = len(self.data)
        self.data += more
        for end in range(before + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of bytes start to end; returns how many entries were computed."""
        tail = self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        same = done = 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self.last.append(self._last(at + 1))
            done += 1
            old = at - start - len(new)
            same = same + 1 if old >= 0 and tail[old] == self.last[-1] else 0
            if same >= self.vocabulary.longest:  # what follows sees only equal entries
                self.last += tail[old + 1 :]
                break
        return done

    def tokens(self) -> tuple[int, ...]:
        return self.vocabulary.read(self.last)


class _Pieces(dict):
    """Tokens of pieces, encoded when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        tokens = (whole,) if whole is not None else self.vocabulary.encode(data)
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = tokens
        return tokens


#: White space of the pattern language: Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(major: str) -> str:
    """The characters of a major category as the inside of a character class."""
    found, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == major
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            found.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(found)


@functools.lru_cache(4)
def splitter(pattern: str) -> re.Pattern:
    r"""``pattern`` for the standard library, with \p{L}, \p{N}, \s and \S spelled out as classes."""
    classes = {r"\p{L}": _ranges("L"), r"\p{N}": _ranges("N"), r"\s": WHITE}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|[\s\S]", pattern):
        inside = (inside or part == "[") and part != "]"
        if part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        elif part == r"\S":
            part = f"[^{WHITE}]"
        out.append(part)
    return re.compile("".join(out))


class Encoder:
    """Texts to token ids and back; each match of ``pattern`` is encoded separately."""

    def __init__(self, data: bytes, pattern: str):
        self.vocabulary = Vocabulary(data)
        self.pieces = _Pieces(self.vocabulary)
        self.split = splitter(pattern).findall
        self.names = {rank: str(rank) for rank in self.vocabulary.tokens}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data, pattern)
    return _ENCODERS[key]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, [text or "" for text in part.column("text").to_pylist()]


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, keep: list[str], ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the columns ``keep`` and n_tokens, ids_sha256 (of the decimal ids
    joined by one space), decoded_sha256 (of the decoded bytes) and, if asked
    for, the ids. Null and empty texts have no tokens. Every row is encoded for
    itself: repeated rows stay repeated, and an empty table stays empty. Columns
    of the added names are replaced. The vocabulary is read where the query is
    made and sent to the executors (half a megabyte).
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    keep = [name for name in keep if name not in added]
    with open(ranks_path, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    schema = documents.select(*map(quoted, keep)).schema
    kinds = ["bigint", "string", "string", *["array<int>"] * ids]
    fields = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema] + [f"{n} {k}" for n, k in zip(added, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            for part, texts in _texts(batch):
                counts, names, decoded, lists = [], [], [], []
                for text in texts:
                    tokens = encoder.encode(text)
                    counts.append(len(tokens))
                    names.append(hashlib.sha256(" ".join(map(encoder.names.__getitem__, tokens)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(tokens)).hexdigest())
                    if ids:
                        lists.append(tokens)
                columns = [part.column(i) for i in range(len(keep))] + [pa.array(counts, pa.int64()), pa.array(names), pa.array(decoded)]
                columns += [pa.array(lists, pa.list_(pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays(
                    columns, names=[*keep, *added]
                )

    # Names with full stops can't be used there.
    kept = [F.col(quoted(name)).alias(f"kept_{i}") for i, name in enumerate(keep)]
    return documents.select(*kept, "text").mapInArrow(run, fields)


def token_counts(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """n_tokens of every row, and nothing else; 0 for null and empty texts."""
    with open(ranks_path, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        lengths = encoder.pieces.__getitem__
        for batch in batches:
            for _, texts in _texts(batch):
                counts = [sum(map(len, map(lengths, encoder.split(text)))) for text in texts]
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return documents.select("text").mapInArrow(run, "n_tokens bigint")
