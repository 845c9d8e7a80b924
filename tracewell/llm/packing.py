"""Packing of token sequences by bounded-space best fit.

Every partition keeps a fixed number of open windows. What is left of a
document goes whole into the open window that it fills best; where none has
room, the fullest is filled to the brim with its first tokens and emitted. The
windows that are still open at a partition's end are merged, some partitions at
a time.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm.bpe import WHITE
from tracewell.llm.common import cut, quoted

WINDOW = 2048
#: Open windows of a partition, and partitions whose leftovers are merged by one task: at most 1,024 windows.
OPEN, TOGETHER = 16, 64
#: White space whose ids a worker keeps: stretches, and the longest one.
CACHED, LONGEST = 10_000, 64
#: Bytes of texts whose equal stretches are encoded once, and of stretches that the library gets in one call.
LOOKED_UP, AT_ONCE = 1 << 25, 1 << 17
#: Cuts texts into stretches: visible characters with the space before them, and white space; in white space that no space
#: ends, the last character before visible ones is a stretch of its own. Common letters and digits are cut from ASCII symbols
#: beside them, but for apostrophes.
MARK = "\0"
_SPACE = WHITE.encode().decode("unicode_escape")
LAST_SPACE = f"([{_SPACE}])([{_SPACE.replace(' ', '')}])([^{_SPACE}])"
VISIBLE = rf" ?[^{_SPACE}\x00]+"
_WORD, _SYMBOL = r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])", r"([!-&(-/:-@\[-`{-~])"
BESIDE = [_WORD + _SYMBOL, _SYMBOL + _WORD]
ROWS = 256
TOKEN = 4  # bytes of an id


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    Of many texts, each stretch is encoded by the tokenizer once: stretches are
    found and numbered by Arrow, and a call of the library gets many of them, as
    the lines of one text. With a ``pattern``, by which the tokenizer must split,
    other than that of public_tokenizers, texts are encoded whole, as where it
    isn't known that stretches are encoded for themselves. Strings of special
    tokens are ordinary text.
    """

    def __init__(self, data: bytes, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True
        self.feed = self.library("\n")
        self.cuts = pattern == PATTERN and len(self.feed) == 1
        self.blanks: dict[str, np.ndarray] = {}

    def library(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def blank(self, text: str) -> np.ndarray:
        ids = self.blanks.get(text)
        if ids is None:
            ids = self.library(text)
            if len(self.blanks) >= CACHED:
                self.blanks.clear()
            if len(text) <= LONGEST:
                self.blanks[text] = ids
        return ids

    def lines(self, visible: pa.Array) -> Iterator[np.ndarray]:
        """Ids of visible stretches, one array for many, each stretch followed by a line feed's id."""
        sizes = np.cumsum(pc.binary_length(visible).to_numpy(zero_copy_only=False)) // AT_ONCE
        starts = [*np.flatnonzero(np.diff(sizes, prepend=-1)).tolist(), len(visible)]
        for start, end in zip(starts, starts[1:]):
            lines = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), visible[start:end].cast(pa.string()))
            ids = self.library(pc.binary_join(lines, "\n")[0].as_py())
            if np.count_nonzero(ids == self.feed[0]) != end - start - 1:
                raise ValueError("a line feed is not a token of its own")
            yield np.append(ids, self.feed)

    def encoded(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each stretch start and how many they are."""
        is_visible = pc.match_substring_regex(stretches, f"[^{_SPACE}]")
        seen = is_visible.to_numpy(zero_copy_only=False)
        blanks = [self.blank(x) for x in stretches.filter(pc.invert(is_visible)).to_pylist()]
        ids = np.concatenate([*self.lines(stretches.filter(is_visible)), *blanks, self.feed[:0]])
        n_lines = len(ids) - sum(map(len, blanks))
        ends = np.flatnonzero(ids[:n_lines] == self.feed[0])
        starts, counts = np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
        starts[seen] = np.concatenate([[0], ends + 1])[:-1]
        counts[seen] = ends - starts[seen]
        counts[~seen] = list(map(len, blanks))
        starts[~seen] = n_lines + np.cumsum(counts[~seen]) - counts[~seen]
        return ids, starts, counts

    def text(self, text: str) -> bytes:
        return next(self.texts(pa.array([text])))

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; none for a null one."""
        texts = texts.cast(pa.large_string()).fill_null("")
        start = size = 0
        for end, length in enumerate(pc.binary_length(texts).to_pylist()):
            if end > start and size + length > LOOKED_UP:
                yield from self._texts(texts[start:end])
                start, size = end, 0
            size += length
        yield from self._texts(texts[start:])

    def _texts(self, texts: pa.Array) -> Iterator[bytes]:
        marked = pc.match_substring(texts, MARK) if self.cuts else pa.array([True] * len(texts))  # these can't be cut
        cut_up = pc.replace_substring_regex(pc.if_else(marked, "", texts), LAST_SPACE, rf"\1{MARK}\2\3")
        cut_up = pc.replace_substring_regex(cut_up, VISIBLE, rf"{MARK}\0{MARK}")
        for beside in BESIDE:
            cut_up = pc.replace_substring_regex(cut_up, beside, rf"\1{MARK}\2")
        cut_up = pc.split_pattern(pc.replace_substring(cut_up, MARK + MARK, MARK), MARK)
        numbered = cut_up.flatten().dictionary_encode()
        ids, starts, counts = self.encoded(numbered.dictionary)
        numbers, at = numbered.indices.to_numpy(), cut_up.offsets.to_pylist()
        for i, whole in enumerate(marked.to_pylist()):
            if whole:
                yield self.library(texts[i].as_py()).tobytes()
                continue
            own = numbers[at[i] : at[i + 1]]
            n = counts[own]
            ends = np.cumsum(n)
            yield ids[np.arange(n.sum()) + np.repeat(starts[own] - ends + n, n)].tobytes()


_IDS: dict[tuple[str, str], Ids] = {}


def _ids(data: bytes, pattern: str) -> Ids:
    """One encoder for all tasks of a Python worker."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _IDS:
        _IDS.clear()
        _IDS[key] = Ids(data, pattern)
    return _IDS[key]


class Packer:
    """Windows of ``size`` tokens, ``limit`` of them open.

    Pieces are (owner, start, ids). ``add`` and ``pour`` return closed windows
    as lists of pieces; every closed window of ``add`` is full.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.open: list[tuple[int, list]] = []

    def add(self, owner, start: int, ids: bytes) -> list[list]:
        closed = []
        while left := len(ids) // TOKEN:
            gaps = [self.size - fill for fill, _ in self.open]
            if left >= self.size:
                take, at = self.size, None
            elif fits := [(gap, i) for i, gap in enumerate(gaps) if gap >= left]:
                take, at = left, min(fits)[1]
            elif len(gaps) < self.limit:
                take, at = left, None
            else:
                take, at = min((gap, i) for i, gap in enumerate(gaps))
            fill, pieces = (0, []) if at is None else self.open.pop(at)
            pieces.append((owner, start, ids[: take * TOKEN]))
            if fill + take == self.size:
                closed.append(pieces)
            else:
                self.open.append((fill + take, pieces))
            start, ids = start + take, ids[take * TOKEN :]
        return closed

    def pour(self) -> list[list]:
        """Empty the open windows, fullest first, into full ones; the rest into windows whose sizes are powers of two."""
        self.open.sort(key=lambda window: -window[0])
        left = sum(fill for fill, _ in self.open)
        closed, room = [], 0
        for _, pieces in self.open:
            for owner, start, ids in pieces:
                while ids:
                    if not room:
                        room = self.size if left >= self.size else 1 << left.bit_length() - 1
                        left -= room
                        closed.append([])
                    take = min(room, len(ids) // TOKEN)
                    closed[-1].append((owner, start, ids[: take * TOKEN]))
                    start, ids, room = start + take, ids[take * TOKEN :], room - take
        self.open = []
        return closed


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    pattern: str,
    keep: list[str],
    end: int,
    window: int = WINDOW,
    limit: int = OPEN,
    together: int = TOGETHER,
    ids: bool = True,
) -> DataFrame:
    """Cut every document's ids, followed by the id ``end``, into pieces that fill sequences of ``window`` tokens.

    Returns one row per piece: the columns ``keep`` of its document, start (its
    document's ids before it), length, ids_crc32 (of the little-endian 32-bit
    ids), doc_tokens, sequence_id, offset and, if asked for, the ids in that form. Sequences
    are full, but for those that hold the rest of the windows merged by one
    task: their lengths are falling powers of two, at most one of each, so that
    no sequence needs padding if a power of two is left as it is. Documents are
    cut where they are longer than a window, where no open window has room, and
    in that rest.

    Null and empty texts are the id ``end`` alone. Every row is a document of its
    own: repeated rows, ties and null ids stay, each packed. Texts are encoded
    whole, whatever their length. An empty table has no pieces. Columns outside
    ``keep`` play no part; those in it may have any name but those added.
    """
    with open(tokenizer_path, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    kinds = {f"kept_{i}": f.dataType.simpleString() for i, f in enumerate(documents.select(*map(quoted, keep)).schema)}
    owners = [*kinds, "doc_tokens"]
    kinds |= {"doc_tokens": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    kinds |= {"ids": "binary", "part": "int"}
    fields = ", ".join(f"{name} {kind}" for name, kind in kinds.items())

    def rows(types: list[pa.Field], part: int, merged: int, numbered: list[tuple[int, list]], keep_ids: bool) -> pa.RecordBatch:
        """Closed windows with their numbers as rows; part is null once a window is closed."""
        out: list[list] = [[] for _ in kinds]
        for number, pieces in numbered:
            offset = 0
            for owner, start, data in pieces:
                values = (*owner, start, len(data) // TOKEN, zlib.crc32(data), (2 * part + merged << 31) + number, offset, data if keep_ids else None)
                for column, value in zip(out, values):
                    column.append(value)
                offset += len(data) // TOKEN
        out[-1] = [None if merged or number >= 0 else part for number, pieces in numbered for _ in pieces]
        arrays = [pa.array(column, field.type) for column, field in zip(out, types)]
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    added = [pa.field(n, {"binary": pa.binary(), "int": pa.int32()}.get(k, pa.int64())) for n, k in kinds.items() if not n.startswith("kept_")]

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, number = _ids(shared.value, pattern), Packer(window, limit), 0
        part, last = TaskContext.get().partitionId(), array("I", [end]).tobytes()
        types = None
        for batch in batches:
            types = [*list(batch.schema)[: len(keep)], *added]
            encoded = encoder.texts(batch.column(len(keep)))
            for at in range(0, batch.num_rows, ROWS):
                some, closed = batch.slice(at, ROWS), []
                columns = [some.column(i).to_pylist() for i in range(len(keep))]
                for i, data in enumerate(islice(encoded, some.num_rows)):
                    data += last
                    closed += packer.add((*[c[i] for c in columns], len(data) // TOKEN), 0, data)
                yield rows(types, part, 0, list(enumerate(closed, number)), ids)
                number += len(closed)
        if types:
            yield rows(types, part, 0, [(~i, pieces) for i, (_, pieces) in enumerate(packer.open)], True)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        own = [table.column(name).to_pylist() for name in owners]
        pieces = list(zip(zip(*own), *[table.column(n).to_pylist() for n in ("start", "ids", "part", "sequence_id", "offset")]))
        pieces.sort(key=lambda p: (-len(p[2]), p[3], p[4], p[5]))
        packer, closed = Packer(window, limit), []
        for owner, start, data, *_ in pieces:
            closed += packer.add(owner, start, data)
        closed += packer.pour()
        types = [*list(table.schema)[: len(keep)], *added]
        return pa.Table.from_batches([rows(types, key[0].as_py(), 1, list(enumerate(closed)), ids)])

    # Names with full stops can't be used there.
    kept = [F.col(quoted(name)).alias(f"kept_{i}") for i, name in enumerate(keep)]
    placed = cut(documents.select(*kept, F.col("text").alias("text")).mapInArrow(online, fields))
    leftovers = placed.filter("part is not null").withColumn("together", F.expr(f"part div {together}"))
    merged = leftovers.groupBy("together").applyInArrow(merge, fields)
    result = placed.filter("part is null").unionByName(merged)
    names = [F.col(f"kept_{i}").alias(name) for i, name in enumerate(keep)]
    return result.select(*names, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids)
