"""64-bit hashes of the words of Arrow string columns, computed on whole buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are worked on at once; a longer text stands alone.
CHUNK_BYTES = 1 << 20

_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text (and the end) the number of its first word.

    Words are runs of bytes other than space and 0x09 to 0x0D; nulls have none.
    ``lower``: A-Z count as a-z.
    """
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[raw]
    fresh = np.ones(n, bool)  # nothing of the same text stands before, or a space does
    fresh[1:] = space[:-1]
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(fresh & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    terms = (raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)
    terms[space] = 0
    hashes = np.add.reduceat(terms, starts) * powers(_INVERSE, n)[starts]
    return scramble(hashes), np.searchsorted(starts, offsets)
