"""How far the sources of a language are from each other, by the terms they use.

A table of 256 entries over the concatenated UTF-8 bytes of a batch finds where
terms begin and end; xxHash groups them, and every term of a group is compared
with the group's first byte by byte. Batches leave as counts by group of
documents; the terms of a language are then dealt out to blocks, whose sparse
matrices of sources and terms give the sums of differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut

#: Bytes that belong to terms: letters and all of characters beyond ASCII; only A-Z are lower-cased.
INSIDE = np.zeros(256, bool)
INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text that are cut at once (a longer text alone), and places of a block's matrix; a block has
#: as many as it has pairs of sources, if that is more, so that pairs never outnumber what they are made of.
CHUNK, PLACES = 1 << 22, 1 << 15
SCALE, PRIOR = 1_000_000_000, 5
#: More languages than these are joined by a shuffle.
BROADCAST_LANGS = 10_000

_COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def find_terms(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each term in the texts that start at ``edges``, and the number of its text."""
    inside = INSIDE[data]
    cuts = edges[edges < len(data)]
    before = np.concatenate(([False], inside[:-1]))[: len(data)]
    before[cuts] = False
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    after[cuts[cuts > 0] - 1] = False
    begins = np.flatnonzero(inside & ~before)
    return begins, np.flatnonzero(inside & ~after) + 1, np.searchsorted(edges, begins, "right") - 1


def group_slices(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The group of each slice, and the first slice of each group: slices of a group have equal bytes."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[b:e]) for b, e in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))
    _, firsts, groups = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(begins):
        return groups, firsts
    lengths = ends - begins
    model = firsts[groups]
    other = lengths != lengths[model]
    same = np.flatnonzero(~other)
    sizes = lengths[same]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) + np.repeat(begins[same] - starts, sizes)
    differs = data[place] != data[place + np.repeat((begins[model] - begins)[same], sizes)]
    if differs.any():
        other[same] = np.logical_or.reduceat(differs, starts)
    known: dict[bytes, int] = {}
    extra = []
    for i in np.flatnonzero(other).tolist():  # hashes that fell together
        text = raw[begins[i] : ends[i]]
        if text not in known:
            known[text] = len(firsts) + len(extra)
            extra.append(i)
        groups[i] = known[text]
    return groups, np.concatenate((firsts, np.array(extra, firsts.dtype)))


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sums of their values, and how many there were."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    if not len(starts):
        return keys, values, values
    return keys[starts], np.add.reduceat(values, starts), np.diff(np.append(starts, len(keys)))


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of the terms of some documents by language and source; each group also has a row of the empty term."""
    lang, source = (pc.fill_null(part.column(n), "").dictionary_encode() for n in ("lang", "source"))
    texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins, ends, text = find_terms(data, offsets[:-1] - offsets[0])
    data = LOWER[data]
    groups, firsts = group_slices(data, begins, ends)
    cells = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    # Documents by terms as a sparse matrix, then its rows summed by language and source.
    width = max(len(firsts), 1)
    places, counts = np.unique(text * width + groups, return_counts=True)
    keys, counts, docs = _sums(cells[places // width] * width + places % width, counts)
    raw = data.tobytes()
    terms = pa.array([raw[b:e] for b, e in zip(begins[firsts].tolist(), ends[firsts].tolist())] + [b""], pa.binary()).cast(pa.string())
    present = np.unique(cells)
    cell = np.concatenate((keys // width, present))
    none = np.zeros(len(present), np.int64)
    columns = [
        lang.dictionary.take(pa.array(cell // len(source.dictionary))),
        source.dictionary.take(pa.array(cell % len(source.dictionary))),
        terms.take(pa.array(np.concatenate((keys % width, none + len(firsts))))),
        pa.array(np.concatenate((counts, none)), pa.int64()),
        pa.array(np.concatenate((docs, none)), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNK, "right")), at + 1)
            yield _count(batch.slice(at, to - at))
            at = to


def share(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / total), exact for totals below 9 * 10^15: three decimal places at a time."""
    whole, rest = np.divmod(counts + PRIOR, totals)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + step
    return whole + 1


def _distances(row: np.ndarray, rest: np.ndarray, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Sums over terms of the differences of one source from all.

    ``row`` is the source's share of each term; ``rest`` each source's share of
    the terms that it lacks. First all terms count as lacking, then the places
    of the sparse matrix are put right.
    """
    ordered = np.sort(row)
    sums = np.concatenate(([0], np.cumsum(ordered)))
    below = np.searchsorted(ordered, rest)
    out = rest * below - sums[below] + (sums[-1] - sums[below]) - rest * (len(row) - below)
    if len(starts):
        right = np.abs(row[columns] - values)
        wrong = np.abs(row[columns] - np.repeat(rest[filled], np.diff(np.append(starts, len(columns)))))
        out[filled] += np.add.reduceat(right - wrong, starts)
    return out


def _measure(key: tuple, table: pa.Table, top: int) -> pa.Table:
    """Differences of the pairs of sources, and the first terms of each source, within one block of terms."""
    term = table.column("term").combine_chunks()
    head = pc.equal(term, "")
    sources = table.filter(head).select(["source", "total", "terms"]).sort_by("source")
    names = sources.column("source").combine_chunks()
    size = len(names)
    cells = table.filter(pc.invert(head))
    coded = cells.column("term").combine_chunks().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    order = np.argsort(np.array([t.encode() for t in terms], object), kind="stable") if terms else np.zeros(0, np.int64)
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    columns = rank[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    rows = pc.index_in(cells.column("source").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = cells.column("n").to_numpy().astype(np.int64)
    by_row = np.lexsort((columns, rows))
    rows, columns, counts = rows[by_row], columns[by_row], counts[by_row]
    totals = sources.column("total").to_numpy() + PRIOR * sources.column("terms").to_numpy()
    out: list[tuple[pa.Array, str, pa.Array, np.ndarray]] = []
    others = np.arange(size)
    if len(terms):
        values = share(counts, totals[rows])
        rest = share(np.zeros(size, np.int64), totals)
        filled, starts = np.unique(rows, return_index=True)
    for s in range(size):
        if len(terms):
            row = np.full(len(terms), rest[s])
            mine = slice(*np.searchsorted(rows, [s, s + 1]))
            row[columns[mine]] = values[mine]
            far = _distances(row, rest, starts, columns, values, filled)
        else:
            far = np.zeros(size, np.int64)
        out.append((names.take(pa.array(np.full(size - 1, s))), "pair", names.take(pa.array(others[others != s])), far[others != s]))
    if len(terms):
        _, of_lang, _ = _sums(columns, counts)
        whole = sources.column("total").to_numpy().sum() + PRIOR * sources.column("terms").to_numpy()[0]
        more = values - share(of_lang, np.full(len(terms), whole))[columns]
        kept = np.flatnonzero(more > 0)
        kept = kept[np.lexsort((columns[kept], -more[kept], rows[kept]))]
        _, first, place = np.unique(rows[kept], return_index=True, return_inverse=True)
        kept = kept[np.arange(len(kept)) - first[place] < top]
        ordered = pa.array(terms, pa.string()).take(pa.array(order))
        out.append((names.take(pa.array(rows[kept])), "term", ordered.take(pa.array(columns[kept])), more[kept]))
    parts = [
        pa.table({"source": s.cast(pa.string()), "part": pa.array([part] * len(s), pa.string()), "item": i.cast(pa.string()), "value": pa.array(v, pa.int64())})
        for s, part, i, v in out
    ]
    result = pa.concat_tables(parts)
    return result.add_column(0, "lang", pa.array([key[0].as_py()] * len(result), pa.string()))


def source_divergence(documents: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """How the sources of each language differ in the terms that at least ``min_docs`` of its documents hold.

    Returns lang, source, part, item, value and rank (from 1 per lang, source
    and part, by falling value, then item). Part ``pair``: item is another source
    of the language, value the sum of the differences of shares over all kept
    terms (0 without any). Part ``term``: item is a term that the source has,
    with a larger share than in the language, value the difference, the first
    ``top``. A share is 1 + floor(10^9 * (count + 5) / (N + 5 * V)), with N the
    counts of kept terms and V their number; all of it is exact.

    Null texts, languages and sources are empty strings. Documents without terms
    make their source occur. Repeated rows are documents of their own; texts are
    cut whole (one longer than 4 MB needs some twenty times its size in a task).
    An empty table has no rows. Other columns, doc_id too, play no part.
    """
    cast = [F.col(name).cast("string").alias(name) for name in ("text", "lang", "source")]
    counted = documents.select(*cast).mapInArrow(_chunks, _COUNTED)
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    kept = cells.select(
        "lang", "source", "term", "n", F.sum("docs").over(same).alias("all_docs"), (F.row_number().over(same.orderBy("source")) == 1).alias("first")
    )
    kept = cut(kept.filter(f"term = '' or all_docs >= {int(min_docs)}").drop("all_docs"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.expr("first and term != ''")).alias("new"))
    langs = totals.groupBy("lang").agg(
        F.sum("new").alias("terms"), F.expr(f"cast(greatest(1, ceil(sum(new) * count(*) / greatest({PLACES}, count(*) * count(*)))) as int)").alias("blocks")
    )
    if langs.count() <= BROADCAST_LANGS:
        langs = F.broadcast(langs)
    own = kept.filter("term != ''").join(langs, "lang").withColumn("block", F.expr("pmod(xxhash64(term), blocks)"))
    every = totals.join(langs, "lang").withColumn("block", F.explode(F.expr("sequence(0L, cast(blocks - 1 as bigint))")))
    rows = own.select("lang", "block", "source", "term", "n", F.lit(None).cast("bigint").alias("total"), "terms").unionByName(
        every.select("lang", "block", "source", F.lit("").alias("term"), F.lit(0).cast("bigint").alias("n"), "total", "terms")
    )

    def measure(key: tuple, table: pa.Table) -> pa.Table:
        return _measure(key, table, top)

    blocks = rows.groupBy("lang", "block").applyInArrow(measure, "lang string, source string, part string, item string, value bigint")
    summed = blocks.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).filter(f"part = 'pair' or rank <= {int(top)}")
