"""Removal of long passages that also stand in an earlier document.

A passage is a window of ``WINDOW`` words, that is a suffix of a document cut to
that depth. Suffixes are split into groups by a short prefix of what they share:
the smallest hash among the ``PREFIX``-word runs inside the window, which equal
windows have in common wherever they stand. Neighbouring suffixes mostly share
it, so a group holds whole segments of text instead of 50 words per suffix.

Groups in which only one document occurs hold no repeat. For the others, equal
segments are merged first; each group's windows are then sorted, which puts
equal ones together as a suffix tree's nodes at that depth would, each with its
smallest doc_id; no tree is built. For groups too large for memory the prefix is lengthened to
the full depth, where a node is one key of a distributed minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut
from tracewell.llm.word_hashes import chunks, powers, scramble, word_hashes

WINDOW, PREFIX = 50, 8
#: Windows in a segment, distinct segments in a group, and segments of a batch that are sorted at once.
SEGMENT, GROUP, SORTED = 64, 2000, 500

_BASES = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
_INVERSES = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]


def _run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hashes of words[start:end], from prefix sums."""
    mixed = scramble(words + np.uint64(which))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mixed * powers(_BASES[which], len(words)), out=sums[1:])
    return scramble((sums[ends] - sums[starts]) * powers(_INVERSES[which], len(words) + 1)[starts])


def segments_of(words: np.ndarray, first: np.ndarray, window: int, prefix: int) -> dict[str, np.ndarray]:
    """The windows of all texts as segments: row, start, windows, group, key_a, key_b."""
    rows = len(first) - 1
    counts = np.diff(first)
    owner = np.repeat(np.arange(rows), counts)
    left = first[1:][owner] - np.arange(len(words))
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return dict(row=empty, start=empty, windows=empty, group=empty, key_a=empty, key_b=empty)
    grams = np.zeros(len(words) + window, np.uint64)
    for k in range(prefix):
        factor = scramble(np.array([k + 77], np.uint64))[0] | np.uint64(1)
        grams[: len(words) - k] += words[k:] * factor
    grams = scramble(grams)
    span, have = window - prefix + 1, 1
    low = grams
    while have < span:  # the minimum over `span` runs, doubled up
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    group = low[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] != starts[:-1] + 1) | (group[1:] != group[:-1])
    at = np.arange(len(starts)) - np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
    fresh |= at % SEGMENT == 0
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, len(starts)))
    begin = starts[heads]
    end = begin + sizes + window - 1
    row = owner[begin]
    return dict(
        row=row,
        start=begin - first[:-1][row],
        windows=sizes,
        group=group[heads].astype(np.int64),
        key_a=_run_hashes(words, begin, end, 0).astype(np.int64),
        key_b=_run_hashes(words, begin, end, 1).astype(np.int64),
    )


def _segments(documents: DataFrame, window: int, prefix: int) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = segments_of(*word_hashes(part.column("text")), window, prefix)
                row = pa.array(found.pop("row"))
                ids = [part.column(n).take(row) for n in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, found.values())], names=["doc_id", "text_key", *found])

    return documents.mapInArrow(
        run, f"doc_id {kind}, text_key bigint, start bigint, windows bigint, group bigint, key_a bigint, key_b bigint"
    )


def _texts_of(asked: DataFrame, documents: DataFrame, window: int) -> DataFrame:
    """The word hashes of the segments in ``asked``."""
    wanted = asked.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "windows", "group", "key_a", "key_b", "large")).alias("wanted")
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = ["windows", "group", "key_a", "key_b", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words, first = word_hashes(part.column("text"))
                lists = part.column("wanted")
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                size = flat.field("windows").to_numpy() + window - 1
                begin = first[:-1][rows] + flat.field("start").to_numpy()
                offsets = np.concatenate([[0], np.cumsum(size)])
                index = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
                text = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words[index].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), *[flat.field(n) for n in fields], text],
                    names=["doc_id", *fields, "words"],
                )

    return documents.join(wanted, ["doc_id", "text_key"]).mapInArrow(
        run,
        f"doc_id {kind}, windows bigint, group bigint, key_a bigint, key_b bigint, large boolean, words array<bigint>",
    )


def repeats_in_groups(
    group: np.ndarray, doc: np.ndarray, words: np.ndarray, offsets: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all suffixes of segments: (segment, position, smallest doc of its node at depth ``window``).

    The suffixes of all groups at hand are sorted by group and words; suffixes
    that agree to full depth are the leaves below one internal node.
    """
    sizes = np.diff(offsets) - window + 1
    segment = np.repeat(np.arange(len(group)), sizes)
    position = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    paths = np.empty((len(segment), window + 1), np.int64)
    paths[:, 0] = group[segment]
    paths[:, 1:] = np.lib.stride_tricks.sliding_window_view(words, window)[offsets[:-1][segment] + position]
    labels = paths.view(np.dtype((np.void, paths.shape[1] * 8))).reshape(-1)
    order = np.argsort(labels)
    paths = paths[order]
    node = np.ones(len(order), bool)
    node[1:] = (paths[1:] != paths[:-1]).any(axis=1)
    smallest = np.minimum.reduceat(doc[segment[order]], np.flatnonzero(node))[np.cumsum(node) - 1]
    return segment[order], position[order], smallest


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Runs of equal values: where they begin, how long they are, the value."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return heads.tolist(), np.diff(np.append(heads, len(values))).tolist(), values[heads].tolist()


_RUNS = "runs array<struct<first: bigint, n: bigint, least: bigint>>"


def _trees(texts: DataFrame, window: int) -> DataFrame:
    """(group, key_a, key_b, runs): for each segment the smallest doc_id of its windows."""

    def solve(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(tables).combine_chunks().to_batches()[0]
        lists = batch.column("words")
        at = lists.offsets.to_numpy()
        words = lists.flatten().to_numpy()
        segment, position, least = repeats_in_groups(
            batch.column("group").to_numpy(), batch.column("doc_id").to_numpy(), words, at - at[0], window
        )
        order = np.lexsort((position, segment))
        segment, least = segment[order], least[order]
        edges = np.searchsorted(segment, np.arange(batch.num_rows + 1))
        runs = [
            [dict(first=a, n=b, least=c) for a, b, c in zip(*_runs(least[edges[k] : edges[k + 1]]))]
            for k in range(batch.num_rows)
        ]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("least", pa.int64())]))
        names = ["group", "key_a", "key_b"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(runs, kind)], names=[*names, "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of groups that may go on
        for big in batches:
            for at in range(0, big.num_rows, SORTED):
                batch = big.slice(at, SORTED)
                group = batch.column("group").to_numpy()
                changes = np.flatnonzero(group[1:] != group[:-1])
                before = held[-1].column("group")[-1].as_py() if held else None
                if held and group[0] != before:
                    yield from solve(held)
                    held = []
                if len(changes):
                    last = int(changes[-1]) + 1
                    yield from solve([*held, batch.slice(0, last)])
                    held = [batch.slice(last)]
                else:
                    held.append(batch)
        if held:
            yield from solve(held)

    sorted_texts = texts.repartition("group").sortWithinPartitions("group")
    return sorted_texts.mapInArrow(run, f"group bigint, key_a bigint, key_b bigint, {_RUNS}")


def _full_depth(texts: DataFrame, window: int) -> DataFrame:
    """The same for groups too large for one tree: each window's full path is a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            at = lists.offsets.to_numpy()
            at = at - at[0]
            words = lists.flatten().to_numpy().astype(np.uint64)
            sizes = np.diff(at) - window + 1
            segment = np.repeat(np.arange(batch.num_rows), sizes)
            position = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin = at[:-1][segment] + position
            paths = [pa.array(_run_hashes(words, begin, begin + window, w).astype(np.int64)) for w in (0, 1)]
            taken = [batch.column(n).take(pa.array(segment)) for n in ("group", "key_a", "key_b", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(position), *paths],
                names=["group", "key_a", "key_b", "doc_id", "first", "path_a", "path_b"],
            )

    windows = texts.mapInArrow(
        run, "group bigint, key_a bigint, key_b bigint, doc_id bigint, first bigint, path_a bigint, path_b bigint"
    )
    nodes = windows.groupBy("path_a", "path_b").agg(F.min("doc_id").alias("least"))
    return (
        windows.join(nodes, ["path_a", "path_b"])
        .groupBy("group", "key_a", "key_b")
        .agg(F.collect_list(F.struct("first", F.lit(1).cast("bigint").alias("n"), "least")).alias("runs"))
    )


def repeated_windows(documents: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, text_key, start, n): runs of window starts whose windows also stand in a document with a smaller id."""
    documents = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    ).filter("doc_id is not null")
    segments = cut(_segments(documents, window, prefix))
    groups = segments.groupBy("group").agg(
        F.min("doc_id").alias("least"),
        F.max("doc_id").alias("most"),
        (F.min("key_a") != F.max("key_a")).alias("many"),
    )
    shared = cut(segments.join(groups.filter("least < most").drop("most"), "group"))
    plain = shared.filter("not many and least < doc_id").select("doc_id", "text_key", "start", F.col("windows").alias("n"))

    distinct = (
        shared.filter("many")
        .groupBy("group", "key_a", "key_b")
        .agg(F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("at"))
        .select("group", "key_a", "key_b", "at.*")
    )
    sizes = distinct.groupBy("group").agg((F.count(F.lit(1)) > GROUP).alias("large"))
    texts = cut(_texts_of(distinct.join(sizes, "group"), documents, window))
    runs = _trees(texts.filter("not large"), window).unionByName(_full_depth(texts.filter("large"), window))
    found = (
        shared.filter("many")
        .drop("least")
        .join(runs, ["group", "key_a", "key_b"])
        .select("doc_id", "text_key", "start", F.explode(F.filter("runs", lambda r: r["least"] < F.col("doc_id"))).alias("run"))
        .select("doc_id", "text_key", (F.col("start") + F.col("run.first")).alias("start"), F.col("run.n").alias("n"))
    )
    return plain.unionByName(found)


def substring_dedup(documents: DataFrame, window: int = WINDOW, prefix: int = PREFIX, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Every word is removed that lies in a window of ``window`` consecutive words
    which also starts in a document with a smaller doc_id. Windows are judged on
    the input. Words are unchanged and joined by one space. Null and wordless
    texts have no words; texts shorter than the window lose nothing. Rows
    without a doc_id lose nothing and cause no loss; rows with one doc_id are
    one document to each other: each loses what its own text shares with smaller ids.
    Other columns are ignored, whatever their names; an empty table gives no row.
    """
    wide = documents.select("doc_id", F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    runs = (
        repeated_windows(documents, window, prefix)
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    )
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                totals, removed, digests, kept_texts = [], [], [], []
                for text, cuts in zip(part.column("text"), part.column("runs")):
                    words = (text.as_py() or "").encode().split()
                    kept = words
                    if cuts.is_valid and len(cuts):
                        flat = cuts.values
                        start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                        inside = (start < len(words)) & (start + n + window - 1 <= len(words))
                        start, n = start[inside], n[inside]
                        depth = np.zeros(len(words) + 1, np.int64)
                        np.add.at(depth, start, 1)
                        np.add.at(depth, start + n + window - 1, -1)
                        kept = [w for w, d in zip(words, np.cumsum(depth).tolist()) if not d]
                    joined = b" ".join(kept)
                    totals.append(len(words))
                    removed.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(joined).hexdigest())
                    if texts:
                        kept_texts.append(joined.decode())
                columns = [part.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
                columns += [pa.array(kept_texts, pa.string())] * texts
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts]
                )

    return (
        wide.join(runs, ["_id", "_key"], "left")
        .select("doc_id", "text", "runs")
        .mapInArrow(
            run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
        )
    )
