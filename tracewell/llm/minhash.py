"""Near-duplicate documents by b-bit MinHash.

Every document becomes its set of word shingles. Equal sets form a class, of
which one member goes on. ``BANDS`` bands of ``ROWS`` minima make candidates;
of each minimum the two lowest bits (scrambled) are kept, and the number of
equal pairs, corrected for chance agreement, estimates the similarity. Links
are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut
from tracewell.llm.components import components
from tracewell.llm.word_hashes import chunks, scramble, word_hashes

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BITS = 2
#: The estimate deviates by 0.04 (one sigma) at 0.8: candidates below 0.6 are five sigmas away.
SLACK = 0.2
#: Bands are compared in blocks; a block holds about so many sets and shingles at most.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20


def _shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted within each text, and the number of each text's first one."""
    hashes, first = word_hashes(texts, lower=True)
    rows = len(texts)
    counts = np.diff(first)
    owner = np.repeat(np.arange(rows), counts)
    left = first[1:][owner] - np.arange(len(hashes))  # words from here to the end of the text
    total = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        factor = scramble(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        shifted = hashes[k:] * factor
        inside = left[: len(shifted)] > k
        total[: len(shifted)] += np.where(inside, shifted, np.uint64(0))
    starts = (left >= width) | ((counts[owner] < width) & (left == counts[owner]))
    owner, values = owner[starts], scramble(total[starts])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[fresh], np.searchsorted(owner[fresh], np.arange(rows + 1))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = scramble(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)
    b = scramble(np.arange(n + 1, 2 * n + 1, dtype=np.uint64)) >> np.uint64(32)
    return a.astype(np.uint32) | np.uint32(1), b.astype(np.uint32)


def signatures(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (rows x HASHES*BITS/64) and band keys (rows x BANDS) of sets that begin at ``starts``."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    a, b = _constants(HASHES)
    minima = np.empty((HASHES, len(starts)), np.uint32)
    for k in range(HASHES):
        minima[k] = np.minimum.reduceat(short * a[k] + b[k], starts)
    wide = scramble(minima.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))[:, None])
    low = wide & np.uint64((1 << BITS) - 1)
    per_long = 64 // BITS
    packed = np.zeros((HASHES // per_long, len(starts)), np.uint64)
    for k in range(HASHES):
        packed[k // per_long] |= low[k] << np.uint64(BITS * (k % per_long))
    keys = scramble(wide.reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64))
    return packed.T.astype(np.int64), keys.T.astype(np.int64)


def _lists(matrix: np.ndarray, present: np.ndarray) -> pa.Array:
    """One list per row of ``present``, null where it is False."""
    width = matrix.shape[1]
    offsets = np.concatenate([[0], np.cumsum(present * width)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))
    return pa.ListArray.from_buffers(
        lists.type,
        len(present),
        [pa.array(present.tolist(), pa.bool_()).buffers()[1], pa.py_buffer(offsets.tobytes())],
        children=[lists.values],
    )


def text_key() -> Column:
    """Tells texts with one doc_id apart."""
    return F.xxhash64("text").alias("text_key")


def set_features(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_a and set_b (a 128-bit hash of the set), signature, bands; nulls for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values, first = _shingles(part.column("text"), width)
                sizes = np.diff(first)
                present = sizes > 0
                starts = first[:-1][present]
                if len(starts):
                    one = np.add.reduceat(scramble(values ^ np.uint64(0x5BD1E995)), starts)
                    two = np.add.reduceat(scramble(values + np.uint64(0x2545F4914F6CDD1D)), starts)
                    packed, keys = signatures(values, starts)
                else:
                    one = two = np.zeros(0, np.uint64)
                    packed, keys = np.zeros((0, HASHES * BITS // 64), np.int64), np.zeros((0, BANDS), np.int64)
                full = np.zeros((2, len(sizes)), np.int64)
                full[0, present], full[1, present] = one.astype(np.int64), two.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(full[0], mask=~present),
                        pa.array(full[1], mask=~present),
                        _lists(packed, present),
                        _lists(keys, present),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "signature", "bands"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_key(), "text").mapInArrow(
        run,
        f"doc_id {kind}, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<bigint>, bands array<bigint>",
    )


def shingle_sets(documents: DataFrame, width: int) -> DataFrame:
    """For rows (id, text): id and the sorted hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values, first = _shingles(part.column("text"), width)
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), sets], names=["id", "shingles"])

    return documents.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def estimate(one: Column, two: Column) -> Column:
    """Similarity from packed signatures: agreement beyond chance, by counting bits."""
    longs = HASHES * BITS // 64
    odd = F.lit(0x5555555555555555)
    differing = sum(
        F.bit_count(
            x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)
        )
        for x in (F.get(one, i).bitwiseXOR(F.get(two, i)) for i in range(longs))
    )
    chance = 1 / (1 << BITS)
    return ((1 - differing / F.lit(float(HASHES))) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    return joined.filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


class _Block:
    """The members of two blocks of a band, and who of them may be linked."""

    def __init__(self, key: tuple[pa.Scalar, ...], table: pa.Table, floor: float):
        self.band, p, q = (k.as_py() for k in key)
        self.floor = floor
        column = lambda n: table.column(n).combine_chunks()
        matrix = lambda n: column(n).flatten().to_numpy().reshape(table.num_rows, -1)
        self.ids, self.component = column("id").to_numpy(), column("component").to_numpy()
        self.signature, self.bands = matrix("signature").astype(np.uint64), matrix("bands")
        block = column("block").to_numpy()
        self.left = np.flatnonzero(block == p)
        self.right = self.left if p == q else np.flatnonzero(block == q)

    def partners(self, i: int) -> np.ndarray:
        """Members of other components that are similar enough to ``i``, the most similar first.

        A pair is looked at in the first band that it shares.
        """
        odd, chance = np.uint64(0x5555555555555555), 1 / (1 << BITS)
        later = (self.right > i) | (self.left is not self.right)
        others = self.right[(self.component[self.right] != self.component[i]) & later]
        if not len(others):
            return others
        x = self.signature[others] ^ self.signature[i]
        differing = np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=1)
        near = ((1 - differing / HASHES) - chance) / (1 - chance)
        good = near >= self.floor
        others, near = others[good], near[good]
        if not len(others):
            return others
        first = self.bands[i][(self.bands[others] == self.bands[i]).argmax(axis=1)] == self.band
        return others[first][np.argsort(-near[first], kind="stable")]


def _links_in_block(block: _Block, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components, enough to connect all that are linked."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    links = []
    for i in block.left:
        for j in block.partners(i):
            a, b = root(block.component[i]), root(block.component[j])
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(a, b)] = min(a, b)
                links.append((int(block.ids[i]), int(block.ids[j])))
    return links


def _linked_in_blocks(rows: DataFrame, sets: DataFrame, percent: int, floor: float) -> DataFrame:
    """Links (a, b) inside bands, from (band, id, component, signature, bands, n_shingles) and (id, shingles).

    Members outside a band's largest component meet all others, block by block
    (a small band is one block): what a task holds is bounded, and it sends
    links, not pairs. Signatures go first; the sets follow only for members
    with a partner that is similar enough.
    """
    whole = (F.col("n") <= BLOCK_SETS) & (F.col("s") <= BLOCK_SHINGLES)
    parts = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_SETS, s / BLOCK_SHINGLES)).cast("int")
    shape = (
        parts.groupBy("band")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("most"))
        .select(
            "band",
            F.when(~whole, F.col("most.component")).alias("main"),
            F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s"))).alias("k"),
            F.when(whole, 0).otherwise(blocks(F.col("most.n"), F.col("most.s"))).alias("l"),
        )
    )
    minor = F.coalesce(F.col("component") != F.col("main"), F.lit(True))
    placed = rows.join(shape, "band").withColumn("minor", minor)
    block = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("k")).otherwise(F.col("l"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("minor"), block).otherwise(F.col("k") + block))
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    meets = F.when(
        F.col("minor"),
        F.transform(
            F.sequence(F.lit(0), F.col("k") + F.col("l") - 1), lambda j: pair(F.least(F.col("block"), j), F.greatest(F.col("block"), j))
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: pair(i, F.col("block"))))
    names = ["band", "p", "q", "id", "component", "signature", "bands", "block"]
    met = placed.withColumn("meet", F.explode(meets)).select("band", "meet.p", "meet.q", *names[3:])

    def with_partner(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(key, table, floor)
        wanted = np.zeros(table.num_rows, bool)
        for i in block.left:
            if len(found := block.partners(i)):
                wanted[i] = True
                wanted[found] = True
        return table.select(names).filter(pa.array(wanted))

    kinds = "band bigint, p int, q int, id bigint, component bigint, signature array<bigint>, bands array<bigint>, block int"
    hopeful = cut(met.groupBy("band", "p", "q").applyInArrow(with_partner, kinds)).join(sets, "id")

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = table.column("shingles").combine_chunks()
        edges = lists.offsets.to_numpy()
        values = lists.flatten().to_numpy()
        each = [values[a - edges[0] : b - edges[0]] for a, b in zip(edges, edges[1:])]
        links = _links_in_block(_Block(key, table, floor), each, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return hopeful.groupBy("band", "p", "q").applyInArrow(join, "a bigint, b bigint")


def near_groups(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, group_id, component_id: ``near_duplicates`` before its verdict.

    group_id is the same for linked rows only; null where the row takes part in nothing.

    First every class is compared with the most similar one among the centres
    and the smallest members of its bands; components of these links settle most
    bands. In bands that still hold several components, pairs across components
    are estimated and, unless far below the limit, confirmed, inside blocks.
    """
    features = cut(set_features(documents, width))
    classes = cut(
        features.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("least"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        )
        .withColumn("id", F.xxhash64("set_a", "set_b"))
    )
    members = classes.select("id", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low")).filter("size > 1")
    members = cut(members.join(sizes, "band"))
    # A text from which others were made stands in the largest bands of its copies.
    weights = cut(members.groupBy("id").agg(F.sum("size").alias("weight")))
    centres = (
        members.join(weights, "id")
        .groupBy("band")
        .agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("centre"))
        .select("band", (-F.col("centre.minus")).alias("centre"))
    )
    signed = classes.select("id", "signature")
    wanted = weights.select("id").join(classes.select("id", "least.*"), "id")
    sets = cut(
        shingle_sets(
            documents.select("doc_id", text_key(), "text").join(wanted, ["doc_id", "text_key"]), width
        ).dropDuplicates(["id"])
    )
    floor = percent / 100 - SLACK

    spokes = (
        members.join(centres, "band")
        .select("id", F.explode(F.array("centre", "low")).alias("other"))
        .filter("id != other")
        .distinct()
    )
    best = (
        spokes.join(signed.withColumnRenamed("signature", "s"), "id")
        .join(signed.select(F.col("id").alias("other"), F.col("signature").alias("t")), "other")
        .withColumn("near", estimate(F.col("s"), F.col("t")))
        .filter(F.col("near") >= floor)
        .groupBy("id")
        .agg(F.max(F.struct("near", (-F.col("other")).alias("minus"))).alias("best"))
        .select(F.least("id", -F.col("best.minus")).alias("a"), F.greatest("id", -F.col("best.minus")).alias("b"))
        .distinct()
    )
    links = cut(_confirmed(best, sets, percent))
    found = components(links)

    labelled = members.join(found, "id", "left").select(
        "band", "id", F.coalesce("component_id", "id").alias("component")
    )
    open_bands = (
        labelled.groupBy("band")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .filter("x < y")
        .select("band")
    )
    opened = cut(labelled.join(open_bands, "band").join(classes.select("id", "signature", "bands", "n_shingles"), "id"))
    more = cut(_linked_in_blocks(opened, sets, percent, floor))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    grouped = cut(
        classes.select("id", "set_a", "set_b", "least.doc_id")
        .join(found, "id", "left")
        .select("set_a", "set_b", "doc_id", F.coalesce("component_id", "id").alias("group_id"))
    )
    lowest = grouped.groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    of_class = grouped.drop("doc_id").join(lowest, "group_id")
    judged = features.select("doc_id", "text_key", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    has_id = F.col("doc_id").isNotNull()
    return judged.select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(has_id, F.col("group_id")).alias("group_id"),
        F.when(has_id, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents``.

    Documents are linked if the Jaccard similarity of their sets of
    ``width``-word shingles (A-Z lower-cased) is at least ``percent``. A text
    with fewer words is one shingle; without words the set is empty and linked
    with nothing. component_id is the smallest doc_id reachable, the row's own
    where it has no link; kept means that it is the row's own. Rows without a
    doc_id take part in nothing and are kept. Rows with one doc_id and
    different texts are judged each for itself; linked to each other, both are
    kept if the id is the smallest. Texts of any length are taken whole, other
    columns are ignored, and an empty table gives no row.
    """
    return near_groups(documents, width, percent).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
