"""Near-duplicate vectors by an epsilon grid order join.

On unit vectors, cosine >= c means a distance of at most eps = sqrt(2 - 2c).
Vectors are sorted by label and by the eps-wide grid cells of their leading
principal coordinates and cut into sequence intervals. Two intervals meet if
they hold vectors in neighbouring cells whose boxes in these coordinates are
within eps of each other; others can't hold a link. Intervals that meet are
joined by recursive halving, with the same test at every step.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut
from tracewell.llm.components import components

LEADING = 4
#: Numbers and vectors in an interval at most, and vectors in a piece that is compared by one matrix product.
#: Longer intervals meet fewer others, so that each vector is sent less often.
INTERVAL_NUMBERS, INTERVAL, PIECE = 1 << 18, 4096, 128
#: Principal directions are fitted on this many vectors (smallest hash of vec_id); they decide only what is skipped.
FIT_ROWS = 10_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    """The rows with length 1; they are scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _directions(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Leading principal directions for each number of dimensions."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").toArrow().column(0)
    by_size: dict[int, list] = {}
    for vector in sample.to_pylist():
        by_size.setdefault(len(vector), []).append(vector)
    out = {}
    for size, some in by_size.items():
        units = _units(np.array(some, np.float64))
        _, axes = np.linalg.eigh(np.cov(units.T, ddof=0).reshape(size, size))
        out[size] = np.ascontiguousarray(axes[:, ::-1][:, :LEADING])
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows that can be linked: an id, a label, and a finite vector other than zero."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.filter(
        "vec_id is not null and label is not null and embedding is not null"
    ).select("vec_id", "label", vector.alias("embedding")).filter(finite & F.exists("embedding", lambda x: x != 0))


def _intervals(vectors: DataFrame, epsilon: float, directions: dict[int, np.ndarray]) -> DataFrame:
    """The vectors in epsilon grid order, with their interval and leading coordinates."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.zeros((batch.num_rows, LEADING))
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = _matrix(batch.column("embedding").take(pa.array(at)))
                axes = directions.get(int(size), np.eye(int(size))[:, :LEADING])
                lead[at, : axes.shape[1]] = _units(rows) @ axes
            cells = np.floor(lead / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in ("vec_id", "label", "embedding")],
                    pa.array(sizes.astype(np.int32)),
                    pa.array(lead.tolist(), pa.list_(pa.float64())),
                    pa.array(cells.tolist(), pa.list_(pa.int64())),
                ],
                names=["vec_id", "label", "embedding", "size", "lead", "cells"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    fields = f"vec_id {kinds['vec_id']}, label {kinds['label']}, embedding array<double>, size int, lead array<double>"
    ordered = vectors.mapInArrow(place, fields + ", cells array<bigint>")
    order = ["label", "size", "cells", "lead", "vec_id"]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).drop("cells")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, before = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            blocks = []
            for key in zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()):
                if key != before or filled >= min(INTERVAL, INTERVAL_NUMBERS // max(key[1], 1) + 1):
                    block, filled, before = block + 1, 0, key
                filled += 1
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "block"])

    return ordered.mapInArrow(number, fields + ", block bigint")


def _interval_pairs(placed: DataFrame, epsilon: float) -> DataFrame:
    """(a, b), a <= b: intervals of one label that hold vectors in neighbouring cells with boxes within epsilon.

    An interval has a box in each cell that it covers; boxes meet on the cell,
    each sent to its own cell and to all next to it.
    """
    lead = [f"{n}{i}" for i in range(LEADING) for n in ("lo", "hi")]
    boxes = (
        placed.withColumn("cell", F.transform("lead", lambda x: F.floor(x / epsilon).cast("bigint")))
        .groupBy("label", "size", "block", "cell")
        .agg(*[f(F.get("lead", i)).alias(f"{n}{i}") for i in range(LEADING) for n, f in (("lo", F.min), ("hi", F.max))])
    )
    steps = F.array(*[F.array(*map(F.lit, step)) for step in itertools.product((-1, 0, 1), repeat=LEADING)])
    two = boxes.withColumn("step", F.explode(steps)).select(
        "label",
        "size",
        F.zip_with("cell", "step", lambda c, s: c + s).alias("cell"),
        *[F.col(c).alias("b_" + c) for c in ["block", *lead]],
    )
    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"hi{i}")), 2)
        for i in range(LEADING)
    )
    near = boxes.join(two, ["label", "size", "cell"]).filter("block <= b_block").filter(gap <= (epsilon * (1 + 1e-9)) ** 2)
    return near.select(F.col("block").alias("a"), F.col("b_block").alias("b")).distinct()


def join_intervals(
    one: np.ndarray, two: np.ndarray, lead_one: np.ndarray, lead_two: np.ndarray, epsilon: float, cosine: float, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of unit vectors at or above ``cosine``; i < j within one interval."""
    found_i, found_j = [], []

    def recurse(a: int, b: int, c: int, d: int) -> None:
        if same and d <= a:
            return
        gap = np.maximum(
            np.maximum(lead_one[a:b].min(0) - lead_two[c:d].max(0), lead_two[c:d].min(0) - lead_one[a:b].max(0)), 0
        )
        if (gap**2).sum() > (epsilon * (1 + 1e-9)) ** 2:
            return
        if b - a <= PIECE and d - c <= PIECE:
            i, j = np.nonzero(one[a:b] @ two[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
        elif b - a >= d - c:
            middle = (a + b) // 2
            recurse(a, middle, c, d)
            recurse(middle, b, c, d)
        else:
            middle = (c + d) // 2
            recurse(a, b, c, middle)
            recurse(a, b, middle, d)

    recurse(0, len(one), 0, len(two))
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))


def near_vectors(embeddings: DataFrame, cosine: float = 0.98, fit_rows: int = FIT_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``embeddings`` (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and their cosine in double
    precision is at least ``cosine``. Null, zero and non-finite vectors, null
    labels and null ids link with nothing, and so do vectors with different
    numbers of dimensions. n_links counts the vectors linked directly;
    component_id is the smallest vec_id reachable, the row's own without links;
    kept: it is the row's own, or the id is null. Rows that share a vec_id get
    the sum of their links each. Linked pairs are counted where they are found:
    two intervals send each other's counts and a spanning forest, never pairs.
    A cosine is at the limit if the double-precision product of the two unit
    vectors is. Other columns are ignored, whatever their names; an empty table
    gives no row.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    vectors = usable(embeddings)
    placed = cut(_intervals(vectors, epsilon, _directions(vectors, fit_rows)))
    pairs = _interval_pairs(placed, epsilon)
    sides = pairs.select(
        "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block")
    )
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        table = table.combine_chunks()
        blocks = table.column("block").to_numpy()
        units = _units(_matrix(table.column("embedding").combine_chunks()))
        lead = _matrix(table.column("lead").combine_chunks())
        ids = table.column("vec_id").to_numpy()
        parts = []
        for block in (a, b):
            at = np.flatnonzero(blocks == block)
            parts.append(at[np.lexsort((*lead[at].T[::-1], *np.floor(lead[at] / epsilon).T[::-1]))])
        i, j = join_intervals(
            units[parts[0]], units[parts[1]], lead[parts[0]], lead[parts[1]], epsilon, cosine, a == b
        )
        i, j = parts[0][i], parts[1][j]
        n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        root = ids.copy()
        while len(i):
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        at = np.flatnonzero(n)
        return pa.table({"vec_id": ids[at], "n": n[at].astype(np.int64), "root": root[at]})

    parts = cut(
        placed.select("vec_id", "embedding", "lead", "block")
        .join(sides, "block")
        .groupBy("a", "b")
        .applyInArrow(join, f"vec_id {kind}, n bigint, root {kind}")
    )
    counts = parts.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    found = components(parts.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    component = F.coalesce("component_id", "vec_id")
    return (
        embeddings.select("vec_id")
        .join(counts, "vec_id", "left")
        .join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            component.cast("bigint").alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        )
    )
