"""Whitening of embedding vectors by their principal components.

One aggregation of generated SQL expressions sums the centred products of every
pair of dimensions, the upper triangle of the covariance; LAPACK decomposes it.
Entries are whole numbers, so that the centre is exact: n * x - S has no error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import quoted

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Products summed by one aggregation: all pairs of 128 dimensions.
PRODUCTS = 8_256
#: Whole numbers beyond these are set to them.
BOUND = 1 << 62


@dataclass
class Whitening:
    """What is fitted on the vectors of one length: components are columns of axes, by falling eigenvalue."""

    n: int
    sums: list[int]
    widest: int  # no entry is further from 0
    covariance: np.ndarray
    axes: np.ndarray
    values: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        kind = np.int64 if self.n * self.widest < BOUND else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows; not a number for components without variance."""
        out = np.full((len(centred), len(self.values)), np.nan)
        real = self.values > 0
        out[:, real] = (centred.astype(np.float64) / self.n) @ (self.axes[:, real] / np.sqrt(self.values[real]))
        return out


def deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where a long can't hold one."""
    largest = int(np.abs(centred).max(initial=0))
    if centred.shape[1] * largest**2 < BOUND:
        return (centred * centred).sum(axis=1).tolist()
    exact = centred.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (exact * exact).sum(axis=1)]


def whole_numbers(embeddings: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, x (floor(64 * entry) + 1000000) and the size of vectors without null or non-finite entries."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    bound = float(BOUND // 2)
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))) + SHIFT)
    kept = [F.col(quoted(name)).alias(f"kept_{i}") for i, name in enumerate(keep)]
    return embeddings.filter(F.col("embedding").isNotNull() & finite).select(*kept, whole.alias("x"), F.size("embedding").alias("size"))


def upper_triangle(rows: DataFrame, columns: list[str], function: str) -> np.ndarray:
    """``function`` of every two columns, as a full matrix; one aggregation for every 8,256 pairs."""
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums: list[float] = []
    for at in range(0, len(pairs), PRODUCTS):
        products = [function.format(columns[i], columns[j]) for i, j in pairs[at : at + PRODUCTS]]
        sums += rows.agg(F.expr(f"array({', '.join(products)})").alias("sums")).first().sums
    matrix = np.zeros((size, size))
    for (i, j), value in zip(pairs, sums):
        matrix[i, j] = matrix[j, i] = value
    return matrix


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Fit on all vectors of one length of ``whole_numbers``; the driver holds size * size numbers."""
    own = vectors.filter(F.col("size") == size)
    sums = ", ".join(f"sum(cast(x[{i}] as decimal(20, 0)))" for i in range(size))
    first = own.agg(
        F.count("*").alias("n"),
        F.expr(f"array({sums})").alias("sums"),
        F.max(F.array_max(F.transform("x", F.abs))).alias("widest"),
    ).first()
    n, sums = first.n, [int(s) for s in first.sums]
    kind = "bigint" if n * first.widest < BOUND else "decimal(38, 0)"
    names = [f"c{i}" for i in range(size)]
    centred = [
        F.expr(f"cast(cast(x[{i}] as {kind}) * cast('{n}' as {kind}) - cast('{s}' as {kind}) as double) / {n}D").alias(name)
        for i, (name, s) in enumerate(zip(names, sums))
    ]
    covariance = upper_triangle(own.select(*centred), names, "sum({} * {})") / n
    values, axes = np.linalg.eigh(covariance)
    # What is below this is rounding alone.
    values = np.where(values > size * np.finfo(float).eps * max(values[-1], 0), values, 0)
    return Whitening(n, sums, first.widest, covariance, axes[:, ::-1][:, :components], values[::-1][:components])


def whitened(vectors: DataFrame, size: int, fitted: Whitening, keep: int) -> DataFrame:
    """The first ``keep`` columns, deviation and the array whitened of the vectors of one length."""
    names = [f"kept_{i}" for i in range(keep)]
    own = vectors.filter(F.col("size") == size).select(*names, "x")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema][:keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(keep).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            centred = fitted.centred(x)
            rows = fitted.project(centred)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            arrays = [*batch.columns[:keep], pa.array(deviations(centred), pa.int64())]
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "deviation", "whitened"])

    return own.mapInArrow(run, ", ".join([*kinds, "deviation bigint", "whitened array<double>"]))


def identity_error(rows: DataFrame, fitted: Whitening) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity; None where nothing varies."""
    real = np.flatnonzero(fitted.values > 0).tolist()
    if not real:
        return None
    names = [f"w{i}" for i in real]
    columns = rows.select(*[F.expr(f"whitened[{i}]").alias(name) for i, name in zip(real, names)])
    return float(np.abs(upper_triangle(columns, names, "covar_pop({}, {})") - np.eye(len(real))).max())


def whiten(embeddings: DataFrame, keep: list[str], components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, up to ``components`` of them.

    Returns the columns ``keep`` and component (from 1, by falling eigenvalue),
    n (vectors that were fitted on), deviation (sum over dimensions of
    (n * x - S)^2, exact; null where a long can't hold it), whitened (x - S / n on
    the component, over the root of its eigenvalue), explained (its share of the
    variance) and identity_error (one value: how far the covariance of what is
    returned is from the identity).

    Rows whose vector is null or holds null or non-finite entries are dropped;
    empty vectors have no components. Vectors of different lengths are fitted
    apart, with one pass of the driver for each length. Repeated rows and null
    ids are vectors like others. A component without variance has a null
    whitened and a zero explained; if nothing varies, explained and
    identity_error are null. Entries beyond 2^55 count as 2^55. An empty table
    has no rows. Columns outside ``keep`` play no part.
    """
    vectors = whole_numbers(embeddings, keep)
    sizes = sorted(r[0] for r in vectors.select("size").distinct().collect() if r[0])
    added = {"component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    kept = [F.col(f"kept_{i}").alias(name) for i, name in enumerate(keep)]
    frames = []
    for size in sizes:
        fitted = fit(vectors, size, components)
        rows = whitened(vectors, size, fitted, len(keep))
        trace = float(np.trace(fitted.covariance))
        error = identity_error(rows, fitted)
        each = F.arrays_zip(
            F.col("whitened"),
            F.array(*[F.lit(float(v) / trace if trace else None).cast("double") for v in fitted.values]).alias("explained"),
        )
        frames.append(
            rows.select("*", F.posexplode(each).alias("place", "one")).select(
                *kept,
                (F.col("place") + 1).alias("component"),
                F.lit(fitted.n).cast("bigint").alias("n"),
                "deviation",
                F.nullif("one.whitened", F.lit(float("nan"))).alias("whitened"),
                F.col("one.explained").alias("explained"),
                F.lit(error).cast("double").alias("identity_error"),
            )
        )
    if frames:
        return reduce(DataFrame.unionByName, frames)
    return vectors.filter("false").select(*kept, *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()])
