"""Whitening of embeddings: moments merged pairwise, one decomposition, one check.

Vectors become integers, and each distinct one counts once. A partition goes
through its vectors in batches and leaves one row: count, mean and the scatter
around that mean. Two such rows make one by Chan's formula, which needs no common
centre and loses no digits, so a tree of merges gives the covariance of all; what
is merged is as large as one matrix, however many vectors there are. The driver
decomposes that matrix. A second pass whitens the fitted vectors, merges their
moments the same way and says how far the covariance is from the identity.

Vectors of another length are another space: each length has its own model.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import cut

#: Entries beyond this size have no exact cell; vectors holding one are left out.
LARGEST = float(1 << 50)


@dataclass
class Moments:
    """Count, mean and scatter around the mean of some vectors; ``sums`` are exact where they are integers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        sums = rows.sum(axis=0)
        mean = sums / len(rows)
        apart = rows - mean
        return cls(len(rows), mean, apart.T @ apart, sums)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters add up, and the distance of the means counts as one more direction."""
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, self.sums + other.sums)


@dataclass
class Whitening:
    """The model of one vector length: ``n`` distinct vectors of sums ``sums``, eigenvalues falling, components as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @classmethod
    def of(cls, moments: Moments, most: int) -> Whitening:
        covariance = moments.scatter / moments.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:most]
        return cls(moments.n, moments.sums, values[order], vectors[:, order], float(np.trace(covariance)))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: the vectors' distance from the mean, times n."""
        return self.n * x - self.sums

    def scales(self) -> np.ndarray:
        """What a projection is multiplied by; zero for a direction in which nothing varies."""
        flat = self.values <= max(self.trace, 0.0) * 1e-13
        return np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, self.values)))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ self.components * self.scales()

    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros_like(self.values)


def cells(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry as a double; null where the vector is null or holds an entry that is null, not finite or beyond LARGEST."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) > LARGEST))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long") + shift))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of each length as a matrix, with their rows."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        yield int(dims), rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _merge(one: dict[int, Moments], other: dict[int, Moments]) -> dict[int, Moments]:
    return one | {d: one[d].merged(m) if d in one else m for d, m in other.items()}


def moments(vectors: DataFrame, made: Callable[[int, np.ndarray], np.ndarray] = lambda dims, x: x) -> dict[int, Moments]:
    """The moments of the vectors in column ``x``, as ``made`` gives them, for each length; one matrix a partition, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for dims, _, rows in _by_length(batch.column(0)):
                found = _merge(found, {dims: Moments.of(made(dims, rows))})
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)])], ["found"])

    parts = vectors.select("x").mapInArrow(run, "found binary").rdd.map(lambda r: pickle.loads(r[0]))
    return parts.treeReduce(_merge, depth=3) if not parts.isEmpty() else {}


def fit(df: DataFrame, vector_col: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> dict[int, Whitening]:
    """The whitening of each vector length, from its distinct vectors of cells; empty vectors have none.

    Eigenvectors are of unit length, of either sign, by falling eigenvalue;
    ``identity_error`` is the largest entry of the whitened vectors' covariance
    less the identity, over the directions that vary. Null vectors and those that
    ``cells`` makes null are left out.
    """
    rows = df.select(cells(F.col(vector_col), scale, shift).alias("x")).filter("x is not null and size(x) > 0")
    distinct = cut(rows.distinct())
    models = {dims: Whitening.of(m, most) for dims, m in moments(distinct).items()}
    for dims, m in moments(distinct, lambda dims, x: models[dims].whiten(x)).items():
        ideal = np.diag((models[dims].scales() > 0).astype(np.float64))
        models[dims].identity_error = float(np.abs(m.scatter / m.n - ideal).max())
    return models


def whiten(df: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row (id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    ``deviation`` is the sum over dimensions of (n * x - S)^2 in whole numbers (it
    wraps beyond 64 bits), ``whitened`` the projection of x - S / n over the
    root of the eigenvalue, 0 where nothing varies. Vectors that are null, empty,
    hold null, non-finite or too large entries, or have a length without a model,
    give no rows; repeated rows and null ids do. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), cells(F.col(vector_col), scale, shift).alias("x")).filter("x is not null and size(x) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, x in _by_length(batch.column(1)):
                if dims not in models:
                    continue
                model = models[dims]
                k, n = len(model.values), len(x)
                apart = model.deviations(x)
                each = lambda values: pa.array(np.repeat(values, k))
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, np.int64)), each((apart * apart).sum(axis=1))]
                columns += [pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained(), n)), pa.array(np.full(n * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
