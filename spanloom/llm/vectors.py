"""Vector tables: validity, bounded samples, blocks, k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are non-null, of ``dim`` finite components and not zero; those rows as a float64 matrix."""
    size = np.array(column.value_lengths().fill_null(-1))
    ok = size == dim
    flat = column.filter(pa.array(ok)).flatten()
    m = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) if len(flat) else np.empty((0, dim))
    good = np.isfinite(m).all(1) & (np.abs(m) > 0).any(1)  # null components come as NaN
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, m[good]


def dimension(table: DataFrame, vec_col: str) -> int:
    """The most frequent vector length (ties: the smaller); 0 without vectors."""
    top = table.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(top[0]) if top else 0


def packed(table: DataFrame, id_col: str, vec_col: str, dim: int, unit: bool) -> DataFrame:
    """(id, v): usable vectors as float64 bytes, of norm 1 if ``unit``. Rows with a null id are left out."""
    small_batches(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, m = usable(batch.column(1), dim)
            if unit and len(m):
                m = m / np.abs(m).max(1, keepdims=True)
                m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in m], pa.binary())], ["id", "v"])

    return table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("e")).mapInArrow(run, "id bigint, v binary")


def sample(vectors: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those with the least id hashes."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()
    return np.stack([np.frombuffer(r[0]) for r in rows]) if rows else np.empty((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T * -2 + (centres**2).sum(1)).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, c, len(centres)) for c in x.T], 1)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row by its largest component, so that no square overflows."""
    return x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
