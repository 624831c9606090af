"""Centroid clustering with block-norm screening.

Vectors become whole numbers once and are written with the norms of their
segments. Of a vector x and a centroid c the segment norms give, by the
Cauchy-Schwarz inequality, a lower bound of the squared distance:

    |x - c|^2  >=  sum over segments s of (|x_s| - |c_s|)^2

A round reads these compressed forms first: the centroid of the smallest bound
gets its exact whole-number distance, which rules out every centroid whose bound
lies above it; only the others get exact distances. The bound is taken less a
margin for rounding, so no centroid that could win or tie is ever left out.

Every round is one pass over the written table. A task sends one row a centroid
and component, whatever it has read, and what returns to the driver is as long
as the centroids are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

DIMENSION, SEGMENTS, SCALE = 64, 8, 1024
CLUSTERS, ROUNDS = 8, 10
#: Components must lie below this, so that distances fit in 64 bits.
LARGEST = float(1 << 17)
#: Share of a bound's magnitude that rounding may take.
_MARGIN = 1e-12


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _norms(q: np.ndarray, segments: int) -> np.ndarray:
    return np.sqrt(np.square(q.astype(np.float64)).reshape(len(q), segments, -1).sum(2))


def _compress(scale: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), np.float64)
            if np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component is not below {LARGEST:.0f}")
            q = np.floor(x * scale).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), pa.array(q.reshape(-1)))
            norms = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * segments, pa.int32()), pa.array(_norms(q, segments).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), whole, norms], names=["vec_id", "q", "norms"])

    return run


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (ties: the
    smaller number), and how many exact distances were computed."""
    own = _norms(centroids, norms.shape[1])
    bound = np.square(norms[:, None, :] - own[None]).sum(2)
    bound -= _MARGIN * np.square(norms[:, None, :] + own[None]).sum(2)
    rows = np.arange(len(q))
    first = bound.argmin(1)
    distance = np.square(q - centroids[first]).sum(1)
    upper, cluster, exact = distance.astype(np.float64), first.copy(), len(q)
    for c in range(len(centroids)):
        open_ = rows[(bound[:, c] <= upper) & (first != c)]
        exact += len(open_)
        d = np.square(q[open_] - centroids[c]).sum(1)
        better = (d < distance[open_]) | ((d == distance[open_]) & (c < cluster[open_]))
        distance[open_[better]], cluster[open_[better]] = d[better], c
        upper[open_[better]] = d[better]
    return cluster, distance, exact


def _batch(b: pa.RecordBatch, centroids: np.ndarray):
    q = _matrix(b.column(1), np.int64)
    return q, *nearest(q, _matrix(b.column(2), np.float64), centroids)[:2]


def _sums(centroids: np.ndarray):
    """A task's count and sums: a row a centroid and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q, cluster, _ = _batch(b, centroids)
            counts += np.bincount(cluster, minlength=k)
            for c in range(k):
                sums[c] += q[cluster == c].sum(0)
        if counts.any():
            at = np.repeat(np.arange(k), width), np.tile(np.arange(width), k)
            columns = [pa.array(x.astype(np.int32)) for x in at] + [pa.array(np.repeat(counts, width)), pa.array(sums.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "d", "n", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, cluster, distance = _batch(b, centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, segments: int = SEGMENTS, scale: int = SCALE, seed: str = "3"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for every
    vector with ``dimension`` components, none null or non-finite.

    Components x become floor(scale * x). Centroids start as the vectors with the
    smallest SHA-256 of "seed:vec_id"; in each round every vector goes to the
    nearest centroid (ties: the smaller number), and a centroid that has vectors
    becomes their componentwise floor of the mean, exactly.

    Defined cases: null vectors, vectors of another length and vectors with a
    null or non-finite component are left out; rows that repeat count each for
    itself, and two of them may be two centroids, of which the second stays
    empty; vectors without an id take part, and start as centroids only where
    too few have one; with fewer vectors than ``clusters`` there are as many
    centroids as vectors; a component of 131072 or more in absolute value
    raises; an inertia beyond a long is null; other columns are ignored; an
    empty table gives an empty result.
    """
    if dimension % segments:
        raise ValueError("segments must divide the dimension")
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.where((F.size("x") == dimension) & F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    held = table(v.mapInArrow(_compress(scale, segments), "vec_id long, q array<int>, norms array<double>"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = held.select("q", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()  # as many rows as centroids
    kept = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not start:
        drop(held)
        return spark.createDataFrame([], kept)
    centroids = np.array([r["q"] for r in start], np.int64)
    for _ in range(rounds):
        sums = held.mapInArrow(_sums(centroids), "cluster int, d int, n long, total long")
        whole = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        for r in sums.groupBy("cluster", "d").agg(F.sum("n").alias("n"), whole).collect():  # one row a centroid and component
            if r["n"]:
                centroids[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
    found = table(held.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    drop(held)
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(s), fits(sum(inertia.values())), centroids[c].tolist()) for c, s in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
