"""Integer k-means whose searches are filtered by n-simplex projection.

The distances of a vector to n pivots fix the apex of a simplex over the pivots: n coordinates, found by one triangular
solve and cached for all rounds. The Euclidean distance of two apexes is a lower bound of the distance of the vectors;
with the sign of the last coordinate turned it is an upper bound. A centroid whose lower bound lies above the smallest
upper bound cannot be nearest; the others are compared by exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenflow.llm.store import in_batches, stored

PIVOTS = 8
LARGEST = 1 << 26  # of an integer component: squared distances of 64 of them fit a long
SLACK = 1e-9  # of the squares involved, for rounding


class Simplex:
    """Base simplex of some integer pivots. Pivots that add no new direction are left out."""

    def __init__(self, pivots: np.ndarray):
        chosen, corners = [], np.zeros((0, 0))
        for p in pivots:
            d = ((pivots[chosen] - p) ** 2).sum(axis=1).astype(float)
            if not chosen:
                chosen.append(len(chosen))
                continue
            apex = self._apexes(corners, d[None, :])[0]
            if apex[-1] > 1e-3 * np.sqrt(d.max(initial=1.0)):
                corners = np.vstack([np.hstack([corners, np.zeros((len(corners), 1))]), apex]) if len(corners) else apex[None, :]
                chosen.append(int(np.flatnonzero((pivots == p).all(axis=1))[0]))
        self.pivots, self.corners = pivots[chosen], corners

    @staticmethod
    def _apexes(corners: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Apexes from squared distances (rows) to the pivots: the first is the origin, the rest ``corners`` (triangular)."""
        if not len(corners):
            return np.sqrt(squares[:, :1])
        right = ((corners ** 2).sum(axis=1) + squares[:, :1] - squares[:, 1:]) / 2
        base = np.linalg.solve(corners, right.T).T
        return np.hstack([base, np.sqrt(np.maximum(squares[:, :1] - (base ** 2).sum(axis=1, keepdims=True), 0))])

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        squares = np.stack([squared(vectors, p) for p in self.pivots], axis=1).astype(float)
        return self._apexes(self.corners, squares)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to a point."""
    d = vectors - point
    return np.einsum("ij,ij->i", d, d)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of every vector's nearest centroid (ties: the smaller), and exact comparisons made."""
    base = (apexes[:, None, :-1] - tops[None, :, :-1]) ** 2
    base = base.sum(axis=2)
    low = base + (apexes[:, -1:] - tops[None, :, -1]) ** 2
    high = base + (apexes[:, -1:] + tops[None, :, -1]) ** 2
    scale = (apexes ** 2).sum(axis=1)[:, None] + (tops ** 2).sum(axis=1)[None, :]
    possible = low - SLACK * scale - 1 <= (high + SLACK * scale + 1).min(axis=1, keepdims=True)
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    cluster = np.zeros(len(vectors), dtype=np.int64)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero(possible[:, number])
        exact = squared(vectors[rows], centroid)
        nearer = exact < best[rows]
        best[rows[nearer]], cluster[rows[nearer]] = exact[nearer], number
    return cluster, best, int(possible.sum())


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width)


def _project(simplex: Simplex):
    """(vec_id, v) -> (vec_id, v, apex)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        apex = simplex.apexes(_matrix(batch.column(1), simplex.pivots.shape[1], np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns, _lists(apex, pa.float64())], names=["vec_id", "v", "apex"])
    return in_batches(run)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel(), kind))


def _sums(simplex: Simplex, centroids: np.ndarray):
    """Cached vectors -> per task and cluster: vectors and component sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, width = simplex.apexes(centroids), centroids.shape[1]
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), width, np.int64)
            cluster, _, _ = nearest(v, _matrix(batch.column(2), tops.shape[1], float), centroids, tops)
            count += np.bincount(cluster, minlength=len(centroids))
            for c in np.unique(cluster).tolist():
                total[c] += v[cluster == c].sum(axis=0)
        own = np.flatnonzero(count)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own]), _lists(total[own], pa.int64())], names=["cluster", "n", "total"])
    return run


def _assign(simplex: Simplex, centroids: np.ndarray):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tops = simplex.apexes(centroids)
        cluster, distance, _ = nearest(_matrix(batch.column(1), centroids.shape[1], np.int64), _matrix(batch.column(2), tops.shape[1], float),
                                       centroids, tops)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
    return in_batches(run)


def integer_vectors(embeddings: DataFrame, width: int, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component of usable vectors."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == width)
    usable = F.forall("x", lambda e: F.coalesce(F.abs(e) * scale < LARGEST, F.lit(False)))  # a NaN is larger than any number
    return rows.where(usable).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def simplex_clusters(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1,
                     pivots: int = PIVOTS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable row (vec_id, embedding).

    Usable vectors have exactly ``width`` components, none null or non-finite, and none whose integer
    floor(scale * x) would leave +-2^26, where squared distances might not fit a long; other rows are left out. First
    centroids are the rows with the smallest sha256 of ``seed:vec_id`` (null ids last; equal ids by their vectors);
    fewer rows than ``clusters`` make fewer centroids. Each round moves the centroids that have vectors to
    floor(sum / count). Repeated rows count as often as they occur. inertia sums squared distances over a cluster and
    over all; a sum that fits no long is null. An empty table gives no rows. Other columns are not read.

    The driver holds the centroids and pivots only; a task sends one row of sums per cluster.
    """
    spark = embeddings.sparkSession
    vectors = stored(integer_vectors(embeddings, width, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "v").limit(clusters).collect()
    out = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    simplex = Simplex(centroids[:pivots])
    cached = stored(vectors.mapInArrow(_project(simplex), "vec_id long, v array<long>, apex array<double>"))
    for _ in range(rounds):
        parts = cached.mapInArrow(_sums(simplex, centroids), "cluster long, n long, total array<long>")
        sums = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total"))
        for row in sums.collect():  # a row per cluster and component
            centroids[row["cluster"], row["pos"]] = row["total"] // row["n"]
    assigned = stored(cached.mapInArrow(_assign(simplex, centroids), out))
    own = {r["cluster"]: int(r["own"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    total = sum(own.values())
    rows = [(c, _long(own[c]), _long(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(own)]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row per cluster
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None
