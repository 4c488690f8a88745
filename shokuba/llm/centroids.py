"""Centroid clustering of integer vectors; Ptolemy's inequality over fixed pivots leaves out most exact distances."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import stage

_ROWS = 2048  # vectors whose bounds are held at once
_EDGE = 2**27  # components below this keep every squared distance of 64 components, and all sums of it, in a long
_SLACK = 2.0**-46  # over all rounding of the few float operations of a bound, relative to its terms


def integer_vectors(vectors: DataFrame, size: int = 64, scale: int = 256, column: str = "embedding") -> DataFrame:
    """vec_id, q (array<long>): each component x of the kept vectors as floor(scale * x), x as double.

    Kept are vectors of `size` components, none null, NaN or infinite. A component of 2^27 or more after scaling, where
    squared distances no longer fit a long, is an error.
    """
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.filter((F.size(x) == size) & finite)
        .select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))
        .withColumn("q", F.when(F.forall("q", lambda v: F.abs(v) < _EDGE), F.col("q")).otherwise(F.raise_error(F.lit("a vector's components are too large for distances in a long"))))
    )


def first_centroids(points: DataFrame, k: int = 40, seed: int = 2) -> list[list[int]]:
    """The `k` vectors with the smallest SHA-256 of `seed:vec_id`, in this order; a null vec_id counts as empty text.

    Rows that repeat a vec_id follow each other by their components. With fewer than `k` vectors all are centroids.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["q"] for r in points.select(name.alias("name"), "q").orderBy("name", "q").limit(k).collect()]


def choose_pivots(centroids: list[list[int]], n: int = 6) -> np.ndarray:
    """Up to `n` different ones of the first centroids: each is the farthest from those before it, from the first on."""
    c = np.unique(np.array(centroids, np.int64), axis=0)
    picked = [0]
    while len(picked) < min(n, len(c)):
        near = np.min([((c - c[p]) ** 2).sum(1) for p in picked], axis=0)
        picked.append(int(near.argmax()))
    return c[picked]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; their squares are exact integers, so each is off by a rounding or two."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1).astype(np.float64))


class Nearest:
    """The nearest centroid of vectors by exact integer distances, smaller number on ties.

    For vector x, centroid c and pivots p, s: d(x,c) >= |d(x,p) d(c,s) - d(x,s) d(c,p)| / d(p,s). The bound is lowered by
    more than its rounding, and a centroid is left out only where it lies above an exact distance already known.
    """

    def __init__(self, centroids: list[list[int]], pivots: np.ndarray):
        self.centroids, self.pivots = np.array(centroids, np.int64), pivots
        self.at = to_pivots(self.centroids, pivots)
        apart = to_pivots(pivots, pivots)
        self.pairs = [(p, s, apart[p, s]) for p, s in combinations(range(len(pivots)), 2)]

    def lower_bounds(self, to_pivot: np.ndarray) -> np.ndarray:
        """Squared bounds, never above the squared distances: one row for each vector, one column for each centroid."""
        best = np.zeros((len(to_pivot), len(self.centroids)))
        for p, s, apart in self.pairs:
            a, b = np.outer(to_pivot[:, p], self.at[:, s]), np.outer(to_pivot[:, s], self.at[:, p])
            np.maximum(best, (np.abs(a - b) - (a + b) * _SLACK) / apart, out=best)
        return best * best * (1 - _SLACK)

    def __call__(self, x: np.ndarray, to_pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Centroid and squared distance of each row of `x`, and how many exact distances were needed."""
        low, rows = self.lower_bounds(to_pivot), np.arange(len(x))
        cluster = low.argmin(1)
        distance = ((x - self.centroids[cluster]) ** 2).sum(1)
        left = low <= distance[:, None]
        left[rows, cluster] = False
        needed = len(x) + int(left.sum())
        for c in np.flatnonzero(left.any(0)).tolist():
            i = np.flatnonzero(left[:, c] & (low[:, c] <= distance))
            d = ((x[i] - self.centroids[c]) ** 2).sum(1)
            better = (d < distance[i]) | ((d == distance[i]) & (c < cluster[i]))
            cluster[i[better]], distance[i[better]] = c, d[better]
        return cluster, distance, needed


def _blocks(batches):
    """Ids, vectors and distances to pivots of the rows of `cached`, a bounded number at a time."""
    for b in batches:
        for i in range(0, b.num_rows, _ROWS):
            part = b.slice(i, _ROWS)
            x = np.frombuffer(b"".join(part.column("q").to_pylist()), "<i4").reshape(part.num_rows, -1).astype(np.int64)
            near = np.frombuffer(b"".join(part.column("near").to_pylist()), "<f8").reshape(part.num_rows, -1)
            yield part.column("vec_id"), x, near


def cache_distances(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, q and near: vectors and their distances to the pivots as bytes, computed once for all rounds."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("q").values.to_numpy()[b.column("q").offsets[0].as_py() :][: sum(map(len, b.column("q")))].reshape(b.num_rows, -1)
                near = to_pivots(x, pivots)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in near.astype("<f8")], pa.binary())], names=["vec_id", "q", "near"]
                )

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.select("vec_id", "q").mapInArrow(run, f"vec_id {kind}, q binary, near binary")


def assign(cached: DataFrame, nearest: Nearest) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches):
        for ids, x, near in _blocks(batches):
            cluster, distance, _ = nearest(x, near)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = cached.schema["vec_id"].dataType.simpleString()
    return cached.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster_sums(cached: DataFrame, nearest: Nearest) -> DataFrame:
    """cluster, n, needed and totals (an array of exact sums): each task adds up what it reads and sends a row a cluster."""

    def run(batches):
        k, size = nearest.centroids.shape
        sums, n, needed = np.zeros((k, size), object), np.zeros(k, np.int64), 0
        for _, x, near in _blocks(batches):
            cluster, _, work = nearest(x, near)
            part = np.zeros((k, size), np.int64)
            np.add.at(part, cluster, x)  # 2048 components below 2^27: far from the end of a long
            sums += part
            n += np.bincount(cluster, minlength=k)
            needed += work
        c = np.flatnonzero(n)
        if len(c):
            rows = [list(map(str, sums[i].tolist())) for i in c]
            work = [needed, *[0] * (len(c) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(n[c]), pa.array(work, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["cluster", "n", "needed", "sums"])

    size = nearest.centroids.shape[1]
    parts = cached.mapInArrow(run, "cluster int, n long, needed long, sums array<string>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(size)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("needed").alias("needed"), *totals).select("cluster", "n", "needed", F.array(*[f"s{i}" for i in range(size)]).alias("totals"))


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, pivots: int = 6) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of every kept vector after `rounds` of exact integer k-means, and the final centroids.

    A round assigns every vector to its nearest centroid and moves each centroid that has vectors to the floor of their
    mean; one that has none stays. Only `k` centroids, and sums of them, ever come to the driver. Vectors are read and
    their pivot distances computed once; no vector is shuffled, so repeated vectors and ids do no harm and each row
    keeps its own. No kept vector: an empty result and no centroids.
    """
    points = integer_vectors(vectors, size)
    centroids = first_centroids(points, k, seed)
    if not centroids:
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    fixed = choose_pivots(centroids, pivots)
    cached = stage(cache_distances(points, fixed), "vectors")
    for _ in range(rounds):
        for r in cluster_sums(cached, Nearest(centroids, fixed)).collect():
            centroids[r["cluster"]] = [int(t) // r["n"] for t in r["totals"]]
    return assign(cached, Nearest(centroids, fixed)), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each kept vector."""
    import hashlib

    found, centroids = cluster_vectors(vectors, **options)
    found = stage(found, "assigned")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows

    def by_cluster(values: dict) -> Column:
        pairs = [F.lit(v) for kv in values.items() for v in kv]
        return F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(None)

    digests = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids)}
    return found.select(
        "vec_id", "cluster", "distance",
        by_cluster(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster(digests).cast("string").alias("centroid_sha256"),
    )
