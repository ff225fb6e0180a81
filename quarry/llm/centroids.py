"""Centroid clustering of whole-number vectors by equal-average equal-variance search.

For vectors x and c of k components with sums S and deviations V = |x - mean(x)|, the squared distance is at least
(S(x) - S(c))^2 / k + (V(x) - V(c))^2. Centroids are sorted by their sums, which are k times their means; each vector
starts at the place of its own mean and scans outward, the nearer side first. When the first term alone is over the
best distance yet, all that is further out is rejected at once; when both terms are, only that centroid is. What isn't
rejected gets the exact distance in whole numbers. A batch of vectors takes each step of the scan together, without
those that are done.

Each round is one pass: tasks add up counts and componentwise sums of their own vectors, Spark adds those up, and the
driver holds nothing but the centroids.

Defined results: vectors that are null, have another number of components, or a null or non-finite one are left out;
of ties the smaller number wins; repeated rows and repeated ids count as often as they are there; rows without vec_id
are clustered but start no centroid while others can; fewer vectors than centroids give as many centroids; an empty
table gives an empty result; only vec_id and embedding are read. A component of BOUND or more after scaling is an
error, since squared distances might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64.0, 1
BOUND = 2.0**27
#: Vectors that are searched at once.
AT_ONCE = 16_384


def kept(batch: pa.RecordBatch, k: int, scale: float) -> tuple[pa.Array, np.ndarray]:
    """The ids and the scaled whole-number vectors of the rows that count."""
    lists = batch.column("embedding")
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), k), False)
    ids, lists = batch.column("vec_id").filter(right), lists.filter(right)
    parts = lists.flatten()
    x = parts.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, k)  # nulls become NaN
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[fine])
    if x.size and np.abs(x).max() >= BOUND:
        raise ValueError(f"components of {BOUND / scale} or more: their squared distances might not fit a long")
    return ids.filter(pa.array(fine)), x.astype(np.int64)


class Search:
    """Nearest centroids. found(x): the number of each vector's centroid and the exact squared distance."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.c, self.sums = centroids[self.order], sums[self.order]
        self.deviation = np.sqrt(((self.c - self.c.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))
        self.tried = 0

    def found(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.of(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = x.shape
        sums = x.sum(axis=1)
        deviation = np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.c))
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        open_ = np.arange(n)
        far = np.iinfo(np.int64).max
        while len(open_):
            a, b = left[open_], right[open_]
            below = np.where(a >= 0, sums[open_] - self.sums[np.maximum(a, 0)], far)
            above = np.where(b < len(self.c), self.sums[np.minimum(b, len(self.c) - 1)] - sums[open_], far)
            go = below <= above
            gap, at = np.where(go, below, above), np.where(go, a, b)
            left[open_] -= go
            right[open_] += ~go
            # both sides are used up, or all that is left has a mean too far away
            more = gap < far
            mean_part = np.where(more, gap, 0).astype(float) ** 2 / k
            limit = best[open_] * (1 + 1e-9) + 1e-3  # bounds are rounded; distances are not
            more &= mean_part <= limit
            near = more & (mean_part + (deviation[open_] - self.deviation[np.clip(at, 0, len(self.c) - 1)]) ** 2 <= limit * (1 + 1e-9))
            rows, own = open_[near], at[near]
            self.tried += len(rows)
            d = x[rows] - self.c[own]
            d = np.einsum("ij,ij->i", d, d)
            label = self.order[own]
            won = (d < best[rows]) | ((d == best[rows]) & (label < number[rows]))
            best[rows[won]], number[rows[won]] = d[won], label[won]
            open_ = open_[more]
        return number, best


def first_centroids(vectors: DataFrame, k: int, scale: float, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:vec_id`. Of equal hashes the smaller vector comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = kept(batch, k, scale)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), k).cast(pa.list_(pa.int64()))})

    named = vectors.mapInArrow(run, "vec_id long, x array<long>").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in named.orderBy(F.col("h").asc_nulls_last(), "x").limit(count).collect()], np.int64).reshape(-1, k)


def moved(vectors: DataFrame, centroids: np.ndarray, scale: float) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean in each component; one without vectors stays."""
    count, k = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n = Search(centroids), np.zeros(count, np.int64)
        total = np.zeros((count, k), np.int64)
        for batch in batches:
            x = kept(batch, k, scale)[1]
            own = search.found(x)[0]
            n += np.bincount(own, minlength=count)
            np.add.at(total, own, x)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(there, k + 1)), "part": pa.array(np.tile(np.arange(k + 1), len(there))), "total": pa.array(np.column_stack((total[there], n[there])).ravel())})

    # sums over all rows are exact beyond a long
    sums = vectors.mapInArrow(run, "cluster long, part long, total long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    of = {(r["cluster"], r["part"]): int(r["total"]) for r in sums}
    return np.array([[of[c, i] // of[c, k] for i in range(k)] if (c, k) in of else centroids[c].tolist() for c in range(count)], np.int64).reshape(-1, k)


def assigned(vectors: DataFrame, centroids: np.ndarray, scale: float) -> DataFrame:
    """vec_id, cluster, distance of each vector that counts."""
    k = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            ids, x = kept(batch, k, scale)
            number, best = search.found(x)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(number.astype(np.int32)), "distance": pa.array(best)})

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = DIMENSIONS, count: int = CENTROIDS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of each vector of k components, and the centroids (count x k whole numbers)."""
    own = vectors.select("vec_id", vectors["embedding"].cast("array<double>").alias("embedding"))
    centroids = first_centroids(own, k, scale, count, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(own, centroids, scale)
    return assigned(own, centroids, scale), centroids


def clustering(vectors: DataFrame, k: int = DIMENSIONS, count: int = CENTROIDS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """The rows of clusters() with cluster_inertia, inertia (sums of distances) and centroid_sha256 (of the centroid's components, comma-joined)."""
    found, centroids = clusters(vectors, k, count, rounds, scale, seed)
    found = written(found, "clusters")
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most `count` rows
    total = sum(r["cluster_inertia"] for r in per)
    rows = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    told = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
