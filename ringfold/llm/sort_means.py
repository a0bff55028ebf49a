"""Centroid clustering by sort-means, exact in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS = 64
SCALE = 256
LIMIT = 1 << 27  # whole components are held within it, so that squared distances fit 64 bits
_PART = 4096  # vectors that are measured at once
_EXACT = 1 << 21  # components below it have exact distances in doubles


class SortMeans:
    """One round's centroids, each with the others in the order of their
    distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        between = np.array([squared(centroids, c) for c in centroids])
        # A centroid leads its own list, also among centroids that equal it.
        np.fill_diagonal(between, -1)
        self.order = between.argsort(axis=1, kind="stable")
        np.fill_diagonal(between, 0)
        self.between = np.take_along_axis(between, self.order, axis=1)

    def assign(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (ties: smaller number) and squared distance of each
        vector; ``before`` has the assignments that the scans start from.

        A scan goes through the others by their distance from the previous
        centroid and ends strictly beyond twice the vector's distance from that:
        whatever follows is further from the vector than the previous centroid.
        """
        cluster, distance = before.copy(), np.empty(len(vectors), dtype=np.int64)
        for c in np.unique(before):
            own = np.flatnonzero(before == c)
            first = squared(vectors[own], self.centroids[c])
            best, nearest = first.copy(), np.full(len(own), c)
            # Vectors by falling distance: those whose scans go on are a stretch in front.
            falling = np.argsort(-first, kind="stable")
            reach = -4 * first[falling]  # rises
            for other, gap in zip(self.order[c][1:], self.between[c][1:], strict=True):
                going = falling[: np.searchsorted(reach, -gap, side="right")]
                if not len(going):
                    break
                d = squared(vectors[own[going]], self.centroids[other])
                closer = (d < best[going]) | ((d == best[going]) & (other < nearest[going]))
                at = going[closer]
                best[at], nearest[at] = d[closer], other
            cluster[own], distance[own] = nearest, best
        return cluster, distance


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors from a centroid."""
    off = vectors - centroid
    if off.size and max(-off.min(), off.max()) < _EXACT:
        off = off.astype(np.float64)  # every partial sum is a whole number below 2 ** 53
        return np.einsum("ij,ij->i", off, off).astype(np.int64)
    return np.einsum("ij,ij->i", off, off)


def whole_components(embedding: str, dims: int = DIMS, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether a vector is kept, and its whole components floor(scale * x)."""
    vec = F.col(embedding)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.coalesce((F.size(vec) == dims) & ~bad, F.lit(False))
    low, high = F.lit(float(-LIMIT)), F.lit(float(LIMIT))
    whole = F.transform(vec, lambda x: F.least(high, F.greatest(low, F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    return good, whole


def _parts(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the vectors with their whole components and kept assignments."""
    for batch in batches:
        for at in range(0, batch.num_rows, _PART):
            part = batch.slice(at, _PART)
            vectors = part.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.int64)
            if "cluster" in part.schema.names:
                before = part.column("cluster").to_numpy().astype(np.int64)
            else:
                before = np.zeros(part.num_rows, dtype=np.int64)
            yield part, vectors, before


def _replayed(rounds: Sequence[SortMeans], vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distance = np.zeros(0, dtype=np.int64)
    for r in rounds:
        before, distance = r.assign(vectors, before)
    return before, distance


def _sums(rounds: Sequence[SortMeans], dims: int):
    """A task's count and sums of each cluster's vectors."""

    def run(batches):
        k = len(rounds[-1].centroids)
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, vectors, before in _parts(batches):
            cluster, _ = _replayed(rounds, vectors, before)
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(vectors[order], starts, axis=0)
            count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), *[pa.array(total[some, i]) for i in range(dims)]],
            names=["cluster", "n", *[f"s{i}" for i in range(dims)]],
        )

    return run, "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(dims))


def _assigned(rounds: Sequence[SortMeans], keep: Sequence[str], distance: bool):
    def run(batches):
        for part, vectors, before in _parts(batches):
            cluster, far = _replayed(rounds, vectors, before)
            arrays = [*[part.column(c) for c in keep], pa.array(cluster.astype(np.int32))]
            names = [*keep, "cluster"]
            if distance:
                arrays, names = [*arrays, pa.array(far)], [*names, "distance"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def initial_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:id``, ties by components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(mark.alias("mark"), "whole").orderBy("mark", "whole").limit(clusters).collect()
    return np.array([r["whole"] for r in first], dtype=np.int64)


def centroid_clusters(
    df: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    seed: int = 2,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    dims: int = DIMS,
    scale: int = SCALE,
    replay: int = 8,
) -> DataFrame:
    """One row per kept vector: (vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256).

    Kept are vectors of exactly ``dims`` components, none null or non-finite;
    a component x becomes the whole number floor(scale * x), held within
    2 ** 27 on either side. The ``clusters`` kept vectors with the smallest
    lowercase-hex sha256 of ``seed:id`` are the first centroids, in that order
    (a null id counts as empty text; rows of one id go by their components; with
    fewer vectors there are fewer centroids). Each of ``rounds`` rounds assigns
    every vector to the nearest centroid (squared Euclidean distance, ties: the
    smaller number) and replaces each non-empty centroid by floor(sum / count)
    in every component; vectors are assigned once more at the end. Repeated
    rows count each; no kept vector gives no rows. Other columns are not read.

    Sort-means: a scan starts at the vector's previous assignment and follows
    the list of the other centroids by their distance from that one. What goes
    through the driver are ``clusters`` centroids a round; tasks send a row of
    sums for each cluster. A round reads the vectors once and writes nothing:
    tasks come to the previous assignments by going through the rounds again
    from the lists, and only after every ``replay`` rounds are the vectors
    written anew with their assignment.
    """
    if clusters < 1 or rounds < 0 or replay < 1:
        raise ValueError("clusters and replay must be at least 1, rounds at least 0")
    spark = df.sparkSession
    good, whole = whole_components(embedding, dims, scale)
    vectors = written(df.where(good).select(F.col(vec_id).cast("long").alias("id"), whole.alias("whole")))
    centroids = initial_centroids(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{vec_id} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    lists = [SortMeans(centroids)]
    for _ in range(rounds):
        if len(lists) > replay:
            keep = "id long, whole array<int>, cluster int"
            vectors = written(vectors.mapInArrow(_assigned(lists[:-1], ["id", "whole"], False), keep))
            lists = lists[-1:]
        run, schema = _sums(lists, dims)
        sums = vectors.mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)])
        centroids = centroids.copy()
        for r in sums.collect():  # a row a cluster
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        lists.append(SortMeans(centroids))

    last = written(vectors.mapInArrow(_assigned(lists, ["id"], True), "id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(
        [(c, d, total, digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    out = last.join(F.broadcast(facts), "cluster")  # a row a cluster
    return out.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
