"""Sort-means against plain k-means in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from ringfold.llm import entry, sort_means


def plain(rows, clusters, rounds, seed, dims, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=mark)[:clusters]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for step in range(rounds + 1):
        near = [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
        if step == rounds:
            break
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == k]
            if own:
                centroids[k] = [sum(col) // len(own) for col in zip(*own)]
    total = sum(d for d, _ in near)
    sums = {k: sum(d for d, c in near if c == k) for k in range(len(centroids))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is None, i or 0, c, d, sums[c], total, text[c]) for (i, _), (d, c) in zip(kept, near))


def shown(df):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in df.collect())


@pytest.mark.parametrize("clusters,rounds,replay", [(7, 5, 8), (7, 5, 1), (40, 3, 2), (1, 2, 8), (5, 0, 8)])
def test_rows_equal_plain_k_means(spark, clusters, rounds, replay):
    rng = np.random.default_rng(clusters)
    rows = [(i, (rng.integers(-3, 3, 4) / 4).tolist()) for i in range(300)]  # coarse: many ties and equal vectors
    rows += [(i + 300, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [rows[5]] * 20 + [(None, [0.5] * 4), (None, [0.25] * 4)]
    rows += [(900, None), (901, []), (902, [0.1] * 3), (903, [0.1, None, 0.2, 0.3]), (904, [0.1, math.nan, 0.0, 0.0]), (905, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, whole int").repartition(5)
    got = sort_means.centroid_clusters(df, clusters, rounds, dims=4, replay=replay)
    assert shown(got) == plain(rows, clusters, rounds, 2, 4)


def test_scans_stop_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    middle = rng.integers(-3000, 3000, (30, 16))
    vectors = middle[rng.integers(0, 30, 4000)] + rng.integers(-60, 60, (4000, 16))
    lists, before = sort_means.SortMeans(middle), np.zeros(4000, dtype=np.int64)
    measured, squared = [], sort_means.squared
    near, _ = lists.assign(vectors, before)
    sort_means.squared = lambda v, c: measured.append(len(v)) or squared(v, c)
    try:
        again, far = lists.assign(vectors, near)
    finally:
        sort_means.squared = squared
    every = ((vectors[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (again == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all() and (near == again).all()
    assert sum(measured) < 4000 * 30 / 4  # of all pairs


def test_huge_components_are_held_and_exact(spark):
    rows = [(i, [x, 0.0]) for i, x in enumerate((1e300, -1e300, 5e5, 5e5 + 1, 3.0))]
    got = {r.vec_id: r for r in sort_means.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 3, dims=2).collect()}
    assert len(got) == 5 and all(r.distance >= 0 for r in got.values())
    a = np.array([[sort_means.LIMIT] * 64]), np.array([-sort_means.LIMIT] * 64)
    assert sort_means.squared(*a)[0] == 64 * (2 * sort_means.LIMIT) ** 2


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert sort_means.centroid_clusters(df).collect() == []


def test_query_equals_plain_k_means(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert shown(entry.op11_centroid_clustering(spark, sf)) == plain([tuple(r) for r in table], 40, 5, 2, 64)
