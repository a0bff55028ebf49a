"""Distinct routes are chosen among more walks of an outline than are kept."""

import numpy as np

import __spark_entry__ as entry
from ringfold.operators import kernels
from ringfold.queries import network
from ringfold.sources.derived import Derived


def test_three_of_four_walks(spark, tmp_path):
    rows = np.random.default_rng(8).normal(0, 0.12, (24, 64))
    values = [(k, [float(v) for v in row]) for k, row in enumerate(rows)]
    spark.createDataFrame(values, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    walks = network.matched(Derived(spark, str(tmp_path)), places=4).select("path_id", "pose", "x", "y", "worst").toPandas()
    want, lost = [], 0
    for _, own in walks.sort_values(["worst", "pose"]).groupby("path_id"):
        chosen = kernels.spread(list(zip(own.x, own.y)), 500.0, 3)
        want += [(int(own.pose.iloc[k]), rank) for rank, k in enumerate(chosen, 1)]
        lost += list(chosen) != list(range(min(3, len(own))))
    assert walks.groupby("path_id").size().max() == 4 and lost
    got = entry.queries()["t06_distinct_routes"](spark, str(tmp_path)).collect()
    assert sorted((r.pose, r["rank"]) for r in got) == sorted(want)
