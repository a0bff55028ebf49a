"""The best neighbour of a pose, against scores of all neighbours as rows."""

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ringfold.operators import matching, paths
from ringfold.params import SearchOptions
from ringfold.sources.derived import Derived


def _folder(spark, path):
    rows = np.random.default_rng(11).normal(0, 0.12, (12, 64))
    rows[5] = rows[4]
    rows[7, 10:20] = np.tile(rows[7, 10:12], 5)
    spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(rows)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_best_neighbour_is_the_best_of_all_rows(spark, tmp_path):
    d = Derived(spark, _folder(spark, tmp_path))
    ring = paths.recentre(d.vertex).localCheckpoint()
    start = paths.centroid(d.vertex).select("path_id", F.explode(F.array(F.lit(3), F.lit(8))).alias("pose"), "cx", "cy")
    start = start.select("path_id", "pose", (F.col("cx") + 4.0 * F.col("pose")).alias("x"), F.col("cy").alias("y"), (F.col("pose") * 0.1).cast("double").alias("rotation")).localCheckpoint()
    o = replace(SearchOptions(), min_coverage=0.2)
    got = matching.refine_poses(start, ring, d.segment, 20, 0.9, o, task_poses=3).toPandas()
    assert len(got) == 24
    tried = matching.refinements(start.withColumnRenamed("pose", "seed"), o).withColumn("pose", F.col("seed").cast("long") * 1000 + F.col("step"))
    every = tried.join(matching.score_poses(tried, ring, d.segment, 20, 0.9, o), ["path_id", "pose"]).toPandas()
    assert len(every) == 24 * 126
    for r in got.itertuples():
        own = every[(every.path_id == r.path_id) & (every.seed == r.pose)]
        same = own[own.step == r.step].iloc[0]
        assert math.isclose(own.score.max(), r.score, abs_tol=1e-9)
        for c in ("score", "coverage", "mean_m", "max_m", "x", "y", "rotation"):
            assert math.isclose(getattr(same, c), getattr(r, c), abs_tol=1e-9)


def test_the_query_tries_all_126(spark, tmp_path):
    """Steps beyond 28 are those that a span of one step has not."""
    found = entry.queries()["t12_local_refine"](spark, _folder(spark, tmp_path)).collect()
    assert len(found) == 12 and max(r.step for r in found) > 27
