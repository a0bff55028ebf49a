"""A search in the background: progress rises, cancelling stops it and nothing else."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.operators import matching, paths
from ringfold.operators.components import cut_lineage
from ringfold.params import SearchOptions
from ringfold.plans.progress import Cancelled, search


def path_frame(spark, *ways):
    rows = [(i, k, float(x), float(y)) for i, w in enumerate(ways) for k, (x, y) in enumerate(w)]
    return spark.createDataFrame(rows, "path_id long, seq long, x double, y double")


def test_progress_of_a_placement_search(spark):
    tri = [(-150, -100), (250, -50), (0, 200)]
    ring = path_frame(spark, [tuple(np.array(a) + (np.array(b) - np.array(a)) * k / 20) for a, b in zip(tri, tri[1:] + tri[:1]) for k in range(20)])
    streets = path_frame(spark, *[[(x + 1200, y + 900) for x, y in (a, b)] for a, b in zip(tri, tri[1:] + tri[:1])])
    segs = paths.segments(streets, False).withColumnRenamed("path_id", "way")
    bounds = spark.createDataFrame([(600.0, 300.0, 1800.0, 1500.0)], "min_x double, min_y double, max_x double, max_y double")
    work = lambda: cut_lineage(matching.search_placements(ring, segs, bounds, 1.0, SearchOptions(samples=(30, 60))))
    run = search(spark, work)
    seen = list(run.updates(0.05))
    assert len(seen) > 3 and all(a.done <= b.done and a.total <= b.total for a, b in zip(seen, seen[1:]))
    assert 0 < seen[-1].done <= seen[-1].total and not run.running
    top = run.result().orderBy("rank").first()
    assert (top.x, top.y) == pytest.approx((1200, 900), abs=1)


def slow(spark, seconds):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(0, 400, 1, 200).mapInArrow(wait, "id long").agg(F.sum("id").alias("s"))


def test_cancelling_stops_a_search_alone(spark):
    steps = []

    def work():
        steps.append(cut_lineage(spark.range(100)).count())
        steps.append(slow(spark, 0.5).first())
        steps.append("not reached")

    run, other = search(spark, work), search(spark, lambda: slow(spark, 0.01).first()["s"])
    seen = []
    for p in run.updates(0.1):
        seen.append(p)
        if p.done > seen[0].done + 3 and len(steps) == 1:
            began = time.monotonic()
            run.cancel()
            assert time.monotonic() - began < 30
    assert not run.running and steps == [100] and seen[-1].done < seen[-1].total
    with pytest.raises(Cancelled):
        run.result()
    assert other.result(120) == 79800 and spark.range(5).count() == 5


def test_errors_come_through(spark):
    run = search(spark, lambda: spark.range(1).select(F.raise_error(F.lit("no streets"))).collect())
    with pytest.raises(Exception, match="no streets"):
        run.result(60)
    with pytest.raises(TimeoutError):
        search(spark, lambda: time.sleep(1.5)).result(0.01)
