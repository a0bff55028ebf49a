"""Pose search at size: suppression by rounds, blocks opened by bounds, tiled transforms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.operators import kernels, matching, paths, raster
from ringfold.params import PoseOptions, RasterOptions

C = F.col


def path_frame(spark, *ways):
    rows = [(i, k, float(x), float(y)) for i, w in enumerate(ways) for k, (x, y) in enumerate(w)]
    return spark.createDataFrame(rows, "path_id long, seq long, x double, y double")


def plain_greedy(rows, distance_m, rotation_deg, limit=None):
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        if all(math.hypot(r[1] - k[1], r[2] - k[2]) > distance_m or kernels.angle_delta(r[3], k[3]) > math.radians(rotation_deg) for k in kept):
            kept.append(r)
            if limit and len(kept) == limit:
                break
    return [r[5] for r in kept]


@pytest.mark.parametrize("limit,degrees", [(None, 10.0), (4, 10.0), (None, 200.0), (7, 100.0)])
def test_rounds_keep_what_the_order_keeps(spark, limit, degrees):
    rng = np.random.default_rng(int(degrees) + (limit or 0))
    rows = []
    for key, n, size in ((0, 400, 900), (1, 300, 300), (2, 1, 1), (3, 200, 2000)):
        x, y, r = rng.uniform(-size, size, n), rng.uniform(-size, size, n), rng.uniform(-7, 7, n)
        cost = np.round(np.hypot(x, y) / 50) if key == 3 else rng.integers(0, 40, n)  # a bowl; many ties
        rows += [(key, float(a), float(b), float(c), float(d), i) for i, (a, b, c, d) in enumerate(zip(x, y, r, cost))]
    rows += [(4, 0.0, 0.0, 0.0, 1.0, i) for i in range(50)] + [(5, 150.0 * i, 0.0, 0.0, float(-i), i) for i in range(9)]
    df = spark.createDataFrame(rows, "path_id long, x double, y double, rotation double, cost double, pose long")
    got = matching.suppress_poses(df, "path_id", ["cost", "pose"], 150.0, degrees, limit).orderBy("path_id", "rank").collect()
    for key in range(6):
        own = [r for r in got if r.path_id == key]
        assert [r.pose for r in own] == plain_greedy([r for r in rows if r[0] == key], 150.0, degrees, limit)
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
    same = matching.dedup_poses(df, "path_id", ["cost", "pose"], 150.0, degrees, limit)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in got}


def test_a_million_poses_of_one_outline(spark):
    n = 1_000_000
    at = lambda k, size: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1 << 20)) / float(1 << 20) * size
    df = spark.range(n).select(
        F.lit(7).alias("path_id"), at(1, 8000.0).alias("x"), at(2, 8000.0).alias("y"), at(3, 2 * math.pi).alias("rotation"), F.floor(at(4, 5000.0)).alias("cost"), C("id").alias("pose")
    )
    got = matching.dedup_poses(df, "path_id", ["cost", "pose"], 150.0, 10.0, 120).orderBy("rank").collect()
    first = df.orderBy("cost", "pose").limit(20_000).collect()
    assert [r.pose for r in got] == plain_greedy([tuple(r) for r in first], 150.0, 10.0, 120) and len(got) == 120


def test_tiles_join_to_the_whole_transform(spark):
    rng = np.random.default_rng(3)
    for reach, tile in ((3, 64), (9, 5), (40, 16)):
        grid = rng.random((2, 50, 70)) < 0.004
        grid[0, 20, 30] = True
        rows = [(int(k), int(x), int(y)) for k, y, x in zip(*np.nonzero(grid))]
        df = spark.createDataFrame(rows, "layer int, cx long, cy long")
        got = {(r.layer, r.cx, r.cy): r.d2 for r in raster.near_cells(df, reach, (70, 50), tile).collect()}
        want = {}
        for k in range(2):
            d = kernels.distance_transform(grid[k])
            want |= {(k, int(x), int(y)): int(d[y, x]) for y, x in zip(*np.nonzero(d <= reach * reach))}
        assert got == want
        free = raster.near_cells(df, reach, None, tile)
        assert free.where((C("cx") < 0) | (C("cy") < 0)).count() > 0 and free.where(C("cx").between(0, 69) & C("cy").between(0, 49)).count() == len(want)


def town(spark, o):
    """Streets in one corner of a wide area."""
    block = [[(x * 100, 0), (x * 100, 300)] for x in range(4)] + [[(0, y * 100), (300, y * 100)] for y in range(4)]
    lone = [[(3900, 2900), (4000, 3000)]]
    segs = paths.segments(path_frame(spark, *block, *lone), False)
    bounds = paths.bounds(path_frame(spark, *block, *lone), None)
    frame = raster.raster_frame(bounds, o)
    return bounds, frame, raster.near_cells(raster.source_cells(segs, frame, o), 6)


def test_blocks_of_poses_open_only_where_they_could_pass(spark):
    r = RasterOptions(cell_m=10.0, margin_m=50.0)
    bounds, frame, cells = town(spark, r)
    corners = [(-100, -100), (100, -100), (100, 100), (-100, 100)]
    ring = [tuple(np.array(a) + (np.array(b) - np.array(a)) * k / 10) for a, b in zip(corners, corners[1:] + corners[:1]) for k in range(10)]
    other = [(x * 0.6 + 5, y * 1.3) for x, y in ring]
    rings = path_frame(spark, ring, other)
    o = PoseOptions(anchor_m=50.0, rotation_deg=45.0, count=60, dedup_m=60.0, dedup_deg=20.0, coarse_m=40.0, max_hole_m=150.0)
    perimeter = paths.path_length(rings, True)
    boxed = rings.select("path_id").distinct().join(F.broadcast(bounds))
    every = raster.open_poses(rings, perimeter, boxed, cells, frame, 1.0, o, r, blocks=())
    some = raster.open_poses(rings, perimeter, boxed, cells, frame, 1.0, o, r, blocks=(16, 4))
    assert every.count() == 2 * 81 * 61 * 8 and every.select("path_id", "pose").distinct().count() == every.count()
    assert some.join(every, every.columns, "left_anti").count() == 0  # the same poses under the same numbers
    assert 0 < some.count() < 0.05 * every.count()
    show = lambda df: sorted(map(tuple, df.select("path_id", "rank", "x", "y", "rotation", "cost", "max_hole_m").collect()))
    plain = show(raster.search_poses(rings, bounds, cells, frame, 1.0, o, r, blocks=()))
    for blocks in ((16, 4), (8,), (64, 16, 4)):
        assert show(raster.search_poses(rings, bounds, cells, frame, 1.0, o, r, blocks=blocks)) == plain
    assert len(plain) > 2 and {p[0] for p in plain} == {0, 1}


@pytest.mark.parametrize("window", [640, 0])
def test_poses_by_tiles_cost_what_their_samples_cost(spark, monkeypatch, window):
    """Outlines of all sizes, one too wide for a tile: the same as by a join."""
    monkeypatch.setattr(raster, "WINDOW", window)
    r = RasterOptions(cell_m=10.0, margin_m=50.0)
    _, frame, cells = town(spark, r)
    rng = np.random.default_rng(8)
    turn = np.linspace(0, 2 * math.pi, 40, endpoint=False)
    rings = path_frame(spark, *[np.column_stack([np.cos(turn), np.sin(turn)]) * size + rng.normal(0, 4, (40, 2)) for size in (20, 90, 150, 3000)])
    samples = raster.spaced_samples(rings, paths.path_length(rings, True), 30.0)
    rows = [(k, n, *map(float, rng.uniform(-300, 4000, 2)), float(rng.uniform(-7, 7))) for k in range(4) for n in range(150)]
    poses = spark.createDataFrame(rows, "path_id long, pose long, x double, y double, rotation double")
    for factor, level in ((1, cells), (4, raster.pooled(cells, 4))):
        seen = raster.lookup(raster.posed_samples(poses, samples, F.lit(1.2)), level, frame, r, factor)
        want = seen.groupBy("path_id", "pose").agg(F.sum(F.least("d", F.lit(60.0))).alias("cost"), raster.longest_hole(30.0).alias("hole")).collect()
        reach = raster.tiled_reach(rings, 1.2, r)
        assert (0 < reach < 200) == (window > 0)
        got = raster.score_poses(poses, samples, level, frame, 1.2, reach, 30.0, 60.0, o=r, factor=factor)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan
        got = {(g.path_id, g.pose): g for g in got.collect()}
        assert len(got) == len(want) == 600
        for w in want:
            g = got[w.path_id, w.pose]
            assert g.max_hole_m == pytest.approx(w.hole) and g.cost == pytest.approx(w.cost) and (g.x, g.y, g.rotation) == rows[150 * w.path_id + w.pose][2:]


def test_small_groups_share_a_call(spark):
    rows = [(k, 40.0 * i, 0.0, 0.0, float(-i)) for k in [*range(300), None] for i in range(8)]
    df = spark.createDataFrame(rows, "path_id long, x double, y double, rotation double, cost double")
    got = matching.dedup_poses(df, "path_id", ["cost"], 90.0, 10.0)
    assert "__bucket" in got._jdf.queryExecution().executedPlan().toString()
    per = {}
    for r in got.collect():
        per.setdefault(r.path_id, []).append((r["rank"], r.x))
    assert len(per) == 301 and all(sorted(v) == [(1, 280.0), (2, 160.0), (3, 40.0)] for v in per.values())
