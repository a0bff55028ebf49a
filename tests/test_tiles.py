"""Matching by tiles against the walk over a whole graph."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.operators import kernels
from ringfold.operators.components import connected_components
from ringfold.params import Bar, LadderOptions, MatchOptions, PruneOptions, Tier
from ringfold.plans import generate, tiles


def town(spark, regions=2, n=14):
    """Crooked street grids, one a region, with pieces missing; no two ways are equally long."""
    rng = np.random.default_rng(4)
    nodes, edges = [], []
    for r in range(regions):
        at = {(i, j): (2500.0 * r + 90 * i + rng.normal(0, 12), 90 * j + rng.normal(0, 12)) for i in range(n) for j in range(n)}
        name = {k: f"r{r}n{k[0]:02}{k[1]:02}" for k in at}
        nodes += [(r, name[k], float(x), float(y)) for k, (x, y) in at.items()]
        for i, j in at:
            for k in ((i + 1, j), (i, j + 1)):
                if k in at and rng.random() < 0.8:
                    a, b = at[i, j], at[k]
                    mid = ((a[0] + b[0]) / 2 + rng.normal(0, 6), (a[1] + b[1]) / 2 + rng.normal(0, 6))
                    points = [[float(v) for v in p] for p in (a, mid, b)]
                    edges.append((f"e{len(edges)}", name[i, j], name[k], math.dist(a, mid) + math.dist(mid, b), points))
    e = spark.createDataFrame(edges, "edge string, a string, b string, length_m double, points array<array<double>>")
    df = spark.createDataFrame(nodes, "region long, node string, x double, y double")
    comps = connected_components(e.select("a", "b"), df.select("node"))
    return df.join(comps, "node"), e, nodes, edges, {r.node: r.component for r in comps.collect()}


@pytest.mark.parametrize("tile_m,passes", [(300.0, 3), (5000.0, 0)])
def test_tiles_give_the_walks_of_whole_graphs(spark, tile_m, passes, monkeypatch):
    nodes, edges, n, e, component = town(spark)
    rng = np.random.default_rng(8)
    a = np.linspace(0, 2 * math.pi, 40, endpoint=False)
    rings = {k: np.column_stack([s * np.cos(a), s * (1 + 0.2 * k) * np.sin(a) + 20 * np.cos(3 * a)]) for k, s in ((0, 150.0), (1, 230.0))}
    ring = spark.createDataFrame([(k, i, float(x), float(y)) for k, xy in rings.items() for i, (x, y) in enumerate(xy)], "path_id long, seq long, x double, y double")
    poses = [(r, k, 10 * k + 100 * r + i, float(2500 * r + rng.uniform(200, 900)), float(rng.uniform(200, 900)), float(rng.uniform(0, 6))) for r in (0, 1) for k in (0, 1) for i in range(4)]
    poses += [(0, 0, 77, 9000.0, 9000.0, 0.0)]  # where no street is
    frame = spark.createDataFrame(poses, "region long, path_id long, pose long, x double, y double, rotation double")
    target = spark.createDataFrame([(k, float(kernels.path_length(xy, True))) for k, xy in rings.items()], "path_id long, length_m double")
    own = tiles.match_outlines
    monkeypatch.setattr(tiles, "match_outlines", lambda *x: own(*x, tile_m))
    ladder = LadderOptions(pool=100)
    got = {r.pose: r for r in generate.match_poses(frame, ring, nodes, edges, target, 1.0, Tier(9, 90.0, 8, passes), ladder).collect()}
    o, walked = MatchOptions(radius_m=90.0, candidates=8), 0
    for r, k, pose, x, y, turn in poses:
        graph = kernels.Graph(sorted(v[1:] for v in n if v[0] == r), [(*v[:4], [tuple(p) for p in v[4]]) for v in e if v[1].startswith(f"r{r}")])
        mine = [component[v[1]] for v in n if v[0] == r]
        main = min((-mine.count(c), c) for c in mine)[1]
        c, s = math.cos(turn), math.sin(turn)
        outline = np.column_stack([rings[k][:, 0] * c - rings[k][:, 1] * s + x, rings[k][:, 0] * s + rings[k][:, 1] * c + y])
        walk = kernels.match_loop(outline, graph, [v[1] for v in n if v[0] == r and component[v[1]] == main], o)
        if walk is None:
            assert pose not in got
            continue
        length = float(kernels.path_length(rings[k], True))
        if passes:
            walk = kernels.prune_spikes(walk, graph, outline, length, PruneOptions(passes=passes), Bar())
        points, legs = graph.loop(walk)
        want = kernels.route_metrics(points, legs, outline, length, graph)
        assert list(got[pose].nodes) == walk
        for name, value in want.items():
            assert got[pose][name] == pytest.approx(value, rel=1e-9, abs=1e-9), name
        assert np.array(got[pose].points) == pytest.approx(points)
        walked += 1
    assert walked > 10 and 77 not in got


def test_bounded_paths_leave_out_what_is_farther(spark):
    nodes, edges, n, e, _ = town(spark, 1, 9)
    graph = kernels.Graph([v[1:] for v in n], [(*v[:4], []) for v in e])
    place = {v[1]: v[2:] for v in n}
    ids = sorted(place)
    rng = np.random.default_rng(2)
    pairs = [(a, b, *map(float, place[a])) for a, b in zip(rng.choice(ids, 60), rng.choice(ids, 60))]
    df = spark.createDataFrame(pairs + pairs[:5], "a string, b string, ax double, ay double")
    for most, tile in ((250.0, 100.0), (400.0, 1000.0)):
        got = {(r.a, r.b): (r.length_m, r.edges) for r in tiles.bounded_paths(df, tiles.street_table(nodes, edges), most, tile).collect()}
        want = {(a, b): graph.shortest(a, b) for a, b, _, _ in pairs}
        assert got.keys() == {k for k, v in want.items() if v and v[0] <= most} and got
        assert all(v[0] == pytest.approx(want[k][0]) and sum(graph.edges[i][3] for i in v[1]) == pytest.approx(v[0]) for k, v in got.items())


def test_closed_walks_of_few_samples():
    inf = math.inf
    assert kernels.closed_walk([np.array([[inf, 1.0], [2.0, 0.5]])], [np.zeros(2)]) == [1]
    assert kernels.closed_walk([np.full((1, 1), inf)], [np.zeros(1)]) is None
    two = [np.array([[1.0, 5.0]]), np.array([[1.0], [0.0]])]
    assert kernels.closed_walk(two, [np.zeros(1), np.array([0.0, 0.0])]) == [0, 0]
    assert kernels.closed_walk(two, [np.zeros(1), np.array([9.0, 0.0])]) == [0, 1]
    assert kernels.closed_walk([np.full((2, 2), inf)] * 3, [np.zeros(2)] * 3) is None


def test_samples_come_in_parts_of_a_batch(spark):
    rng = np.random.default_rng(9)
    rings = [rng.normal(0, 80, (n, 2)) for n in (1, 2, 5, 30, 0, 12, 3)]
    rows = [(k % 2, k, 7 * k, [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]) for k, xy in enumerate(rings)]
    placed = spark.createDataFrame(rows, "region long, path_id long, pose long, ring array<struct<seq:long,x:double,y:double>>").coalesce(1)
    want = [(k % 2, k, 7 * k, i, len(s), float(x), float(y)) for k, xy in enumerate(rings) for s in [kernels.resample(xy, 25.0, True)] for i, (x, y) in enumerate(s)]
    for some in (3, 1, 100):
        assert sorted(map(tuple, tiles.placed_samples(placed, 25.0, some).collect())) == sorted(want)


def test_routes_stay_out_of_python_when_some_are_chosen(spark):
    columns = [c.split() for c in generate.ROUTE.split(", ")]
    value = {"long": 0, "double": 0.5, "boolean": True, "array<string>": ["a"], "array<array<double>>": [[1.0, 2.0]]}
    made = lambda pose, x, worst: tuple({"path_id": 4, "pose": pose, "x": x, "y": 0.0, "worst": worst}.get(n, value[t]) for n, t in columns)
    routes = spark.createDataFrame([made(1, 0.0, 0.3), made(2, 100.0, 0.4), made(3, 900.0, 0.5), made(4, 50.0, 0.6)], generate.ROUTE)
    found = generate.pick_distinct(routes, 3, 500.0)
    assert found.columns == [n for n, _ in columns] + ["rank"]
    assert sorted((r["rank"], r.pose) for r in found.collect()) == [(1, 1), (2, 3), (3, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    python = next(line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line)
    assert "points" not in python and "nodes" not in python


def test_poses_share_calls_whatever_their_rows(spark):
    poses = [(0, k, p) for k in range(20) for p in range(2)]
    many = spark.createDataFrame([(*p, i) for p in poses for i in range(50)], "region long, path_id long, pose long, i long")
    rows = spark.createDataFrame([(*p, v) for p in poses for v in (1.0, 2.0)], "region long, path_id long, pose long, v double")
    run = lambda key, frame, rows: [(*key, len(frame), rows.v.sum())]
    got = tiles.by_pose(many, rows, run, "region long, path_id long, pose long, n long, v double").collect()
    assert sorted((r.region, r.path_id, r.pose) for r in got) == poses
    assert all(r.n == 50 and r.v == 3.0 for r in got)
    frames = spark.createDataFrame(poses, "region long, path_id long, pose long")
    one = tiles.by_pose(frames, rows, lambda key, row, rows: [(*key, row.path_id, len(rows))], "region long, path_id long, pose long, p long, n long", single=True)
    assert sorted((r.path_id, r.pose, r.p, r.n) for r in one.collect()) == [(k, p, k, 2) for _, k, p in poses]
    # 40 poses are two buckets, though they have 2,000 rows.
    assert _buckets(many) == 2


def _buckets(poses):
    """The buckets of a call by the numbers in its plan."""
    import re

    plan = tiles.by_pose(poses, poses, lambda *a: [], "region long")._jdf.queryExecution().toString()
    return int(re.search(r"pmod\(xxhash64\([^)]*\), (?:cast\()?(\d+)", plan).group(1))
