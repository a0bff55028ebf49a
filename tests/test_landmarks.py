"""Corners of many outlines in few calls into Python, equal to those of each alone."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from ringfold.operators import kernels, paths
from ringfold.params import CornerOptions
from ringfold.plans import skeleton


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for path in range(40):
        n = int(rng.integers(1, 30))
        rows += [(path, i, *map(float, p)) for i, p in enumerate(rng.normal(0, 150, (n, 2)))]
    return spark.createDataFrame(rows, "path_id long, seq long, x double, y double")


def test_landmarks_equal_each_outline_alone(rings, monkeypatch):
    monkeypatch.setattr(skeleton, "TOGETHER", 7)
    o = CornerOptions()
    heading = {(r.path_id, r.seq): (r.x, r.y, r.hx, r.hy) for r in paths.headings(rings).collect()}
    want = []
    for path in range(40):
        seqs = sorted(s for p, s in heading if p == path)
        found = sorted(i for i, _ in kernels.corners(np.array([heading[path, s][:2] for s in seqs]), o.min_turn_rad, o.min_spacing_m))
        want += [(path, k, seqs[i], *heading[path, seqs[i]]) for k, i in enumerate(found)]
    assert sorted(map(tuple, skeleton.landmarks(rings, o).collect())) == want and len(want) > 100


def test_landmarks_are_no_call_an_outline(rings):
    plan = skeleton.landmarks(rings)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_landmarks_meet_the_nearest_street(spark, rings):
    """Whatever the cells, the nearest street that runs along."""
    streets = [(f"e{i}", f"a{i}", f"b{i}", 100.0, [[x, y], [x + 100 * math.cos(i), y + 100 * math.sin(i)]], 0) for i, (x, y) in enumerate(np.random.default_rng(5).uniform(-400, 400, (80, 2)).tolist())]
    edges = spark.createDataFrame(streets, "edge string, a string, b string, length_m double, points array<array<double>>, region long")
    poses = spark.createDataFrame([(0, p, 20.0, -30.0, 0.3) for p in range(40)], "region long, path_id long, tx double, ty double, rotation double")
    got = {(r.path_id, r.k): r for r in skeleton.resolve_landmarks(skeleton.landmarks(rings), poses, edges).collect()}
    c, s, along = math.cos(0.3), math.sin(0.3), math.cos(math.radians(35))
    seen = 0
    for m in skeleton.landmarks(rings).collect():
        x, y = m.x * c - m.y * s + 20, m.x * s + m.y * c - 30
        h = np.array([m.hx * c - m.hy * s, m.hx * s + m.hy * c])
        best = None
        for _, _, _, _, (p, q), _ in streets if h.any() else ():
            p, v = np.array(p), np.array(q) - np.array(p)
            if abs(v @ h) >= along * np.linalg.norm(v) * np.linalg.norm(h):
                foot = p + v * min(1, max(0, ((x, y) - p) @ v / (v @ v)))
                d = np.linalg.norm(foot - (x, y))
                if d <= 120 and (best is None or d < best[0]):
                    best = (d, foot)
        r = got[m.path_id, m.k]
        assert (r.x, r.y) == (pytest.approx(x), pytest.approx(y))
        assert (r.fx is None) == (best is None)
        if best is not None:
            seen += 1
            assert (r.fx, r.fy) == (pytest.approx(best[1][0]), pytest.approx(best[1][1]))
    assert seen > 50


def test_anchors_move_to_their_own_region(spark, tmp_path):
    """First corners of wide outlines lie on the streets of the next region."""
    rows = np.random.default_rng(5).normal(0, 0.125, (130, 64))
    rows[:60] *= 7
    values = [(k, [float(v) for v in row]) for k, row in enumerate(rows) if k < 60 or k >= 100]
    spark.createDataFrame(values, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()["r12_move_landmark"](spark, str(tmp_path)).collect()
    assert sorted(r.path_id for r in found) == [k for k, _ in values]
