"""Segments come in few copies to a distance join, whatever its reach, and pairs stay whole."""

import math

import numpy as np
import pytest

from ringfold.operators import spatial


@pytest.fixture(scope="module")
def streets(spark):
    """Long segments (about 180 m a side) like those of the derived streets."""
    rows = np.random.default_rng(5).normal(0, 180, (400, 2, 2)).cumsum(axis=1) + np.random.default_rng(6).uniform(0, 4000, (400, 1, 2))
    return spark.createDataFrame([(k, 0, *map(float, r.ravel())) for k, r in enumerate(rows)], "way long, seq long, ax double, ay double, bx double, by double")


@pytest.mark.parametrize("reach", [40.0, 60.0, 250.0])
def test_points_meet_few_copies_of_a_segment(streets, reach):
    copies = spatial.segment_cells(streets, spatial.near_cell(reach), reach).count()
    assert copies < 8 * 400


def test_pairs_meet_few_copies_of_a_segment(streets):
    cell = spatial.typical_cell(streets, 6.0)
    assert cell >= 100
    assert spatial.segment_cells(streets, cell, 6.0).count() < 6 * 400
    assert spatial.typical_cell(streets.where("false"), 6.0) == 50.0


def test_cells_do_not_change_what_is_found(spark, streets):
    at = np.random.default_rng(7).uniform(0, 4000, (300, 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "pid long, x double, y double")
    for reach in (12.0, 60.0):
        near = lambda cell: sorted((r.pid, r.way, r.d) for r in spatial.near_segments(points, streets, reach, cell).collect())  # noqa: B023, E731
        assert near(None) == near(50.0)
    pairs = spatial.near_segment_pairs(streets, 6.0, ["way", "seq"]).collect()
    small = spatial.near_segment_pairs(streets, 6.0, ["way", "seq"], index=spatial.segment_index(streets, 50.0, 6.0)).collect()
    key = lambda rows: sorted((r.a_way, r.b_way, r.near.d) for r in rows)
    assert key(pairs) == key(small) and pairs and all(math.isfinite(r.near.d) for r in pairs)
