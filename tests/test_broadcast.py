"""What an explode or a Python function makes is not broadcast by an estimate."""

import pytest

import __spark_entry__ as entry
from ringfold.session import ESTIMATED, MEASURED, broadcast_measured


@pytest.mark.parametrize("name", ["a12_lap_deviation", "j06_expanding_search", "j18_raster_lookup", "a15_pose_cost"])
def test_cells_are_broadcast_by_measure_only(spark, sf, name):
    before = {k: spark.conf.get(k, None) for k in (ESTIMATED, MEASURED)}
    try:
        spark.conf.set(ESTIMATED, "10MB")  # as in a session of the caller's
        spark.conf.unset(MEASURED)
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert (spark.conf.get(ESTIMATED), spark.conf.get(MEASURED)) == ("-1", "10MB")
        broadcast_measured(spark)
        assert spark.conf.get(MEASURED) == "10MB"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_feasible_poses_broadcast_no_cells(spark, sf):
    before = {k: spark.conf.get(k, None) for k in (ESTIMATED, MEASURED)}
    try:
        spark.conf.set(ESTIMATED, "10MB")
        spark.conf.unset(MEASURED)
        plan = entry.queries()["f14_feasible_poses"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_tier_scores_poses_by_tiles(spark, sf, monkeypatch):
    """The block of ``r14_run_tier`` on the whole lattice: no row for every sample of every pose."""
    from ringfold.operators import raster

    def joined(*_, **__):
        raise AssertionError("samples were joined")

    monkeypatch.setattr(raster, "lookup", joined)
    rows = entry.queries()["r14_run_tier"](spark, sf).collect()
    assert rows and all(r.length_m > 0 for r in rows)
