"""Scoring placements of an outline against streets, and choosing among them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import STRAIGHT_RATIO, SearchOptions
from . import kernels, paths, spatial
from .components import cut_lineage


def seed_poses(streets: DataFrame, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """Two poses (x, y, rotation, flip) per street (ax, ay, bx, by, bearing):
    the outline's straight a-b laid middle on middle, along it and against it."""
    own = math.atan2(b[1] - a[1], b[0] - a[0])
    mx, my = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    s = streets.withColumn("flip", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    s = s.withColumn("rotation", F.col("bearing") + F.col("flip") * math.pi - own)
    m = g.rotate(F.lit(mx), F.lit(my), F.col("rotation"))
    return s.withColumns({"x": (F.col("ax") + F.col("bx")) / 2 - m["x"], "y": (F.col("ay") + F.col("by")) / 2 - m["y"]})


def matching_straights(ways: DataFrame, target_m: float, band: tuple[float, float] = STRAIGHT_RATIO) -> DataFrame:
    """(path_id, ax, ay, bx, by, length_m, bearing) of the ways' longest
    straights whose length is within the band of the target, ends included."""
    s = paths.longest_straight(ways, closed=False).where(F.col("length_m").between(target_m * band[0], target_m * band[1]))
    at = lambda name, i: ways.select("path_id", F.col("seq").alias(i), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"))
    return s.join(at("a", "start_index"), ["path_id", "start_index"]).join(at("b", "end_index"), ["path_id", "end_index"]).select(
        "path_id", "ax", "ay", "bx", "by", "length_m", "bearing"
    )


def float_range(start: Column, end: Column, step: float) -> Column:
    """Array start, start + step, ... up to the end with a hair of slack."""
    n = F.floor((end - start + 1e-9) / step)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0).cast("long"))), lambda i: start + i * step)


def pose_grid(bounds: DataFrame, grid_m: float, step_deg: float, keep: list[str]) -> DataFrame:
    """Poses (keep..., x, y, rotation, turn, pose) on a grid over the bounds
    (min_x, min_y, max_x, max_y) with all rotations, numbered by their place in
    the grid: by x, y and turn."""
    turns = round(360 / step_deg)
    b = bounds.withColumn("ys", float_range(F.col("min_y"), F.col("max_y"), grid_m))
    b = b.select("*", F.posexplode(float_range(F.col("min_x"), F.col("max_x"), grid_m)).alias("ix", "x"))
    b = b.select("*", F.size("ys").cast("long").alias("ny"), F.posexplode("ys").alias("iy", "y"))
    b = b.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    pose = (F.col("ix") * F.col("ny") + F.col("iy")) * turns + F.col("turn")
    return b.select(*keep, "x", "y", (F.col("turn") * (step_deg * math.pi / 180)).alias("rotation"), "turn", pose.alias("pose"))


def sample_ring(ring: DataFrame, samples: int, key: str = "path_id") -> DataFrame:
    """(key, s, seq, x, y, hx, hy): about ``samples`` evenly chosen vertices with headings."""
    h = paths.headings(ring, key=key)
    h = h.withColumn("n", F.count("*").over(Window.partitionBy(key)))
    # Vertex i is sample s = ceil(i k / n) if floor(s n / k) is i.
    s = F.ceil(F.col("seq") * samples / F.col("n"))
    chosen = F.when(F.col("n") <= samples, F.col("seq")).otherwise(F.when((F.floor(s * F.col("n") / samples) == F.col("seq")) & (s < samples), s))
    return h.withColumn("s", chosen.cast("long")).where("s is not null").select(key, "s", "seq", "x", "y", "hx", "hy")


def score_poses(
    poses: DataFrame,
    ring: DataFrame,
    streets: DataFrame,
    samples: int,
    scale: float = 1.0,
    o: SearchOptions = SearchOptions(),
    key: str = "path_id",
    pose: str = "pose",
) -> DataFrame:
    """(key, pose, coverage, mean_m, max_m, turning, residual, score) of poses
    (key, pose, x, y, rotation).

    Coverage is the share of samples with a street along them within 10 m.
    Poses under the minimum coverage stop there, with score coverage - 1; the
    others lose for the turning distance between placed and snapped outline
    and for the misfit of the snapped points to the outline.
    """
    base = sample_ring(ring, samples, key)
    p = poses.select(key, pose, F.col("x").alias("tx"), F.col("y").alias("ty"), "rotation").join(base, key)
    at = g.apply(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"), F.col("rotation"), F.lit(scale))
    turned = g.rotate(F.col("hx"), F.col("hy"), F.col("rotation"))
    p = p.withColumns({"at": at, "h": turned}).select(
        key, pose, "s", F.col("x").alias("bx0"), F.col("y").alias("by0"), "at.x", "at.y", F.col("h.x").alias("hx"), F.col("h.y").alias("hy")
    )
    near = spatial.nearest_segment(p, streets, [key, pose, "s"], o.search_m, 50.0, align_rad=o.align_rad)
    # Read five times below; the distance join should run once.
    near = cut_lineage(near.withColumns({"sx": F.coalesce("fx", "x"), "sy": F.coalesce("fy", "y")}))
    cover = near.groupBy(key, pose).agg(
        F.avg((F.col("d") < o.near_m).cast("double")).alias("coverage"), F.avg("d").alias("mean_m"), F.max("d").alias("max_m"),
        F.sqrt(F.max(F.col("bx0") * F.col("bx0") + F.col("by0") * F.col("by0"))).alias("radius"),
    )
    fit = near.join(cover.where(F.col("coverage") >= o.min_coverage).select(key, pose), [key, pose])
    both = F.struct(F.col(key), F.col(pose)).alias("both")
    line = lambda x, y: fit.select(both, F.col("s").alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))
    turn = lambda x, y, n: paths.cumulative_turning(line(x, y), True, "both").withColumnRenamed("turning", n)
    turning = paths.turning_distance(turn("x", "y", "a").join(turn("sx", "sy", "b"), ["both", "seq"]), "both").withColumnRenamed("distance", "turning")
    pairs = fit.select(both, F.col("sx").alias("fx"), F.col("sy").alias("fy"), F.col("bx0").alias("tx"), F.col("by0").alias("ty"))
    residual = paths.fit_similarity(pairs, "both").select("both", "residual")
    shape = turning.join(residual, "both").select(F.col(f"both.{key}").alias(key), F.col(f"both.{pose}").alias(pose), "turning", "residual")
    s = cover.join(shape, [key, pose], "left")
    norm = F.when(F.col("radius") > 0, F.col("residual") / F.when(F.col("radius") > 0, F.col("radius")).otherwise(F.lit(1.0))).otherwise(F.col("residual"))
    score = F.when(F.col("residual").isNull(), F.col("coverage") - 1).otherwise(
        F.col("coverage") - o.w_turning * F.col("turning") - o.w_procrustes * norm
    )
    return s.select(key, pose, "coverage", "mean_m", "max_m", "turning", "residual", score.alias("score"))


def macro_winners(scored: DataFrame, macro_m: float, keep: int, key: str = "path_id", order: str = "pose") -> DataFrame:
    """The best pose of each macro cell, then the best ``keep`` of them for
    each key; the first in ``order`` on ties."""
    cells = [g.cell(F.col("x"), macro_m).alias("mx"), g.cell(F.col("y"), macro_m).alias("my")]
    value = F.struct(*scored.columns)
    best = scored.groupBy(key, *cells).agg(F.max_by(value, F.struct("score", -F.col(order))).alias("b")).select("b.*")
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def offsets_near(o: SearchOptions) -> list[tuple[float, float, float]]:
    """(dx, dy, turn) of a pose itself, then of its neighbours."""
    span, step = o.refine_m
    turn, turn_step = (math.radians(v) for v in o.refine_deg)
    shifts = [-span + step * i for i in range(int(2 * span / step + 1e-9) + 1)]
    turns = [-turn + turn_step * i for i in range(int(2 * turn / turn_step + 1e-9) + 1)]
    return [(0.0, 0.0, 0.0)] + [(dx, dy, dr) for dx in shifts for dy in shifts for dr in turns]


def refinements(kept: DataFrame, o: SearchOptions = SearchOptions()) -> DataFrame:
    """Each pose with its neighbours in place and rotation, numbered by
    ``step``; the pose itself is step 0."""
    near = [(n, *v) for n, v in enumerate(offsets_near(o))]
    offsets = kept.sparkSession.createDataFrame(near, "step int, dx double, dy double, dr double")
    j = kept.join(F.broadcast(offsets))
    return j.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy"), "rotation": F.col("rotation") + F.col("dr")}).drop("dx", "dy", "dr")


#: Metres of a tile whose poses share the streets near them, of the cells these come by, and poses of a tile in one call.
REFINE_TILE, REFINE_CELL, REFINE_POSES = 4000.0, 500.0, 512


def refine_poses(
    kept: DataFrame, ring: DataFrame, streets: DataFrame, samples: int, scale: float = 1.0, o: SearchOptions = SearchOptions(), key: str = "path_id", pose: str = "pose",
    task_poses: int = REFINE_POSES,
) -> DataFrame:
    """(key, pose, step, x, y, rotation, coverage, mean_m, max_m, score): of each
    pose (key, pose, x, y, rotation) and its ``refinements`` the one with the
    best score of ``score_poses``, the first on ties.

    Neighbours are made where they are scored, from the outline and the streets
    that any of them reaches: neither they nor their samples are shuffled.
    """
    base = sample_ring(ring, samples, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "x", "y", "hx", "hy"))).alias("p"))
    line = lambda c: F.transform("p", lambda v: v[c]).alias(f"p{c}")
    base = base.select(key, *[line(c) for c in ("x", "y", "hx", "hy")])
    w = kept.select(key, pose, F.col("x").alias("tx"), F.col("y").alias("ty"), "rotation").join(base, key)

    # Of each turn on its own: where the centre lies far off, samples swing wide.
    offsets = np.array(offsets_near(o))
    turns, margin = F.array(*[F.lit(v) for v in np.unique(offsets[:, 2]).tolist()]), float(np.abs(offsets[:, :2]).max()) + o.search_m + 1.0

    def cells(x, y, turn):
        at = g.apply(x, y, F.col("tx"), F.col("ty"), F.col("rotation") + turn, F.lit(scale))
        return spatial.box_cells(at["x"] - margin, at["y"] - margin, at["x"] + margin, at["y"] + margin, REFINE_CELL)

    at_turn = lambda turn: F.flatten(F.transform(F.arrays_zip("px", "py"), lambda v: cells(v["px"], v["py"], turn)))
    reached = F.array_distinct(F.flatten(F.transform(turns, at_turn)))
    w = w.withColumns({"__tx": g.cell(F.col("tx"), REFINE_TILE), "__ty": g.cell(F.col("ty"), REFINE_TILE), "cells": reached})
    number = F.row_number().over(Window.partitionBy("__tx", "__ty").orderBy(key, pose))
    unit = ["__tx", "__ty", "__part"]
    w = cut_lineage(w.withColumn("__part", F.floor((number - 1) / task_poses)))
    wanted = w.select(*unit, F.explode("cells").alias("c")).select(*unit, F.col("c.cx").alias("__cx"), F.col("c.cy").alias("__cy")).distinct()
    near = spatial.segment_cells(streets.select("ax", "ay", "bx", "by"), REFINE_CELL).join(wanted, ["__cx", "__cy"])
    near = near.select(*unit, "ax", "ay", "bx", "by").toDF(*unit, "ax", "ay", "bx", "by")  # columns of its own
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"`{key}` {types[key]}, `{pose}` {types[pose]}, step int, x double, y double, rotation double, coverage double, mean_m double, max_m double, score double"

    def run(poses: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        # Segments come once a cell, in the order in which ties go.
        segs = np.unique(near[["ax", "ay", "bx", "by"]].to_numpy(dtype=float), axis=0)
        out = []
        for r in poses.itertuples(index=False):
            own = np.array([r.px, r.py, r.phx, r.phy], dtype=float).T
            out.append((getattr(r, key), getattr(r, pose), *kernels.best_neighbour(own, (r.tx, r.ty, r.rotation), segs, offsets, scale, o)))
        return pd.DataFrame(out, columns=[key, pose, "step", "x", "y", "rotation", "coverage", "mean_m", "max_m", "score"])

    # A number that is given stays: adaptive execution goes by bytes, and these rows take long for theirs.
    tasks = min(max(1, w.select(*unit).distinct().count()), int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = w.drop("cells").toDF(*[c for c in w.columns if c != "cells"]).repartition(tasks, *unit)
    return dealt.groupBy(*unit).cogroup(near.repartition(tasks, *unit).groupBy(*unit)).applyInPandas(run, schema)


def pick_greedy(ranked: DataFrame, key: str, kernel, order: list[str], schema: str, buckets: int | None = None) -> DataFrame:
    """Runs an order-dependent choice on each group; ``kernel`` gets the rows
    (x, y, rotation) in order and gives the numbers of those to keep, ranked.
    With ``buckets`` groups are dealt to so many calls, since small ones cost
    more to call than to choose from."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.drop(columns="__bucket", errors="ignore").sort_values([key, *order], kind="stable").reset_index(drop=True)
        x, y, rotation = (f[c].to_numpy() for c in ("x", "y", "rotation"))
        own = f[key].to_numpy()
        ends = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(f)]
        if f[key].isna().any():  # unknown keys are one group
            ends = [e for e in ends if e <= f[key].notna().sum()] + [len(f)]
        kept, rank = [], []
        for a, b in zip(ends[:-1], ends[1:]):
            chosen = kernel(list(zip(x[a:b].tolist(), y[a:b].tolist(), rotation[a:b].tolist())))
            kept += [a + k for k in chosen]
            rank += range(1, len(chosen) + 1)
        out = f.iloc[kept].copy()
        out["rank"] = rank
        return out

    if buckets is None:
        return ranked.groupBy(key).applyInPandas(run, schema)
    return ranked.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("__bucket").applyInPandas(run, schema)


#: Poses of one key that one task chooses among; where there are more, rounds over cells do.
TASK_POSES = 20_000
#: Poses that share a call where keys have few.
BUCKET_POSES = 5_000


def dedup_poses(
    ranked: DataFrame, key: str, order: list[str], distance_m: float, rotation_deg: float, limit: int | None = None, task_poses: int = TASK_POSES
) -> DataFrame:
    """Poses in order, without those close to an earlier one in place and
    rotation: the first ``limit`` of each key with their rank. ``order`` tells
    the poses of a key apart."""
    ranked = cut_lineage(ranked.drop("rank"))
    most, rows = ranked.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) > task_poses:
        return suppress_poses(ranked, key, order, distance_m, rotation_deg, limit)
    clash = kernels.same_pose(distance_m, math.radians(rotation_deg))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields) + ", rank int"
    return pick_greedy(ranked, key, lambda rows: kernels.greedy(rows, clash, limit), order, schema, max(1, -(-(rows or 0) // BUCKET_POSES)))


def suppress_poses(ranked: DataFrame, key: str, order: list[str], distance_m: float, rotation_deg: float, limit: int | None = None) -> DataFrame:
    """``dedup_poses`` for any number of poses of a key, in parallel rounds.

    Poses lie in cells of ``distance_m`` a side and a rotation of at least
    ``rotation_deg``, so that only those of neighbouring cells can clash. In
    each round a pose that comes first among all open ones of its own and the
    neighbouring cells is kept, since nothing open before it could clash with
    it, and what clashes with it goes, until nothing is open. That gives what
    going through the poses in order gives. First poses of cells, not pairs of
    poses, meet their neighbours, and kept ones lie apart, so that crowded
    places cost no more than their rows. With a ``limit``, what comes after a
    key's so many best kept poses can't be among its first and goes as well.
    """
    bins = max(1, math.floor(360 / max(rotation_deg, 1e-9)))
    bins = min(bins, 1 << 20)
    width = 2 * math.pi / bins
    turn = F.pmod(F.col("rotation"), F.lit(2 * math.pi))
    cell = {
        "__cx": g.cell(F.col("x"), distance_m), "__cy": g.cell(F.col("y"), distance_m),
        "__cr": F.least(F.floor(turn / width), F.lit(bins - 1).cast("long")),
    }
    place = F.struct(*order)
    open_ = ranked.select(key, "x", "y", "rotation", place.alias("__o")).withColumns(cell)
    at = [key, "__cx", "__cy", "__cr"]
    steps = sorted({d % bins for d in (-1, 0, 1)})

    def around(rows: DataFrame) -> DataFrame:
        """A row for each cell whose poses ``rows`` could clash with."""
        for c in ("__cx", "__cy"):
            rows = rows.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
        return rows.withColumn("__cr", F.explode(F.array(*[(F.col("__cr") + d) % bins for d in steps])))

    apart = F.abs(F.col("rotation") - F.col("__kr")) % (2 * math.pi)
    apart = F.when(apart > math.pi, 2 * math.pi - apart).otherwise(apart)
    clash = (g.distance(F.col("x"), F.col("y"), F.col("__kx"), F.col("__ky")) <= distance_m) & (apart <= math.radians(rotation_deg))
    kept = None
    open_ = cut_lineage(open_)
    while not open_.isEmpty():
        first = open_.groupBy(*at).agg(F.min("__o").alias("__f"))
        least = around(first).groupBy(*at).agg(F.min("__f").alias("__f"))
        new = cut_lineage(open_.join(least, at).where(F.col("__o") == F.col("__f")).drop("__f"))
        kept = new if kept is None else kept.unionByName(new)
        near = around(new.select(*at, F.col("x").alias("__kx"), F.col("y").alias("__ky"), F.col("rotation").alias("__kr")))
        on = clash
        for c in at:
            on = on & (F.col(f"o.{c}") == F.col(f"n.{c}"))
        open_ = open_.alias("o").join(near.alias("n"), on, "left_anti")
        if limit:
            # A key's ``limit``-th kept pose so far: at most that many rows a key.
            w = Window.partitionBy(key).orderBy("__o")
            last = kept.select(key, "__o", F.row_number().over(w).alias("n")).where(F.col("n") <= limit)
            last = last.groupBy(key).agg(F.max("__o").alias("__l"), F.max("n").alias("n")).where(F.col("n") == limit).drop("n")
            open_ = open_.join(last, key, "left").where(F.col("__l").isNull() | (F.col("__o") < F.col("__l"))).drop("__l")
        open_ = cut_lineage(open_)
    if kept is None:
        return ranked.withColumn("rank", F.lit(0)).where("false")
    w = Window.partitionBy(key).orderBy("__o")
    chosen = kept.select(key, "__o", F.row_number().over(w).cast("int").alias("rank"))
    chosen = chosen.where(F.col("rank") <= limit) if limit else chosen
    names = {f"__o{i}": F.col("__o")[c] for i, c in enumerate(order)}
    chosen = chosen.select(F.col(key).alias("__k"), *[c.alias(n) for n, c in names.items()], "rank")
    same = F.col(key).eqNullSafe(F.col("__k"))
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"__o{i}"))
    return ranked.join(chosen, same).drop("__k", *names)


def diverse_poses(ranked: DataFrame, key: str, order: list[str], distance_m: float, count: int) -> DataFrame:
    """Poses that lie apart first, then the best of the rest, up to ``count``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank") + ", rank int"
    return pick_greedy(ranked.drop("rank"), key, lambda rows: kernels.spread(rows, distance_m, count), order, schema)


def search_placements(
    ring: DataFrame, streets: DataFrame, bounds: DataFrame, scale: float = 1.0, o: SearchOptions = SearchOptions(), key: str = "path_id"
) -> DataFrame:
    """(key, rank, x, y, rotation, coverage, mean_m, max_m, score): the best
    placements of each outline on the streets.

    A coarse grid over the bounds is scored; every macro cell sends its best
    pose, so that one good quarter can't take all places; the winners are
    refined, freed of duplicates and spread out.
    """
    cross = ring.select(key).distinct().join(F.broadcast(bounds))
    grid = pose_grid(cross, o.grid_m, o.grid_deg, [key])
    coarse = score_poses(grid, ring, streets, o.samples[0], scale, o, key).where(F.col("coverage") >= o.min_coverage)
    coarse = grid.join(coarse.select(key, "pose", "coverage", "score"), [key, "pose"])
    kept = cut_lineage(macro_winners(coarse, o.macro_m, o.keep, key).select(key, F.col("pose").alias("seed"), "x", "y", "rotation"))
    tried = refinements(kept, o).withColumn("pose", F.col("seed").cast("long") * 1000 + F.col("step"))
    fine = score_poses(tried, ring, streets, o.samples[1], scale, o, key)
    value = F.struct("x", "y", "rotation", "coverage", "mean_m", "max_m", "score")
    best = tried.join(fine, [key, "pose"]).groupBy(key, "seed").agg(F.max_by(value, F.struct("score", -F.col("step"))).alias("b")).select(key, "seed", "b.*")
    ranked = best.where(F.col("coverage") >= o.min_coverage).withColumn("lost", -F.col("score"))
    apart = dedup_poses(ranked, key, ["lost", "seed"], o.dedup_m, o.dedup_deg)
    chosen = diverse_poses(apart, key, ["lost", "seed"], o.diversity_m, o.results)
    final = Window.partitionBy(key).orderBy(F.desc("score"), "seed")
    return chosen.withColumn("rank", F.row_number().over(final)).select(key, "rank", "x", "y", "rotation", "coverage", "mean_m", "max_m", "score")
