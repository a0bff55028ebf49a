"""Matching placed outlines to streets without a task that holds a region's graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph as graphs
from ..operators import kernels, spatial
from ..operators.components import cut_lineage
from ..params import MatchOptions

POSE = ["region", "path_id", "pose"]


def main_nodes(nodes: DataFrame) -> DataFrame:
    """(region, node, x, y) of every region's largest component; ties by name."""
    size = nodes.groupBy("region", "component").agg(F.count("*").alias("n"))
    main = size.groupBy("region").agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    return nodes.join(main, ["region", "component"]).select("region", "node", "x", "y")


def street_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, a, b, length_m, points, ax, ay, bx, by): edges with their nodes' places."""
    at = lambda s: nodes.select(F.col("node").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    return edges.select("edge", "a", "b", "length_m", "points").join(at("a"), "a").join(at("b"), "b")


def small_graph(frame: pd.DataFrame) -> kernels.Graph:
    """The graph of some rows of ``street_table``."""
    nodes = dict(zip(frame.a, zip(frame.ax, frame.ay))) | dict(zip(frame.b, zip(frame.bx, frame.by)))
    rows = zip(frame.edge, frame.a, frame.b, frame.length_m, frame.points)
    edges = sorted(((i, a, b, n, [tuple(p) for p in points]) for i, a, b, n, points in rows), key=lambda e: e[0])
    return kernels.Graph([(k, *xy) for k, xy in sorted(nodes.items())], edges)


#: Poses that share a call into Python.
TOGETHER = 32


def by_pose(poses: DataFrame, rows: DataFrame, run, schema: str, single: bool = False, together: int = TOGETHER) -> DataFrame:
    """``run(key, poses, rows)``, a list of rows, for every pose (region,
    path_id, pose) of ``poses`` with its ``rows``; about ``together`` poses are
    dealt to a call, since few rows a call cost more than they work. Where
    poses have a row each (``single``), ``run`` gets that row, not a frame."""
    buckets = max(1, -(-poses.select(*POSE).distinct().count() // together))
    # A number that is given stays: adaptive execution goes by bytes, and these rows take long for theirs.
    tasks = min(buckets, int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [c.split()[0] for c in schema.split(", ")]
    own = lambda t: t.toDF(*t.columns).withColumn("__bucket", F.pmod(F.xxhash64(*POSE), F.lit(buckets))).repartition(tasks, "__bucket")  # noqa: E731  columns of its own

    def each(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = dict(list(right.groupby(POSE)))
        own = (((r.region, r.path_id, r.pose), r) for r in left.itertuples()) if single else left.groupby(POSE)
        out = []
        for pose, rows in own:
            out += run(pose, rows, parts.get(pose, right.iloc[:0]))
        return pd.DataFrame(out, columns=names)

    return own(poses).groupBy("__bucket").cogroup(own(rows).groupBy("__bucket")).applyInPandas(each, schema)


#: Outlines that are resampled at once.
SAMPLED = 256


def placed_samples(placed: DataFrame, step_m: float, some: int = SAMPLED) -> DataFrame:
    """(region, path_id, pose, i, n, x, y): the outlines ``placed`` (...,
    ring), resampled, ``some`` at once."""

    def run(batches):
        for batch in batches:
            # Arrow's lists are read in place: as Python objects a batch of rings is many times as large.
            for part in (batch.slice(at, some) for at in range(0, batch.num_rows, some)):
                rings = part.column("ring")
                vertices = rings.flatten()
                xy = np.column_stack([vertices.field(c).to_numpy(zero_copy_only=False) for c in "xy"])
                ends = np.concatenate([[0], np.cumsum(rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
                found = [kernels.resample(xy[a:b], step_m, True) for a, b in zip(ends[:-1], ends[1:])]
                n = np.array([len(f) for f in found], dtype=np.int64)
                own = np.repeat(np.arange(len(found)), n)
                places = np.concatenate(found)
                i = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                columns = [*(part.column(c).take(pa.array(own)) for c in POSE), *map(pa.array, (i, n[own], places[:, 0], places[:, 1]))]
                yield pa.RecordBatch.from_arrays(columns, names=[*POSE, "i", "n", "x", "y"])

    return placed.select(*POSE, "ring").mapInArrow(run, "region long, path_id long, pose long, i long, n long, x double, y double")


def candidates(samples: DataFrame, inside: DataFrame, o: MatchOptions) -> DataFrame:
    """(region, path_id, pose, i, n, c): up to ``candidates`` nodes (node, x, y,
    d) in reach of each sample, nearest first, that keep their spacing; only
    poses all of whose samples have some."""
    own = inside.select(F.col("region").alias("r"), "node", F.col("x").alias("px"), F.col("y").alias("py"))
    near = spatial.near_points(samples, own, o.radius_m).where("region = r")
    by = near.groupBy(*POSE, "i", "n").agg(F.array_sort(F.collect_list(F.struct("d", "node", F.col("px").alias("x"), F.col("py").alias("y")))).alias("c"))
    none = F.filter("c", lambda c: F.lit(False))
    apart = lambda kept, c: ~F.exists(kept, lambda k: g.distance(k["x"], k["y"], c["x"], c["y"]) < o.min_separation_m)
    pick = F.aggregate("c", none, lambda kept, c: F.when((F.size(kept) < o.candidates) & apart(kept, c), F.concat(kept, F.array(c))).otherwise(kept))
    by = cut_lineage(by.select(*POSE, "i", "n", pick.alias("c")))
    whole = by.groupBy(*POSE).agg(F.count("*").alias("have"), F.max("n").alias("n")).where("have = n").select(*POSE)
    return by.join(whole, POSE, "left_semi")


def bounded_paths(pairs: DataFrame, streets: DataFrame, most: float, tile_m: float) -> DataFrame:
    """(a, b, length_m, edges): the shortest path of each distinct pair (a, b,
    ax, ay) of at most ``most`` metres; other pairs are left out.

    Such a path stays within ``most`` of its start. A tile of starts gets the
    edges that begin within ``most`` of it and searches once from each start,
    for all of its ends.
    """
    starts = spatial.point_cells(pairs.dropDuplicates(["a", "b"]), tile_m, 0.0, "ax", "ay").withColumnsRenamed({"__cx": "tx", "__cy": "ty"})
    starts = cut_lineage(starts.select("tx", "ty", "a", "b"))
    near = spatial.point_cells(streets.select("edge", "a", "b", "length_m", "ax", "ay"), tile_m, most, "ax", "ay").withColumnsRenamed({"__cx": "tx", "__cy": "ty"})
    near = near.join(starts.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi").select("tx", "ty", "edge", "a", "b", "length_m")

    def run(key: tuple, asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked):
            near = near.sort_values("edge")
            graph = kernels.Graph([], [(*e, []) for e in zip(near.edge, near.a, near.b, near.length_m)])
            for start, ends in asked.groupby("a").b:
                rows += [(start, end, length, list(way)) for end, (length, way) in graph.reach(start, sorted(ends), most).items()]
        return pd.DataFrame(rows, columns=["a", "b", "length_m", "edges"])

    found = starts.groupBy("tx", "ty").cogroup(near.groupBy("tx", "ty"))
    return found.applyInPandas(run, "a string, b string, length_m double, edges array<string>")


def match_outlines(
    placed: DataFrame, nodes: DataFrame, edges: DataFrame, streets: DataFrame, o: MatchOptions, tile_m: float = 1000.0
) -> tuple[DataFrame, DataFrame]:
    """(walks, legs) of the outlines ``placed`` (region, path_id, pose, ring):
    walks (region, path_id, pose, nodes) along the streets of their region's
    largest component, and the shortest paths legs (a, b, edges) of
    consecutive nodes. Poses without a walk are left out.

    ``nodes`` (region, node, x, y, component), ``edges`` (edge, a, b, length_m,
    points), ``streets`` their ``street_table``. Samples meet nodes by a distance join. The cost of a hop doesn't
    rise beyond a length, so hops come from searches bounded by it, tile by
    tile, each start once; they are rows. What a task holds of one pose are its
    hops' costs, from which the cheapest closed walk is folded.
    """
    found = cut_lineage(candidates(placed_samples(placed, o.step_m), main_nodes(nodes), o))
    after = found.select(*[F.col(c).alias(f"next_{c}") for c in POSE], F.col("i").alias("next_i"), F.col("c").alias("e"))
    on = F.col("next_i") == (F.col("i") + 1) % F.col("n")
    for c in POSE:
        on = on & (F.col(c) == F.col(f"next_{c}"))
    steps = found.where("n > 1").join(after, on)
    steps = steps.select(*POSE, "i", F.posexplode("c").alias("k", "p"), "e").select(*POSE, "i", "k", "p", F.posexplode("e").alias("m", "q"))
    reach = g.distance(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"))
    steps = steps.where((reach <= o.step_m * o.hop_factor) | (F.col("p.node") == F.col("q.node")))
    first = F.col("p.node") < F.col("q.node")
    place = lambda c: F.when(first, F.col(f"p.{c}")).otherwise(F.col(f"q.{c}"))
    steps = steps.select(*POSE, "i", "k", "m", F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"), place("x").alias("ax"), place("y").alias("ay"))
    steps = cut_lineage(steps)
    most = o.step_m * (1 + o.cost_cap / o.excess_weight)
    hops = cut_lineage(bounded_paths(steps.where("a <> b").select("a", "b", "ax", "ay"), streets, most, max(tile_m, most)))

    length = F.col("length_m")
    cost = (o.excess_weight * F.greatest(F.lit(0.0), length - o.step_m) + o.deficit_weight * F.greatest(F.lit(0.0), o.step_m - length)) / o.step_m
    cost = F.when(F.col("a") == F.col("b"), 0.0).when(length.isNull(), o.cost_cap).otherwise(F.least(cost, F.lit(o.cost_cap)))
    priced = steps.join(hops.select("a", "b", "length_m"), ["a", "b"], "left").select(*POSE, "i", "k", "m", cost.alias("cost"))

    def run(key: tuple, states: pd.DataFrame, costs: pd.DataFrame) -> list:
        states = states.sort_values("i")
        names = [[c["node"] for c in row] for row in states.c]
        emission = [(np.array([c["d"] for c in row]) / o.emission_m) ** 2 for row in states.c]
        sizes = [len(x) for x in names]
        layers = [np.full((s, sizes[(i + 1) % len(sizes)]), np.inf) for i, s in enumerate(sizes)]
        for i, k, m, c in zip(costs.i.tolist(), costs.k.tolist(), costs.m.tolist(), costs.cost.tolist()):
            layers[i][k, m] = c
        if len(names) == 1:
            np.fill_diagonal(layers[0], 0.0)
        walk = kernels.closed_walk(layers, emission)
        return [] if walk is None else [(*key, [names[i][k] for i, k in enumerate(walk)])]

    walks = cut_lineage(by_pose(found, priced, run, "region long, path_id long, pose long, nodes array<string>"))

    ring = F.concat("nodes", F.array(F.get("nodes", F.lit(0))))
    pairs = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
    legs = cut_lineage(walks.select(F.explode(pairs).alias("l")).select("l.*").where("a <> b").distinct())
    both = hops.select("a", "b", "edges").unionByName(hops.select(F.col("b").alias("a"), F.col("a").alias("b"), F.reverse("edges").alias("edges")))
    legs = cut_lineage(legs.join(both, ["a", "b"], "left"))
    # Hops at the cost's cap: mostly a little farther, or else anywhere.
    far, legs = legs.where("edges is null").select("a", "b"), legs.where("edges is not null")
    starts = nodes.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    near = cut_lineage(far.join(starts, "a").join(bounded_paths(far.join(starts, "a"), streets, 4 * most, max(tile_m, 4 * most)).drop("length_m"), ["a", "b"], "left"))
    legs = legs.unionByName(near.where("edges is not null").select("a", "b", "edges"))
    rest = near.where("edges is null").select("a", "b")
    if not rest.isEmpty():
        legs = legs.unionByName(graphs.shortest_paths(rest, nodes, edges).select("a", "b", "edges"))
    return walks, cut_lineage(legs)


def walk_streets(walks: DataFrame, legs: DataFrame, streets: DataFrame) -> DataFrame:
    """The rows of ``streets`` that each walk passes, as (region, path_id,
    pose, leg, k, ...): edge k of the leg from node number ``leg``."""
    ring = F.concat("nodes", F.array(F.get("nodes", F.lit(0))))
    pairs = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
    steps = walks.select(*POSE, F.posexplode(pairs).alias("leg", "l")).select(*POSE, "leg", "l.a", "l.b")
    used = steps.join(legs, ["a", "b"]).select(*POSE, "leg", F.posexplode("edges").alias("k", "edge"))
    return used.join(streets, "edge")


def score_walks(walks: DataFrame, legs: DataFrame, nodes: DataFrame, streets: DataFrame, score, schema: str, work: DataFrame) -> DataFrame:
    """``score(row, nodes, points, legs, graph)`` of each walk, with its row of
    ``work`` and the graph of the streets that it passes."""
    # A walk of one node passes no street: its place comes with it.
    first = nodes.select(F.col("node").alias("first"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    rows = work.join(walks, POSE).withColumn("first", F.get("nodes", F.lit(0))).join(first, "first")

    def run(key: tuple, row, used: pd.DataFrame) -> list:
        used = used.sort_values(["leg", "k"])
        by_leg: dict = {}
        for leg, edge in zip(used.leg, used.edge):
            by_leg.setdefault(leg, []).append(edge)
        graph = small_graph(used.drop_duplicates("edge"))
        graph.position.setdefault(row.first, (row.fx, row.fy))
        ring = [*row.nodes, row.nodes[0]]
        walked = [{"points": graph.polyline(a, by_leg.get(i, [])), "real": True, "edges": by_leg.get(i, [])} for i, a in enumerate(ring[:-1])]
        return [score(row, list(row.nodes), kernels.leg_points(walked), walked, graph)]

    return by_pose(rows, walk_streets(walks, legs, streets), run, schema, single=True)


#: Routes that share a call with the streets around each.
AROUND = 8


def with_surroundings(work: DataFrame, streets: DataFrame, run, schema: str, tile_m: float = 1000.0) -> DataFrame:
    """``run(graph, row)``, a list, on each row of ``work`` (region, path_id,
    pose, points, length_m, ...) with the streets around its route.

    Whatever is left out of a loop, the shortest path between two of its nodes
    is no longer than half the loop and so stays within a quarter of it from
    one of them: what lies farther from the route's box is on none. Edges
    come by tiles of that box, and none twice.
    """
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    margin = F.col("length_m") / 4 + 50.0  # and what a node may lie off its streets
    lo, hi = lambda v: F.array_min(v) - margin, lambda v: F.array_max(v) + margin
    boxed = work.withColumn("box", F.struct(lo(xs).alias("x0"), lo(ys).alias("y0"), hi(xs).alias("x1"), hi(ys).alias("y1")))
    tiles = boxed.select(*POSE, "box", F.explode(spatial.box_cells(F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1"), tile_m)).alias("t"))
    own = streets.select("*", g.cell(F.col("ax"), tile_m).alias("tx"), g.cell(F.col("ay"), tile_m).alias("ty"))
    near = tiles.select(*POSE, F.col("t.cx").alias("tx"), F.col("t.cy").alias("ty")).join(own, ["tx", "ty"]).drop("tx", "ty")

    return by_pose(work, near, lambda key, row, near: run(small_graph(near), row), schema, single=True, together=AROUND)
