"""Generating routes: poses, matching to streets, pruning, ranking, and more
effort where the best route misses the bar."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph as graphs
from ..operators import kernels, paths, raster
from ..operators.components import BROADCAST_ROWS, cut_lineage
from ..params import Bar, GraphOptions, LadderOptions, MatchOptions, PoseOptions, PruneOptions, RasterOptions, Tier
from . import tiles

ROUTE = (
    "path_id long, pose long, x double, y double, rotation double, length_m double, length_ratio double, mean_deviation_m double,"
    " max_deviation_m double, frechet_m double, retraced_fraction double, worst double, passes boolean, nodes array<string>,"
    " points array<array<double>>"
)


#: Poses of a region that share a task, and with it the region's graph.
TASK_POSES = 16


def graph_rows(nodes: DataFrame, edges: DataFrame, region: str | None = None) -> DataFrame:
    """(region, nodes, edges, main): a row a region, its graph packed for the
    matching kernels with the nodes of its largest component.

    Without ``region`` all is region 0. A region's graph must fit a task;
    nothing passes through the driver.
    """
    own = F.col(region).cast("long") if region else F.lit(0).cast("long")
    nodes, edges = nodes.withColumn("__r", own), edges.withColumn("__r", own)
    size = nodes.groupBy("__r", "component").agg(F.count("*").alias("n"))
    main = size.groupBy("__r").agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    inside = nodes.join(main, ["__r", "component"]).groupBy("__r").agg(F.array_sort(F.collect_list("node")).alias("main"))
    n = nodes.groupBy("__r").agg(F.collect_list(F.struct("node", "x", "y")).alias("nodes"))
    e = edges.groupBy("__r").agg(F.collect_list(F.struct("edge", "a", "b", "length_m", "points")).alias("edges"))
    return n.join(e, "__r").join(inside, "__r").withColumnRenamed("__r", "region")


def by_region(work: DataFrame, packed: DataFrame, run, schema: str, task_rows: int = TASK_POSES) -> DataFrame:
    """``run(graph, main, frame)`` on the rows of ``work`` (region, ...), dealt
    to tasks of about ``task_rows`` rows of one region each."""
    salts = work.groupBy("region").agg(F.ceil(F.count("*") / task_rows).cast("long").alias("salts"))
    w = Window.partitionBy("region").orderBy("path_id", "pose")
    dealt = work.withColumn("salt", F.floor((F.row_number().over(w) - 1) / task_rows))
    copies = packed.join(salts, "region").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def each(key: tuple, frame: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        if not len(frame) or not len(graph):
            return pd.DataFrame(columns=columns)
        return pd.DataFrame(run(*unpack_graph(graph.iloc[0]), frame), columns=columns)

    return dealt.groupBy("region", "salt").cogroup(copies.groupBy("region", "salt")).applyInPandas(each, schema)


def unpack_graph(row) -> tuple[kernels.Graph, list]:
    nodes = sorted((n["node"], n["x"], n["y"]) for n in row["nodes"])
    edges = sorted(((e["edge"], e["a"], e["b"], e["length_m"], [tuple(p) for p in e["points"]]) for e in row["edges"]), key=lambda e: e[0])
    return kernels.Graph(nodes, edges), list(row["main"])


def match_poses(
    poses: DataFrame, ring: DataFrame, nodes: DataFrame, edges: DataFrame, target_m: DataFrame, scale: float, tier: Tier, o: LadderOptions = LadderOptions(),
    key: str = "path_id",
) -> DataFrame:
    """Routes (``ROUTE``) of the poses: each placed outline matched to the
    streets and scored; the best ``pool`` of each outline are pruned and
    scored again. Poses without a match are left out. With a column ``region``
    poses are matched to the nodes of theirs, all regions in one run.

    No task holds a region's graph: hops come from tiles of it (``tiles``), a
    scored walk brings the streets that it passes, a pruned one those around.
    """
    own = lambda t: (F.col("region").cast("long") if "region" in t.columns else F.lit(0).cast("long")).alias("region")
    nodes = cut_lineage(nodes.select(own(nodes), "node", "x", "y", "component"))
    both = g.apply(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"), F.col("rotation"), F.lit(scale))
    p = poses.select(own(poses), key, "pose", F.col("x").alias("tx"), F.col("y").alias("ty"), "rotation").join(ring, key).withColumn("p", both)
    placed = p.groupBy("region", key, "pose", "tx", "ty", "rotation").agg(F.array_sort(F.collect_list(F.struct("seq", "p.x", "p.y"))).alias("ring"))
    work = placed.join(target_m.select(key, (F.col("length_m") * scale).alias("target_m")), key)
    work = cut_lineage(work.withColumnRenamed(key, "path_id"))
    bar = o.bar

    def outline(row) -> np.ndarray:
        return np.array([(p["x"], p["y"]) for p in row.ring])

    def score(row, nodes: list, points: np.ndarray, legs: list, graph: kernels.Graph) -> dict:
        m = kernels.route_metrics(points, legs, outline(row), row.target_m, graph)
        worst = max(kernels.bar_terms(m, bar))
        return {
            "path_id": row.path_id, "pose": row.pose, "x": row.tx, "y": row.ty, "rotation": row.rotation, **m,
            "worst": worst, "passes": worst <= 1, "nodes": nodes, "points": points.tolist(),
        }

    def prune(graph: kernels.Graph, row) -> list[dict]:
        kept = kernels.prune_spikes(list(row.nodes), graph, outline(row), row.target_m, PruneOptions(passes=tier.passes), bar)
        return [score(row, kept, *graph.loop(kept), graph)]

    options = MatchOptions(radius_m=tier.radius_m, candidates=tier.candidates)
    streets = cut_lineage(tiles.street_table(nodes, edges))
    walks, legs = tiles.match_outlines(work, nodes, edges, streets, options)
    matched = cut_lineage(tiles.score_walks(walks, legs, nodes, streets, score, ROUTE, work))
    w = Window.partitionBy("path_id").orderBy("worst", "pose")
    best = matched.withColumn("n", F.row_number().over(w)).where(F.col("n") <= o.pool)
    if not tier.passes:
        return cut_lineage(best.drop("n"))
    best = best.select("path_id", "pose", "nodes", "points", "length_m").join(work, ["path_id", "pose"])
    # A walk of one node has no length and nothing to prune.
    still = cut_lineage(best.where("size(nodes) < 2").select("path_id", "pose"))
    pruned = tiles.with_surroundings(cut_lineage(best.where("size(nodes) > 1")), streets, prune, ROUTE)
    return cut_lineage(pruned.unionByName(matched.join(still, ["path_id", "pose"], "left_semi")))


def pick_distinct(routes: DataFrame, kept: int, separation_m: float) -> DataFrame:
    """Routes whose anchors lie apart first, then the best of the rest, ranked by worst term."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["worst", "pose"], kind="stable").reset_index(drop=True)
        chosen = kernels.spread(list(zip(f.x, f.y)), separation_m, kept)
        return pd.DataFrame({"path_id": f.path_id[chosen], "pose": f.pose[chosen], "rank": range(1, len(chosen) + 1)})

    # The choice needs places only: the routes themselves stay out of Python.
    chosen = routes.select("path_id", "pose", "x", "y", "worst").groupBy("path_id").applyInPandas(run, "path_id long, pose long, rank int")
    return routes.select(*[c.split()[0] for c in ROUTE.split(", ")]).join(chosen, ["path_id", "pose"])


def generate_routes(
    rings: DataFrame, ways: DataFrame, scale: float = 1.0, ladder: LadderOptions = LadderOptions(), poses: PoseOptions = PoseOptions(),
    grid: RasterOptions = RasterOptions(), streets: GraphOptions = GraphOptions(),
) -> DataFrame:
    """(region, ..., rank, tier): up to ``kept`` routes for every outline
    ``rings`` (path_id, seq, x, y; centred) in every region of the streets
    ``ways`` (region, path_id, seq, x, y); without ``region`` all is region 0.

    An outline in a region is searched for on its own. Each tier searches
    wider; those whose best route meets the bar stop there, the others go on,
    and after the last tier keep what they have. All regions run at once: one
    graph build, one sparse raster, and matching by tiles.
    """
    region = F.col("region").cast("long") if "region" in ways.columns else F.lit(0).cast("long")
    ways = ways.select(region.alias("region"), "path_id", "seq", "x", "y")
    own = ways.select("region", F.col("path_id").alias("way")).distinct()
    nodes, edges = graphs.build_graph(ways.drop("region"), streets)
    edges = edges.withColumn("way", F.split("edge", ":")[0].cast(ways.schema["path_id"].dataType))
    edges = cut_lineage(edges.join(own, "way").drop("way"))
    ends = edges.select("region", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.min("region").alias("region"))
    nodes = cut_lineage(nodes.join(ends, "node"))
    segs = paths.segments(ways.drop("region"), False)
    box = cut_lineage(paths.bounds(ways, "region"))
    frame = cut_lineage(raster.raster_frame(paths.bounds(ways, None), grid))
    reach = int(np.ceil(poses.cap_m / grid.cell_m))
    cells = cut_lineage(raster.near_cells(raster.source_cells(segs, frame, grid), reach))

    # One outline in one region is a pair: every outline is asked for in every region.
    outlines, regions = rings.select("path_id").distinct(), box.select("region")
    pairs = outlines.join(F.broadcast(regions) if regions.count() <= BROADCAST_ROWS else regions)
    pairs = cut_lineage(pairs.withColumn("pair", F.monotonically_increasing_id()))
    left = rings.join(pairs, "path_id").select("pair", "seq", "x", "y")
    target = cut_lineage(paths.path_length(left, True, "pair"))
    bounds = cut_lineage(pairs.join(box, "region").select("pair", "min_x", "min_y", "max_x", "max_y"))
    done = None
    for number, tier in enumerate(ladder.tiers):
        found = raster.search_poses(left, bounds, cells, frame, scale, replace(poses, count=tier.poses), grid, "pair")
        found = found.withColumn("pose", F.col("rank").cast("long")).join(pairs.select("pair", "region"), "pair")
        routes = match_poses(cut_lineage(found), left, nodes, edges, target, scale, tier, ladder, "pair")
        best = routes.groupBy("path_id").agg(F.min("worst").alias("best"))
        last = number == len(ladder.tiers) - 1
        over = best if last else best.where("best <= 1")
        part = routes.join(over.select("path_id"), "path_id", "left_semi")
        part = pick_distinct(part, ladder.kept, ladder.separation_m).withColumn("tier", F.lit(number))
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left = cut_lineage(left.join(over.select(F.col("path_id").alias("pair")), "pair", "left_anti"))
        if left.isEmpty():
            break
    named = pairs.select(F.col("pair").alias("path_id"), "region", F.col("path_id").alias("outline"))
    return done.join(named, "path_id").drop("path_id").withColumnRenamed("outline", "path_id")


def route_entries(routes: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Routes as stored: points in degrees to six decimals without the closing one."""
    def place(p):
        ll = g.to_lonlat(p[0], p[1], F.lit(lon0), F.lit(lat0))
        return F.array(g.half_up(ll["lon"], 6), g.half_up(ll["lat"], 6))

    return routes.withColumn("points", F.transform(F.slice("points", 1, F.size("points") - 1), place))


def write_routes(routes: DataFrame, folder: str, dry_run: bool = False) -> int:
    """Writes stored routes partitioned by circuit and gives their number; a
    dry run only counts. Only the circuits at hand are replaced."""
    if dry_run:
        return routes.count()
    routes = cut_lineage(routes)  # one generation for both the files and the count
    writer = routes.repartition("circuit_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("circuit_id").parquet(folder)
    return routes.count()


__all__ = ["Bar", "generate_routes", "match_poses", "pick_distinct", "route_entries", "write_routes"]
