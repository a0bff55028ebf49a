"""Building a routable graph from streets, and shortest paths on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import GraphOptions
from . import overlay, paths, spatial
from .components import connected_components, cut_lineage
from .kernels import Graph


def endpoints(ways: DataFrame) -> DataFrame:
    """(ep, way, x, y): both ends of every way; ep = 2 * way, + 1 for the last."""
    e = ways.groupBy("path_id").agg(
        F.min_by(F.struct("x", "y"), "seq").alias("first"), F.max_by(F.struct("x", "y"), "seq").alias("last")
    )
    both = F.array(F.struct(F.lit(0).alias("end"), F.col("first").alias("p")), F.struct(F.lit(1).alias("end"), F.col("last").alias("p")))
    e = e.select("path_id", F.explode(both).alias("e"))
    return e.select((F.col("path_id") * 2 + F.col("e.end")).alias("ep"), F.col("path_id").alias("way"), "e.p.x", "e.p.y")


def merge_endpoints(ends: DataFrame, merge_m: float) -> DataFrame:
    """(ep, cluster): ends within ``merge_m`` of each other, transitively; the
    cluster is its least end."""
    other = ends.select(F.col("ep").alias("b"), F.col("x").alias("px"), F.col("y").alias("py"))
    links = spatial.near_points(ends, other, merge_m).where("ep < b").select(F.col("ep").alias("a"), "b")
    return connected_components(links, ends.select(F.col("ep").alias("node"))).select(
        F.col("node").alias("ep"), F.col("component").alias("cluster")
    )


def junction_splits(ends: DataFrame, clusters: DataFrame, segs: DataFrame, o: GraphOptions, index: DataFrame | None = None) -> DataFrame:
    """(way, seg, t, x, y, root): where a lonely end meets the inside of
    another way, the nearest place in reach."""
    lonely = clusters.groupBy("cluster").agg(F.min("ep").alias("ep"), F.count("*").alias("n")).where("n = 1")
    lonely = ends.join(lonely.select("ep", "cluster"), "ep").withColumnRenamed("way", "own")
    pairs = spatial.near_segments(lonely, segs, o.merge_m, o.cell_m, strict=False, index=index).where("way <> own")
    best = pairs.groupBy("ep", "cluster").agg(
        F.min_by(F.struct("way", "seg", "t", "fx", "fy"), F.struct("d", "way", "seg")).alias("b")
    )
    root = F.concat(F.lit("e"), F.col("cluster").cast("string"))
    return best.select("b.way", "b.seg", "b.t", F.col("b.fx").alias("x"), F.col("b.fy").alias("y"), root.alias("root"))


def corridor_approaches(segs: DataFrame, corridor_m: float, index: DataFrame | None = None) -> DataFrame:
    """(way_a, way_b, seg_a, seg_b, near): each pair of ways' closest approach
    within the corridor, the first on ties."""
    pairs = spatial.near_segment_pairs(segs, corridor_m, ["way", "seg"], F.col("a_way") != F.col("b_way"), index)
    pairs = pairs.groupBy(F.col("a_way").alias("way_a"), F.col("b_way").alias("way_b")).agg(
        F.min_by(F.struct("a_seg", "b_seg", "near"), F.struct("near.d", "a_seg", "b_seg")).alias("b")
    )
    return pairs.select("way_a", "way_b", F.col("b.a_seg").alias("seg_a"), F.col("b.b_seg").alias("seg_b"), "b.near")


def corridor_splits(segs: DataFrame, ends: DataFrame, o: GraphOptions, index: DataFrame | None = None) -> DataFrame:
    """(way, seg, t, x, y, root) on both ways of each approach that is not at
    an end of either way nor at a place where streets cross on two levels."""
    a = corridor_approaches(segs, o.corridor_m, index)
    for x, y in o.exclusions:
        a = a.where(g.distance(F.col("near.x"), F.col("near.y"), F.lit(x), F.lit(y)) > o.exclude_m)
    by_way = ends.groupBy("way").agg(F.collect_list(F.struct("x", "y")).alias("ends"))
    for side in ("way_a", "way_b"):
        own = by_way.select(F.col("way").alias(side), F.col("ends").alias("__ends"))
        close = F.exists("__ends", lambda e: g.distance(F.col("near.x"), F.col("near.y"), e["x"], e["y"]) <= o.merge_m)
        a = a.join(own, side).where(~close).drop("__ends")
    root = F.concat_ws(":", F.lit("x"), F.col("way_a"), F.col("way_b"))
    one = lambda way, seg, t: F.struct(F.col(way).alias("way"), F.col(seg).alias("seg"), F.col(t).alias("t"))
    sides = F.explode(F.array(one("way_a", "seg_a", "near.ta"), one("way_b", "seg_b", "near.tb")))
    a = a.select(sides.alias("s"), F.col("near.x").alias("x"), F.col("near.y").alias("y"), root.alias("root"))
    return a.select("s.way", "s.seg", "s.t", "x", "y", "root")


def build_graph(ways: DataFrame, o: GraphOptions = GraphOptions()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the streets ``ways`` (path_id, seq from 0, x, y).

    nodes: (node, x, y, component); edges: (edge, a, b, length_m, points).
    Ends in reach of each other become one node, lonely ends join the street
    that they touch, and ways that come within the corridor are joined at
    their closest approach. Nothing is collected: every step is a cell join
    or a window over one way.
    """
    ways = cut_lineage(ways.select("path_id", "seq", "x", "y").repartition("path_id"))
    segs = paths.segments(ways, False).select(
        F.col("path_id").alias("way"), (F.col("seq") + 1).alias("seg"), "ax", "ay", "bx", "by"
    )
    segs, ends = cut_lineage(segs), cut_lineage(endpoints(ways))
    clusters = cut_lineage(merge_endpoints(ends, o.merge_m))
    # One index of the segments by cell serves both the touching ends and the corridor, where their cells agree.
    shared = o.corridor_m > 0 and o.cell_m == spatial.pair_cell(o.corridor_m) and o.merge_m <= o.corridor_m
    index = spatial.segment_index(segs, o.cell_m, o.corridor_m) if shared else None
    splits = junction_splits(ends, clusters, segs, o, index)
    if o.corridor_m > 0:
        splits = splits.unionByName(corridor_splits(segs, ends, o, index))
    splits = cut_lineage(splits)

    roots = cut_lineage(ends.join(clusters, "ep").withColumn("root", F.concat(F.lit("e"), F.col("cluster").cast("string"))))
    means = roots.groupBy("root").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = splits.groupBy("root").agg(F.min_by(F.struct("x", "y"), F.struct("way", "seg", "t")).alias("p"))
    nodes = means.join(moved, "root", "full").select(
        F.col("root").alias("node"), F.coalesce("p.x", "mx").alias("x"), F.coalesce("p.y", "my").alias("y")
    )
    nodes = cut_lineage(nodes)

    # Vertices and splits of each way in walking order; a split lies before the vertex that ends its segment.
    w = Window.partitionBy("way").orderBy("seg", "t", "root")
    whole = Window.partitionBy("way")
    own = ways.select(F.col("path_id").alias("way"), F.col("seq").alias("seg"), F.lit(2.0).alias("t"), "x", "y")
    own = own.withColumn("end", F.when(F.col("seg") == F.min("seg").over(whole), 0).when(F.col("seg") == F.max("seg").over(whole), 1))
    own = own.withColumn("ep", F.col("way") * 2 + F.col("end"))
    own = own.join(roots.select("ep", "root"), "ep", "left").select("way", "seg", "t", "x", "y", "root")
    verts = own.unionByName(splits.select("way", "seg", "t", "x", "y", "root"))
    verts = verts.withColumns({"n": F.row_number().over(w), "k": F.count("root").over(w)})
    # A node in the inside ends one edge and begins the next.
    last = F.max("k").over(whole)
    verts = verts.withColumn("last", last)
    spans = F.when(F.col("root").isNotNull() & (F.col("k") > 1) & (F.col("k") < F.col("last")), F.array(F.col("k") - 1, F.col("k")))
    spans = spans.when(F.col("root").isNotNull() & (F.col("k") == F.col("last")), F.array(F.col("k") - 1)).otherwise(F.array("k"))
    parts = verts.withColumn("part", F.explode(spans)).where("part >= 1 and part < last")
    edges = parts.groupBy("way", "part").agg(
        F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("v"),
        F.min_by("root", "n").alias("a"),
        F.max_by("root", "n").alias("b"),
    )
    length = F.aggregate(
        F.sequence(F.lit(1), F.size("v") - 1),
        F.lit(0.0),
        lambda s, i: s + g.distance(F.get("v", i - 1)["x"], F.get("v", i - 1)["y"], F.get("v", i)["x"], F.get("v", i)["y"]),
    )
    edges = edges.select(
        F.concat_ws(":", "way", "part").alias("edge"), "a", "b", length.alias("length_m"),
        F.transform("v", lambda p: F.array(p["x"], p["y"])).alias("points"),
    )
    edges = cut_lineage(edges)
    comps = connected_components(edges.select("a", "b"), nodes.select("node"))
    return nodes.join(comps, "node"), edges


def main_component(nodes: DataFrame) -> DataFrame:
    """(component, nodes) of the component with most nodes; ties by name."""
    return nodes.groupBy("component").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "component").limit(1)


def component_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, length_m) of all components with edges, longest first."""
    own = edges.join(nodes.select(F.col("node").alias("a"), "component"), "a")
    return own.groupBy("component").agg(F.sum("length_m").alias("length_m")).orderBy(F.desc("length_m"), "component")


def nearest_edge_point(
    points: DataFrame, edges: DataFrame, key: list[str], max_m: float, align_rad: float | None = None, within: str | None = None, cell: float | None = None
) -> DataFrame:
    """``points`` with the nearest place on an edge within ``max_m``: d, fx,
    fy, edge and the edge's end ``node`` that is nearer along it (ties: a);
    nulls where there is none. With ``align_rad`` the points' headings (hx,
    hy) must not be zero; with ``within`` only edges of a point's own value of
    that column count; ``cell`` as in ``spatial.near_segments``."""
    own = [F.col(within).alias("__within")] if within else []
    line = edges.select("edge", "a", "b", "length_m", *own, F.posexplode("points").alias("seq", "p"))
    kept = ["__within"] if within else []
    line = line.select("edge", "a", "b", "length_m", *kept, "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    arc = paths.cumulative_length(line.withColumnRenamed("edge", "path_id"))
    w = Window.partitionBy("path_id").orderBy("seq")
    segs = arc.select(
        F.col("path_id").alias("edge"), "a", "b", "length_m", *kept, "seq", "arc_m", F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"),
    ).where("bx is not null")
    if align_rad is not None:
        points = points.where(F.assert_true((F.col("hx") != 0) | (F.col("hy") != 0), F.lit("a heading must not be zero")).isNull())
    pairs = spatial.near_segments(points, segs, max_m, cell, align_rad, strict=False)
    pairs = pairs.where(F.col(within) == F.col("__within")) if within else pairs
    to_foot = F.col("arc_m") + F.col("t") * g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    node = F.when(to_foot <= F.col("length_m") - to_foot, F.col("a")).otherwise(F.col("b"))
    best = pairs.withColumn("node", node).groupBy(*key).agg(
        F.min_by(F.struct("d", "fx", "fy", "edge", "node"), F.struct("d", "edge", "seq")).alias("m")
    )
    return points.join(best.select(*key, "m.*"), key, "left")


#: Nodes of a component that a task searches whole; larger ones are searched on an overlay of cells.
TASK_NODES = 100_000


def shortest_paths(
    pairs: DataFrame, nodes: DataFrame, edges: DataFrame, task_pairs: int = 5000, task_nodes: int = TASK_NODES, cell_m: float | None = None
) -> DataFrame:
    """(a, b, length_m, edges): the shortest path of every distinct pair of
    nodes; a null length where there is none, 0 from a node to itself.

    Best-first search with the straight distance as bound. Pairs of different
    components need no search. The others are dealt by component, and a
    component of many pairs to several tasks of about ``task_pairs``, each of
    which gets that component's graph alone: the graph is copied as often as
    its pairs call for. Where a component has over ``task_nodes`` nodes, the
    search goes over an overlay of cells instead (``cell_m`` a side), of which
    a task holds one.
    """
    largest = nodes.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > task_nodes:
        return overlay.overlay_paths(pairs, nodes, edges, cell_m or overlay.suggested_cell(nodes))
    of = lambda s: nodes.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    p = pairs.select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("c", F.when(F.col("ca") == F.col("cb"), F.col("ca")))
    p = cut_lineage(p.select("a", "b", "c"))
    apart = p.where("c is null").select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).alias("length_m"), F.when(F.col("a") == F.col("b"), F.array().cast("array<string>")).alias("edges"))
    salts = p.where("c is not null").groupBy("c").agg(F.ceil(F.count("*") / task_pairs).cast("long").alias("salts"))
    asked = p.join(salts, "c").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("salts"))).drop("salts")
    each = salts.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    none = F.lit(None).cast("string")
    n = nodes.select(F.col("component").alias("c"), F.lit("n").alias("kind"), F.col("node").alias("ident"), none.alias("a"), none.alias("b"), "x", "y")
    e = edges.join(of("a"), "a").select(F.col("ca").alias("c"), F.lit("e").alias("kind"), F.col("edge").alias("ident"), "a", "b", F.col("length_m").alias("x"), F.lit(0.0).alias("y"))
    both = n.unionByName(e).join(each, "c")

    def run(key: tuple, asked: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        node = parts[parts.kind == "n"]
        edge = parts[parts.kind == "e"]
        graph = Graph(
            list(zip(node.ident, node.x, node.y)), [(i, a, b, length, []) for i, a, b, length in zip(edge.ident, edge.a, edge.b, edge.x)]
        )
        found = [graph.shortest(a, b) for a, b in zip(asked.a, asked.b)]
        return pd.DataFrame(
            {
                "a": asked.a,
                "b": asked.b,
                "length_m": [f[0] if f else None for f in found],
                "edges": [list(f[1]) if f else None for f in found],
            }
        )

    found = asked.groupBy("c", "salt").cogroup(both.groupBy("c", "salt")).applyInPandas(run, "a string, b string, length_m double, edges array<string>")
    return found.unionByName(apart)


