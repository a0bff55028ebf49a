"""Shortest paths on graphs beyond a task: cells, tables between their borders,
and a search that leaps from border to border."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .components import cut_lineage
from .kernels import Graph

#: Nodes of a cell; a cell of more is quartered, LEVELS times at most.
CELL_NODES, LEVELS = 2000, 10


def node_cells(nodes: DataFrame, cell_m: float, most: int = CELL_NODES) -> DataFrame:
    """(node, x, y, cell): squares of ``cell_m`` a side, quartered again and
    again where they hold more than ``most`` nodes."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    all_ = nodes.select("node", "x", "y", levels.alias("level"))
    side = F.lit(float(cell_m)) / F.pow(F.lit(2.0), F.col("level"))
    all_ = all_.withColumn("cell", F.concat_ws(":", "level", F.floor(F.col("x") / side), F.floor(F.col("y") / side)))
    fits = all_.groupBy("cell").agg(F.count("*").alias("n"), F.first("level").alias("level")).where((F.col("n") <= most) | (F.col("level") == LEVELS))
    value = F.struct("level", "x", "y", "cell")
    own = all_.join(fits.select("cell"), "cell", "left_semi").groupBy("node").agg(F.min_by(value, "level").alias("c"))
    return own.select("node", "c.x", "c.y", "c.cell")


def cell_tables(cells: DataFrame, edges: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, cross): shortest ways within a cell (cell, a, b, length_m, edges)
    from every asked node and border node of a cell to its border nodes and,
    where both are asked, between them; and the edges (a, b, length_m, edges)
    from cell to cell, both ways.

    A task holds one cell's graph.
    """
    of = lambda s: cells.select(F.col("node").alias(s), F.col("cell").alias(f"c{s}"))
    e = cut_lineage(edges.select("edge", "a", "b", "length_m").join(of("a"), "a").join(of("b"), "b"))
    out = e.where("ca <> cb")
    cross = out.select("a", "b", "length_m", F.array("edge").alias("edges"))
    cross = cross.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "length_m", F.array("edge").alias("edges")))
    # Of edges side by side the shortest counts.
    cross = cut_lineage(cross.groupBy("a", "b").agg(F.min_by("edges", F.struct("length_m", "edges")).alias("edges"), F.min("length_m").alias("length_m")))

    none = F.lit(None).cast("string")
    border = cross.select(F.col("a").alias("node")).distinct().withColumn("kind", F.lit("b"))
    points = border.unionByName(asked.select("node").distinct().withColumn("kind", F.lit("q"))).join(cells.select("node", "cell"), "node")
    points = points.select("cell", "kind", F.col("node").alias("edge"), none.alias("a"), none.alias("b"), F.lit(0.0).alias("length_m"))
    inner = e.where("ca = cb").select(F.col("ca").alias("cell"), F.lit("e").alias("kind"), "edge", "a", "b", "length_m")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        e = frame[frame.kind == "e"]
        graph = Graph([], [(i, a, b, n, []) for i, a, b, n in zip(e.edge, e.a, e.b, e.length_m)])
        border, asked = set(frame.edge[frame.kind == "b"]), set(frame.edge[frame.kind == "q"])
        rows = []
        for start in sorted(border | asked):
            goals = border | asked if start in asked else border
            rows += [(key[0], start, goal, length, list(way)) for goal, (length, way) in graph.reach(start, goals).items()]
        return pd.DataFrame(rows, columns=["cell", "a", "b", "length_m", "edges"])

    spans = points.unionByName(inner).groupBy("cell").applyInPandas(run, "cell string, a string, b string, length_m double, edges array<string>")
    return cut_lineage(spans), cross


def overlay_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, cell_m: float, most: int = CELL_NODES) -> DataFrame:
    """(a, b, length_m, edges) as ``graph.shortest_paths``, for components of
    any size: no task holds more than a cell of the graph.

    A leap is the shortest way through a cell to its border and the edge over
    it. Labels (pair, node, length) leap on, a round a cell, all pairs at once;
    a label stays open while it shortens the way to its node and, by the
    straight distance that is left, may still shorten its pair's best way. The
    rounds are at most the cells on a way, and every way found is exact.
    """
    at = lambda s: nodes.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    p = pairs.select("a", "b").distinct().join(at("a"), "a", "left").join(at("b"), "b", "left")
    p = cut_lineage(p.withColumn("pair", F.monotonically_increasing_id()))
    same, none = F.col("a") == F.col("b"), F.array().cast("array<string>")
    apart = p.where(same | F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") != F.col("cb")))
    apart = apart.select("a", "b", F.when(same, 0.0).alias("length_m"), F.when(same, none).alias("edges"))
    p = cut_lineage(p.where((F.col("a") != F.col("b")) & (F.col("ca") == F.col("cb"))).select("pair", "a", "b", "bx", "by"))

    cells = cut_lineage(node_cells(nodes, cell_m, most))
    asked = p.select(F.explode(F.array("a", "b")).alias("node"))
    spans, cross = cell_tables(cells, edges, asked)
    over = cross.select(F.col("a").alias("b"), F.col("b").alias("to"), F.col("length_m").alias("more"), F.col("edges").alias("last"))
    leaps = spans.join(over, "b").withColumn("length_m", F.col("length_m") + F.col("more"))
    place = nodes.select(F.col("node").alias("to"), "x", "y")
    # Of the ways from one node to another over the same border the shortest.
    leaps = leaps.groupBy("a", "to").agg(F.min("length_m").alias("length_m"), F.min_by(F.concat("edges", "last"), F.struct("length_m", "b")).alias("edges"))
    leaps = cut_lineage(leaps.join(place, "to").withColumn("leap", F.monotonically_increasing_id()))

    within = p.join(spans.select("a", "b", "length_m", "edges"), ["a", "b"])
    best = within.select("pair", "length_m", F.array().cast("array<long>").alias("route"), F.col("b").alias("into"))
    # Ways into each asked end from the border of its cell.
    back = spans.select(F.col("a").alias("end"), F.col("b").alias("node"), F.col("length_m").alias("tail"))
    ends = cut_lineage(p.select("pair", F.col("b").alias("end")).join(back, "end").select("pair", "node", "tail"))
    goal = p.select("pair", "bx", "by")

    def better(best: DataFrame, labels: DataFrame) -> DataFrame:
        done = labels.join(ends, ["pair", "node"]).select("pair", (F.col("length_m") + F.col("tail")).alias("length_m"), "route", F.col("node").alias("into"))
        value = F.struct("length_m", "route", "into")
        return cut_lineage(best.unionByName(done).groupBy("pair").agg(F.min(value).alias("v")).select("pair", "v.*"))

    def leapt(labels: DataFrame) -> DataFrame:
        on = labels.join(leaps.select(F.col("a").alias("node"), F.col("length_m").alias("step"), "to", "x", "y", "leap"), "node")
        length = F.col("length_m") + F.col("step")
        value = F.struct(length.alias("length_m"), F.concat("route", F.array("leap")).alias("route"), "x", "y")
        return on.groupBy("pair", F.col("to").alias("node")).agg(F.min(value).alias("v")).select("pair", "node", "v.*")

    labels = p.select("pair", F.col("a").alias("node"), F.lit(0.0).alias("length_m"), F.array().cast("array<long>").alias("route"))
    best, known, open_ = cut_lineage(best), None, labels
    while True:
        new = leapt(open_)
        if known is not None:
            was = known.select("pair", "node", F.col("length_m").alias("was"))
            new = new.join(was, ["pair", "node"], "left").where(F.col("was").isNull() | (F.col("length_m") < F.col("was"))).drop("was")
        bound = best.select("pair", F.col("length_m").alias("most"))
        new = new.join(bound, "pair", "left").join(goal, "pair")
        rest = F.col("length_m") + g.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
        new = cut_lineage(new.where(F.col("most").isNull() | (rest < F.col("most"))).drop("most", "bx", "by", "x", "y"))
        if new.isEmpty():
            break
        best = better(best, new)
        fresh = new.select("pair", "node", "length_m")
        known = fresh if known is None else cut_lineage(known.unionByName(fresh).groupBy("pair", "node").agg(F.min("length_m").alias("length_m")))
        open_ = new

    parts = best.select("pair", F.posexplode("route").alias("n", "leap")).join(leaps.select("leap", "edges"), "leap").select("pair", "n", "edges")
    # The last stretch as it was found, from the asked end to where the way comes in.
    into = F.when(F.size("route") == 0, F.col("a")).otherwise(F.col("into"))
    last = best.join(p, "pair").select("pair", F.size("route").alias("n"), F.col("b").alias("end"), into.alias("node"))
    back = spans.select(F.col("a").alias("end"), F.col("b").alias("node"), F.reverse("edges").alias("edges"))
    last = last.join(back, ["end", "node"]).select("pair", "n", "edges")
    ways = parts.unionByName(last).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("n", "edges"))).alias("w"))
    ways = ways.select("pair", F.flatten(F.transform("w", lambda x: x["edges"])).alias("edges"))
    found = p.select("pair", "a", "b").join(best.select("pair", "length_m"), "pair", "left").join(ways, "pair", "left")
    return found.select("a", "b", "length_m", "edges").unionByName(apart)


def suggested_cell(nodes: DataFrame, most: int = CELL_NODES) -> float:
    """Metres a side of cells that hold about ``most`` nodes in the mean."""
    box = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not box[4]:
        return 1.0
    area = max(box[1] - box[0], 1.0) * max(box[3] - box[2], 1.0)
    return math.sqrt(area * most / max(1, box[4]))
