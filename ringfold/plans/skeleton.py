"""Corners of outlines laid on streets one by one, joined to loops, and moved."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph as graphs
from ..operators import kernels
from ..operators.components import cut_lineage
from ..params import DIRECTION_SPAN, CornerOptions, RasterOptions
from .generate import by_region

LOOP = (
    "region long, path_id long, landmarks int, gaps int, length_m double, mean_m double, max_m double, retraced_m double,"
    " anchor_retraced_m array<double>, points array<array<double>>"
)


#: Outlines whose corners are looked for at once.
TOGETHER = 256


def landmarks(rings: DataFrame, o: CornerOptions = CornerOptions(), span: int = DIRECTION_SPAN) -> DataFrame:
    """(path_id, k, seq, x, y, hx, hy): the significant corners of each outline
    in order, with their local heading (``paths.headings``)."""

    def run(batches):
        for batch in batches:
            # Arrow's lists are read in place, many outlines a call.
            for part in (batch.slice(at, TOGETHER) for at in range(0, batch.num_rows, TOGETHER)):
                vertices = part.column("ring").flatten()
                seq, x, y = (vertices.field(c).to_numpy(zero_copy_only=False) for c in ("seq", "x", "y"))
                ends = np.concatenate([[0], np.cumsum(part.column("ring").value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
                xy = np.column_stack([x, y])
                found = [np.array(sorted(i for i, _ in kernels.corners(xy[a:b], o.min_turn_rad, o.min_spacing_m)), dtype=int) for a, b in zip(ends[:-1], ends[1:])]
                n = np.array([len(f) for f in found], dtype=int)
                k, first, size = np.concatenate([np.arange(len(f)) for f in found]), np.repeat(ends[:-1], n), np.repeat(np.diff(ends), n)
                own = np.concatenate(found)
                at, ahead, behind = first + own, first + (own + span) % size, first + (own - span) % size
                columns = [k.astype(np.int32), seq[at].astype(np.int64), x[at], y[at], x[ahead] - x[behind], y[ahead] - y[behind]]
                paths = part.column("path_id").take(pa.array(np.repeat(np.arange(len(found)), n)))
                yield pa.RecordBatch.from_arrays([paths, *map(pa.array, columns)], names=["path_id", "k", "seq", "x", "y", "hx", "hy"])

    whole = rings.groupBy(F.col("path_id").cast("long").alias("path_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("ring"))
    return whole.mapInArrow(run, "path_id long, k int, seq long, x double, y double, hx double, hy double")


def resolve_landmarks(marks: DataFrame, poses: DataFrame, edges: DataFrame, scale: float = 1.0, o: CornerOptions = CornerOptions()) -> DataFrame:
    """(region, path_id, k, x, y, fx, fy, node): the landmarks placed by each
    outline's pose (region, path_id, tx, ty, rotation) and, each on its own,
    the nearest place on a street of the region (a column of ``edges``) that
    runs along; null where none is in reach. Landmarks without a heading have none."""
    j = marks.join(poses.select("region", "path_id", "tx", "ty", "rotation"), "path_id")
    at = g.apply(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"), F.col("rotation"), F.lit(scale))
    h = g.rotate(F.col("hx"), F.col("hy"), F.col("rotation"))
    placed = j.select("region", "path_id", "k", at.alias("p"), h.alias("h"))
    # Read three times below; corners should be looked for once.
    placed = cut_lineage(placed.select("region", "path_id", "k", "p.x", "p.y", F.col("h.x").alias("hx"), F.col("h.y").alias("hy")))
    still = (F.col("hx") == 0) & (F.col("hy") == 0)
    reach, along = o.search_radius_m, RasterOptions().align_rad
    # Corners are many to a street: small cells save tests.
    near = graphs.nearest_edge_point(placed.where(~still), edges, ["region", "path_id", "k"], reach, along, "region", max(50.0, reach / 2))
    columns = ["region", "path_id", "k", "x", "y", "fx", "fy", "node"]
    none = placed.where(still).select("region", "path_id", "k", "x", "y", *[F.lit(None).cast(t).alias(c) for c, t in (("fx", "double"), ("fy", "double"), ("node", "string"))])
    return near.select(columns).unionByName(none)


def skeleton_loops(anchors: DataFrame, packed: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """(LOOP): the loop through the anchors of each outline, joined leg by leg
    on its region's graph (``generate.graph_rows``).

    ``moves`` (path_id, k, x, y, node) puts anchors elsewhere after the loop is
    built, in the order of ``k``; only the legs at them are searched for again.
    """
    anchor = F.struct("k", "x", "y", "fx", "fy", "node")
    work = anchors.groupBy("region", "path_id").agg(F.array_sort(F.collect_list(anchor)).alias("anchors"))
    none = F.array().cast("array<struct<k:int,x:double,y:double,node:string>>")
    if moves is None:
        work = work.withColumn("moves", none)
    else:
        own = moves.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "x", "y", "node"))).alias("moves"))
        work = work.join(own, "path_id", "left").withColumn("moves", F.coalesce("moves", none))
    work = work.withColumn("pose", F.lit(0).cast("long"))

    def run(graph: kernels.Graph, main: list, frame: pd.DataFrame) -> list[dict]:
        out = []
        for row in frame.itertuples():
            a = list(row.anchors)
            found = [None if v["node"] is None else (v["fx"], v["fy"]) for v in a]
            loop = kernels.Skeleton([(v["x"], v["y"]) for v in a], found, [v["node"] for v in a], graph)
            for m in row.moves:
                loop = loop.moved(m["k"], (m["x"], m["y"]), m["node"])
            points = kernels.leg_points(loop.legs).tolist()
            out.append({"region": row.region, "path_id": row.path_id, "landmarks": len(a), **loop.measures(), "points": points})
        return out

    return by_region(work, packed, run, LOOP)
