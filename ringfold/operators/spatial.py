"""Distance joins by an equality join on grid cells.

Every distance join here has a bound: one side is dealt to all cells that it
could reach, the other to its own, and the join is an equality on the cell
followed by the exact test. Plans stay linear in the data at a fixed density;
cells that hold too much are split by adaptive execution.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import geometry as g
from . import kernels
from .components import cut_dealt

_CX, _CY = "__cx", "__cy"


def box_cells(min_x: Column, min_y: Column, max_x: Column, max_y: Column, cell: float) -> Column:
    """Array of the cells (structs cx, cy) that a box touches."""
    xs = F.sequence(g.cell(min_x, cell), g.cell(max_x, cell))
    ys = F.sequence(g.cell(min_y, cell), g.cell(max_y, cell))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def segment_cells(segs: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """Segments (ax, ay, bx, by), one row for each cell of their box."""
    lo = lambda a, b: F.least(F.col(a), F.col(b)) - margin
    hi = lambda a, b: F.greatest(F.col(a), F.col(b)) + margin
    cells = box_cells(lo("ax", "bx"), lo("ay", "by"), hi("ax", "bx"), hi("ay", "by"), cell)
    s = segs.withColumn("__c", F.explode(cells))
    return s.select("*", F.col("__c.cx").alias(_CX), F.col("__c.cy").alias(_CY)).drop("__c")


def segment_index(segs: DataFrame, cell: float, margin: float) -> DataFrame:
    """``segment_cells`` dealt and sorted by cell once, for several joins: what
    joins it on the cell needs no shuffle of the segments any more."""
    cells = segment_cells(segs, cell, margin)
    return cut_dealt(cells, _CX, _CY)


def point_cells(points: DataFrame, cell: float, margin: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """Points, one row for each cell within ``margin`` of them along the axes."""
    px, py = F.col(x), F.col(y)
    if not margin:
        return points.withColumns({_CX: g.cell(px, cell), _CY: g.cell(py, cell)})
    cells = box_cells(px - margin, py - margin, px + margin, py + margin, cell)
    p = points.withColumn("__c", F.explode(cells))
    return p.select("*", F.col("__c.cx").alias(_CX), F.col("__c.cy").alias(_CY)).drop("__c")


def cells_along(segs: DataFrame, cell: float, min_x: Column, min_y: Column) -> DataFrame:
    """Distinct raster cells on a walk along each segment in half-cell steps."""
    length = g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    s = segs.withColumn("steps", F.greatest(F.lit(1).cast("long"), F.ceil(length / (cell / 2))))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps")))).withColumn("t", F.col("i") / F.col("steps"))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("t")
    keep = [c for c in segs.columns if c not in ("ax", "ay", "bx", "by")]
    cx, cy = g.cell(at("ax", "bx") - min_x, cell), g.cell(at("ay", "by") - min_y, cell)
    return s.select(*keep, cx.alias("cx"), cy.alias("cy")).distinct()


def near_cell(max_m: float) -> float:
    """The cell of ``near_segments`` for points about as many as the streets: twice
    what a point reaches, so that a segment's copies stay few whatever the reach."""
    return max(50.0, 4.0 * max_m)


def near_segments(
    points: DataFrame, segs: DataFrame, max_m: float, cell: float | None = None, align_rad: float | None = None, strict: bool = True, index: DataFrame | None = None
) -> DataFrame:
    """All pairs of points (x, y and any columns) and segments (ax, ay, bx, by
    and any columns) under ``max_m`` apart (or at, if not ``strict``), with
    the foot (fx, fy, t) and distance d.

    With ``align_rad`` the segment must run along the point's heading (hx,
    hy), either way; a zero heading takes any segment. A pair that shares
    several cells comes out once, in the cell of its first match: the point
    has a single cell of its own. ``cell`` is ``near_cell`` by default; where
    points are many to a segment, small cells save tests. ``index`` may be a ``segment_index`` of the
    segments with the same cell and a margin of at least ``max_m``.
    """
    cell = cell or near_cell(max_m)
    reach = segment_cells(segs, cell, max_m) if index is None else index
    own = point_cells(points, cell)
    j = own.join(reach, [_CX, _CY]).drop(_CX, _CY)
    if align_rad is not None:
        still = (F.col("hx") == 0) & (F.col("hy") == 0)
        along = g.aligned(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("hx"), F.col("hy"), align_rad)
        j = j.where(still | along)
    seg = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    d = g.segment_distance(F.col("x"), F.col("y"), *seg)
    j = j.withColumn("d", d).where(F.col("d") < max_m if strict else F.col("d") <= max_m)
    j = j.withColumn("__f", g.project_on_segment(F.col("x"), F.col("y"), *seg))
    return j.select("*", F.col("__f.x").alias("fx"), F.col("__f.y").alias("fy"), F.col("__f.t").alias("t")).drop("__f")


def nearest_segment(
    points: DataFrame,
    segs: DataFrame,
    key: list[str],
    max_m: float,
    cell: float | None = None,
    align_rad: float | None = None,
    strict: bool = True,
    tie: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``points`` (unique by ``key``) with their nearest segment within
    ``max_m``: d (``max_m`` if there is none), fx, fy, t and ``keep`` of the
    segment (null if none). Ties go to the least ``tie`` columns."""
    keep, tie = keep or [], tie or ["ax", "ay"]
    pairs = near_segments(points, segs, max_m, cell, align_rad, strict)
    value = F.struct("d", *tie, "fx", "fy", "t", *[c for c in keep if c not in tie])
    best = pairs.groupBy(*key).agg(F.min_by(value, F.struct("d", *tie)).alias("b"))
    best = best.select(*key, "b.d", "b.fx", "b.fy", "b.t", *[f"b.{c}" for c in keep])
    out = points.join(best, key, "left")
    return out.withColumn("d", F.coalesce("d", F.lit(float(max_m))))


def near_points(left: DataFrame, right: DataFrame, max_m: float, cell: float | None = None) -> DataFrame:
    """All pairs of points (x, y) and (px, py) at most ``max_m`` apart, with d."""
    cell = cell or max(max_m, 1.0)
    reach = point_cells(right, cell, max_m, "px", "py")
    j = point_cells(left, cell).join(reach, [_CX, _CY]).drop(_CX, _CY)
    return j.withColumn("d", g.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).where(F.col("d") <= max_m)


def pair_cell(max_m: float) -> float:
    """The least cell of ``near_segment_pairs``, and that of its ``index``."""
    return max(max_m, 50.0)


def typical_cell(segs: DataFrame, max_m: float) -> float:
    """The cell of ``near_segment_pairs`` without an index. Long segments touch
    many small cells: cells as large as the median one keep the copies few."""
    side = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    median = segs.agg(F.percentile_approx(side, 0.5, 100)).first()[0]
    usual = median if median is not None and math.isfinite(median) else 0.0
    return max(pair_cell(max_m), 10.0 * math.ceil(usual / 10))


def near_segment_pairs(segs: DataFrame, max_m: float, key: list[str], apart: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """Pairs a < b (by ``key``) of segments at most ``max_m`` apart, once each,
    as columns a_*, b_* with their closest approach (struct ``near``).

    ``apart`` may narrow the pairs further, on a_* and b_* columns; ``index``
    may be a ``segment_index`` with cells of ``pair_cell`` and the margin ``max_m``.
    """
    cell = typical_cell(segs, max_m) if index is None else pair_cell(max_m)
    name = lambda s: [F.col(c).alias(f"{s}_{c}") for c in segs.columns]
    corner = lambda s: tuple(F.col(f"{s}_{c}") for c in ("ax", "ay", "bx", "by"))
    lo = lambda s, p, q: F.least(F.col(f"{s}_{p}"), F.col(f"{s}_{q}"))
    hi = lambda s, p, q: F.greatest(F.col(f"{s}_{p}"), F.col(f"{s}_{q}"))
    if index is None:
        a, b = segment_cells(segs, cell), segment_cells(segs, cell, max_m)
    else:  # of the index, a segment's own cells are those of its box without the margin
        a, b = index, index
        for c, p, q in ((_CX, "ax", "bx"), (_CY, "ay", "by")):
            a = a.where(F.col(c).between(g.cell(F.least(p, q), cell), g.cell(F.greatest(p, q), cell)))
    a, b = a.select(*name("a"), _CX, _CY), b.select(*name("b"), _CX, _CY)
    first = F.struct(*[F.col(f"a_{c}") for c in key]) < F.struct(*[F.col(f"b_{c}") for c in key])
    j = a.join(b, [_CX, _CY]).where(first if apart is None else first & apart)
    # A pair counts in the lowest cell that both boxes touch: once, without a shuffle.
    for c, p, q in ((_CX, "ax", "bx"), (_CY, "ay", "by")):
        j = j.where(F.col(c) == F.greatest(g.cell(lo("a", p, q), cell), g.cell(lo("b", p, q) - max_m, cell)))
    # Cheap tests first, which most pairs of a cell fail: boxes, then whether one lies wholly beyond the other's line.
    for p, q in (("ax", "bx"), ("ay", "by")):
        j = j.where((lo("a", p, q) <= hi("b", p, q) + max_m) & (lo("b", p, q) <= hi("a", p, q) + max_m))
    for s, o in ("ab", "ba"):
        (px, py, qx, qy), (rx, ry, tx, ty) = corner(s), corner(o)
        off = lambda x, y: (qx - px) * (y - py) - (qy - py) * (x - px)  # noqa: B023, E731
        reach = (max_m + 1e-6) * g.distance(px, py, qx, qy) + 1e-9
        j = j.where((F.least(off(rx, ry), off(tx, ty)) <= reach) & (F.greatest(off(rx, ry), off(tx, ty)) >= -reach))
    return with_approach(j.drop(_CX, _CY), max_m)


def with_approach(pairs: DataFrame, max_m: float) -> DataFrame:
    """Pairs of segments (a_ax, ..., b_by) at most ``max_m`` apart with
    ``near``, the same struct as ``geometry.closest_approach``.

    In batches of arrays: as one column expression the four feet of a pair
    nest into code that takes longer to compile than the batches to run.
    """
    names = ["d", "k", "x", "y", "ta", "tb"]

    def run(batches):
        for batch in batches:
            sides = [np.column_stack([batch.column(f"{s}_{c}").to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")]) for s in "ab"]
            found = kernels.closest_approaches(*sides)
            near = pa.StructArray.from_arrays([pa.array(v) for v in found], names=names)
            whole = pa.RecordBatch.from_arrays([*batch.columns, near], names=[*batch.schema.names, "near"])
            yield whole.filter(pa.array(found[0] <= max_m))

    near = StructType([StructField(n, IntegerType() if n == "k" else DoubleType()) for n in names])
    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("near", near)]))
