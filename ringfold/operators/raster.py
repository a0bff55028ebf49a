"""Distance rasters by street direction, and poses scored on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import PoseOptions, RasterOptions
from . import paths, spatial
from .components import cut_lineage
from .kernels import distance_transform, posed_costs


def raster_frame(bounds: DataFrame, o: RasterOptions = RasterOptions()) -> DataFrame:
    """(x0, y0, width, height) of the raster over bounds (min_x, ...) with a margin."""
    size = lambda lo, hi: F.greatest(F.lit(1).cast("long"), F.ceil((hi - lo + 2 * o.margin_m) / o.cell_m) + 1)
    return bounds.select(
        (F.col("min_x") - o.margin_m).alias("x0"), (F.col("min_y") - o.margin_m).alias("y0"),
        size(F.col("min_x"), F.col("max_x")).alias("width"), size(F.col("min_y"), F.col("max_y")).alias("height"),
    )


def source_cells(segs: DataFrame, frame: DataFrame, o: RasterOptions = RasterOptions()) -> DataFrame:
    """(layer, cx, cy): the cells on streets whose heading is within the
    alignment of the layer's, modulo pi; a street may feed several layers."""
    s = segs.where("ax <> bx or ay <> by").withColumn("h", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    s = s.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(o.layers - 1))))
    s = s.where(g.heading_delta(F.col("h"), F.col("layer") * (math.pi / o.layers)) <= o.align_rad)
    s = s.select("layer", "ax", "ay", "bx", "by").join(F.broadcast(frame.select("x0", "y0")))
    return spatial.cells_along(s, o.cell_m, F.col("x0"), F.col("y0")).select("layer", "cx", "cy").distinct()


#: Cells a side of what a task transforms at once.
TILE = 64


def near_cells(sources: DataFrame, reach: int, box: tuple[int, int] | None = None, tile: int = TILE) -> DataFrame:
    """(layer, cx, cy, d2): cells within ``reach`` cells of a source and the
    exact squared distance to the nearest one; with ``box`` only cells from 0
    to its width and height.

    What lies farther counts like infinity for every use that caps distances,
    so the raster stays as sparse as the streets. Every source goes to the
    tiles that it reaches, and a task transforms a tile with the sources around
    it, columns first, then rows: no task holds a layer, and the copies of a
    source don't grow with ``reach`` while that is below a tile.
    """
    own = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    dealt = sources.select("layer", "cx", "cy").withColumn("tx", own("cx")).withColumn("ty", own("cy"))
    # Rows as short as they can be: a tile's own place of each source.
    local = [(F.col(c) - F.col(t) * tile + reach).cast("short").alias(c) for c, t in (("cx", "tx"), ("cy", "ty"))]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        layer, tx, ty = key
        grid = np.zeros((tile + 2 * reach,) * 2, dtype=bool)
        grid[frame.cy, frame.cx] = True
        d = distance_transform(grid, reach)[reach : reach + tile, reach : reach + tile]
        y, x = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"layer": layer, "cx": x + tx * tile, "cy": y + ty * tile, "d2": d[y, x].astype(np.int64)})

    cells = dealt.select("layer", "tx", "ty", *local).groupBy("layer", "tx", "ty").applyInPandas(run, "layer int, cx long, cy long, d2 long")
    if box is None:
        return cells
    return cells.where(F.col("cx").between(0, box[0] - 1) & F.col("cy").between(0, box[1] - 1))


def pooled(cells: DataFrame, factor: int) -> DataFrame:
    """(layer, cx, cy, d2): the least d2 of each square of 2 * ``factor`` cells
    a side from (cx * factor, cy * factor): a level of the pyramid of lower
    bounds. Squares overlap, so that one of them holds any box of up to
    ``factor`` cells a side that begins in its first quarter."""
    block = lambda c: F.floor(F.col(c) / factor)
    least = cells.groupBy("layer", block("cx").alias("cx"), block("cy").alias("cy")).agg(F.min("d2").alias("d2"))
    for c in ("cx", "cy"):
        least = least.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c))))
    return least.groupBy("layer", "cx", "cy").agg(F.min("d2").alias("d2"))


def spaced_samples(ring: DataFrame, perimeter: DataFrame, spacing_m: float, key: str = "path_id") -> DataFrame:
    """(key, i, x, y, hx, hy, spacing, perimeter_m): every n-th vertex of the
    ring, so that they are about ``spacing_m`` apart."""
    r = paths.headings(ring, key=key).join(perimeter.select(key, F.col("length_m").alias("perimeter_m")), key)
    w = Window.partitionBy(key)
    r = r.withColumn("n", F.count("*").over(w))
    wanted = F.greatest(F.lit(1).cast("long"), g.half_up(F.col("perimeter_m") / spacing_m))
    r = r.withColumn("step", F.greatest(F.lit(1).cast("long"), g.half_up(F.col("n") / wanted))).where(F.col("seq") % F.col("step") == 0)
    r = r.withColumn("spacing", F.col("perimeter_m") / F.count("*").over(w))
    return r.select(key, F.col("seq").alias("i"), "x", "y", "hx", "hy", "spacing", "perimeter_m")


def lookup(samples: DataFrame, cells: DataFrame, frame: DataFrame, o: RasterOptions = RasterOptions(), factor: int = 1) -> DataFrame:
    """``samples`` (x, y, layer) with ``d``, the raster's distance in metres;
    infinite where the raster has none. ``factor``: of a pyramid's level."""
    size = o.cell_m * factor
    f = samples.join(F.broadcast(frame.select("x0", "y0")))  # one row
    f = f.withColumns({"cx": g.cell(F.col("x") - F.col("x0"), size), "cy": g.cell(F.col("y") - F.col("y0"), size)})
    j = f.join(cells.select("layer", "cx", "cy", "d2"), ["layer", "cx", "cy"], "left")
    d = F.coalesce(F.sqrt("d2") * o.cell_m, F.lit(g.INF))
    return j.withColumn("d", d).drop("x0", "y0", "cx", "cy", "d2")


def posed_samples(poses: DataFrame, samples: DataFrame, scale: Column, key: str = "path_id", layers: int = 12) -> DataFrame:
    """(key, pose, i, spacing, perimeter_m, x, y, layer): the samples under
    every pose (key, pose, x, y, rotation), with the layer of their heading."""
    p = poses.select(key, "pose", F.col("x").alias("tx"), F.col("y").alias("ty"), "rotation").join(samples, key)
    at = g.apply(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"), F.col("rotation"), scale)
    h = g.rotate(F.col("hx"), F.col("hy"), F.col("rotation"))
    p = p.withColumns({"at": at, "h": h})
    layer = g.heading_layer(F.col("h.x"), F.col("h.y"), layers).cast("int")
    return p.select(key, "pose", "i", "spacing", "perimeter_m", "at.x", "at.y", layer.alias("layer"))


def evaluate_poses(
    poses: DataFrame, samples: DataFrame, cells: DataFrame, frame: DataFrame, scale: Column, threshold_m: float, cap_m: float,
    key: str = "path_id", o: RasterOptions = RasterOptions(),
) -> DataFrame:
    """(key, pose, cost, max_hole_m) of poses (key, pose, x, y, rotation):
    capped distances summed over the samples, and the longest run of samples
    farther than the threshold."""
    near = lookup(posed_samples(poses, samples, scale, key, o.layers), cells, frame, o)
    return near.groupBy(key, "pose").agg(F.sum(F.least("d", F.lit(cap_m))).alias("cost"), longest_hole(threshold_m).alias("max_hole_m"))


def longest_hole(threshold_m: float) -> Column:
    """Aggregate over a pose's samples (i, d, spacing): the longest run of those
    farther than the threshold, where a run at the end goes on at the start
    unless it is the whole ring. A pose's samples are few."""
    sample = F.struct("i", (F.col("d") > threshold_m).alias("off"), "spacing")
    zero = F.lit(0.0)
    start = F.struct(zero.alias("run"), zero.alias("head"), zero.alias("longest"), F.lit(False).alias("street"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x["off"], s["run"] + x["spacing"]).otherwise(zero)
        head = F.when(s["street"] | ~x["off"], s["head"]).otherwise(run)
        return F.struct(run.alias("run"), head.alias("head"), F.greatest(s["longest"], run).alias("longest"), (s["street"] | ~x["off"]).alias("street"))

    def end(s: Column) -> Column:
        return F.greatest(s["longest"], F.when(s["street"] & (s["run"] > 0), s["run"] + s["head"]).otherwise(zero))

    return F.aggregate(F.array_sort(F.collect_list(sample)), start, step, end)


#: Cells a side of what a call holds at most to score poses, and outlines of a tile that share one.
WINDOW, TOGETHER = 640, 64


def tiled_reach(ring: DataFrame, scale: float, o: RasterOptions, key: str = "path_id") -> float:
    """The farthest that a vertex lies from the origin of its outline, among the
    outlines that ``score_poses`` can take by tiles."""
    far = ring.groupBy(key).agg(F.max(g.norm(F.col("x"), F.col("y"))).alias("far"))
    return far.where(F.col("far") <= (WINDOW // 4 - 1) * o.cell_m / scale).agg(F.max("far")).first()[0] or 0.0


def score_poses(
    poses: DataFrame, samples: DataFrame, cells: DataFrame, frame: DataFrame, scale: float, reach_m: float, threshold_m: float, cap_m: float,
    key: str = "path_id", o: RasterOptions = RasterOptions(), factor: int = 1,
) -> DataFrame:
    """``evaluate_poses`` for many poses: (key, pose, x, y, rotation, cost,
    max_hole_m). ``factor`` is of a pyramid's level.

    Poses go to the tile of their anchor, a row for each outline in a tile, and
    cells to the tiles whose poses' samples, at most ``reach_m`` from the
    anchor, could read them: rows of poses and cells are shuffled, not a row for
    every sample of every pose. Outlines that reach farther (or have no number
    for a place) are few; their samples are joined to the cells.
    """
    size = o.cell_m * factor
    margin = math.ceil(reach_m * scale / size) + 1
    side = max(TILE, 2 * margin)
    far = F.max(g.norm(F.col("x"), F.col("y")))
    shape = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "hx", "hy", "spacing"))).alias("samples"), far.alias("far"))
    shape = cut_lineage(shape.withColumn("near", F.coalesce(F.col("far") <= reach_m, F.lit(False))).drop("far"))
    poses = cut_lineage(poses.select(key, "pose", "x", "y", "rotation"))
    wide = shape.where(~F.col("near")).select(key)
    joined = None
    if not wide.isEmpty():
        p = poses.join(wide, key, "left_semi")
        seen = lookup(posed_samples(p, samples.join(wide, key, "left_semi"), F.lit(scale), key, o.layers), cells, frame, o, factor)
        joined = seen.groupBy(key, "pose").agg(F.sum(F.least("d", F.lit(cap_m))).alias("cost"), longest_hole(threshold_m).alias("max_hole_m"))
        joined = p.join(joined, [key, "pose"])
    shape = shape.where("near").drop("near")
    p = poses.join(F.broadcast(frame.select("x0", "y0")))  # one row
    tile = lambda c: F.floor(g.cell(F.col(c) - F.col(f"{c}0"), size) / side)
    p = p.select(key, tile("x").alias("tx"), tile("y").alias("ty"), "x0", "y0", F.struct("pose", "x", "y", "rotation", F.cos("rotation").alias("c"), F.sin("rotation").alias("s")).alias("p"))
    work = p.groupBy(key, "tx", "ty", "x0", "y0").agg(F.collect_list("p").alias("poses")).join(shape, key)
    salts = F.ceil(F.count("*").over(Window.partitionBy("tx", "ty")) / TOGETHER)
    work = cut_lineage(work.withColumn("salt", F.pmod(F.xxhash64(key), salts)))
    asked = work.select("tx", "ty", "salt").distinct()
    own = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / side), F.floor((F.col(c) + margin) / side)))
    dealt = cells.select("layer", "cx", "cy", "d2").withColumn("tx", own("cx")).withColumn("ty", own("cy"))
    place = [(F.col(c) - F.col(t) * side + margin).cast("short").alias(c) for c, t in (("cx", "tx"), ("cy", "ty"))]
    dealt = dealt.select("tx", "ty", "layer", *place, "d2").join(asked, ["tx", "ty"])
    dealt = dealt.toDF(*dealt.columns)  # columns of its own
    width, layers, cell_m = side + 2 * margin, o.layers, o.cell_m

    def run(at: tuple, work: pa.Table, near: pa.Table) -> pa.Table:
        plain = lambda column: column.to_numpy(zero_copy_only=False)
        grid = np.full((layers, width, width), -1, dtype=np.int64)
        layer, cx, cy, d2 = (near.column(c).to_numpy() for c in ("layer", "cx", "cy", "d2"))
        grid[layer, cy, cx] = d2
        left, below = (at[k].as_py() * side - margin for k in (0, 1))
        out = []
        for batch in work.to_batches():
            lists = [[(v := batch.column(c)).flatten(), np.concatenate([[0], np.cumsum(plain(v.value_lengths()))]).astype(int)] for c in ("poses", "samples")]
            (posed, pe), (shapes, se) = lists
            n, x, y, turn, c, s = (plain(posed.field(f)) for f in ("pose", "x", "y", "rotation", "c", "s"))
            shape = np.column_stack([plain(shapes.field(f)).astype(float) for f in ("x", "y", "hx", "hy", "spacing")])
            x0, y0 = plain(batch.column("x0")), plain(batch.column("y0"))
            parts = [(np.zeros(0), np.zeros(0))]
            for k in range(batch.num_rows):
                own = shape[se[k] : se[k + 1]]
                some = max(1, (1 << 18) // max(1, len(own)))  # poses at once
                for a in range(pe[k], pe[k + 1], some):
                    b = min(a + some, pe[k + 1])
                    parts.append(posed_costs(own, x[a:b], y[a:b], c[a:b], s[a:b], grid, (x0[k], y0[k], left, below), size, cell_m, scale, threshold_m, cap_m))
            cost, hole = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(pe))))
            out.append(pa.RecordBatch.from_arrays([keys, *map(pa.array, (n, x, y, turn, cost, hole))], names=[key, "pose", "x", "y", "rotation", "cost", "max_hole_m"]))
        return pa.Table.from_batches(out, schema=schema if not out else out[0].schema)

    schema = pa.schema([(key, pa.int64()), ("pose", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "rotation", "cost", "max_hole_m"))])
    found = work.groupBy("tx", "ty", "salt").cogroup(dealt.groupBy("tx", "ty", "salt"))
    kinds = {c: poses.schema[c].dataType.simpleString() for c in (key, "pose")}
    tiled = found.applyInArrow(run, f"`{key}` {kinds[key]}, pose {kinds['pose']}, x double, y double, rotation double, cost double, max_hole_m double")
    return tiled if joined is None else tiled.unionByName(joined)


#: Anchors a side of the blocks that are opened step by step.
BLOCKS = (16, 4)


def open_poses(
    ring: DataFrame, perimeter: DataFrame, bounds: DataFrame, cells: DataFrame, frame: DataFrame, scale: float = 1.0, o: PoseOptions = PoseOptions(),
    r: RasterOptions = RasterOptions(), key: str = "path_id", blocks: tuple[int, ...] = BLOCKS, reach_m: float | None = None,
) -> DataFrame:
    """(key, pose, x, y, rotation): the poses of the grid whose hole, on the
    coarse samples, may still be short enough.

    ``bounds`` has a row for each outline with its ``key``. Blocks of anchors
    are opened from the largest down: under one rotation a sample stays within
    a box over all anchors of a block, and the least distance of the raster in
    that box, which a level of min-pooled cells gives, bounds its distance from
    below, hence the block's hole as well. A block whose bound is too long has
    no pose that could pass. Poses are numbered by their place in the grid.
    """
    turns = round(360 / o.rotation_deg)
    reach_m = tiled_reach(ring, scale, r, key) if reach_m is None else reach_m
    last = lambda c: F.greatest(F.floor((F.col(f"max_{c}") - F.col(f"min_{c}") + 1e-9) / o.anchor_m), F.lit(0).cast("long"))
    grid = bounds.select(key, "min_x", "min_y", last("x").alias("lx"), last("y").alias("ly"))
    samples = spaced_samples(ring, perimeter, o.coarse_m, key)
    most = o.max_hole_m + 2 * o.coarse_m
    size = blocks[0] if blocks else 1
    span = lambda last, n: F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / n))
    found = grid.withColumn("bx", F.explode(span("lx", size))).withColumn("by", F.explode(span("ly", size)))
    found = found.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    number = lambda n: (F.col("bx") * (F.floor(F.col("ly") / n) + 1) + F.col("by")) * turns + F.col("turn")
    for k, size in enumerate(blocks):
        side = (size - 1) * o.anchor_m + 1e-3
        factor = 1
        while factor * r.cell_m < side:
            factor *= 2
        low = lambda c, b: F.col(f"min_{c}") + F.col(b) * (size * o.anchor_m) - 5e-4  # noqa: B023, E731
        found = found.withColumn("pose", number(size))
        poses = found.select(key, "pose", low("x", "bx").alias("x"), low("y", "by").alias("y"), (F.col("turn") * math.radians(o.rotation_deg)).alias("rotation"))
        hole = score_poses(poses, samples, pooled(cells, factor), frame, scale, reach_m, o.hole_threshold_m, o.cap_m, key, r, factor)
        left = hole.where(F.col("max_hole_m") <= most + 1e-6).select(key, "pose")
        found = cut_lineage(found.join(left, [key, "pose"], "left_semi").drop("pose"))
        inner = size // (blocks[k + 1] if k + 1 < len(blocks) else 1)
        part = F.sequence(F.lit(0).cast("long"), F.lit(inner - 1).cast("long"))
        found = found.withColumn("ix", F.explode(part)).withColumn("iy", F.explode(part))
        found = found.withColumns({"bx": F.col("bx") * inner + F.col("ix"), "by": F.col("by") * inner + F.col("iy")}).drop("ix", "iy")
        below = size // inner
        found = found.where((F.col("bx") * below <= F.col("lx")) & (F.col("by") * below <= F.col("ly")))
    place = lambda c, b: (F.col(f"min_{c}") + F.col(b) * o.anchor_m).alias(c)
    rotation = F.col("turn") * (o.rotation_deg * math.pi / 180)
    return found.select(key, number(1).alias("pose"), place("x", "bx"), place("y", "by"), rotation.alias("rotation"))


def search_poses(
    ring: DataFrame, bounds: DataFrame, cells: DataFrame, frame: DataFrame, scale: float = 1.0, o: PoseOptions = PoseOptions(),
    r: RasterOptions = RasterOptions(), key: str = "path_id", limit: int | None = None, blocks: tuple[int, ...] = BLOCKS,
) -> DataFrame:
    """(key, x, y, rotation, cost, max_hole_m, rank): the cheapest poses
    without a long hole, none close to a better one.

    Of the poses of the grid, those that ``open_poses`` can't rule out are
    scored on few samples; only those whose holes could still be short enough
    are scored on all. ``bounds`` is one row for all outlines, or one for each
    with its ``key``.
    """
    from . import matching

    # Read several times below: outlines, samples of them and cells should be made once.
    ring, cells = cut_lineage(ring), cut_lineage(cells)
    perimeter = cut_lineage(paths.path_length(ring, True, key))
    outlines = ring.select(key).distinct()
    boxed = outlines.join(bounds, key) if key in bounds.columns else outlines.join(F.broadcast(bounds))
    reach = tiled_reach(ring, scale, r, key)
    grid = open_poses(ring, perimeter, boxed, cells, frame, scale, o, r, key, blocks, reach)

    def holes(poses: DataFrame, spacing: float, most: float) -> DataFrame:
        s = spaced_samples(ring, perimeter, spacing, key)
        return score_poses(poses, s, cells, frame, scale, reach, o.hole_threshold_m, o.cap_m, key, r).where(F.col("max_hole_m") <= most)

    fine = holes(holes(grid, o.coarse_m, o.max_hole_m + 2 * o.coarse_m), o.fine_m, o.max_hole_m)
    # Sums in any order: equal costs must stay equal, so that the grid's order decides.
    fine = fine.withColumn("cost", F.floor(F.col("cost") * 1e6 + 0.5) / 1e6)
    best = matching.dedup_poses(fine, key, ["cost", "pose"], o.dedup_m, o.dedup_deg, limit or o.count)
    return best.select(key, "x", "y", "rotation", "cost", "max_hole_m", "rank")
