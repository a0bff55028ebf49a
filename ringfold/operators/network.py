"""Street networks from raw ways: clipping, thinning, lattice encoding, gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import METRES_PER_DEGREE, RUNNABLE_CLASSES, NetworkOptions
from . import kernels, paths


def encode_lattice(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., flat) of lattice points (keys..., seq, gx, gy): the first
    point, then steps; repeats are dropped, and so are ways of one point."""
    keys = keys or ["path_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    same = (F.lag("gx").over(w) == F.col("gx")) & (F.lag("gy").over(w) == F.col("gy"))
    p = points.withColumn("__same", F.coalesce(same, F.lit(False))).where(~F.col("__same"))
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0).cast("long"))
    p = p.withColumns({"dx": step("gx"), "dy": step("gy")})
    rows = F.array_sort(F.collect_list(F.struct("seq", "dx", "dy")))
    e = p.groupBy(*keys).agg(rows.alias("r")).where(F.size("r") >= 2)
    return e.select(*keys, F.flatten(F.transform("r", lambda v: F.array(v["dx"], v["dy"]))).alias("flat"))


def build_network(ways: DataFrame, box: tuple[float, float, float, float], o: NetworkOptions = NetworkOptions()) -> DataFrame:
    """(path_id, run, flat): runnable ways (path_id, seq, lon, lat, highway)
    clipped to the box, thinned by Douglas-Peucker and encoded."""
    own = ways.where(F.col("highway").isin(*RUNNABLE_CLASSES))
    own = own.select("path_id", "seq", F.col("lon").alias("x"), F.col("lat").alias("y"))
    runs = paths.clip_to_box(own, box)
    lon0, lat0 = F.lit((box[0] + box[2]) / 2), F.lit((box[1] + box[3]) / 2)
    local = runs.withColumn("p", g.to_local(F.col("x"), F.col("y"), lon0, lat0)).select("path_id", "run", "seq", "p.x", "p.y")

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("seq")
        return f[kernels.simplify(f[["x", "y"]].to_numpy(), o.simplify_m, False)]

    kept = local.groupBy("path_id", "run").applyInPandas(thin, "path_id long, run long, seq long, x double, y double")
    ll = kept.withColumn("p", g.to_lonlat(F.col("x"), F.col("y"), lon0, lat0))
    lattice = ll.select(
        "path_id", "run", "seq",
        g.half_up((F.col("p.lon") - box[0]) / o.grid_deg).alias("gx"), g.half_up((F.col("p.lat") - box[1]) / o.grid_deg).alias("gy"),
    )
    return encode_lattice(lattice, ["path_id", "run"])


def loose_end_bridges(ends: DataFrame, tolerance_m: float, max_latitude: float = 85.0) -> DataFrame:
    """(a, b, gap): pairs a < b of ends (end, lon, lat) at most the tolerance apart.

    Cells are as high as the tolerance and as wide as it is in degrees at the
    band's own latitude, so an end meets only its neighbours.
    """
    import math

    high = tolerance_m / METRES_PER_DEGREE
    band = F.floor(F.col("lat") / high)
    # A cell's width must cover the tolerance at the far edge of the neighbouring bands.
    edge = lambda b: F.least(F.greatest(F.abs(b * high), F.abs((b + 1) * high)) + 2 * high, F.lit(max_latitude))
    wide = lambda b: high / F.cos(edge(b) * (math.pi / 180)) * 1.000001
    a = ends.select(F.col("end").alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), band.alias("row"))
    a = a.withColumn("col", F.floor(F.col("lon_a") / wide(F.col("row"))))
    b = ends.select(F.col("end").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"), band.alias("own"))
    b = b.withColumn("row", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)))
    at = F.floor(F.col("lon_b") / wide(F.col("row")))
    b = b.withColumn("col", F.explode(F.sequence(at - 1, at + 1)))
    j = a.join(b, ["row", "col"]).where("a < b")
    gap = g.gap_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return j.withColumn("gap", gap).where(F.col("gap") <= tolerance_m).select("a", "b", "gap")
