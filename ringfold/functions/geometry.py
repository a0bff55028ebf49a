"""Planar and geographic geometry as column expressions.

Points are pairs of columns (x, y), so that everything stays inside code
generation; functions that give a point return a struct with x and y.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EARTH_RADIUS_M, METRES_PER_DEGREE, Bar, MatchOptions

INF = float("inf")


def half_up(x: Column, decimals: int = 0) -> Column:
    """Rounds halves towards plus infinity; a double for decimals, else a long."""
    if not decimals:
        return F.floor(x + 0.5)
    f = 10.0**decimals
    return F.floor(x * f + 0.5) / f


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return norm(bx - ax, by - ay)


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def rotate(x: Column, y: Column, angle: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    return point(x * c - y * s, x * s + y * c)


def normalize(x: Column, y: Column) -> Column:
    """The unit vector, or (0, 0) for the zero vector."""
    n = norm(x, y)
    zero = n == 0
    n = F.when(zero, F.lit(1.0)).otherwise(n)
    return point(F.when(zero, F.lit(0.0)).otherwise(x / n), F.when(zero, F.lit(0.0)).otherwise(y / n))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed angle from a to b, in (-pi, pi]."""
    return F.atan2(cross(ax, ay, bx, by), dot(ax, ay, bx, by))


def to_local(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Equirectangular metres east and north of an origin."""
    deg = math.pi / 180
    return point(EARTH_RADIUS_M * (lon - lon0) * deg * F.cos(lat0 * deg), EARTH_RADIUS_M * (lat - lat0) * deg)


def to_lonlat(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    deg = math.pi / 180
    return F.struct(
        (lon0 + x / (EARTH_RADIUS_M * deg * F.cos(lat0 * deg))).alias("lon"),
        (lat0 + y / (EARTH_RADIUS_M * deg)).alias("lat"),
    )


def apply(x: Column, y: Column, tx: Column, ty: Column, rotation: Column, scale: Column) -> Column:
    """Scale, then rotate, then translate."""
    c, s = F.cos(rotation), F.sin(rotation)
    return point(scale * (x * c - y * s) + tx, scale * (x * s + y * c) + ty)


def transform_struct(tx: Column, ty: Column, rotation: Column, scale: Column) -> Column:
    return F.struct(tx.alias("tx"), ty.alias("ty"), rotation.alias("rotation"), scale.alias("scale"))


def compose(outer: Column, inner: Column) -> Column:
    """The transform that applies ``inner``, then ``outer`` (structs tx, ty, rotation, scale)."""
    moved = apply(inner["tx"], inner["ty"], outer["tx"], outer["ty"], outer["rotation"], outer["scale"])
    return transform_struct(moved["x"], moved["y"], outer["rotation"] + inner["rotation"], outer["scale"] * inner["scale"])


def invert(t: Column) -> Column:
    s = 1 / t["scale"]
    c, n = F.cos(-t["rotation"]), F.sin(-t["rotation"])
    return transform_struct(
        s * (-t["tx"] * c + t["ty"] * n), s * (-t["tx"] * n - t["ty"] * c), -t["rotation"], s
    )


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(x, y, t): the closest point of the segment; a degenerate one gives a."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.when(len2 == 0, F.lit(1.0)).otherwise(len2)
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return F.struct((ax + t * dx).alias("x"), (ay + t * dy).alias("y"), t.alias("t"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance to a segment, in one expression without a struct."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.when(len2 == 0, F.lit(1.0)).otherwise(len2)
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return distance(px, py, ax + t * dx, ay + t * dy)


def segment_intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """struct(x, y, ta, tb) where two segments (ax, ay, bx, by) cross; null if
    they are parallel or miss each other."""
    rx, ry, sx, sy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    den = cross(rx, ry, sx, sy)
    safe = F.when(den == 0, F.lit(None)).otherwise(den)
    qx, qy = b[0] - a[0], b[1] - a[1]
    t, u = cross(qx, qy, sx, sy) / safe, cross(qx, qy, rx, ry) / safe
    hit = F.struct((a[0] + t * rx).alias("x"), (a[1] + t * ry).alias("y"), t.alias("ta"), u.alias("tb"))
    return F.when(t.between(0, 1) & u.between(0, 1), hit)


def closest_approach(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """struct(d, k, x, y, ta, tb): where two segments are closest.

    Zero at a crossing (k = -1); else the best of the four end points against
    the other segment, the first on ties; (x, y) is halfway between. The work
    is in lambdas, which keeps it out of the generated code's size limit.
    """
    names = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
    both = F.struct(*[c.cast("double").alias(n) for c, n in zip((*a, *b), names, strict=True)])

    def feet(s: Column) -> Column:
        def one(k: int, p: str, seg: str) -> Column:
            return F.struct(
                F.lit(k).alias("k"), s[f"{p}x"].alias("px"), s[f"{p}y"].alias("py"),
                *[s[f"{e}{v}"].alias(f"{n}{v}") for e, n in zip(seg, "se") for v in "xy"],
            )

        def place(f: Column) -> Column:
            g = project_on_segment(f["px"], f["py"], f["sx"], f["sy"], f["ex"], f["ey"])
            return F.struct(f["k"].alias("k"), f["px"].alias("px"), f["py"].alias("py"), g.alias("g"))

        def measure(f: Column) -> Column:
            own = F.when(f["k"] % 2 == 1, F.lit(1.0)).otherwise(F.lit(0.0))
            return F.struct(
                distance(f["px"], f["py"], f["g"]["x"], f["g"]["y"]).alias("d"),
                f["k"].alias("k"),
                ((f["px"] + f["g"]["x"]) / 2).alias("x"),
                ((f["py"] + f["g"]["y"]) / 2).alias("y"),
                F.when(f["k"] < 2, own).otherwise(f["g"]["t"]).alias("ta"),
                F.when(f["k"] < 2, f["g"]["t"]).otherwise(own).alias("tb"),
            )

        ends = F.array(one(0, "a", "cd"), one(1, "b", "cd"), one(2, "c", "ab"), one(3, "d", "ab"))
        return F.array_min(F.transform(F.transform(ends, place), measure))

    def crossing(s: Column) -> Column:
        hit = segment_intersection((s["ax"], s["ay"], s["bx"], s["by"]), (s["cx"], s["cy"], s["dx"], s["dy"]))
        made = F.transform(
            F.array(hit),
            lambda h: F.struct(F.lit(0.0).alias("d"), F.lit(-1).alias("k"), *[h[c].alias(c) for c in ("x", "y", "ta", "tb")]),
        )
        return F.when(hit.isNotNull(), F.get(made, 0))

    return F.get(F.transform(F.array(both), lambda s: F.coalesce(crossing(s), feet(s))), 0)


def turn(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Unsigned angle between unit vectors."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(ax, ay, bx, by))))


def bearing(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.atan2(by - ay, bx - ax)


def angle_delta(a: Column, b: Column) -> Column:
    """Smallest difference of two angles, in [0, pi]."""
    d = F.abs(a - b) % (2 * math.pi)
    return F.when(d > math.pi, 2 * math.pi - d).otherwise(d)


def heading_delta(a: Column, b: Column) -> Column:
    """Smallest difference of two undirected headings, in [0, pi/2]."""
    d = F.abs(a - b) % math.pi
    return F.when(d > math.pi / 2, math.pi - d).otherwise(d)


def heading_layer(hx: Column, hy: Column, layers: int = 12) -> Column:
    """Number of the orientation layer nearest to a heading, modulo pi."""
    angle = F.atan2(hy, hx)
    folded = ((angle % math.pi) + math.pi) % math.pi
    return F.floor(folded / (math.pi / layers) + 0.5) % layers


def aligned(sx: Column, sy: Column, hx: Column, hy: Column, max_rad: float) -> Column:
    """Whether a segment runs along a heading, either way; never if it has no length."""
    n = norm(sx, sy) * norm(hx, hy)
    safe = F.when(n == 0, F.lit(None)).otherwise(n)
    return F.coalesce(F.abs(dot(sx, sy, hx, hy) / safe) >= math.cos(max_rad), F.lit(False))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def gap_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat = (lat2 - lat1) * METRES_PER_DEGREE
    dlon = (lon2 - lon1) * METRES_PER_DEGREE * F.cos((lat1 + lat2) / 2 * (math.pi / 180))
    return norm(dlat, dlon)


def emission_cost(distance_m: Column, o: MatchOptions = MatchOptions()) -> Column:
    r = distance_m / o.emission_m
    return r * r


def transition_cost(straight_m: Column, path_m: Column, o: MatchOptions = MatchOptions()) -> Column:
    """Cost of a hop whose shortest path is ``path_m`` (null: none); infinite
    where the ends are too far apart or not connected."""
    over = F.greatest(F.lit(0.0), path_m - o.step_m) / o.step_m
    under = F.greatest(F.lit(0.0), o.step_m - path_m) / o.step_m
    cost = F.least(F.lit(o.cost_cap), o.excess_weight * over + o.deficit_weight * under)
    return F.when((straight_m > o.step_m * o.hop_factor) | path_m.isNull(), F.lit(INF)).otherwise(cost)


def bar_terms(mean: Column, longest: Column, ratio: Column, retraced: Column, bar: Bar = Bar()) -> dict[str, Column]:
    """Each criterion as a multiple of its limit; the length ratio is 0 inside
    its band and above 1 outside."""
    length = (
        F.when(ratio < bar.ratio_lo, 1 + (bar.ratio_lo - ratio) / bar.ratio_lo)
        .when(ratio > bar.ratio_hi, 1 + (ratio - bar.ratio_hi) / bar.ratio_hi)
        .otherwise(F.lit(0.0))
    )
    return {
        "mean_ratio": mean / bar.mean_m,
        "max_ratio": longest / bar.max_m,
        "length_term": length,
        "retrace_ratio": retraced / bar.retrace,
    }


def worst_ratio(*metrics: Column, bar: Bar = Bar()) -> Column:
    return F.greatest(*bar_terms(*metrics, bar=bar).values())


def passes_bar(*metrics: Column, bar: Bar = Bar()) -> Column:
    return worst_ratio(*metrics, bar=bar) <= 1


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def bucket_of(coverage: Column, levels: int = 8) -> Column:
    return F.least(F.lit(levels - 1), F.floor(clamp(coverage, 0.0, 1.0) * levels))


#: The colours at coverage 0, 0.5 and 1.
RED, AMBER, GREEN = (0xC6, 0x28, 0x28), (0xF9, 0xA8, 0x25), (0x2E, 0x7D, 0x32)


def coverage_colour(coverage: Column) -> Column:
    """``#rrggbb`` on the ramp from red over amber to green."""
    c = clamp(coverage, 0.0, 1.0)
    high = c >= 0.5
    t = F.when(high, (c - 0.5) / 0.5).otherwise(c / 0.5)

    def channel(k: int) -> Column:
        a = F.when(high, F.lit(float(AMBER[k]))).otherwise(F.lit(float(RED[k])))
        b = F.when(high, F.lit(float(GREEN[k]))).otherwise(F.lit(float(AMBER[k])))
        return F.lpad(F.lower(F.hex(half_up(a + (b - a) * t))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def drag_bearing(cx: Column, cy: Column, px: Column, py: Column) -> Column:
    return F.atan2(-(px - cx), -(py - cy))


def handle_pixel(cx: Column, cy: Column, rotation: Column, radius: Column) -> Column:
    return point(cx - radius * F.sin(rotation), cy - radius * F.cos(rotation))
