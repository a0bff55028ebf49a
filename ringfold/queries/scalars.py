"""M: projections, one row in and one row out."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..params import EARTH_RADIUS_M, Bar
from .registry import q, query, sdist, sfix, shalf, sproj, sq, ssegdist

C, L = F.col, F.lit
_R = f"{EARTH_RADIUS_M}::DOUBLE"
_DEG = "(pi() / 180)"
KEY = "way, seq"


@query(
    "m01_vector",
    f"""SELECT {KEY}, {sq('ax + bx')} AS add_x, {sq('ay - by')} AS sub_y, {sq('ax * 2.5')} AS scale_x,
    {sq('ax * cos(0.7::DOUBLE) - ay * sin(0.7::DOUBLE)')} AS rot_x, {sq('ax * sin(0.7::DOUBLE) + ay * cos(0.7::DOUBLE)')} AS rot_y,
    {sq('sqrt(ax * ax + ay * ay)')} AS len, {sq(sdist('ax', 'ay', 'bx', 'by'))} AS dist,
    {sq('ax * bx + ay * by', 1)} AS dot, {sq('ax * by - ay * bx', 1)} AS cross_z FROM g_segment""",
)
def m01(d):
    r = g.rotate(C("ax"), C("ay"), L(0.7))
    return d.segment.select(
        "way", "seq", q(C("ax") + C("bx")).alias("add_x"), q(C("ay") - C("by")).alias("sub_y"), q(C("ax") * 2.5).alias("scale_x"), q(r["x"]).alias("rot_x"),
        q(r["y"]).alias("rot_y"), q(g.norm(C("ax"), C("ay"))).alias("len"), q(g.distance(C("ax"), C("ay"), C("bx"), C("by"))).alias("dist"),
        q(g.dot(C("ax"), C("ay"), C("bx"), C("by")), 1).alias("dot"), q(g.cross(C("ax"), C("ay"), C("bx"), C("by")), 1).alias("cross_z"),
    )


@query(
    "m02_normalize_angle",
    f"""SELECT {KEY}, {sq('CASE WHEN n = 0 THEN 0 ELSE dx / n END')} AS ux, {sq('CASE WHEN n = 0 THEN 0 ELSE dy / n END')} AS uy,
    {sq('atan2(ax * by - ay * bx, ax * bx + ay * by)', 6)} AS angle
    FROM (SELECT *, (seq % 4) * (bx - ax) AS dx, (seq % 4) * (by - ay) AS dy, (seq % 4) * {sdist('ax', 'ay', 'bx', 'by')} AS n FROM g_segment)""",
)
def m02(d):
    k = C("seq") % 4  # every fourth is the zero vector
    u = g.normalize(k * (C("bx") - C("ax")), k * (C("by") - C("ay")))
    return d.segment.select("way", "seq", q(u["x"]).alias("ux"), q(u["y"]).alias("uy"), q(g.angle_between(C("ax"), C("ay"), C("bx"), C("by")), 6).alias("angle"))


_GEO = "g_geo AS (SELECT path_id, seq, -8.6 + x / 100000 AS lon, 41.1 + y / 100000 AS lat FROM g_vertex)"


def geo(d):
    """Vertices as longitudes and latitudes."""
    return d.vertex.select("path_id", "seq", (-8.6 + C("x") / 100000).alias("lon"), (41.1 + C("y") / 100000).alias("lat"))


@query(
    "m03_to_local",
    f"""SELECT path_id, seq, {sq(f'{_R} * (lon + 8.6291) * {_DEG} * cos(41.1579 * {_DEG})')} AS x,
    {sq(f'{_R} * (lat - 41.1579) * {_DEG}')} AS y FROM g_geo""",
    _GEO,
)
def m03(d):
    p = g.to_local(C("lon"), C("lat"), L(-8.6291), L(41.1579))
    return geo(d).select("path_id", "seq", q(p["x"]).alias("x"), q(p["y"]).alias("y"))


@query(
    "m04_to_lonlat",
    f"""SELECT path_id, seq, {sq(f'-8.6291 + x / ({_R} * {_DEG} * cos(41.1579 * {_DEG}))', 7)} AS lon,
    {sq(f'41.1579 + y / ({_R} * {_DEG})', 7)} AS lat FROM g_vertex""",
)
def m04(d):
    p = g.to_lonlat(C("x"), C("y"), L(-8.6291), L(41.1579))
    return d.vertex.select("path_id", "seq", q(p["lon"], 7).alias("lon"), q(p["lat"], 7).alias("lat"))


@query(
    "m05_project_ring",
    f"""SELECT path_id, seq, {sq(f'{_R} * (lon - lon0) * {_DEG} * cos(lat0 * {_DEG})')} AS x, {sq(f'{_R} * (lat - lat0) * {_DEG}')} AS y
    FROM (SELECT *, avg(lon) OVER (PARTITION BY path_id) AS lon0, avg(lat) OVER (PARTITION BY path_id) AS lat0 FROM g_geo)""",
    _GEO,
)
def m05(d):
    from ..operators import paths

    return paths.project_rings(geo(d)).select("path_id", "seq", q(C("x")).alias("x"), q(C("y")).alias("y"))


@query(
    "m06_apply_transform",
    f"""SELECT path_id, seq, {sq('1.5 * (x * cos(0.3::DOUBLE) - y * sin(0.3::DOUBLE)) + 100')} AS x,
    {sq('1.5 * (x * sin(0.3::DOUBLE) + y * cos(0.3::DOUBLE)) - 50')} AS y FROM g_vertex""",
)
def m06(d):
    p = g.apply(C("x"), C("y"), L(100.0), L(-50.0), L(0.3), L(1.5))
    return d.vertex.select("path_id", "seq", q(p["x"]).alias("x"), q(p["y"]).alias("y"))


_SC, _SR = "(0.5 + seq * 0.05::DOUBLE)", "(path_id % 7 * 0.4::DOUBLE)"


@query(
    "m07_compose_invert",
    f"""SELECT path_id, seq, {sq('1.5 * (x * cos(0.3::DOUBLE) - y * sin(0.3::DOUBLE)) + 100')} AS c_tx,
    {sq(f'0.3 + {_SR}', 6)} AS c_rotation, {sq(f'1.5 * {_SC}', 6)} AS c_scale,
    {sq(f'-(x * cos({_SR}) + y * sin({_SR})) / {_SC}')} AS i_tx, {sq(f'(x * sin({_SR}) - y * cos({_SR})) / {_SC}')} AS i_ty,
    {sq(f'1 / {_SC}', 6)} AS i_scale, 0.0::DOUBLE AS round_trip FROM g_vertex""",
)
def m07(d):
    own = g.transform_struct(C("x"), C("y"), C("path_id") % 7 * 0.4, 0.5 + C("seq") * 0.05)
    outer = g.transform_struct(L(100.0), L(-50.0), L(0.3), L(1.5))
    s = d.vertex.withColumn("t", own).withColumn("o", outer)
    s = s.withColumns({"c": g.compose(C("o"), C("t")), "i": g.invert(C("t"))})
    s = s.withColumn("id", g.compose(C("t"), C("i")))
    return s.select(
        "path_id", "seq", q(C("c.tx")).alias("c_tx"), q(C("c.rotation"), 6).alias("c_rotation"), q(C("c.scale"), 6).alias("c_scale"),
        q(C("i.tx")).alias("i_tx"), q(C("i.ty")).alias("i_ty"), q(C("i.scale"), 6).alias("i_scale"), q(F.abs(C("id.tx")) + F.abs(C("id.ty"))).alias("round_trip"),
    )


@query(
    "m08_place_points",
    f"""SELECT path_id, seq, k, {sq('2 * (x * cos(k * pi() / 4) - y * sin(k * pi() / 4)) + 300 * k')} AS x,
    {sq('2 * (x * sin(k * pi() / 4) + y * cos(k * pi() / 4)) - 200 * k')} AS y FROM g_vertex, range(4) t(k)""",
)
def m08(d):
    poses = d.spark.range(4).withColumnRenamed("id", "k")
    p = g.apply(C("x"), C("y"), 300.0 * C("k"), -200.0 * C("k"), C("k") * math.pi / 4, L(2.0))
    return d.vertex.join(F.broadcast(poses)).select("path_id", "seq", "k", q(p["x"]).alias("x"), q(p["y"]).alias("y"))


@query(
    "m09_overlay",
    f"""SELECT path_id, seq, {sq(f'-8.6 + px / ({_R} * {_DEG} * cos(41.15 * {_DEG}))', 7)} AS lon, {sq(f'41.15 + py / ({_R} * {_DEG})', 7)} AS lat
    FROM (SELECT path_id, seq, 1.2 * (x * cos(0.5::DOUBLE) - y * sin(0.5::DOUBLE)) AS px, 1.2 * (x * sin(0.5::DOUBLE) + y * cos(0.5::DOUBLE)) AS py FROM g_vertex)""",
)
def m09(d):
    p = d.vertex.withColumn("p", g.apply(C("x"), C("y"), L(0.0), L(0.0), L(0.5), L(1.2)))
    ll = g.to_lonlat(C("p.x"), C("p.y"), L(-8.6), L(41.15))
    return p.select("path_id", "seq", q(ll["lon"], 7).alias("lon"), q(ll["lat"], 7).alias("lat"))


_PX, _PY = "(ax + 60 * (seq % 5) - 100)", "(by - 40 * (seq % 3))"


@query(
    "m10_closest_point",
    f"""SELECT {KEY}, {sq('ax + t * (bx - ax)')} AS x, {sq('ay + t * (by - ay)')} AS y, {sq('t', 6)} AS t, {sq(ssegdist(_PX, _PY))} AS d
    FROM (SELECT *, {sproj(_PX, _PY)} AS t FROM g_segment)""",
)
def m10(d):
    px, py = C("ax") + 60 * (C("seq") % 5) - 100, C("by") - 40 * (C("seq") % 3)
    s = d.segment.withColumn("f", g.project_on_segment(px, py, C("ax"), C("ay"), C("bx"), C("by")))
    return s.select(
        "way", "seq", q(C("f.x")).alias("x"), q(C("f.y")).alias("y"), q(C("f.t"), 6).alias("t"), q(g.segment_distance(px, py, C("ax"), C("ay"), C("bx"), C("by"))).alias("d")
    )


_PAIR = """g_pair AS (SELECT a.way, a.seq, a.ax, a.ay, a.bx, a.by, b.ax AS cx, b.ay AS cy, b.bx AS dx, b.by AS dy
    FROM g_segment a JOIN g_segment b ON a.way = b.way AND b.seq = a.seq + 2)"""
_DEN = "((bx - ax) * (dy - cy) - (by - ay) * (dx - cx))"
_TA = f"(((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif({_DEN}, 0))"
_TB = f"(((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / nullif({_DEN}, 0))"
_HIT = f"coalesce({_TA} BETWEEN 0 AND 1 AND {_TB} BETWEEN 0 AND 1, false)"


def seg_pairs(d):
    """Each segment with the one after the next of its way."""
    b = d.segment.select("way", (C("seq") - 2).alias("seq"), C("ax").alias("cx"), C("ay").alias("cy"), C("bx").alias("dx"), C("by").alias("dy"))
    return d.segment.join(b, ["way", "seq"])


@query(
    "m11_intersection",
    f"""SELECT {KEY}, {sq('(ax + bx) / 2')} AS mid_x, CASE WHEN {_HIT} THEN {sq(f'ax + {_TA} * (bx - ax)')} END AS x,
    CASE WHEN {_HIT} THEN {sq(f'ay + {_TA} * (by - ay)')} END AS y FROM g_pair""",
    _PAIR,
)
def m11(d):
    s = seg_pairs(d).withColumn("h", g.segment_intersection((C("ax"), C("ay"), C("bx"), C("by")), (C("cx"), C("cy"), C("dx"), C("dy"))))
    return s.select("way", "seq", q((C("ax") + C("bx")) / 2).alias("mid_x"), q(C("h.x")).alias("x"), q(C("h.y")).alias("y"))


_FEET = ", ".join(
    [
        ssegdist("ax", "ay", "cx", "cy", "dx", "dy"),
        ssegdist("bx", "by", "cx", "cy", "dx", "dy"),
        ssegdist("cx", "cy"),
        ssegdist("dx", "dy"),
    ]
)


@query(
    "m12_closest_approach",
    f"SELECT {KEY}, CASE WHEN {_HIT} THEN 0.0::DOUBLE ELSE {sq(f'least({_FEET})')} END AS d, CASE WHEN {_HIT} THEN -1 ELSE "
    f"list_position([{_FEET}], least({_FEET})) - 1 END AS k FROM g_pair",
    _PAIR,
)
def m12(d):
    near = g.closest_approach((C("ax"), C("ay"), C("bx"), C("by")), (C("cx"), C("cy"), C("dx"), C("dy")))
    s = seg_pairs(d).withColumn("n", near)
    return s.select("way", "seq", q(C("n.d")).alias("d"), C("n.k").alias("k"))


@query(
    "m14_local_heading",
    f"""SELECT a.path_id, a.seq, {sq('(b.x - c.x) * cos(0.4::DOUBLE) - (b.y - c.y) * sin(0.4::DOUBLE)')} AS hx,
    {sq('(b.x - c.x) * sin(0.4::DOUBLE) + (b.y - c.y) * cos(0.4::DOUBLE)')} AS hy FROM g_vertex a
    JOIN g_vertex b ON b.path_id = a.path_id AND b.seq = (a.seq + 2) % 32
    JOIN g_vertex c ON c.path_id = a.path_id AND c.seq = (a.seq + 30) % 32""",
)
def m14(d):
    from ..operators import paths

    h = paths.headings(d.vertex).withColumn("r", g.rotate(C("hx"), C("hy"), L(0.4)))
    return h.select("path_id", "seq", q(C("r.x")).alias("hx"), q(C("r.y")).alias("hy"))


_U = "g_unit AS (SELECT way, seq, ax, ay, bx, by, (bx - ax) / {n} AS ux, (by - ay) / {n} AS uy FROM g_segment WHERE {n} > 0)".format(
    n=sdist("ax", "ay", "bx", "by")
)


@query(
    "m15_turn_bearing",
    f"""SELECT a.way, a.seq, {sq('acos(least(1, greatest(-1, a.ux * b.ux + a.uy * b.uy)))', 6)} AS turn,
    {sq('atan2(a.by - a.ay, a.bx - a.ax)', 6)} AS bearing FROM g_unit a JOIN g_unit b ON a.way = b.way AND b.seq = a.seq + 1""",
    _U,
)
def m15(d):
    from pyspark.sql import Window

    from ..operators import paths

    w = Window.partitionBy("path_id").orderBy("seq")
    s = paths.directed(d.vertex, False).withColumns({"vx": F.lead("ux").over(w), "vy": F.lead("uy").over(w)}).where("vx is not null")
    return s.select(
        C("path_id").alias("way"), "seq", q(g.turn(C("ux"), C("uy"), C("vx"), C("vy")), 6).alias("turn"), q(g.bearing(C("ax"), C("ay"), C("bx"), C("by")), 6).alias("bearing")
    )


_A, _B = "(way * 0.37 + seq)", "(seq * 1.9 - way * 0.11)"


def _sdelta(period: str, a: str = _A, b: str = _B) -> str:
    m = f"(abs({a} - {b}) - floor(abs({a} - {b}) / {period}) * {period})"
    return f"least({m}, {period} - {m})"


@query(
    "m16_angle_delta",
    f"SELECT {KEY}, {sq(_sdelta('(2 * pi())', _A + '::DOUBLE', _B + '::DOUBLE'), 6)} AS full_delta, {sq(_sdelta('pi()', _A + '::DOUBLE', _B + '::DOUBLE'), 6)} AS half_delta FROM g_segment",
)
def m16(d):
    a, b = C("way") * 0.37 + C("seq"), C("seq") * 1.9 - C("way") * 0.11
    a, b = a.cast("double"), b.cast("double")
    return d.segment.select("way", "seq", q(g.angle_delta(a, b), 6).alias("full_delta"), q(g.heading_delta(a, b), 6).alias("half_delta"))


@query(
    "m17_heading_layer",
    f"""SELECT {KEY}, CAST(floor(m / (pi() / 12) + 0.5) AS BIGINT) % 12 AS layer FROM (SELECT {KEY}, h - floor(h / pi()) * pi() AS m
    FROM (SELECT *, atan2(by - ay, bx - ax) AS h FROM g_segment))""",
)
def m17(d):
    return d.segment.select("way", "seq", g.heading_layer(C("bx") - C("ax"), C("by") - C("ay")).alias("layer"))


@query("m18_cell_key", f"SELECT {KEY}, CAST(floor(ax / 50) AS BIGINT) AS cx, CAST(floor(ay / 50) AS BIGINT) AS cy FROM g_segment")
def m18(d):
    return d.segment.select("way", "seq", g.cell(C("ax"), 50.0).alias("cx"), g.cell(C("ay"), 50.0).alias("cy"))


_STRAIGHT, _PATH = sdist("ax", "ay", "bx", "by"), f"({sdist('ax', 'ay', 'bx', 'by')} * (1 + (seq % 4) * 0.3))"


@query(
    "m19_match_costs",
    f"""SELECT {KEY}, {sq(f'({_STRAIGHT} / 70) * ({_STRAIGHT} / 70)')} AS emission,
    CASE WHEN {_STRAIGHT} > 150 OR seq % 5 = 0 THEN 'infinite' ELSE {sfix(f'least(10, 3 * greatest(0, {_PATH} - 50) / 50 + 0.3 * greatest(0, 50 - {_PATH}) / 50)', 4)} END AS transition FROM g_segment""",
)
def m19(d):
    n = g.distance(C("ax"), C("ay"), C("bx"), C("by"))
    path = F.when(C("seq") % 5 != 0, n * (1 + (C("seq") % 4) * 0.3))
    cost = g.transition_cost(n, path)
    shown = F.when(cost == g.INF, L("infinite")).otherwise(t.fixed(F.least(cost, L(99.0)), 4))
    return d.segment.select("way", "seq", q(g.emission_cost(n)).alias("emission"), shown.alias("transition"))


def metrics():
    """Columns of a route's metrics, in the order that the bar takes."""
    return tuple(C(c) for c in ("mean_dev", "max_dev", "ratio", "retrace"))


S_TERMS = """g_terms AS (SELECT *, mean_dev / 30 AS mean_ratio, max_dev / 100 AS max_ratio, retrace / 0.05::DOUBLE AS retrace_ratio,
    CASE WHEN ratio < 0.9::DOUBLE THEN 1 + (0.9::DOUBLE - ratio) / 0.9::DOUBLE WHEN ratio > 1.2::DOUBLE THEN 1 + (ratio - 1.2::DOUBLE) / 1.2::DOUBLE ELSE 0 END AS length_term FROM g_route),
    g_bar AS (SELECT *, greatest(mean_ratio, max_ratio, length_term, retrace_ratio) AS worst FROM g_terms)"""


@query(
    "m20_bar_terms",
    f"""SELECT circuit, region, k, {sq('mean_ratio', 4)} AS mean_ratio, {sq('max_ratio', 4)} AS max_ratio, {sq('length_term', 4)} AS length_term,
    {sq('retrace_ratio', 4)} AS retrace_ratio, {sq('worst', 4)} AS worst, {sq('mean_ratio + max_ratio + length_term + retrace_ratio')} AS total,
    worst <= 1 AS passes FROM g_bar""",
    S_TERMS,
)
def m20(d):
    terms = g.bar_terms(*metrics())
    return d.route.select(
        "circuit", "region", "k", *[q(c, 4).alias(n) for n, c in terms.items()], q(g.worst_ratio(*metrics()), 4).alias("worst"),
        q(sum(list(terms.values())[1:], list(terms.values())[0])).alias("total"), g.passes_bar(*metrics()).alias("passes"),
    )


@query(
    "m21_readout_clamp",
    f"""SELECT circuit, region, k, {sq('least(3, greatest(0.5, ratio * 2 - 1))', 4)} AS scale, {sq('mean_dev * ratio')} AS lap_m,
    {sq('max_dev * ratio')} AS straight_m FROM g_route""",
)
def m21(d):
    return d.route.select(
        "circuit", "region", "k", q(g.clamp(C("ratio") * 2 - 1, 0.5, 3.0), 4).alias("scale"), q(C("mean_dev") * C("ratio")).alias("lap_m"),
        q(C("max_dev") * C("ratio")).alias("straight_m"),
    )


def _channel(i: int) -> str:
    red, amber, green = g.RED[i], g.AMBER[i], g.GREEN[i]
    v = f"CASE WHEN c >= 0.5 THEN {amber} + ({green} - {amber}) * ((c - 0.5) / 0.5) ELSE {red} + ({amber} - {red}) * (c / 0.5) END"
    return f"lpad(lower(printf('%x', {shalf(v)})), 2, '0')"


@query(
    "m22_coverage_colour",
    f"""SELECT circuit, region, k, '#' || {_channel(0)} || {_channel(1)} || {_channel(2)} AS colour,
    CAST(least(7, floor(c * 8)) AS BIGINT) AS bucket FROM (SELECT *, least(1, greatest(0, ratio * 2 - 1.5)) AS c FROM g_route)""",
)
def m22(d):
    c = C("ratio") * 2 - 1.5
    return d.route.select("circuit", "region", "k", g.coverage_colour(c).alias("colour"), g.bucket_of(c).alias("bucket"))


@query(
    "m23_drag_bearing",
    f"""SELECT {KEY}, {sq('atan2(-(bx - ax), -(by - ay))', 6)} AS bearing, {sq('ax - 40 * sin(atan2(-(bx - ax), -(by - ay)))')} AS handle_x,
    {sq('ay - 40 * cos(atan2(-(bx - ax), -(by - ay)))')} AS handle_y FROM g_segment""",
)
def m23(d):
    b = g.drag_bearing(C("ax"), C("ay"), C("bx"), C("by"))
    h = g.handle_pixel(C("ax"), C("ay"), b, L(40.0))
    return d.segment.select("way", "seq", q(b, 6).alias("bearing"), q(h["x"]).alias("handle_x"), q(h["y"]).alias("handle_y"))


@query(
    "m24_gap_metres",
    f"""SELECT a.path_id, a.seq, {sq('sqrt(((b.lat - a.lat) * 111320) * ((b.lat - a.lat) * 111320) + ((b.lon - a.lon) * 111320 * cos((a.lat + b.lat) / 2 * (pi() / 180))) * ((b.lon - a.lon) * 111320 * cos((a.lat + b.lat) / 2 * (pi() / 180))))')} AS gap
    FROM g_geo a JOIN g_geo b ON a.path_id = b.path_id AND b.seq = a.seq + 1""",
    _GEO,
)
def m24(d):
    from pyspark.sql import Window

    w = Window.partitionBy("path_id").orderBy("seq")
    p = geo(d).withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)}).where("lon2 is not null")
    return p.select("path_id", "seq", q(g.gap_m(C("lon"), C("lat"), C("lon2"), C("lat2"))).alias("gap"))


@query(
    "m25_round_half_up",
    "SELECT circuit, region, k, floor(max_dev * 100 + 0.5) / 100 AS r2, CAST(floor(mean_dev - 26 + 0.5) AS BIGINT) AS r0 FROM g_route",
)
def m25(d):
    return d.route.select("circuit", "region", "k", g.half_up(C("max_dev"), 2).alias("r2"), g.half_up(C("mean_dev") - 26).alias("r0"))


@query(
    "m26_seed_poses",
    f"""SELECT {KEY}, flip, {sq('rot', 6)} AS rotation, {sq('(ax + bx) / 2 - (150 * cos(rot) - 40 * sin(rot))')} AS x, {sq('(ay + by) / 2 - (150 * sin(rot) + 40 * cos(rot))')} AS y
    FROM (SELECT *, atan2(by - ay, bx - ax) + flip * pi() - atan2(80::DOUBLE, 100::DOUBLE) AS rot FROM g_segment, range(2) t(flip))""",
)
def m26(d):
    from ..operators.matching import seed_poses

    s = d.segment.withColumn("bearing", g.bearing(C("ax"), C("ay"), C("bx"), C("by")))
    p = seed_poses(s, (100.0, 0.0), (200.0, 80.0))
    return p.select("way", "seq", "flip", q(C("rotation"), 6).alias("rotation"), q(C("x")).alias("x"), q(C("y")).alias("y"))


@query(
    "m27_svg_path",
    f"""SELECT path_id, 'M ' || string_agg({sfix('14 + (w - sx) * s / 2 + (x - x0) * s', 1)} || ' ' || {sfix('14 + (w - sy) * s / 2 + (y1 - y) * s', 1)}, ' L ' ORDER BY k) AS d
    FROM (SELECT *, 192 / w AS s FROM (SELECT *, greatest(x1 - x0, y1 - y0) AS w, x1 - x0 AS sx, y1 - y0 AS sy FROM (
    SELECT path_id, k, x, y, min(x) OVER p AS x0, max(x) OVER p AS x1, min(y) OVER p AS y0, max(y) OVER p AS y1 FROM (
    SELECT path_id, seq AS k, x, y FROM g_vertex UNION ALL SELECT path_id, 32, x, y FROM g_vertex WHERE seq = 0) WINDOW p AS (PARTITION BY path_id)))) GROUP BY path_id""",
)
def m27(d):
    b = d.vertex.groupBy("path_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    return b.select("path_id", t.svg_path(C("p"), C("x0"), C("y0"), C("x1"), C("y1")).alias("d"))


DEFAULT_BAR = Bar()
