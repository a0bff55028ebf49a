"""A, W and G: aggregates, window functions and generators on paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import kernels, matching, paths, spatial
from ..operators.components import connected_components
from ..params import Proximity
from .registry import q, query, sdist, shalf, sq, ssegdist
from .scalars import _GEO, geo

C, L = F.col, F.lit
K = "path_id"
_LEN = sdist("ax", "ay", "bx", "by")
_W = "(ax * by - bx * ay)"
_AREA = f"g_area AS (SELECT path_id, sum({_W}) AS w, sum((ax + bx) * {_W}) AS sx, sum((ay + by) * {_W}) AS sy FROM g_ring_segment GROUP BY path_id)"
_CENTRE = "g_centre AS (SELECT path_id, sx / (3 * w) AS cx, sy / (3 * w) AS cy FROM g_area)"


@query("a01_mean_lonlat", f"SELECT path_id, {sq('avg(lon)', 7)} AS lon, {sq('avg(lat)', 7)} AS lat FROM g_geo GROUP BY path_id", _GEO)
def a01(d):
    return geo(d).groupBy(K).agg(q(F.avg("lon"), 7).alias("lon"), q(F.avg("lat"), 7).alias("lat"))


@query(
    "a02_path_length",
    f"""SELECT path_id, {sq(f'sum(CASE WHEN seq < 31 THEN {_LEN} END)')} AS open_m, {sq(f'sum({_LEN})')} AS closed_m FROM g_ring_segment GROUP BY path_id""",
)
def a02(d):
    o = paths.path_length(d.vertex, False).withColumnRenamed("length_m", "o")
    c = paths.path_length(d.vertex, True).withColumnRenamed("length_m", "c")
    return o.join(c, K).select(K, q(C("o")).alias("open_m"), q(C("c")).alias("closed_m"))


@query(
    "a03_bounds",
    f"""SELECT path_id, {sq('min(x)')} AS min_x, {sq('min(y)')} AS min_y, {sq('max(x)')} AS max_x, {sq('max(y)')} AS max_y FROM g_vertex GROUP BY path_id
    UNION ALL SELECT NULL, {sq('min(x)')}, {sq('min(y)')}, {sq('max(x)')}, {sq('max(y)')} FROM g_vertex""",
)
def a03(d):
    whole = paths.bounds(d.vertex, None).withColumn(K, L(None).cast("long"))
    b = paths.bounds(d.vertex).unionByName(whole)
    return b.select(K, *[q(C(c)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("a04_signed_area", f"SELECT path_id, {sq('w / 2', 1)} AS area FROM g_area", _AREA)
def a04(d):
    return paths.signed_area(d.vertex).select(K, q(C("area"), 1).alias("area"))


@query("a05_centroid", f"SELECT path_id, {sq('cx', 2)} AS cx, {sq('cy', 2)} AS cy FROM g_centre", _AREA, _CENTRE)
def a05(d):
    return paths.centroid(d.vertex).select(K, q(C("cx"), 2).alias("cx"), q(C("cy"), 2).alias("cy"))


_FIT = """g_fit AS (SELECT a.path_id, a.x AS fx, a.y AS fy, b.x AS tx, b.y AS ty FROM g_vertex a JOIN g_vertex b
    ON a.path_id = b.path_id AND b.seq = (a.seq * 3) % 32),
    g_mom AS (SELECT path_id, avg(fx) AS mfx, avg(fy) AS mfy, avg(tx) AS mtx, avg(ty) AS mty, count(*) AS n,
    (covar_pop(fx, tx) + covar_pop(fy, ty)) * count(*) AS a, (covar_pop(fx, ty) - covar_pop(fy, tx)) * count(*) AS b,
    (var_pop(fx) + var_pop(fy)) * count(*) AS ff, (var_pop(tx) + var_pop(ty)) * count(*) AS tt FROM g_fit GROUP BY path_id),
    g_sim AS (SELECT *, atan2(b, a) AS rot, sqrt(a * a + b * b) / ff AS sc FROM g_mom)"""


@query(
    "a06_procrustes",
    f"""SELECT path_id, {sq('sc', 5)} AS scale, {sq('cos(rot)', 4)} AS cos_rotation, {sq('mtx - sc * (cos(rot) * mfx - sin(rot) * mfy)', 1)} AS tx,
    {sq('mty - sc * (sin(rot) * mfx + cos(rot) * mfy)', 1)} AS ty, {sq('sqrt(greatest(0, sc * sc * ff - 2 * sc * sqrt(a * a + b * b) + tt) / n)', 2)} AS residual FROM g_sim""",
    _FIT,
)
def a06(d):
    to = d.vertex.select(K, C("seq").alias("s3"), C("x").alias("tx"), C("y").alias("ty"))
    pairs = d.vertex.withColumn("s3", C("seq") * 3 % 32).join(to, [K, "s3"]).select(K, C("x").alias("fx"), C("y").alias("fy"), "tx", "ty")
    f = paths.fit_similarity(pairs)
    return f.select(
        K, q(C("scale"), 5).alias("scale"), q(F.cos("rotation"), 4).alias("cos_rotation"), q(C("tx"), 1).alias("tx"), q(C("ty"), 1).alias("ty"), q(C("residual"), 2).alias("residual")
    )


_TURN = """g_dir AS (SELECT path_id, seq, bx - ax AS dx, by - ay AS dy FROM g_ring_segment),
    g_turn AS (SELECT path_id, seq, sum(angle) OVER (PARTITION BY path_id ORDER BY seq) AS turning FROM (SELECT path_id, seq,
    coalesce(atan2(px * dy - py * dx, px * dx + py * dy), 0) AS angle FROM (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM g_dir WINDOW w AS (PARTITION BY path_id ORDER BY seq))))"""


@query(
    "a07_turning_distance",
    f"""SELECT a.path_id, {sq('sqrt(var_pop(a.turning - b.turning))', 5)} AS distance FROM g_turn a JOIN g_turn b ON b.path_id = (a.path_id + 1) % (SELECT count(*) FROM embeddings) AND b.seq = a.seq GROUP BY a.path_id""",
    _TURN,
)
def a07(d):
    n = d.table("embeddings").count()
    turn = paths.cumulative_turning(d.vertex, True)
    other = turn.select(F.pmod(C(K) - 1, L(n)).alias(K), "seq", C("turning").alias("b"))
    return paths.turning_distance(turn.withColumnRenamed("turning", "a").join(other, [K, "seq"])).select(K, q(C("distance"), 5).alias("distance"))


@query("w01_segments", f"SELECT path_id, seq, {sq('ax')} AS ax, {sq('ay')} AS ay, {sq('bx')} AS bx, {sq('by')} AS by FROM g_ring_segment")
def w01(d):
    return paths.segments(d.vertex, True).select(K, "seq", *[q(C(c)).alias(c) for c in ("ax", "ay", "bx", "by")])


@query("w02_cumulative_turning", f"SELECT path_id, seq, {sq('turning', 6)} AS turning FROM g_turn", _TURN)
def w02(d):
    return paths.cumulative_turning(d.vertex, True).select(K, "seq", q(C("turning"), 6).alias("turning"))


_ARC = f"""g_arc AS (SELECT path_id, seq, ax, ay, bx, by, {_LEN} AS len, sum({_LEN}) OVER (PARTITION BY path_id ORDER BY seq) AS end_m,
    sum({_LEN}) OVER (PARTITION BY path_id) AS total FROM g_ring_segment)"""


@query("w03_arc_length", f"SELECT path_id, seq, {sq('end_m - len')} AS arc_m FROM g_arc", _ARC)
def w03(d):
    return paths.cumulative_length(d.vertex).select(K, "seq", q(C("arc_m")).alias("arc_m"))


_RUNS = f"""g_unit AS (SELECT path_id, seq, ax, ay, bx, by, {_LEN} AS len, (bx - ax) / {_LEN} AS ux, (by - ay) / {_LEN} AS uy FROM g_ring_segment),
    g_joint AS (SELECT a.*, CASE WHEN acos(least(1, greatest(-1, a.ux * b.ux + a.uy * b.uy))) > 0.6 THEN 1 ELSE 0 END AS broke
    FROM g_unit a JOIN g_unit b ON a.path_id = b.path_id AND b.seq = (a.seq + 31) % 32),
    g_first AS (SELECT path_id, min(seq) AS f FROM g_joint WHERE broke = 1 GROUP BY path_id),
    g_turned AS (SELECT j.*, (seq + 32 - coalesce(f, 0)) % 32 AS pos_k, f FROM g_joint j LEFT JOIN g_first USING (path_id)),
    g_island AS (SELECT *, sum(CASE WHEN pos_k > 0 AND f IS NOT NULL THEN broke ELSE 0 END) OVER (PARTITION BY path_id ORDER BY pos_k) AS island FROM g_turned),
    g_run AS (SELECT path_id, island, sum(len) AS length_m, arg_min(seq, pos_k) AS s, arg_max(seq, pos_k) AS e, arg_min(ax, pos_k) AS x0, arg_min(ay, pos_k) AS y0, arg_max(bx, pos_k) AS x1, arg_max(by, pos_k) AS y1 FROM g_island GROUP BY 1, 2)"""


@query(
    "w05_longest_straight",
    f"""SELECT path_id, s AS start_index, (e + 1) % 32 AS end_index, {sq('length_m')} AS length_m, {sq('atan2(y1 - y0, x1 - x0)', 5)} AS bearing
    FROM g_run QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY floor(length_m * 1e8 + 0.5) DESC, s) = 1""",
    _RUNS,
)
def w05(d):
    s = paths.longest_straight(d.vertex, 0.6, True)
    return s.select(K, "start_index", "end_index", q(C("length_m")).alias("length_m"), q(C("bearing"), 5).alias("bearing"))


@query(
    "m13_circuit_columns",
    f"""SELECT path_id, {sq('lap', 2)} AS lap_m, {sq('length_m', 2)} AS straight_m, {sq('m.x - cx', 2)} AS first_x, {sq('m.y - cy', 2)} AS first_y FROM (
    SELECT path_id, sum({_LEN}) AS lap FROM g_ring_segment GROUP BY path_id) JOIN g_centre USING (path_id) JOIN (SELECT path_id, x, y FROM g_vertex WHERE seq = 0) m USING (path_id)
    JOIN (SELECT path_id, max(length_m) AS length_m FROM g_run GROUP BY path_id) USING (path_id)""",
    _AREA,
    _CENTRE,
    _RUNS,
)
def m13(d):
    lap = paths.path_length(d.vertex, True).withColumnRenamed("length_m", "lap")
    straight = paths.longest_straight(d.vertex, 0.6, True).select(K, "length_m")
    first = paths.recentre(d.vertex).where("seq = 0")
    return lap.join(straight, K).join(first, K).select(
        K, q(C("lap"), 2).alias("lap_m"), q(C("length_m"), 2).alias("straight_m"), q(C("x"), 2).alias("first_x"), q(C("y"), 2).alias("first_y")
    )


BOX = (500.0, 5.0, 3500.0, 400.0)
_RUN6 = f"""g_in AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM (
    SELECT *, x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]} AS inside FROM g_track))"""


@query(
    "w06_clip",
    f"SELECT user_id, run, seq, {sq('x')} AS x, {sq('y')} AS y FROM g_in WHERE inside QUALIFY count(*) OVER (PARTITION BY user_id, run) >= 2",
    _RUN6,
)
def w06(d):
    return paths.clip_to_box(d.track, BOX, "user_id").select("user_id", "run", "seq", q(C("x")).alias("x"), q(C("y")).alias("y"))


@query(
    "w07_longest_hole",
    f"""SELECT user_id, {sq('greatest(longest, CASE WHEN islands > 0 AND tail > 0 THEN tail + head ELSE 0 END)')} AS hole FROM (
    SELECT user_id, max(run) AS longest, sum(CASE WHEN island = 0 THEN run ELSE 0 END) AS head, sum(CASE WHEN island = islands THEN run ELSE 0 END) AS tail, max(islands) AS islands FROM (
    SELECT user_id, island, sum(CASE WHEN off THEN 10.0::DOUBLE ELSE 0 END) AS run, max(islands) AS islands FROM (SELECT *, max(island) OVER (PARTITION BY user_id) AS islands FROM (
    SELECT user_id, seq, y > 30 AS off, sum(CASE WHEN y > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM g_track)) GROUP BY 1, 2) GROUP BY 1)""",
)
def w07(d):
    t = d.track.select("user_id", C("seq").alias("i"), C("y").alias("d"))
    n = F.count("*").over(Window.partitionBy("user_id"))
    t = t.withColumn("perimeter", 10.0 * n)
    return paths.off_street_run(t, ["user_id"], L(10.0), 30.0, C("perimeter")).select("user_id", q(C("max_hole_m")).alias("hole"))


@query(
    "w08_drop_repeats",
    """SELECT user_id, seq, cx, cy FROM (SELECT user_id, seq, cx, cy, lag(cx) OVER w AS px, lag(cy) OVER w AS py, row_number() OVER w AS n FROM (
    SELECT user_id, seq, CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM g_track) WINDOW w AS (PARTITION BY user_id ORDER BY seq))
    WHERE n = 1 OR px <> cx OR py <> cy""",
)
def w08(d):
    t = d.track.select("user_id", "seq", g.cell(C("x"), 2000.0).alias("cx"), g.cell(C("y"), 100.0).alias("cy"))
    return paths.drop_repeats(t, ["cx", "cy"], "user_id")


@query(
    "w12_neighbour_average",
    f"SELECT path_id, seq, {sq(f'(len + coalesce(lag(len) OVER w, last_value(len) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 2')} AS half FROM g_arc WINDOW w AS (PARTITION BY path_id ORDER BY seq)",
    _ARC,
)
def w12(d):
    w = Window.partitionBy(K).orderBy("seq")
    s = paths.directed(d.vertex, True)
    before = F.coalesce(F.lag("len").over(w), F.last("len").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select(K, "seq", q((C("len") + before) / 2).alias("half"))


@query(
    "w13_corner_joints",
    f"""SELECT a.path_id, a.seq, {sq('acos(least(1, greatest(-1, a.ux * b.ux + a.uy * b.uy)))', 5)} AS turn_rad FROM g_unit a JOIN g_unit b
    ON a.path_id = b.path_id AND b.seq = (a.seq + 31) % 32 WHERE acos(least(1, greatest(-1, a.ux * b.ux + a.uy * b.uy))) > 0.35""",
    f"g_unit AS (SELECT path_id, seq, (bx - ax) / {_LEN} AS ux, (by - ay) / {_LEN} AS uy FROM g_ring_segment)",
)
def w13(d):
    return paths.joints(d.vertex, True).where("turn_rad > 0.35").select(K, "seq", q(C("turn_rad"), 5).alias("turn_rad"))


_RES = f"""g_step AS (SELECT *, greatest(3, CAST(floor(total / 90 + 0.5) AS BIGINT)) AS n FROM g_arc),
    g_target AS (SELECT s.path_id, i, s.total / s.n * i AS target FROM (SELECT DISTINCT path_id, total, n FROM g_step) s, range(2000) r(i) WHERE i < s.n),
    g_res AS (SELECT t.path_id, t.i AS seq, s.ax + (s.bx - s.ax) * least(1, greatest(0, (t.target - (s.end_m - s.len)) / s.len)) AS x,
    s.ay + (s.by - s.ay) * least(1, greatest(0, (t.target - (s.end_m - s.len)) / s.len)) AS y FROM g_target t JOIN g_step s ON s.path_id = t.path_id
    AND (t.target > s.end_m - s.len OR s.seq = 0) AND (t.target <= s.end_m OR s.seq = 31))"""


@query("g09_resample", f"SELECT path_id, seq, {sq('x', 2)} AS x, {sq('y', 2)} AS y FROM g_res", _ARC, _RES)
def g09(d):
    return paths.resample(d.vertex, 90.0, True).select(K, "seq", q(C("x"), 2).alias("x"), q(C("y"), 2).alias("y"))


@query("g01_float_range", f"SELECT path_id, i AS n, {sq('x0 + 37.5 * i', 3)} AS v FROM (SELECT path_id, min(x) AS x0, max(x) AS x1 FROM g_vertex GROUP BY 1), range(200) r(i) WHERE x0 + 37.5 * i <= x1 + 1e-9")
def g01(d):
    b = paths.bounds(d.vertex).select(K, F.posexplode(matching.float_range(C("min_x"), C("max_x"), 37.5)).alias("n", "v"))
    return b.select(K, C("n").cast("long").alias("n"), q(C("v")).alias("v"))


def _grid_sql(step: float, turns: int, rad: str) -> str:
    return f"""SELECT i AS xi, j AS yi, k AS turn, {sq(f'x0 + {step} * i')} AS x, {sq(f'y0 + {step} * j')} AS y, {sq(f'k * {rad}', 6)} AS rotation FROM (
    SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g_vertex), range(2000) a(i), range(2000) b(j), range({turns}) c(k)
    WHERE x0 + {step} * i <= x1 + 1e-9 AND y0 + {step} * j <= y1 + 1e-9"""


def _grid(d, step: float, deg: float):
    b = paths.bounds(d.vertex, None)
    p = matching.pose_grid(b, step, deg, ["min_x", "min_y"])
    return p.select(
        g.half_up((C("x") - C("min_x")) / step).alias("xi"), g.half_up((C("y") - C("min_y")) / step).alias("yi"), C("turn").cast("long").alias("turn"),
        q(C("x")).alias("x"), q(C("y")).alias("y"), q(C("rotation"), 6).alias("rotation"),
    )


@query("g02_pose_grid", _grid_sql(250, 24, "pi() / 12"))
def g02(d):
    return _grid(d, 250.0, 15.0)


@query("g03_placement_grid", _grid_sql(300, 12, "pi() / 6"))
def g03(d):
    return _grid(d, 300.0, 30.0)


_STEPS = "greatest(1, CAST(floor({} / 5 + 0.5) AS BIGINT))".format(_LEN)


@query(
    "g11_segment_samples",
    f"SELECT path_id, seq, count(*) AS n, {sq('sum(ax + (bx - ax) * i / steps)', 1)} AS sum_x, {sq('max(ay + (by - ay) * i / steps)', 2)} AS max_y FROM (SELECT *, {_STEPS} AS steps FROM g_ring_segment), range(400) r(i) WHERE i <= steps GROUP BY 1, 2",
)
def g11(d):
    s = paths.sample_segments(d.ring_segment, 5.0, True, [K, "seq"])
    return s.groupBy(K, "seq").agg(F.count("*").alias("n"), q(F.sum("x"), 1).alias("sum_x"), q(F.max("y"), 2).alias("max_y"))


_SPANS = f"""g_round AS (SELECT path_id, seq, x, y FROM g_vertex UNION ALL SELECT path_id, 32, x, y FROM g_vertex WHERE seq = 0),
    g_far AS MATERIALIZED (SELECT a.path_id, a.seq AS i, b.seq AS j, arg_max(k.seq, {ssegdist('k.x', 'k.y', 'a.x', 'a.y', 'b.x', 'b.y')}) AS k, max({ssegdist('k.x', 'k.y', 'a.x', 'a.y', 'b.x', 'b.y')}) AS d
        FROM g_round a JOIN g_round b ON b.path_id = a.path_id AND b.seq > a.seq + 1 JOIN g_round k ON k.path_id = a.path_id AND k.seq > a.seq AND k.seq < b.seq GROUP BY 1, 2, 3),
    g_first AS (SELECT a.path_id, arg_max(k.seq, (k.x - a.x) * (k.x - a.x) + (k.y - a.y) * (k.y - a.y)) AS far FROM g_vertex a JOIN g_vertex k ON k.path_id = a.path_id AND k.seq > 0 WHERE a.seq = 0 GROUP BY 1),
    g_span AS (SELECT path_id, false AS ring, 0 AS i, 31 AS j FROM g_first UNION ALL SELECT path_id, true, 0, far FROM g_first UNION ALL SELECT path_id, true, far, 32 FROM g_first),
    g_split AS (SELECT path_id, ring, i, j FROM g_span UNION ALL SELECT s.path_id, s.ring, CASE WHEN h = 0 THEN s.i ELSE f.k END, CASE WHEN h = 0 THEN f.k ELSE s.j END
        FROM g_split s JOIN g_far f ON f.path_id = s.path_id AND f.i = s.i AND f.j = s.j AND f.d > 40, range(2) t(h)),
    g_stay AS (SELECT DISTINCT path_id, ring, seq FROM (SELECT path_id, ring, i AS seq FROM g_split UNION ALL SELECT path_id, ring, j FROM g_split))"""


@query(
    "g10_simplify",
    """SELECT v.path_id, v.seq, EXISTS (SELECT 1 FROM g_stay s WHERE s.path_id = v.path_id AND s.seq = v.seq AND NOT ring) AS open_kept,
    EXISTS (SELECT 1 FROM g_stay s WHERE s.path_id = v.path_id AND s.seq = v.seq AND ring) AS ring_kept FROM g_vertex v""",
    _SPANS,
    recursive=True,
)
def g10(d):
    """Douglas-Peucker of every outline at 40 m, open and closed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("seq")
        xy = f[["x", "y"]].to_numpy()
        f = f.assign(open_kept=kernels.simplify(xy, 40.0, False), ring_kept=kernels.simplify(xy, 40.0, True))
        return f[["path_id", "seq", "open_kept", "ring_kept"]]

    return d.vertex.groupBy(K).applyInPandas(run, "path_id long, seq long, open_kept boolean, ring_kept boolean")


# --- aggregates over distance joins ------------------------------------------

_STREET = "g_street AS (SELECT way, seq AS sseq, ax, ay, bx, by FROM g_segment)"


def shifted_rings(d):
    """Every outline, moved off its own street: (path_id, seq, ax, ay, bx, by)."""
    s = d.ring_segment
    return s.select(K, "seq", (C("ax") + 6).alias("ax"), (C("ay") - 4).alias("ay"), (C("bx") + 6).alias("bx"), (C("by") - 4).alias("by"))


_SHIFT = "g_shift AS (SELECT path_id, seq, ax + 6 AS ax, ay - 4 AS ay, bx + 6 AS bx, by - 4 AS by FROM g_ring_segment)"


def _samples_sql(sample: int, inclusive: bool) -> str:
    steps = f"greatest(1, CAST(floor({_LEN} / {sample} + 0.5) AS BIGINT))"
    return f"""g_sample AS (SELECT path_id, seq, i, ax + (bx - ax) * (i / steps) AS x, ay + (by - ay) * (i / steps) AS y, bx - ax AS hx, by - ay AS hy, {_LEN} AS len
    FROM (SELECT *, {steps} AS steps FROM g_shift), range(400) r(i) WHERE i {'<=' if inclusive else '<'} steps)"""


def _nearest_sql(max_m: float, cell: float = 50) -> str:
    """Distances to aligned segments; cells only keep the pairs few."""
    cut = "0.8191520442889918::DOUBLE"
    return f"""g_cellseg AS (SELECT way, sseq, ax, ay, bx, by, cx, cy FROM g_street, range(-20, 2000) a(cx), range(-20, 4000) b(cy)
    WHERE cx BETWEEN floor((least(ax, bx) - {max_m}) / {cell}) AND floor((greatest(ax, bx) + {max_m}) / {cell})
    AND cy BETWEEN floor((least(ay, by) - {max_m}) / {cell}) AND floor((greatest(ay, by) + {max_m}) / {cell})),
    g_near AS (SELECT p.path_id, p.seq, p.i, min({ssegdist('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')}) AS d FROM g_sample p JOIN g_cellseg s
    ON s.cx = floor(p.x / {cell}) AND s.cy = floor(p.y / {cell}) AND abs((s.bx - s.ax) * p.hx + (s.by - s.ay) * p.hy) >= {cut} * {sdist('s.ax', 's.ay', 's.bx', 's.by')} * sqrt(p.hx * p.hx + p.hy * p.hy)
    GROUP BY 1, 2, 3 HAVING min({ssegdist('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')}) < {max_m})"""


O = Proximity()


def aligned_samples(d, max_m: float, inclusive: bool, sample: float = O.sample_m):
    p = paths.sample_segments(shifted_rings(d), sample, inclusive, [K, "seq"])
    return spatial.nearest_segment(p, d.segment.withColumnRenamed("seq", "sseq"), [K, "seq", "i"], max_m, 50.0, align_rad=O.align_rad, tie=["way", "sseq"])


_COVER = f"""g_cover AS (SELECT p.path_id, p.seq, max(len) AS len, avg(CASE WHEN n.d < 10 THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM g_sample p LEFT JOIN g_near n USING (path_id, seq, i) GROUP BY 1, 2)"""


@query("a10_segment_coverage", f"SELECT path_id, seq, {sq('coverage', 4)} AS coverage FROM g_cover", _STREET, _SHIFT, _samples_sql(20, True), _nearest_sql(10), _COVER)
def a10(d):
    n = aligned_samples(d, O.near_m, True, 20.0)
    return n.groupBy(K, "seq").agg(q(F.avg((C("d") < O.near_m).cast("double")), 4).alias("coverage"))


@query("a11_lap_proximity", f"SELECT path_id, {sq('sum(coverage * len) / sum(len)', 4)} AS near_fraction FROM g_cover GROUP BY 1", _STREET, _SHIFT, _samples_sql(20, True), _nearest_sql(10), _COVER)
def a11(d):
    n = aligned_samples(d, O.near_m, True, 20.0)
    per = n.groupBy(K, "seq").agg(F.avg((C("d") < O.near_m).cast("double")).alias("coverage"), F.max(g.norm(C("hx"), C("hy"))).alias("len"))
    return per.groupBy(K).agg(q(F.sum(C("coverage") * C("len")) / F.sum("len"), 4).alias("near_fraction"))


@query(
    "a12_lap_deviation",
    f"SELECT path_id, {sq('avg(coalesce(n.d, 40))', 3)} AS mean_m, {sq('max(coalesce(n.d, 40))', 3)} AS max_m FROM g_sample p LEFT JOIN g_near n USING (path_id, seq, i) GROUP BY 1",
    _STREET, _SHIFT, _samples_sql(20, False), _nearest_sql(40),
)
def a12(d):
    n = aligned_samples(d, O.cap_m, False, 20.0)
    return n.groupBy(K).agg(q(F.avg("d"), 3).alias("mean_m"), q(F.max("d"), 3).alias("max_m"))


@query("a26_bucket_collect", f"SELECT bucket, count(*) AS n, string_agg(path_id || ':' || seq, ',' ORDER BY path_id, seq) AS members FROM (SELECT path_id, seq, CAST(least(7, floor(coverage * 8 + 1e-9)) AS BIGINT) AS bucket FROM g_cover) GROUP BY 1", _STREET, _SHIFT, _samples_sql(20, True), _nearest_sql(10), _COVER)
def a26(d):
    n = aligned_samples(d, O.near_m, True, 20.0)
    per = n.groupBy(K, "seq").agg(F.avg((C("d") < O.near_m).cast("double")).alias("coverage"))
    b = per.withColumn("bucket", F.least(L(7).cast("long"), F.floor(C("coverage") * 8 + 1e-9)))
    m = F.transform(F.array_sort(F.collect_list(F.struct(K, "seq"))), lambda s: F.concat_ws(":", s[K], s["seq"]))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.array_join(m, ",").alias("members"))


def neighbour_pairs(d):
    """Each outline as a route (its vertices, moved) against the next outline, moved onto the same tile."""
    centre = paths.centroid(d.vertex)
    n = d.table("embeddings").count()
    own = d.vertex.join(centre, K).select(K, "seq", (C("x") - C("cx")).alias("x"), (C("y") - C("cy")).alias("y"))
    ring = own.select(F.pmod(C(K) - 1, L(n)).alias(K), "seq", "x", "y")
    return own, ring


#: Paths whose distances make a batch of rows.
MEASURED = 256


def polyline_nearest(points, line, closed: bool):
    """(path_id, d): each point's distance to its own path's partner polyline.

    Both are lists, a row a path: with a row for each point and segment, the
    least of every point of a task would be held at once."""
    listed = lambda t, *names: t.groupBy(K).agg(F.collect_list(F.struct(*names)).alias(names[0]))
    pairs = listed(points, "x", "y").join(listed(paths.segments(line, closed), "ax", "ay", "bx", "by"), K)

    def run(batches):
        for batch in batches:
            sides = []
            for name in ("x", "ax"):
                lists = batch.column(name)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
                fields = lists.flatten()
                sides.append((ends, [fields.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(fields.type.num_fields)]))
            (pe, places), (se, sides) = sides
            for at in range(0, batch.num_rows, MEASURED):
                rows = range(at, min(at + MEASURED, batch.num_rows))
                d = [kernels.least_distances(*(v[pe[k] : pe[k + 1]] for v in places), *(v[se[k] : se[k + 1]] for v in sides)) for k in rows]
                own = batch.column(K).take(pa.array(np.repeat(np.array(rows), [len(part) for part in d])))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.concatenate(d), from_pandas=True)], names=[K, "d"])

    return pairs.mapInArrow(run, f"{K} long, d double")


_REC = """g_own AS (SELECT path_id, seq, x - cx AS x, y - cy AS y FROM g_vertex JOIN g_centre USING (path_id)),
    g_other AS (SELECT (path_id - 1 + n) % n AS path_id, seq, x, y FROM g_own, (SELECT count(*) AS n FROM embeddings))"""


def _res_sql(name: str, source: str, spacing: int, closed: bool) -> str:
    nxt = lambda c: (
        f"coalesce(lead({c}) OVER w, first_value({c}) OVER w)" if closed else f"lead({c}) OVER w"
    )
    last, low, den = (31, 3, "n") if closed else (30, 2, "(n - 1)")
    return f"""{name}_seg AS (SELECT * FROM (SELECT path_id, seq, x AS ax, y AS ay, {nxt('x')} AS bx, {nxt('y')} AS by FROM {source} WINDOW w AS (PARTITION BY path_id ORDER BY seq)) WHERE bx IS NOT NULL),
    {name}_arc AS (SELECT *, greatest({low}, CAST(floor(total / {spacing} + 0.5) AS BIGINT)) AS n FROM (SELECT *, {_LEN} AS len, sum({_LEN}) OVER (PARTITION BY path_id ORDER BY seq) AS end_m, sum({_LEN}) OVER (PARTITION BY path_id) AS total FROM {source}_seg_x)),
    {name}_pt AS (SELECT t.path_id, t.i, s.ax + (s.bx - s.ax) * least(1, greatest(0, (t.target - (s.end_m - s.len)) / s.len)) AS x, s.ay + (s.by - s.ay) * least(1, greatest(0, (t.target - (s.end_m - s.len)) / s.len)) AS y
    FROM (SELECT path_id, i, {'total / n * i' if closed else f'CASE WHEN i = n - 1 THEN total ELSE total / {den} * i END'} AS target FROM (SELECT DISTINCT path_id, total, n FROM {name}_arc), range(3000) r(i) WHERE i < n) t
    JOIN {name}_arc s ON s.path_id = t.path_id AND (t.target > s.end_m - s.len OR s.seq = 0) AND (t.target <= s.end_m OR s.seq = {last}))""".replace(f"{source}_seg_x", f"{name}_seg")


_DEV = f"""g_dev AS (SELECT p.path_id, p.i, 'a' AS side, min({ssegdist('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')}) AS d FROM g_rt_pt p JOIN g_rg_seg s USING (path_id) GROUP BY 1, 2
    UNION ALL SELECT p.path_id, p.i, 'b', min({ssegdist('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')}) FROM g_rg_pt p JOIN g_rt_seg s USING (path_id) GROUP BY 1, 2)"""
_DEV_CTES = (_AREA, _CENTRE, _REC, _res_sql("g_rt", "g_own", 40, False), _res_sql("g_rg", "g_other", 40, True), _DEV)


def deviations(d, spacing: float = 40.0):
    route, ring = neighbour_pairs(d)
    a = polyline_nearest(paths.resample(route, spacing, False), ring, True)
    b = polyline_nearest(paths.resample(ring, spacing, True), route, False)
    return a.unionByName(b)


@query("a08_route_deviation", f"SELECT path_id, {sq('avg(d)', 2)} AS mean_m, {sq('max(d)', 2)} AS max_m FROM g_dev GROUP BY 1", *_DEV_CTES)
def a08(d):
    return deviations(d).groupBy(K).agg(q(F.avg("d"), 2).alias("mean_m"), q(F.max("d"), 2).alias("max_m"))


@query(
    "a09_route_stats",
    f"""SELECT path_id, {sq('length_m', 2)} AS length_m, {sq('mean_m', 2)} AS mean_m, {sq('max_m', 2)} AS max_m FROM (SELECT path_id, avg(d) AS mean_m, max(d) AS max_m FROM g_dev GROUP BY 1)
    JOIN (SELECT path_id, sum({_LEN}) AS length_m FROM g_rt_seg GROUP BY 1) USING (path_id) WHERE length_m > 0""",
    *_DEV_CTES,
)
def a09(d):
    s = deviations(d).groupBy(K).agg(F.avg("d").alias("mean_m"), F.max("d").alias("max_m"))
    n = paths.path_length(d.vertex, False).where("length_m > 0")
    return s.join(n, K).select(K, q(C("length_m"), 2).alias("length_m"), q(C("mean_m"), 2).alias("mean_m"), q(C("max_m"), 2).alias("max_m"))


@query("a14_bounding_radius", f"SELECT path_id, {sq('max(sqrt(x * x + y * y))', 2)} AS radius FROM g_own GROUP BY 1", _AREA, _CENTRE, _REC)
def a14(d):
    return paths.recentre(d.vertex).groupBy(K).agg(q(F.max(g.norm(C("x"), C("y"))), 2).alias("radius"))


#: The table of couplings an anti-diagonal a step, as lists by row with a row outside before the first.
_FRECHET = """g_walked AS MATERIALIZED (SELECT path_id, list(x ORDER BY i) AS ax, list(y ORDER BY i) AS ay FROM g_rt_pt GROUP BY 1),
    g_ringed AS (SELECT path_id, list(x ORDER BY i) AS rx, list(y ORDER BY i) AS ry FROM g_rg_pt GROUP BY 1),
    g_begin AS (SELECT path_id, arg_min(p.i, ((p.x - ax[1]) * (p.x - ax[1]) + (p.y - ay[1]) * (p.y - ay[1]), p.i)) AS s FROM g_rg_pt p JOIN g_walked USING (path_id) GROUP BY 1),
    g_both AS MATERIALIZED (SELECT path_id, ax, ay, list_concat(rx[s + 1:], rx[:s]) AS bx, list_concat(ry[s + 1:], ry[:s]) AS by, len(ax) AS n, len(rx) AS m FROM g_walked JOIN g_ringed USING (path_id) JOIN g_begin USING (path_id)),
    g_table AS (SELECT path_id, CAST(-1 AS BIGINT) AS k, list_transform(range(n + 1), lambda r: 'inf'::DOUBLE) AS prior, list_transform(range(n + 1), lambda r: 'inf'::DOUBLE) AS now FROM g_both
        UNION ALL SELECT t.path_id, t.k + 1, t.now, list_transform(range(n + 1), lambda r: CASE WHEN r = 0 OR t.k + 2 - r < 0 OR t.k + 2 - r >= m THEN 'inf'::DOUBLE ELSE
        greatest(CASE WHEN t.k = -1 THEN 0 ELSE least(t.now[r], t.now[r + 1], t.prior[r]) END, sqrt((ax[r] - bx[t.k + 3 - r]) * (ax[r] - bx[t.k + 3 - r]) + (ay[r] - by[t.k + 3 - r]) * (ay[r] - by[t.k + 3 - r]))) END)
        FROM g_table t JOIN g_both b USING (path_id) WHERE t.k < n + m - 2)"""


#: Paths of a call of ``r05``.
FRECHET_PATHS = 256


@query(
    "r05_discrete_frechet",
    f"SELECT path_id, {sq('now[n + 1]', 2)} AS frechet_m FROM g_table JOIN g_both USING (path_id) WHERE k = n + m - 2",
    _AREA, _CENTRE, _REC, _res_sql("g_rt", "g_own", 20, False), _res_sql("g_rg", "g_other", 20, True), _FRECHET,
    recursive=True,
)
def r05(d):
    """Discrete Frechet distance of every outline, sampled, to the next one as a ring."""
    route, ring = neighbour_pairs(d)
    both = route.withColumn("side", L("a")).unionByName(ring.withColumn("side", L("b")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["path_id", "side", "seq"])
        lines = {k: p[["x", "y"]].to_numpy() for k, p in f.groupby(["path_id", "side"])}
        ids, none = f.path_id.unique(), np.zeros((0, 2))
        curves = [kernels.curves_to_ring(lines.get((k, "a"), none), lines.get((k, "b"), none), 20.0) for k in ids]
        return pd.DataFrame({"path_id": ids, "frechet_m": kernels.discrete_frechets(curves)})

    # Paths share a call: a coupling's steps cost about the same for many as for one.
    buckets = F.lit(max(1, -(-d.table("embeddings").count() // FRECHET_PATHS)))
    dealt = both.withColumn("__bucket", F.pmod(F.xxhash64(K), buckets)).groupBy("__bucket")
    return dealt.applyInPandas(run, "path_id long, frechet_m double").select(K, q(C("frechet_m"), 2).alias("frechet_m"))


_MERGE = f"""g_unit AS (SELECT path_id, seq, ax, ay, (bx - ax) / {_LEN} AS ux, (by - ay) / {_LEN} AS uy FROM g_ring_segment),
    g_bend AS (SELECT a.path_id, a.seq, a.ax AS x, a.ay AS y, acos(least(1, greatest(-1, a.ux * b.ux + a.uy * b.uy))) AS turn FROM g_unit a JOIN g_unit b ON a.path_id = b.path_id AND b.seq = (a.seq + 31) % 32),
    g_corner AS (SELECT path_id, 0 AS step, list({{'seq': seq, 'x': x, 'y': y, 'turn': turn}} ORDER BY seq) AS c FROM g_bend WHERE turn > 0.35 GROUP BY 1
        UNION ALL SELECT path_id, step + 1, list_concat(c[:loser - 1], c[loser + 1:]) FROM (SELECT path_id, step, c, CASE WHEN c[k].turn >= c[k % len(c) + 1].turn THEN k % len(c) + 1 ELSE k END AS loser FROM (
        SELECT path_id, step, c, list_position(gaps, list_min(gaps)) AS k FROM (SELECT path_id, step, c, list_transform(range(1, len(c) + 1), lambda i: sqrt((c[i % len(c) + 1].x - c[i].x) * (c[i % len(c) + 1].x - c[i].x)
        + (c[i % len(c) + 1].y - c[i].y) * (c[i % len(c) + 1].y - c[i].y))) AS gaps FROM g_corner WHERE len(c) > 1) WHERE list_min(gaps) < 60)))"""


@query(
    "t11_corners",
    f"SELECT path_id, u.seq AS corner, {sq('u.turn', 5)} AS turn_rad FROM (SELECT path_id, unnest(c) AS u FROM (SELECT * FROM g_corner QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY step DESC) = 1))",
    _MERGE,
    recursive=True,
)
def t11(d):
    """Significant corners of every outline, close ones merged."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("seq")
        found = kernels.corners(f[["x", "y"]].to_numpy(), 0.35, 60.0)
        return pd.DataFrame({"path_id": f.path_id.iloc[0], "corner": [i for i, _ in found], "turn_rad": [t for _, t in found]})

    return d.vertex.groupBy(K).applyInPandas(run, "path_id long, corner long, turn_rad double").select(K, "corner", q(C("turn_rad"), 5).alias("turn_rad"))


# --- joins -------------------------------------------------------------------

_POINTS = "g_probe AS (SELECT pid, x + 15 AS x, y - 10 AS y FROM g_point)"


def probes(d):
    return d.point.select("pid", (C("x") + 15).alias("x"), (C("y") - 10).alias("y"))


_PD = ssegdist("p.x", "p.y", "s.ax", "s.ay", "s.bx", "s.by")


@query(
    "j01_nearest_segment",
    f"""SELECT p.pid, {sq('coalesce(least(60, min(d)), 60)')} AS d, arg_min(way, (d, way, seq)) AS way, arg_min(seq, (d, way, seq)) AS seq
    FROM g_probe p LEFT JOIN (SELECT p.pid, s.way, s.seq, {_PD} AS d FROM g_probe p JOIN g_segment s ON {_PD} < 60) USING (pid) GROUP BY p.pid""",
    _POINTS,
)
def j01(d):
    n = spatial.nearest_segment(probes(d), d.segment, ["pid"], 60.0, tie=["way", "seq"], keep=["way", "seq"])
    return n.select("pid", q(C("d")).alias("d"), "way", "seq")


_ALIGN = "abs((s.bx - s.ax) * p.hx + (s.by - s.ay) * p.hy) >= 0.8191520442889918::DOUBLE * {} * sqrt(p.hx * p.hx + p.hy * p.hy) AND {} > 0".format(
    sdist("s.ax", "s.ay", "s.bx", "s.by"), sdist("s.ax", "s.ay", "s.bx", "s.by")
)


@query(
    "j02_nearest_aligned",
    f"""SELECT p.pid, {sq('coalesce(min(d), 60)')} AS d FROM g_aim p LEFT JOIN (SELECT p.pid, {_PD} AS d FROM g_aim p JOIN g_segment s
    ON {_PD} < 60 AND ((p.hx = 0 AND p.hy = 0) OR ({_ALIGN}))) USING (pid) GROUP BY p.pid""",
    _POINTS,
    "g_aim AS (SELECT *, CAST(pid % 3 AS DOUBLE) AS hx, CAST(pid % 4 AS DOUBLE) AS hy FROM g_probe)",
)
def j02(d):
    p = probes(d).withColumns({"hx": (C("pid") % 3).cast("double"), "hy": (C("pid") % 4).cast("double")})
    return spatial.nearest_segment(p, d.segment, ["pid"], 60.0, align_rad=O.align_rad, tie=["way", "seq"]).select("pid", q(C("d")).alias("d"))


_NODED = sdist("p.x", "p.y", "v.x", "v.y")


@query(
    "j03_nearest_node",
    f"""SELECT pid, path_id, seq, {sq('d')} AS d FROM (SELECT p.pid, v.path_id, v.seq, {_NODED} AS d FROM g_probe p JOIN g_vertex v ON {_NODED} <= 80)
    QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, path_id, seq) = 1""",
    _POINTS,
)
def j03(d):
    v = d.vertex.select(K, "seq", C("x").alias("px"), C("y").alias("py"))
    n = spatial.near_points(probes(d), v, 80.0, 50.0)
    b = n.groupBy("pid").agg(F.min_by(F.struct(K, "seq", "d"), F.struct("d", K, "seq")).alias("b"))
    return b.select("pid", f"b.{K}", "b.seq", q(C("b.d")).alias("d"))


@query(
    "j06_expanding_search",
    f"""SELECT p.pid, CASE WHEN min({_PD}) <= 50 THEN 50 WHEN min({_PD}) <= 200 THEN 200 END AS radius, CASE WHEN min({_PD}) <= 200 THEN {sq(f'min({_PD})')} END AS d
    FROM (SELECT pid, x + 150 * (pid % 3) AS x, y - 120 * (pid % 4) AS y FROM g_probe) p, g_segment s GROUP BY 1""",
    _POINTS,
)
def j06(d):
    """Nearest segment within growing radii; only points without a hit go on."""
    p = probes(d).select("pid", (C("x") + 150 * (C("pid") % 3)).alias("x"), (C("y") - 120 * (C("pid") % 4)).alias("y"))
    out, left = None, p
    for radius in (50.0, 200.0):
        near = spatial.near_segments(left, d.segment, radius, strict=False).groupBy("pid").agg(F.min("d").alias("d"))
        found = near.select("pid", L(int(radius)).alias("radius"), q(C("d")).alias("d"))
        out = found if out is None else out.unionByName(found)
        left = left.join(near, "pid", "left_anti")
    return out.unionByName(left.select("pid", L(None).cast("int").alias("radius"), L(None).cast("double").alias("d")))


@query(
    "j07_merge_endpoints",
    f"""SELECT ep, min(r) AS cluster FROM g_reach GROUP BY 1""",
    """g_end AS (SELECT path_id * 2 + CASE WHEN seq = 0 THEN 0 ELSE 1 END AS ep, x, y FROM g_vertex WHERE seq IN (0, 31))""",
    f"""g_link AS (SELECT a.ep AS a, b.ep AS b FROM g_end a JOIN g_end b ON {sdist('a.x', 'a.y', 'b.x', 'b.y')} <= 60)""",
    "g_reach AS (SELECT ep, ep AS r FROM g_end UNION SELECT g_reach.ep, g_link.b FROM g_reach JOIN g_link ON g_link.a = g_reach.r)",
    recursive=True,
)
def j07(d):
    from ..operators import graph

    return graph.merge_endpoints(graph.endpoints(d.vertex), 60.0)


@query(
    "j08_junctions",
    f"""SELECT ep, way, seg, {sq('d')} AS d FROM (SELECT p.ep, s.way, s.seq + 1 AS seg, {_PD} AS d FROM (SELECT path_id * 2 + CASE WHEN seq = 0 THEN 0 ELSE 1 END AS ep, path_id, x, y FROM g_vertex WHERE seq IN (0, 31)) p
    JOIN g_segment s ON s.way <> p.path_id AND {_PD} <= 12) QUALIFY row_number() OVER (PARTITION BY ep ORDER BY d, way, seg) = 1""",
)
def j08(d):
    from ..operators import graph

    segs = d.segment.select("way", (C("seq") + 1).alias("seg"), "ax", "ay", "bx", "by")
    ends = graph.endpoints(d.vertex).withColumnRenamed("way", "own")
    n = spatial.near_segments(ends, segs, 12.0, strict=False).where("way <> own")
    b = n.groupBy("ep").agg(F.min_by(F.struct("way", "seg", "d"), F.struct("d", "way", "seg")).alias("b"))
    return b.select("ep", "b.way", "b.seg", q(C("b.d")).alias("d"))


_FEET9 = ", ".join(
    [
        ssegdist("a.ax", "a.ay", "b.ax", "b.ay", "b.bx", "b.by"),
        ssegdist("a.bx", "a.by", "b.ax", "b.ay", "b.bx", "b.by"),
        ssegdist("b.ax", "b.ay", "a.ax", "a.ay", "a.bx", "a.by"),
        ssegdist("b.bx", "b.by", "a.ax", "a.ay", "a.bx", "a.by"),
    ]
)
_D9 = "((a.bx - a.ax) * (b.by - b.ay) - (a.by - a.ay) * (b.bx - b.ax))"
_T9 = f"(((b.ax - a.ax) * (b.by - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / nullif({_D9}, 0))"
_U9 = f"(((b.ax - a.ax) * (a.by - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / nullif({_D9}, 0))"
_PAIRS9 = f"""g_pairs AS (SELECT a.way AS way_a, b.way AS way_b, a.seq + 1 AS seg_a, b.seq + 1 AS seg_b,
    CASE WHEN coalesce({_T9} BETWEEN 0 AND 1 AND {_U9} BETWEEN 0 AND 1, false) THEN 0.0::DOUBLE ELSE least({_FEET9}) END AS d
    FROM g_segment a JOIN g_segment b ON a.way < b.way AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) + 6 AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) + 6
    AND least(a.ay, a.by) <= greatest(b.ay, b.by) + 6 AND least(b.ay, b.by) <= greatest(a.ay, a.by) + 6)"""


@query(
    "j09_corridor_pairs",
    f"SELECT way_a, way_b, seg_a, seg_b, {sq('d')} AS d FROM g_pairs WHERE d <= 6 QUALIFY row_number() OVER (PARTITION BY way_a, way_b ORDER BY d, seg_a, seg_b) = 1",
    _PAIRS9,
)
def j09(d):
    from ..operators import graph

    segs = d.segment.select("way", (C("seq") + 1).alias("seg"), "ax", "ay", "bx", "by")
    a = graph.corridor_approaches(segs, 6.0)
    return a.select("way_a", "way_b", "seg_a", "seg_b", q(C("near.d")).alias("d"))


@query("a25_best_way_pair", "SELECT way_a, count(*) AS partners, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS crossings FROM (SELECT way_a, way_b, min(d) AS d FROM g_pairs WHERE d <= 6 GROUP BY 1, 2) GROUP BY 1", _PAIRS9)
def a25(d):
    pairs = spatial.near_segment_pairs(d.segment, 6.0, ["way", "seq"], C("a_way") != C("b_way"))
    best = pairs.groupBy("a_way", "b_way").agg(F.min("near.d").alias("d"))
    return best.groupBy(C("a_way").alias("way_a")).agg(F.count("*").alias("partners"), F.sum((C("d") == 0).cast("long")).alias("crossings"))


@query(
    "j14_nearest_vertex",
    f"""SELECT path_id, seq, {sq('d', 2)} AS d FROM (SELECT o.path_id, r.seq, {sdist('o.x', 'o.y', 'r.x', 'r.y')} AS d FROM g_own o JOIN g_other r USING (path_id) WHERE o.seq = 0)
    QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY d, seq) = 1""",
    _AREA, _CENTRE, _REC,
)
def j14(d):
    own, ring = neighbour_pairs(d)
    p = own.where("seq = 0").select(K, C("x").alias("ox"), C("y").alias("oy"))
    j = ring.join(p, K).withColumn("d", g.distance(C("ox"), C("oy"), C("x"), C("y")))
    b = j.groupBy(K).agg(F.min_by(F.struct("seq", "d"), F.struct("d", "seq")).alias("b"))
    return b.select(K, "b.seq", q(C("b.d"), 2).alias("d"))


@query(
    "j15_nearest_on_polyline",
    f"SELECT o.path_id, o.seq, {sq('min(' + ssegdist('o.x', 'o.y', 's.ax', 's.ay', 's.bx', 's.by') + ')', 2)} AS d FROM g_own o JOIN g_rg_seg s USING (path_id) GROUP BY 1, 2",
    *_DEV_CTES,
)
def j15(d):
    own, ring = neighbour_pairs(d)
    j = own.join(paths.segments(ring, True).select(K, "ax", "ay", "bx", "by"), K)
    return j.groupBy(K, "seq").agg(q(F.min(g.segment_distance(C("x"), C("y"), C("ax"), C("ay"), C("bx"), C("by"))), 2).alias("d"))


@query("j16_hausdorff", f"SELECT path_id, {sq('max(CASE WHEN side = ' + chr(39) + 'a' + chr(39) + ' THEN d END)', 2)} AS there, {sq('max(CASE WHEN side = ' + chr(39) + 'b' + chr(39) + ' THEN d END)', 2)} AS back FROM g_dev GROUP BY 1", *_DEV_CTES)
def j16(d):
    route, ring = neighbour_pairs(d)
    a = polyline_nearest(paths.resample(route, 40.0, False), ring, True).groupBy(K).agg(q(F.max("d"), 2).alias("there"))
    b = polyline_nearest(paths.resample(ring, 40.0, True), route, False).groupBy(K).agg(q(F.max("d"), 2).alias("back"))
    return a.join(b, K)


@query("j19_pose_samples", f"SELECT path_id, k, {sq('sum(x * cos(k * pi() / 6) - y * sin(k * pi() / 6))', 1)} AS sum_x, count(*) AS n FROM g_own, range(12) t(k) GROUP BY 1, 2", _AREA, _CENTRE, _REC)
def j19(d):
    import math

    turns = d.spark.range(12).withColumnRenamed("id", "k")
    p = paths.recentre(d.vertex).join(F.broadcast(turns)).withColumn("r", g.rotate(C("x"), C("y"), C("k") * (math.pi / 6)))
    return p.groupBy(K, "k").agg(q(F.sum("r.x"), 1).alias("sum_x"), F.count("*").alias("n"))


@query(
    "j22_segment_cells",
    """SELECT way, seq, (floor(greatest(ax, bx) / 50) - floor(least(ax, bx) / 50) + 1) * (floor(greatest(ay, by) / 50) - floor(least(ay, by) / 50) + 1) AS cells,
    floor(least(ax, bx) / 50) AS first_cx, floor(greatest(ay, by) / 50) AS last_cy FROM g_segment""",
)
def j22(d):
    s = spatial.segment_cells(d.segment, 50.0)
    return s.groupBy("way", "seq").agg(
        F.count("*").cast("double").alias("cells"), F.min("__cx").cast("double").alias("first_cx"), F.max("__cy").cast("double").alias("last_cy")
    )


@query("f11_heading_aligned", f"SELECT way, seq, abs((bx - ax) * 3 + (by - ay) * 4) >= 0.8191520442889918::DOUBLE * {_LEN} * 5 AND {_LEN} > 0 AS ok FROM g_segment")
def f11(d):
    return d.segment.select("way", "seq", g.aligned(C("bx") - C("ax"), C("by") - C("ay"), L(3.0), L(4.0), O.align_rad).alias("ok"))


_STRAIGHTS = _RUNS.replace("g_ring_segment", "(SELECT way AS path_id, seq, ax, ay, bx, by FROM g_segment)").replace(
    "FROM g_unit a JOIN g_unit b ON a.path_id = b.path_id AND b.seq = (a.seq + 31) % 32", "FROM g_unit a LEFT JOIN g_unit b ON a.path_id = b.path_id AND b.seq = a.seq - 1"
).replace("> 0.6", "> 0.12").replace("(seq + 32 - coalesce(f, 0)) % 32", "seq")


@query(
    "f12_matching_straights",
    f"""SELECT path_id, {sq('length_m')} AS length_m, {sq('atan2(y1 - y0, x1 - x0)', 5)} AS bearing FROM (SELECT * FROM g_run
    QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY floor(length_m * 1e8 + 0.5) DESC, s) = 1) WHERE length_m BETWEEN 180 AND 480""",
    _STRAIGHTS,
)
def f12(d):
    s = matching.matching_straights(d.vertex, 300.0)
    return s.select(K, q(C("length_m")).alias("length_m"), q(C("bearing"), 5).alias("bearing"))


__all__ = ["connected_components", "shalf"]
