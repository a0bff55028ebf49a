"""A13, A24, T02-T04, T12, T15, G12, U01, F13: placements scored and chosen."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import matching, paths
from ..params import SearchOptions
from ..sources.derived import lattice_x, lattice_y
from .geometry import _AREA, _CENTRE, _REC
from .registry import q, query, sclose, sgreedy, sq

C, L = F.col, F.lit
K = "path_id"


@query(
    "t15_sample_indices",
    "SELECT path_id, s, seq FROM (SELECT path_id, s, CAST(floor(s * 32 / 20.0::DOUBLE) AS BIGINT) AS seq FROM (SELECT DISTINCT path_id FROM g_vertex), range(20) t(s))",
)
def t15(d):
    return matching.sample_ring(d.vertex, 20).select(K, "s", "seq")


def own_poses(d):
    """Six poses of each outline about its own street: it lies on the street at pose 0."""
    c = paths.centroid(d.vertex)
    p = c.withColumn("pose", F.explode(F.sequence(L(0).cast("long"), L(5).cast("long"))))
    return p.select(K, "pose", (C("cx") + 3 * C("pose")).alias("x"), (C("cy") - 2 * C("pose")).alias("y"), (C("pose") * 0.05).alias("rotation"))


def scored(d):
    s = matching.score_poses(own_poses(d), paths.recentre(d.vertex), d.segment, 20, o=SearchOptions(min_coverage=0.2))
    return own_poses(d).join(s, [K, "pose"])


_HALF = "0.8191520442889918::DOUBLE"
_SCORE = f"""g_base AS (SELECT o.path_id, s, o.seq, o.x, o.y, b.x - c.x AS hx, b.y - c.y AS hy FROM g_own o JOIN range(20) t(s) ON o.seq = CAST(floor(s * 32 / 20.0::DOUBLE) AS BIGINT)
    JOIN g_own b ON b.path_id = o.path_id AND b.seq = (o.seq + 2) % 32 JOIN g_own c ON c.path_id = o.path_id AND c.seq = (o.seq + 30) % 32),
    g_pose AS (SELECT path_id, pose, cx + 3 * pose AS tx, cy - 2 * pose AS ty, pose * 0.05::DOUBLE AS rot FROM g_centre, range(6) p(pose)),
    g_placed AS (SELECT path_id, pose, s, b.x AS bx0, b.y AS by0, b.x * cos(rot) - b.y * sin(rot) + tx AS x, b.x * sin(rot) + b.y * cos(rot) + ty AS y,
    hx * cos(rot) - hy * sin(rot) AS hx, hx * sin(rot) + hy * cos(rot) AS hy FROM g_base b JOIN g_pose USING (path_id)),
    g_rub AS (SELECT p.path_id, p.pose, p.s, p.x, p.y, s.ax, s.ay, s.bx - s.ax AS dx, s.by - s.ay AS dy, greatest(0, least(1, ((p.x - s.ax) * (s.bx - s.ax) + (p.y - s.ay) * (s.by - s.ay)) / ((s.bx - s.ax) * (s.bx - s.ax) + (s.by - s.ay) * (s.by - s.ay)))) AS t
    FROM g_placed p JOIN g_segment s ON least(s.ax, s.bx) <= p.x + 40 AND greatest(s.ax, s.bx) >= p.x - 40 AND least(s.ay, s.by) <= p.y + 40 AND greatest(s.ay, s.by) >= p.y - 40
    AND abs((s.bx - s.ax) * p.hx + (s.by - s.ay) * p.hy) >= {_HALF} * sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.by - s.ay) * (s.by - s.ay)) * sqrt(p.hx * p.hx + p.hy * p.hy)),
    g_foot AS (SELECT path_id, pose, s, min(d) AS d FROM (SELECT *, sqrt((ax + t * dx - x) * (ax + t * dx - x) + (ay + t * dy - y) * (ay + t * dy - y)) AS d FROM g_rub) WHERE d < 40 GROUP BY 1, 2, 3),
    g_cover AS (SELECT p.path_id, p.pose, avg(CASE WHEN d < 10 THEN 1.0::DOUBLE ELSE 0 END) AS coverage, avg(coalesce(d, 40)) AS mean_m, max(coalesce(d, 40)) AS max_m FROM g_placed p LEFT JOIN g_foot USING (path_id, pose, s) GROUP BY 1, 2)"""


@query(
    "a13_pose_coverage",
    f"SELECT path_id, pose, {sq('coverage', 4)} AS coverage, {sq('mean_m', 3)} AS mean_m, {sq('max_m', 3)} AS max_m FROM g_cover",
    _AREA, _CENTRE, _REC, _SCORE,
)
def a13_coverage(d):
    return scored(d).select(K, "pose", q(C("coverage"), 4).alias("coverage"), q(C("mean_m"), 3).alias("mean_m"), q(C("max_m"), 3).alias("max_m"))


@query("f13_min_coverage", "SELECT path_id, count(*) AS poses FROM g_cover WHERE coverage >= 0.4 GROUP BY 1", _AREA, _CENTRE, _REC, _SCORE)
def f13(d):
    return scored(d).where("coverage >= 0.4").groupBy(K).agg(F.count("*").alias("poses"))


#: The nearest aligned place of every sample, and the misfit of these places to the outline.
_SHAPE = f"""g_snap AS (SELECT p.path_id, p.pose, p.s, p.bx0, p.by0, p.x, p.y, coalesce(f.fx, p.x) AS sx, coalesce(f.fy, p.y) AS sy FROM g_placed p LEFT JOIN (
        SELECT path_id, pose, s, arg_min(fx, (d, ax, ay)) AS fx, arg_min(fy, (d, ax, ay)) AS fy FROM (SELECT *, ax + t * dx AS fx, ay + t * dy AS fy, sqrt((ax + t * dx - x) * (ax + t * dx - x) + (ay + t * dy - y) * (ay + t * dy - y)) AS d FROM g_rub)
        WHERE d < 40 GROUP BY 1, 2, 3) f USING (path_id, pose, s) JOIN g_cover c ON c.path_id = p.path_id AND c.pose = p.pose AND c.coverage >= 0.2),
    g_misfit AS (SELECT path_id, pose, sqrt(greatest(0, tt - (a * a + b * b) / ff) / n) AS residual FROM (SELECT path_id, pose, count(*) AS n, (covar_pop(sx, bx0) + covar_pop(sy, by0)) * count(*) AS a, (covar_pop(sx, by0) - covar_pop(sy, bx0)) * count(*) AS b,
        (var_pop(sx) + var_pop(sy)) * count(*) AS ff, (var_pop(bx0) + var_pop(by0)) * count(*) AS tt FROM g_snap GROUP BY 1, 2))"""


@query(
    "a13_snap_misfit",
    f"SELECT path_id, pose, {sq('residual', 2)} AS residual FROM g_misfit",
    _AREA, _CENTRE, _REC, _SCORE, _SHAPE,
)
def a13_misfit(d):
    """How far the snapped outlines are from the outline's own shape."""
    return scored(d).where("residual is not null").select(K, "pose", q(C("residual"), 2).alias("residual"))


@query("a13_candidate_score")
def a13(d):
    """The whole score of each pose. Where a snapped outline turns back on
    itself the sign of the half turn is a matter of rounding, so there is no
    SQL for the turning; tests hold it and the score against a plain version."""
    return scored(d).select(K, "pose", q(C("coverage"), 4).alias("coverage"), q(C("turning"), 4).alias("turning"), q(C("residual"), 2).alias("residual"), q(C("score"), 4).alias("score"))


_CANDIDATE = "g_cand AS (SELECT way AS pose, seq, ax AS x, ay AS y, (way * 7919 + seq * 104729) % 1000 AS score FROM g_segment)"
_MACRO = "g_macro AS (SELECT * FROM g_cand QUALIFY row_number() OVER (PARTITION BY CAST(floor(x / 2000) AS BIGINT), CAST(floor(y / 2000) AS BIGINT) ORDER BY score DESC, pose * 100 + seq) = 1)"


def candidates(d):
    s = d.segment
    return s.select(
        L(0).alias("search"), (C("way") * 100 + C("seq")).alias("pose"), C("ax").alias("x"), C("ay").alias("y"), ((C("way") * 7919 + C("seq") * 104729) % 1000).alias("score"), L(0.0).alias("rotation")
    )


@query("a24_macro_winners", f"SELECT pose * 100 + seq AS pose, {sq('x')} AS x, {sq('y')} AS y, score FROM g_macro", _CANDIDATE, _MACRO)
def a24(d):
    return matching.macro_winners(candidates(d), 2000.0, 1 << 30, "search").select("pose", q(C("x")).alias("x"), q(C("y")).alias("y"), "score")


@query("t02_top_winners", "SELECT pose * 100 + seq AS pose, score, row_number() OVER (ORDER BY score DESC, pose * 100 + seq) AS rank FROM g_macro ORDER BY score DESC, pose * 100 + seq LIMIT 16", _CANDIDATE, _MACRO)
def t02(d):
    return matching.macro_winners(candidates(d), 2000.0, 16, "search").select("pose", "score", "rank")


def macro_cells(d):
    """Candidates grouped by macro cell, best first."""
    c = candidates(d).select("pose", "x", "y", "score", "rotation", F.concat_ws(",", g.cell(C("x"), 2000.0), g.cell(C("y"), 2000.0)).alias("cell"))
    return c.withColumn("lost", -C("score"))


_CELLS = """g_line AS MATERIALIZED (SELECT CAST(floor(x / 2000) AS BIGINT) || ',' || CAST(floor(y / 2000) AS BIGINT) AS g, pose * 100 + seq AS pose, x, y, 0.0::DOUBLE AS r, score,
    row_number() OVER (PARTITION BY CAST(floor(x / 2000) AS BIGINT), CAST(floor(y / 2000) AS BIGINT) ORDER BY score DESC, pose * 100 + seq) AS rn FROM g_cand)"""
_CHOSEN = "SELECT g AS cell, pose, CAST(rank AS INTEGER) AS rank, score FROM g_line_kept JOIN g_line USING (g, rn)"


@query("t03_dedup", _CHOSEN, _CANDIDATE, _CELLS, sgreedy("g_line", sclose(200.0, 12.0)), recursive=True)
def t03(d):
    """Candidates of each macro cell without those within 200 m of a better one; tests hold it against a plain loop."""
    return matching.dedup_poses(macro_cells(d), "cell", ["lost", "pose"], 200.0, 12.0).select("cell", "pose", "rank", "score")


@query("t04_diversity", _CHOSEN, _CANDIDATE, _CELLS, sgreedy("g_line", sclose(800.0), spread=5), recursive=True)
def t04(d):
    """Five candidates of each macro cell, 800 m apart first."""
    return matching.diverse_poses(macro_cells(d), "cell", ["lost", "pose"], 800.0, 5).select("cell", "pose", "rank", "score")


@query("u01_seed_and_grid", f"""SELECT origin, count(*) AS n, {sq('sum(x)', 1)} AS sum_x FROM (SELECT 'seed' AS origin, (ax + bx) / 2 AS x FROM g_segment, range(2) UNION ALL
    SELECT 'grid', x0 + 300 * i FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g_vertex), range(2000) a(i), range(2000) b(j), range(12) c(k) WHERE x0 + 300 * i <= x1 + 1e-9 AND y0 + 300 * j <= y1 + 1e-9) GROUP BY 1""")
def u01(d):
    s = matching.seed_poses(d.segment.withColumn("bearing", g.bearing(C("ax"), C("ay"), C("bx"), C("by"))), (-50.0, 0.0), (50.0, 0.0))
    p = matching.pose_grid(paths.bounds(d.vertex, None), 300.0, 30.0, [])
    both = s.select(L("seed").alias("origin"), "x").unionByName(p.select(L("grid").alias("origin"), "x"))
    return both.groupBy("origin").agg(F.count("*").alias("n"), q(F.sum("x"), 1).alias("sum_x"))


@query("t12_refine_offsets", f"""SELECT path_id, count(*) AS n, {sq('sum(cx + dx)', 1)} AS sum_x, {sq('max(dr)', 6)} AS max_turn FROM g_centre, (SELECT -180 + 90 * i AS dx, (-18 + 9 * k) * pi() / 180 AS dr FROM range(5) a(i), range(5) b(j), range(5) c(k)
    UNION ALL SELECT 0, 0) GROUP BY 1""", _AREA, _CENTRE)
def t12_offsets(d):
    p = paths.centroid(d.vertex).select(K, C("cx").alias("x"), C("cy").alias("y"), L(0.0).alias("rotation"))
    return matching.refinements(p).groupBy(K).agg(F.count("*").alias("n"), q(F.sum("x"), 1).alias("sum_x"), q(F.max("rotation"), 6).alias("max_turn"))


@query("t12_local_refine")
def t12(d):
    """The best of the 126 neighbours of each outline's own place."""
    o = SearchOptions(min_coverage=0.2)
    start = paths.centroid(d.vertex).select(K, L(0).alias("pose"), (C("cx") + 15).alias("x"), (C("cy") - 10).alias("y"), L(0.0).alias("rotation"))
    best = matching.refine_poses(start, paths.recentre(d.vertex), d.segment, o.samples[1], o=o)
    return best.select(K, "step", q(C("score"), 4).alias("score"), q(C("coverage"), 4).alias("coverage"))


@query("g12_search_placements")
def g12(d):
    """The search end to end for one outline: a block on the lattice's streets."""
    from .network import block_ring

    ends = lambda k, s: [lattice_x(k).alias(f"{s}x"), lattice_y(k).alias(f"{s}y")]
    segs = d.lattice.select(C("a").alias("way"), *ends("a", "a"), *ends("b", "b"))
    bounds = segs.agg(F.min("ax").alias("min_x"), F.min("ay").alias("min_y"), F.max("bx").alias("max_x"), F.max("by").alias("max_y"))
    o = SearchOptions(grid_m=100.0, grid_deg=90.0, macro_m=300.0, diversity_m=250.0, refine_m=(20.0, 20.0), refine_deg=(5.0, 5.0), samples=(20, 40))
    s = matching.search_placements(block_ring(d), segs, bounds, 1.0, o)
    return s.select("rank", q(C("x"), 1).alias("x"), q(C("y"), 1).alias("y"), q(C("rotation"), 4).alias("rotation"), q(C("coverage"), 3).alias("coverage"), q(C("score"), 3).alias("score"))


WINDOW = Window
