"""R, A15-A22, J04-J18 and W10-W11: the street graph and rasters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph, kernels, paths, raster, spatial
from ..operators.components import connected_components, cut_lineage
from ..params import GraphOptions, LadderOptions, MatchOptions, PoseOptions, PruneOptions, RasterOptions
from ..plans import generate
from ..sources.derived import REGION_M, lattice_x, lattice_y, slattice
from .geometry import _AREA, _CENTRE, _LEN, _REC
from .registry import q, query, sclose, sdist, sgreedy, sproj, sq, ssegdist

C, L = F.col, F.lit

_REACH = "g_reach AS (SELECT id AS node, id AS r FROM g_node UNION SELECT g_reach.node, g_edge.b FROM g_reach JOIN g_edge ON g_edge.a = g_reach.r)"
_COMP = "g_comp AS (SELECT node, min(r) AS component FROM g_reach GROUP BY 1)"


@query("r01_components", "SELECT node, component FROM g_comp", _REACH, _COMP, recursive=True)
def r01(d):
    return connected_components(d.lattice.select("a", "b"))


@query("a19_component_lengths", "SELECT component, sum(len) AS length_m FROM g_lattice JOIN g_comp ON node = a GROUP BY 1", _REACH, _COMP, recursive=True)
def a19(d):
    c = connected_components(d.lattice.select("a", "b"))
    return d.lattice.join(c, C("a") == C("node")).groupBy("component").agg(F.sum("len").alias("length_m"))


@query("a20_main_component", "SELECT component, count(*) AS nodes FROM g_comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", _REACH, _COMP, recursive=True)
def a20(d):
    return graph.main_component(connected_components(d.lattice.select("a", "b")))


@query(
    "a21_cluster_position",
    f"SELECT cluster, {sq('avg(x)')} AS x, {sq('avg(y)')} AS y, count(*) AS n FROM g_end JOIN (SELECT ep, min(r) AS cluster FROM g_hang GROUP BY 1) USING (ep) GROUP BY 1",
    "g_end AS (SELECT path_id * 2 + CASE WHEN seq = 0 THEN 0 ELSE 1 END AS ep, x, y FROM g_vertex WHERE seq IN (0, 31))",
    f"g_link AS (SELECT a.ep AS a, b.ep AS b FROM g_end a JOIN g_end b ON {sdist('a.x', 'a.y', 'b.x', 'b.y')} <= 60)",
    "g_hang AS (SELECT ep, ep AS r FROM g_end UNION SELECT g_hang.ep, g_link.b FROM g_hang JOIN g_link ON g_link.a = g_hang.r)",
    recursive=True,
)
def a21(d):
    ends = graph.endpoints(d.vertex)
    m = ends.join(graph.merge_endpoints(ends, 60.0), "ep")
    return m.groupBy("cluster").agg(q(F.avg("x")).alias("x"), q(F.avg("y")).alias("y"), F.count("*").alias("n"))


@query("a22_node_degree", "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM g_lattice UNION ALL SELECT b FROM g_lattice) GROUP BY 1")
def a22(d):
    return d.lattice.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def lattice_graph(d):
    """(nodes, edges) of the lattice in the shape that the graph operators take."""
    n = d.lattice_nodes.select(C("id").cast("string").alias("node"), "x", "y")
    at = lambda k: F.array(lattice_x(k), lattice_y(k))
    e = d.lattice.select(
        F.concat_ws("-", "a", "b").alias("edge"), C("a").cast("string").alias("a"), C("b").cast("string").alias("b"), C("len").alias("length_m"), F.array(at("a"), at("b")).alias("points")
    )
    c = cut_lineage(connected_components(d.lattice.select("a", "b")))
    c = c.select(C("node").cast("string").alias("node"), C("component").cast("string").alias("component"))
    return n.join(c, "node"), e


_WALK = """g_walk AS (SELECT id AS s, id AS t, 0 AS hops FROM g_node UNION SELECT s, g_edge.b, hops + 1 FROM g_walk JOIN g_edge ON g_edge.a = g_walk.t WHERE hops < 40),
    g_dist AS (SELECT s, t, min(hops) * 100.0::DOUBLE AS len FROM g_walk GROUP BY 1, 2)"""


@query(
    "r03_shortest_paths",
    "SELECT CAST(x.id AS VARCHAR) AS a, CAST(y.id AS VARCHAR) AS b, len AS length_m FROM g_node x JOIN g_node y ON y.id // 121 = x.id // 121 LEFT JOIN g_dist ON s = x.id AND t = y.id WHERE (x.id * 7 + y.id) % 10 = 0",
    _WALK,
    recursive=True,
)
def r03(d):
    """Paths of a tenth of the pairs of crossings of every region."""
    nodes, edges = lattice_graph(d)
    one = d.lattice_nodes.select(F.floor(C("id") / 121).alias("region"), C("id").alias("i"))
    pairs = one.join(one.withColumnRenamed("i", "j"), "region").where((C("i") * 7 + C("j")) % 10 == 0)
    pairs = pairs.select(C("i").cast("string").alias("a"), C("j").cast("string").alias("b"))
    return graph.shortest_paths(pairs, nodes, edges).select("a", "b", "length_m")


@query("r04_graph_lookups", f"SELECT CAST(node AS VARCHAR) AS node, {sq('x')} AS x, {sq('y')} AS y, CAST(component AS VARCHAR) AS component, component = (SELECT component FROM g_comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS main FROM g_comp JOIN g_node ON id = node", _REACH, _COMP, recursive=True)
def r04(d):
    c = connected_components(d.lattice.select("a", "b"))
    main = graph.main_component(c).select(C("component").alias("m"))
    n = d.lattice_nodes.join(c, C("id") == C("node")).join(F.broadcast(main))
    return n.select(C("node").cast("string").alias("node"), q(C("x")).alias("x"), q(C("y")).alias("y"), C("component").cast("string").alias("component"), (C("component") == C("m")).alias("main"))


@query("r02_street_graph")
def r02(d):
    """Edges of the graph built from all streets, with their component; tests
    hold the build against a plain sequential one."""
    nodes, edges = graph.build_graph(d.vertex, GraphOptions(exclusions=()))
    e = edges.join(nodes.select(C("node").alias("a"), "component"), "a")
    return e.select("edge", "a", "b", q(C("length_m"), 2).alias("length_m"), F.size("points").alias("vertices"), "component")


_PROBE = f"g_probe AS (SELECT pid, x % 1000 + CASE WHEN x % 1000 < 0 THEN 1000 ELSE 0 END + {REGION_M}::DOUBLE * (pid // 100) AS x, y % 1000 + CASE WHEN y % 1000 < 0 THEN 1000 ELSE 0 END AS y FROM g_point)"
_LSEG = f"g_lseg AS (SELECT a, b, {slattice('a')[0]} AS ax, {slattice('a')[1]} AS ay, {slattice('b')[0]} AS bx, {slattice('b')[1]} AS by FROM g_lattice)"


def lattice_probes(d):
    fold = lambda c: F.pmod(C(c), L(1000.0))
    east = fold("x") + float(REGION_M) * F.floor(C("pid") / 100)
    return d.point.select("pid", east.alias("x"), fold("y").alias("y"))


@query(
    "j04_nearest_edge_node",
    f"""SELECT pid, {sq('d')} AS d, a || '-' || b AS edge, CAST(CASE WHEN t * 100 <= 100 - t * 100 THEN a ELSE b END AS VARCHAR) AS node FROM (
    SELECT pid, a, b, {sproj('x', 'y')} AS t, {ssegdist('x', 'y')} AS d FROM g_probe JOIN g_lseg ON a // 121 BETWEEN pid // 100 - 1 AND pid // 100 + 1) WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, a || '-' || b) = 1""",
    _PROBE, _LSEG,
)
def j04(d):
    _, edges = lattice_graph(d)
    n = graph.nearest_edge_point(lattice_probes(d), edges, ["pid"], 60.0)
    return n.where("edge is not null").select("pid", q(C("d")).alias("d"), "edge", "node")


@query(
    "j05_nearest_aligned_edge",
    f"""SELECT pid, {sq('d')} AS d, a || '-' || b AS edge FROM (SELECT pid, a, b, {ssegdist('x', 'y')} AS d FROM g_probe JOIN g_lseg ON a // 121 BETWEEN pid // 100 - 1 AND pid // 100 + 1
    WHERE abs((bx - ax) * (pid % 2 * 5 + 1) + (by - ay) * (6 - pid % 2 * 5)) >= 0.8191520442889918::DOUBLE * 100 * sqrt(37::DOUBLE)) WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, a || '-' || b) = 1""",
    _PROBE, _LSEG,
)
def j05(d):
    _, edges = lattice_graph(d)
    odd = C("pid") % 2
    p = lattice_probes(d).withColumns({"hx": (odd * 5 + 1).cast("double"), "hy": (6 - odd * 5).cast("double")})
    n = graph.nearest_edge_point(p, edges, ["pid"], 60.0, GraphRad)
    return n.where("edge is not null").select("pid", q(C("d")).alias("d"), "edge")


GraphRad = RasterOptions().align_rad


#: Nodes of the main component in reach of every probe, nearest first.
_NEAR = f"""g_near AS MATERIALIZED (SELECT pid AS g, n.id AS node, n.x, n.y, 0.0::DOUBLE AS r, {sdist('p.x', 'p.y', 'n.x', 'n.y')} AS d,
        row_number() OVER (PARTITION BY pid ORDER BY {sdist('p.x', 'p.y', 'n.x', 'n.y')}, CAST(n.id AS VARCHAR)) AS rn FROM g_probe p JOIN g_node n ON n.id // 121 BETWEEN pid // 100 - 1 AND pid // 100 + 1
        JOIN g_comp c ON c.node = n.id WHERE {sdist('p.x', 'p.y', 'n.x', 'n.y')} <= 150
        AND c.component = (SELECT component FROM g_comp GROUP BY 1 ORDER BY count(*) DESC, CAST(component AS VARCHAR) LIMIT 1))"""
_SPACED = f"SELECT g AS pid, CAST(rank AS INTEGER) AS rank, CAST(node AS VARCHAR) AS node, {sq('d')} AS d FROM g_near_kept JOIN g_near USING (g, rn)"
_SPACING = (_PROBE, _REACH, _COMP, _NEAR, sgreedy("g_near", sclose(120.0), limit=8))


@query("j13_match_candidates", _SPACED, *_SPACING, recursive=True)
def j13(d):
    """Up to 8 spaced nodes of the main component near every probe (also T05)."""
    return spaced_candidates(d)


def spaced_candidates(d):
    nodes, _ = lattice_graph(d)
    main = graph.main_component(nodes).select("component")
    inside = nodes.join(F.broadcast(main), "component", "left_semi").select("node", C("x").alias("px"), C("y").alias("py"))
    near = spatial.near_points(lattice_probes(d), inside, 150.0)
    o = MatchOptions(radius_m=150.0, min_separation_m=120.0)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["d", "node"]).reset_index(drop=True)
        rows = list(zip(f.px, f.py))
        kept = kernels.greedy(rows, lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 < o.min_separation_m, o.candidates)
        return pd.DataFrame({"pid": f.pid.iloc[0], "rank": range(1, len(kept) + 1), "node": f.node[kept].tolist(), "d": f.d[kept].tolist()})

    out = near.groupBy("pid").applyInPandas(run, "pid long, rank int, node string, d double")
    return out.select("pid", "rank", "node", q(C("d")).alias("d"))


@query("t05_spaced_candidates", f"SELECT pid, count(*) AS n, max(d) AS reach FROM ({_SPACED}) GROUP BY 1", *_SPACING, recursive=True)
def t05(d):
    """How many spaced candidates each probe keeps and how far they reach."""
    return spaced_candidates(d).groupBy("pid").agg(F.count("*").alias("n"), F.max("d").alias("reach"))


# --- rasters -----------------------------------------------------------------

R = RasterOptions(cell_m=25.0, margin_m=50.0)


def lattice_raster(d, o: RasterOptions = R):
    ends = lambda k, s: [lattice_x(k).alias(f"{s}x"), lattice_y(k).alias(f"{s}y")]
    segs = d.lattice.select(*ends("a", "a"), *ends("b", "b"))
    b = segs.agg(
        F.min(F.least("ax", "bx")).alias("min_x"), F.min(F.least("ay", "by")).alias("min_y"), F.max(F.greatest("ax", "bx")).alias("max_x"), F.max(F.greatest("ay", "by")).alias("max_y")
    )
    frame = raster.raster_frame(b, o)
    return segs, b, frame, raster.source_cells(segs, frame, o)


# Headings of the lattice are 0 and pi / 2; layers within 35 degrees take them.
_CELLS = """g_source AS (SELECT DISTINCT layer, CAST(floor((ax + (bx - ax) * (i / 8.0::DOUBLE) + 50) / 25) AS BIGINT) AS cx, CAST(floor((ay + (by - ay) * (i / 8.0::DOUBLE) + 50) / 25) AS BIGINT) AS cy
    FROM g_lseg, range(12) l(layer), range(9) s(i) WHERE least(abs(atan2(by - ay, bx - ax) - layer * pi() / 12), pi() - abs(atan2(by - ay, bx - ax) - layer * pi() / 12)) <= 35 * pi() / 180)"""
_GRID = """g_grid AS (SELECT layer, cx, cy, min(d2) AS d2 FROM (SELECT s.layer, x.cx, y.cy, (s.cx - x.cx) * (s.cx - x.cx) + (s.cy - y.cy) * (s.cy - y.cy) AS d2
    FROM g_source s JOIN (SELECT unnest(range(45 + 60 * (SELECT max(region) FROM g_quarter))) AS cx) x ON x.cx BETWEEN s.cx - 44 AND s.cx + 44, range(45) y(cy)) GROUP BY 1, 2, 3)"""


def raster_width(d) -> int:
    """Cells from the first region's lattice to the last one's, margins included."""
    return 45 + REGION_M // 25 * d.region.agg(F.max("region")).first()[0]


@query("r11_orientation_layers", "SELECT CAST(layer AS INTEGER) AS layer, cx, cy FROM g_source", _LSEG, _CELLS)
def r11(d):
    return lattice_raster(d)[3].select("layer", "cx", "cy")


@query("r10_distance_transform", "SELECT CAST(layer AS INTEGER) AS layer, cx, cy, CAST(d2 AS DOUBLE) AS d2 FROM g_grid WHERE d2 <= 44 * 44", _LSEG, _CELLS, _GRID)
def r10(d):
    cells = raster.near_cells(lattice_raster(d)[3], 44, (raster_width(d), 45))
    return cells.withColumn("d2", C("d2").cast("double"))


@query(
    "j18_raster_lookup",
    f"SELECT pid, {sq('coalesce(sqrt(d2) * 25, 9999)')} AS d FROM g_probe LEFT JOIN g_grid ON layer = pid % 12 AND cx = floor((x + 50) / 25) AND cy = floor((y + 50) / 25)",
    _PROBE, _LSEG, _CELLS, _GRID,
)
def j18(d):
    _, _, frame, sources = lattice_raster(d)
    cells = raster.near_cells(sources, 64, (raster_width(d), 45))
    p = lattice_probes(d).withColumn("layer", (C("pid") % 12).cast("int"))
    return raster.lookup(p, cells, frame, R).select("pid", q(F.least("d", L(9999.0))).alias("d"))


def small_rings(d, size: float = 1.0):
    """All outlines about their centroid."""
    r = paths.recentre(d.vertex)
    return r.select("path_id", "seq", (C("x") * size).alias("x"), (C("y") * size).alias("y"))


#: Spaced samples of the small outlines at four poses, looked up in the raster; runs of far ones as islands.
_POSED = f"""g_small AS (SELECT path_id, seq, 0.15::DOUBLE * x AS x, 0.15::DOUBLE * y AS y FROM g_own),
    g_girth AS (SELECT path_id, sum({sdist('x', 'y', 'nx', 'ny')}) AS per FROM (SELECT path_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM g_small WINDOW w AS (PARTITION BY path_id ORDER BY seq)) GROUP BY 1),
    g_pick AS (SELECT s.path_id, s.seq, s.x, s.y, f.x - b.x AS hx, f.y - b.y AS hy, per FROM g_small s JOIN g_girth USING (path_id) JOIN g_small f ON f.path_id = s.path_id AND f.seq = (s.seq + 2) % 32 JOIN g_small b ON b.path_id = s.path_id AND b.seq = (s.seq + 30) % 32
        WHERE s.seq % greatest(1, CAST(floor(32 / greatest(1, floor(per / 60 + 0.5)) + 0.5) AS BIGINT)) = 0),
    g_laid AS (SELECT path_id, pose, seq, per, per / count(*) OVER (PARTITION BY path_id, pose) AS spacing, x * cos(rot) - y * sin(rot) + 400 + 50 * pose AS x, x * sin(rot) + y * cos(rot) + 600 - 30 * pose AS y,
        atan2(hx * sin(rot) + hy * cos(rot), hx * cos(rot) - hy * sin(rot)) AS h FROM (SELECT *, pose * 0.4::DOUBLE AS rot FROM g_pick, range(4) t(pose))),
    g_seen AS (SELECT l.*, coalesce(sqrt(d2) * 25, 'inf'::DOUBLE) AS d FROM (SELECT *, CAST(floor((h - floor(h / pi()) * pi()) / (pi() / 12) + 0.5) AS BIGINT) % 12 AS layer, CAST(floor((x + 50) / 25) AS BIGINT) AS cx, CAST(floor((y + 50) / 25) AS BIGINT) AS cy FROM g_laid) l
        LEFT JOIN g_grid g ON g.layer = l.layer AND g.cx = l.cx AND g.cy = l.cy),
    g_isle AS (SELECT *, max(island) OVER (PARTITION BY path_id, pose) AS islands FROM (SELECT *, sum(CASE WHEN d > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY path_id, pose ORDER BY seq) AS island FROM g_seen)),
    g_hole AS (SELECT path_id, pose, max(run) AS longest, sum(CASE WHEN island = 0 THEN run ELSE 0 END) AS head, sum(CASE WHEN island = islands THEN run ELSE 0 END) AS tail, max(islands) AS islands FROM (
        SELECT path_id, pose, island, any_value(islands) AS islands, sum(CASE WHEN d > 30 THEN spacing ELSE 0 END) AS run FROM g_isle GROUP BY 1, 2, 3) GROUP BY 1, 2),
    g_cost AS (SELECT c.path_id, c.pose, {sq('cost', 2)} AS cost, {sq('greatest(longest, CASE WHEN islands > 0 AND tail > 0 THEN tail + head ELSE 0 END)', 2)} AS max_hole_m
        FROM (SELECT path_id, pose, sum(least(d, 60)) AS cost FROM g_seen GROUP BY 1, 2) c JOIN g_hole h ON h.path_id = c.path_id AND h.pose = c.pose)"""
_POSES = (_AREA, _CENTRE, _REC, _LSEG, _CELLS, _GRID, _POSED)


@query("a15_pose_cost", "SELECT path_id, CAST(pose AS INTEGER) AS pose, cost, max_hole_m FROM g_cost", *_POSES)
def a15(d):
    """Cost and longest hole of every outline at four poses on the lattice."""
    _, _, frame, sources = lattice_raster(d)
    cells = raster.near_cells(sources, 8)
    ring = small_rings(d, 0.15)
    samples = raster.spaced_samples(ring, paths.path_length(ring, True), 60.0)
    poses = ring.select("path_id").distinct().withColumn("pose", F.explode(F.sequence(L(0), L(3))))
    poses = poses.select("path_id", "pose", (400.0 + 50 * C("pose")).alias("x"), (600.0 - 30 * C("pose")).alias("y"), (C("pose") * 0.4).cast("double").alias("rotation"))
    e = raster.evaluate_poses(poses, samples, cells, frame, L(1.0), 30.0, 60.0, o=R)
    return e.select("path_id", "pose", q(C("cost"), 2).alias("cost"), q(C("max_hole_m"), 2).alias("max_hole_m"))


@query("f14_feasible_poses", "SELECT path_id, CAST(pose AS INTEGER) AS pose, cost, max_hole_m FROM g_cost WHERE max_hole_m <= 200", *_POSES)
def f14(d):
    """The poses of ``a15_pose_cost`` whose longest hole is at most 200 m."""
    return a15(d).where("max_hole_m <= 200")


def block_ring(d):
    """A rectangle on the lattice's streets, drawn a little off them."""
    rows = []
    corners = [(-105.0, -155.0), (95.0, -145.0), (105.0, 145.0), (-95.0, 155.0)]
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        rows += [(ax + (bx - ax) * k / 20, ay + (by - ay) * k / 20) for k in range(20)]
    return d.spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(rows)], "path_id long, seq long, x double, y double")


#: Anchors and rotations of every outline in its own region's box.
SEARCH = PoseOptions(anchor_m=250.0, rotation_deg=45.0, count=5)


def _holes(out: str, poses: str, spacing: int) -> str:
    """CTEs up to ``out`` (path_id, pose, cost, hole): samples of the small
    outlines under the poses of a CTE, looked up; runs of far ones as islands."""
    step = f"greatest(1, CAST(floor(32 / greatest(1, floor(per / {spacing} + 0.5)) + 0.5) AS BIGINT))"
    run = "CASE WHEN d > 30 THEN spacing ELSE 0 END"
    return f"""{out}_pick AS (SELECT s.path_id, s.seq, s.x, s.y, f.x - b.x AS hx, f.y - b.y AS hy, per / count(*) OVER (PARTITION BY s.path_id) AS spacing FROM g_small s JOIN g_girth USING (path_id)
        JOIN g_small f ON f.path_id = s.path_id AND f.seq = (s.seq + 2) % 32 JOIN g_small b ON b.path_id = s.path_id AND b.seq = (s.seq + 30) % 32 WHERE s.seq % {step} = 0),
    {out}_laid AS (SELECT path_id, pose, seq, spacing, p.x * cos(rot) - p.y * sin(rot) + t.x AS x, p.x * sin(rot) + p.y * cos(rot) + t.y AS y,
        atan2(hx * sin(rot) + hy * cos(rot), hx * cos(rot) - hy * sin(rot)) AS h FROM {out}_pick p JOIN {poses} t USING (path_id)),
    {out}_seen AS (SELECT l.*, coalesce(sqrt(d2) * 25, 'inf'::DOUBLE) AS d FROM (SELECT *, CAST(floor((h - floor(h / pi()) * pi()) / (pi() / 12) + 0.5) AS BIGINT) % 12 AS layer,
        CAST(floor((x + 50) / 25) AS BIGINT) AS cx, CAST(floor((y + 50) / 25) AS BIGINT) AS cy FROM {out}_laid) l LEFT JOIN g_grid g ON g.layer = l.layer AND g.cx = l.cx AND g.cy = l.cy),
    {out}_isle AS (SELECT *, max(island) OVER (PARTITION BY path_id, pose) AS islands
        FROM (SELECT *, sum(CASE WHEN d > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY path_id, pose ORDER BY seq) AS island FROM {out}_seen)),
    {out}_run AS (SELECT path_id, pose, island, any_value(islands) AS islands, sum({run}) AS run, sum(least(d, 60)) AS cost FROM {out}_isle GROUP BY 1, 2, 3),
    {out} AS MATERIALIZED (SELECT path_id, pose, cost, greatest(longest, CASE WHEN islands > 0 AND tail > 0 THEN tail + head ELSE 0 END) AS hole FROM (SELECT path_id, pose, sum(cost) AS cost, max(run) AS longest,
        sum(CASE WHEN island = 0 THEN run ELSE 0 END) AS head, sum(CASE WHEN island = islands THEN run ELSE 0 END) AS tail, max(islands) AS islands FROM {out}_run GROUP BY 1, 2))"""


_SMALL = ",\n    ".join(_POSED.split(",\n    ")[:2])
_SEARCHED = f"""g_spot AS (SELECT path_id, (i * 5 + j) * 8 + k AS pose, {REGION_M} * (path_id // 100) + 250.0::DOUBLE * i AS x, 250.0::DOUBLE * j AS y, k * pi() / 4 AS rot FROM g_girth, range(5) a(i), range(5) b(j), range(8) c(k)),
    {_holes('g_rough', 'g_spot', 100)},
    g_left AS MATERIALIZED (SELECT s.* FROM g_spot s JOIN g_rough USING (path_id, pose) WHERE hole <= 400),
    {_holes('g_fine', 'g_left', 20)},
    g_best AS MATERIALIZED (SELECT path_id AS g, pose, x, y, rot AS r, floor(cost * 1e6 + 0.5) / 1e6 AS cost, hole, row_number() OVER (PARTITION BY path_id ORDER BY floor(cost * 1e6 + 0.5), pose) AS rn FROM g_fine JOIN g_left USING (path_id, pose) WHERE hole <= 200)"""


@query(
    "r13_search_poses",
    f"""SELECT g AS path_id, CAST(rank AS INTEGER) AS rank, {sq('x', 1)} AS x, {sq('y', 1)} AS y, {sq('r', 5)} AS rotation, {sq('cost', 2)} AS cost, {sq('hole', 2)} AS max_hole_m
    FROM g_best_kept JOIN g_best USING (g, rn)""",
    _AREA, _CENTRE, _REC, _LSEG, _CELLS, _GRID, _SMALL, _SEARCHED, sgreedy("g_best", sclose(150.0, 10.0), 5),
    recursive=True,
)
def r13(d):
    """The best five poses of every outline among all of the grid over its region."""
    _, _, frame, sources = lattice_raster(d)
    ring = small_rings(d, 0.15)
    west = float(REGION_M) * F.floor(C("path_id") / 100)
    box = ring.select("path_id").distinct().select("path_id", west.alias("min_x"), L(0.0).alias("min_y"), (west + 1000).alias("max_x"), L(1000.0).alias("max_y"))
    found = raster.search_poses(ring, box, raster.near_cells(sources, 3), frame, 1.0, SEARCH, R, blocks=(2,))
    return found.select("path_id", "rank", q(C("x"), 1).alias("x"), q(C("y"), 1).alias("y"), q(C("rotation"), 5).alias("rotation"), q(C("cost"), 2).alias("cost"), q(C("max_hole_m"), 2).alias("max_hole_m"))


_POSE_ORDER = """g_try AS MATERIALIZED (SELECT c.path_id AS g, c.pose, p.x + 90 * c.pose AS x, p.y, c.pose * 0.1::DOUBLE AS r, cost, row_number() OVER (PARTITION BY c.path_id ORDER BY cost, c.pose) AS rn FROM g_cost c JOIN g_point p ON p.pid = c.path_id)"""


@query(
    "t01_spaced_poses",
    "SELECT g AS path_id, CAST(pose AS INTEGER) AS pose, CAST(rank AS INTEGER) AS rank, cost FROM g_try_kept JOIN g_try USING (g, rn)",
    *_POSES, _POSE_ORDER, sgreedy("g_try", sclose(150.0, 10.0)),
    recursive=True,
)
def t01(d):
    """Poses in order of cost without those within 150 m and 10 degrees of a better one."""
    from ..operators import matching

    w = Window.partitionBy("path_id").orderBy("pose")
    p = a15(d).join(d.point.select(C("pid").alias("path_id"), "x", "y"), "path_id")
    p = p.select("path_id", "pose", (C("x") + 90 * C("pose")).alias("x"), "y", (C("pose") * 0.1).cast("double").alias("rotation"), "cost").withColumn("n", F.row_number().over(w)).drop("n")
    return matching.dedup_poses(p, "path_id", ["cost", "pose"], 150.0, 10.0).select("path_id", "pose", "rank", "cost")


# --- matching and pruning on the lattice --------------------------------------


def matched(d, pruned: bool = True, places: int = 1):
    """All outlines at a pose in their region, matched to its streets; or at two, the better of which is pruned.
    At more ``places``, 300 m from one to the next, an outline has a pose and a pruned walk at each."""
    from ..params import Tier

    nodes, edges = region_graph(d)
    poses = places if places > 1 else 1 + int(pruned)
    at = d.point.select(C("pid").alias("path_id"), F.floor(C("pid") / 100).alias("region"), F.explode(F.sequence(L(0), L(poses - 1))).alias("k"))
    east = 200.0 + 100 * (C("path_id") % 8) + float(REGION_M) * C("region")
    north = 100 * F.floor(C("path_id") % 64 / 8) + (300 * C("k") if places > 1 else 0)
    poses = at.select(
        "region", "path_id", (C("path_id") * max(2, poses) + C("k")).alias("pose"), east.alias("x"), (200.0 + north % 800).alias("y"), (C("k") * 0.7).cast("double").alias("rotation")
    )
    ring = cut_lineage(small_rings(d, 0.15))
    pool = places if pruned else 1 << 30
    return generate.match_poses(poses, ring, nodes, edges, paths.path_length(ring, True), 1.0, Tier(12, 90.0, 8, 3 if pruned else 0), LadderOptions(pool=pool))


def region_graph(d):
    """The lattice's graph with the region of every node and edge."""
    nodes, edges = lattice_graph(d)
    nodes = nodes.withColumn("region", F.floor(C("node").cast("long") / 121))
    return nodes, edges.withColumn("region", F.floor(C("a").cast("long") / 121))


def _shown(r):
    return r.select(
        "pose", *[q(C(c), 3).alias(c) for c in ("length_m", "length_ratio", "mean_deviation_m", "max_deviation_m", "frechet_m", "retraced_fraction", "worst")], "passes",
        F.array_join("nodes", ",").alias("nodes"),
    )


@query("r06_map_match")
def r06(d):
    """All outlines at a pose matched to their region's streets; tests hold the walk against exhaustive search."""
    return _shown(matched(d, pruned=False)).select("pose", "nodes", "length_m")


@query("a18_route_metrics")
def a18(d):
    """All metrics of the matched walks."""
    return _shown(matched(d, pruned=False)).drop("nodes")


@query("r08_prune_spikes")
def r08(d):
    """The matched walks after greedy pruning of waypoints."""
    return _shown(matched(d)).select("pose", "nodes", "length_m", "worst")


@query("t13_prune_pool")
def t13(d):
    """Each outline's walk with the least worst term, which is the one that gets pruned."""
    return _shown(matched(d)).select("pose", "worst", "passes")


@query("t06_distinct_routes")
def t06(d):
    """Three of each outline's four walks, 500 m apart first."""
    r = generate.pick_distinct(matched(d, places=4), 3, 500.0)
    return r.select("pose", "rank", q(C("worst"), 3).alias("worst"))


@query("r14_run_tier")
def r14(d):
    """One tier: the block outline's poses searched, matched, scored, pruned and ranked."""
    from ..params import Tier

    _, b, frame, sources = lattice_raster(d)
    o = PoseOptions(anchor_m=100.0, rotation_deg=90.0, count=6, hole_threshold_m=40.0)
    ring = block_ring(d)
    poses = raster.search_poses(ring, b, raster.near_cells(sources, 3), frame, 1.0, o, R).withColumn("pose", C("rank").cast("long"))
    poses = poses.withColumn("region", F.floor((C("x") + 250) / REGION_M))
    r = generate.match_poses(poses, ring, *region_graph(d), paths.path_length(ring, True), 1.0, Tier(6, 90.0, 8, 3))
    return _shown(r).drop("nodes")


def lattice_ways(d):
    ends = F.array(F.struct(L(0).cast("long").alias("seq"), C("a").alias("n")), F.struct(L(1).cast("long").alias("seq"), C("b").alias("n")))
    w = d.lattice.select((C("a") * 1_000_000 + C("b")).alias("path_id"), F.floor(C("a") / 121).alias("region"), F.explode(ends).alias("e"))
    return w.select("region", "path_id", "e.seq", C("e.n").alias("n")).select("region", "path_id", "seq", lattice_x("n").alias("x"), lattice_y("n").alias("y"))


@query("r15_generate_routes")
def r15(d):
    """The whole ladder for the block outline on the streets of every region."""
    from ..params import Tier

    ladder = LadderOptions(tiers=(Tier(4, 90.0, 8, 1), Tier(8, 120.0, 8, 2)))
    o = PoseOptions(anchor_m=200.0, rotation_deg=90.0, hole_threshold_m=40.0)
    r = generate.generate_routes(block_ring(d), lattice_ways(d), 1.0, ladder, o, R, GraphOptions(exclusions=()))
    return r.select("region", "rank", "tier", *[q(C(c), 3).alias(c) for c in ("length_m", "mean_deviation_m", "max_deviation_m", "worst")], "passes")


# --- loops, retracing, gaps ----------------------------------------------------

_LEGS = "g_leg AS (SELECT circuit AS loop, row_number() OVER (PARTITION BY circuit ORDER BY region, k) - 1 AS leg, region * 7 + k AS e1, region * 5 + 2 * k AS e2 FROM g_route)"
_USE = "g_use AS (SELECT loop, leg, e1 AS edge FROM g_leg UNION ALL SELECT loop, leg, e2 FROM g_leg)"
_EDGE = "g_used AS (SELECT loop, leg, edge, 50 + edge % 9 * 10.0::DOUBLE AS len, count(*) OVER (PARTITION BY loop, edge) AS uses FROM g_use)"


def leg_edges(d):
    """Loops of legs over numbered edges, some used several times."""
    w = Window.partitionBy("circuit").orderBy("region", "k")
    legs = d.route.select(C("circuit").alias("loop"), (F.row_number().over(w) - 1).cast("long").alias("leg"), F.array(C("region") * 7 + C("k"), C("region") * 5 + 2 * C("k")).alias("e"))
    u = legs.select("loop", "leg", F.explode("e").alias("edge"))
    uses = F.count("*").over(Window.partitionBy("loop", "edge"))
    return u.select("loop", "leg", "edge", (50 + C("edge") % 9 * 10.0).alias("len"), uses.alias("uses"))


@query(
    "a16_retraced_fraction",
    f"SELECT loop, {sq('sum(CASE WHEN uses >= 2 THEN (uses - 1) * len / uses ELSE 0 END) / sum(len)', 5)} AS retraced FROM g_used GROUP BY 1",
    _LEGS, _USE, _EDGE,
)
def a16(d):
    per = leg_edges(d).groupBy("loop", "edge").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    again = F.sum(F.when(C("n") >= 2, (C("n") - 1) * C("len")).otherwise(0.0))
    return per.groupBy("loop").agg(q(again / F.sum(C("n") * C("len")), 5).alias("retraced"))


@query(
    "a17_retrace_shares",
    f"""SELECT loop, leg, {sq('share')} AS share, {sq('(share + coalesce(lag(share) OVER (PARTITION BY loop ORDER BY leg), last_value(share) OVER (PARTITION BY loop ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 2')} AS anchor FROM (
    SELECT loop, leg, sum((uses - 1) * len / uses) AS share FROM g_used GROUP BY 1, 2)""",
    _LEGS, _USE, _EDGE,
)
def a17(d):
    w = Window.partitionBy("loop").orderBy("leg")
    s = leg_edges(d).groupBy("loop", "leg").agg(F.sum((C("uses") - 1) * C("len") / C("uses")).alias("share"))
    before = F.coalesce(F.lag("share").over(w), F.last("share").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("loop", "leg", q(C("share")).alias("share"), q((C("share") + before) / 2).alias("anchor"))


@query(
    "r09_join_waypoints",
    f"""SELECT CAST(w.s AS BIGINT) AS leg, len IS NOT NULL AS real, {sq('coalesce(len, straight)')} AS length_m FROM (SELECT id AS s, lead(id) OVER (PARTITION BY id // 121 ORDER BY id * 37 % 121, id) AS t FROM g_node) w
    LEFT JOIN g_dist ON g_dist.s = w.s AND g_dist.t = w.t JOIN (SELECT x.id AS s2, y.id AS t2, {sdist('x.x', 'x.y', 'y.x', 'y.y')} AS straight FROM g_node x JOIN g_node y ON y.id // 121 = x.id // 121) ON s2 = w.s AND t2 = w.t""",
    _WALK,
    recursive=True,
)
def r09(d):
    """Legs of a walk through all crossings of every region: shortest paths, or straight gaps where there is none."""
    nodes, edges = lattice_graph(d)
    w = Window.partitionBy(F.floor(C("id") / 121)).orderBy(C("id") * 37 % 121, "id")
    at = lambda s: d.lattice_nodes.select(C("id").alias(s), C("x").alias(f"{s}x"), C("y").alias(f"{s}y"))
    legs = d.lattice_nodes.select(C("id").alias("s"), F.lead("id").over(w).alias("t")).where("t is not null").join(at("s"), "s").join(at("t"), "t")
    pairs = legs.select(C("s").cast("string").alias("a"), C("t").cast("string").alias("b"))
    found = graph.shortest_paths(pairs, nodes, edges).select(C("a").cast("long").alias("s"), C("b").cast("long").alias("t"), "length_m")
    j = legs.join(found, ["s", "t"])
    straight = g.distance(C("sx"), C("sy"), C("tx"), C("ty"))
    return j.select(C("s").alias("leg"), C("length_m").isNotNull().alias("real"), q(F.coalesce("length_m", straight)).alias("length_m"))


def skeleton_anchors(d):
    """The corners of every outline, at half its size, on the streets of its region."""
    from ..plans import skeleton

    nodes, edges = region_graph(d)
    ring = small_rings(d, 0.5)
    middle = 500.0 + float(REGION_M) * F.floor(C("path_id") / 100)
    poses = d.point.select(C("pid").alias("path_id")).distinct().select(
        F.floor(C("path_id") / 100).alias("region"), "path_id", middle.alias("tx"), L(500.0).alias("ty"), ((C("path_id") % 8) * 0.2).cast("double").alias("rotation")
    )
    anchors = cut_lineage(skeleton.resolve_landmarks(skeleton.landmarks(ring), poses, edges))
    return anchors, cut_lineage(generate.graph_rows(nodes, edges, "region"))


def _loops(r):
    return r.select("region", "path_id", "landmarks", "gaps", *[q(C(c), 2).alias(c) for c in ("length_m", "mean_m", "max_m", "retraced_m")])


@query("r12_skeleton_loop")
def r12(d):
    """Corners of every outline resolved on the streets one by one and joined
    leg by leg; tests hold legs and measures against plain ones."""
    from ..plans import skeleton

    return _loops(skeleton.skeleton_loops(*skeleton_anchors(d)))


@query("r12_move_landmark")
def r12_move(d):
    """The same loops with each first anchor moved to the node of its region
    nearest to where it was expected; only the two legs at it are searched for anew."""
    from ..plans import skeleton

    anchors, packed = skeleton_anchors(d)
    at = d.lattice_nodes.select(F.floor(C("id") / 121).alias("r"), C("id").cast("string").alias("node"), C("x").alias("px"), C("y").alias("py"))
    # Wide outlines reach streets of the next region, which are not on their graph.
    near = spatial.near_points(anchors.where("k = 0").select("region", "path_id", "k", "x", "y"), at, 250.0).where("region = r")
    to = near.groupBy("path_id", "k").agg(F.min_by(F.struct("px", "py", "node"), F.struct("d", "node")).alias("n"))
    moves = to.select("path_id", "k", C("n.px").alias("x"), C("n.py").alias("y"), "n.node")
    return _loops(skeleton.skeleton_loops(anchors, packed, moves))


# --- splitting ways ------------------------------------------------------------

_CUT = """g_cut AS (SELECT path_id, seq, CAST(floor(x / 40) AS BIGINT) || ',' || CAST(floor(y / 40) AS BIGINT) AS node FROM g_vertex),
    g_many AS (SELECT node, count(*) AS uses FROM g_cut GROUP BY 1),
    g_part AS (SELECT path_id, seq, cut, sum(CASE WHEN cut AND seq > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY seq) AS part FROM (SELECT path_id, seq, seq = 31 OR uses >= 2 AS cut FROM g_cut JOIN g_many USING (node)))"""


@query(
    "w10_split_ways",
    "SELECT path_id, part, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT path_id, seq, part FROM g_part WHERE seq < 31 UNION ALL SELECT path_id, seq, part - 1 FROM g_part WHERE cut AND seq > 0) GROUP BY 1, 2",
    _CUT,
)
def w10(d):
    """Ways cut at vertices that several share; the cut vertex ends one part and begins the next."""
    from ..operators.rings import split_ways

    node = F.concat_ws(",", g.cell(C("x"), 40.0), g.cell(C("y"), 40.0))
    parts = split_ways(d.vertex.select("path_id", "seq", node.alias("node")))
    return parts.groupBy("path_id", "part").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(
    "w11_order_splits",
    f"SELECT way, seg, {sq('t', 5)} AS t, row_number() OVER (PARTITION BY way ORDER BY seg, t) AS n FROM (SELECT s.way, s.seq + 1 AS seg, {sproj('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')} AS t FROM g_point p JOIN g_segment s ON s.way <> p.pid AND {ssegdist('p.x', 'p.y', 's.ax', 's.ay', 's.bx', 's.by')} <= 12)",
)
def w11(d):
    segs = d.segment.select("way", (C("seq") + 1).alias("seg"), "ax", "ay", "bx", "by")
    n = spatial.near_segments(d.point, segs, 12.0, strict=False).where("way <> pid")
    w = Window.partitionBy("way").orderBy("seg", "t")
    return n.select("way", "seg", q(C("t"), 5).alias("t"), F.row_number().over(w).alias("n"))


PRUNE = PruneOptions()
