"""Operators on small frames with known answers or plain versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.functions import geometry as g
from ringfold.functions import text as t
from ringfold.operators import graph, matching, names, network, paths, raster, spatial, validate
from ringfold.operators.components import connected_components
from ringfold.params import GraphOptions, LadderOptions, PoseOptions, RasterOptions, SearchOptions, Tier
from ringfold.plans import extract, generate
from ringfold.queries.extraction import extract_fixture
from ringfold.sources import files

C, L = F.col, F.lit


def path_frame(spark, *lines):
    rows = [(k, i, float(x), float(y)) for k, line in enumerate(lines) for i, (x, y) in enumerate(line)]
    return spark.createDataFrame(rows, "path_id long, seq long, x double, y double")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- graph structure -------------------------------------------------------------


@pytest.mark.parametrize(
    "ways,nodes,edges,components",
    [
        ([[(0, 0), (10, 0)], [(10, 0), (10, 10)]], 3, 2, 1),  # a shared end
        ([[(0, 0), (100, 0)], [(50, 2), (50, 50)]], 4, 3, 1),  # a T-junction
        ([[(0, 0), (30, 40)]], 2, 1, 1),  # alone
        ([[(0, 0), (100, 0)], [(50, -50), (50, 50)]], 5, 4, 1),  # a crossing
        ([[(0, 0), (100, 0)], [(0, 5), (30, 5.5), (70, 5.5), (100, 5)]], 4, 2, 2),  # closest at the ends: rejected
        ([[(0, 0), (100, 0)], [(500, 0), (600, 0)]], 4, 2, 2),
        ([[(0, 0), (0, 50), (50, 50), (0, 0)]], 1, 1, 1),  # a closed way
    ],
)
def test_graph_structure(spark, ways, nodes, edges, components):
    n, e = graph.build_graph(path_frame(spark, *ways), GraphOptions(exclusions=()))
    n, e = n.collect(), e.collect()
    assert (len(n), len(e), len({r.component for r in n})) == (nodes, edges, components)
    for r in e:
        p = np.array(r.points)
        assert r.length_m == pytest.approx(np.sqrt((np.diff(p, axis=0) ** 2).sum(axis=1)).sum())


def test_exclusions_keep_levels_apart(spark):
    ways = path_frame(spark, [(0, 0), (100, 0)], [(50, -50), (50, 50)])
    n, e = graph.build_graph(ways, GraphOptions(exclusions=((50.0, 10.0),)))
    assert n.count() == 4 and e.count() == 2
    n, _ = graph.build_graph(ways, GraphOptions(exclusions=((50.0, 26.0),)))
    assert n.count() == 5


def plain_graph_length(ways, o):
    """Total edge length of a sequential build: it is that of the ways plus the detours to split points."""
    return sum(math.dist(a, b) for w in ways for a, b in zip(w, w[1:]))


def test_random_streets(spark):
    rng = np.random.default_rng(0)
    ways = [np.cumsum(rng.normal(0, 60, (6, 2)), axis=0) + rng.uniform(0, 500, 2) for _ in range(25)]
    n, e = graph.build_graph(path_frame(spark, *ways), GraphOptions(exclusions=()))
    total = e.agg(F.sum("length_m")).first()[0]
    assert total == pytest.approx(plain_graph_length(ways, None), rel=0.02)
    ends = n.select("node")
    assert e.select(C("a").alias("node")).union(e.select(C("b").alias("node"))).join(ends, "node", "left_anti").count() == 0
    without, _ = graph.build_graph(path_frame(spark, *ways), GraphOptions(corridor_m=0.0, exclusions=()))
    most = lambda f: f.groupBy("component").count().agg(F.max("count")).first()[0] / f.count()
    assert most(n) >= most(without)


def test_components_of_strings_and_lonely_nodes(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string")
    n = spark.createDataFrame([("lonely",)], "node string")
    got = {r.node: r.component for r in connected_components(e, n).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z", "lonely": "lonely"}


@pytest.mark.parametrize("task_links,hot", [(None, 100_000), (0, 100_000), (0, 5)])
def test_components_in_one_task_and_in_rounds(spark, task_links, hot):
    """Chains, stars, cliques and random links give the same by either way, with nodes of many links dealt out."""
    rng = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(i, j) for i in range(2000, 2012) for j in range(i)  if j >= 2000]
    links += [(int(a), int(b)) for a, b in rng.integers(3000, 3400, (300, 2))] + [(5000, 5000)] + links[:30]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.component for r in connected_components(df, None, task_links, hot, many=0).collect()}
    assert got == {i: root(i) for pair in links for i in pair}
    assert connected_components(df.limit(0), None, task_links, hot, many=0).count() == 0


# --- distance joins against all pairs ---------------------------------------------


def test_nearest_segment_equals_a_scan(spark):
    rng = np.random.default_rng(42)
    segs = [(i, *map(float, rng.uniform(-200, 400, 4))) for i in range(30)] + [(30, 10.0, 10.0, 10.0, 10.0)]
    pts = [(i, *map(float, rng.uniform(-250, 450, 2)), *map(float, rng.normal(size=2) * (i % 7 > 0))) for i in range(200)]
    s = spark.createDataFrame(segs, "k long, ax double, ay double, bx double, by double")
    p = spark.createDataFrame(pts, "pid long, x double, y double, hx double, hy double")
    for align in (None, math.radians(35)):
        got = {r.pid: r for r in spatial.nearest_segment(p, s, ["pid"], 60.0, align_rad=align, tie=["k"], keep=["k"]).collect()}
        for pid, x, y, hx, hy in pts:
            best = (60.0, None)
            for k, ax, ay, bx, by in segs:
                dx, dy = bx - ax, by - ay
                n, m = math.hypot(dx, dy), math.hypot(hx, hy)
                if align and m and (not n or abs(dx * hx + dy * hy) / (n * m) < math.cos(align)):
                    continue
                u = 0 if not n else max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (n * n)))
                d = math.hypot(ax + u * dx - x, ay + u * dy - y)
                if d < best[0]:
                    best = (d, k)
            assert got[pid].d == pytest.approx(best[0]) and got[pid].k == best[1]


# --- paths ------------------------------------------------------------------------


def test_odd_paths(spark):
    p = path_frame(spark, [(1, 1)], [(0, 0), (3, 0), (3, 4)], [(5, 5), (5, 5)])
    length = {r.path_id: r.length_m for r in paths.path_length(p, False).collect()}
    assert length == {0: 0.0, 1: 7.0, 2: 0.0}
    assert {r.path_id: r.length_m for r in paths.path_length(p, True).collect()}[1] == 12
    assert {r.path_id: r.area for r in paths.signed_area(p).collect()} == {0: 0.0, 1: 6.0, 2: 0.0}
    centre = {r.path_id: (r.cx, r.cy) for r in paths.centroid(p).collect()}
    assert centre[0] == (1, 1) and centre[2] == (5, 5) and centre[1] == pytest.approx((2, 4 / 3))
    got = paths.resample(p, 2.0, False).collect()
    assert [(r.x, r.y) for r in got if r.path_id != 1] == [(1, 1), (5, 5)] and len(got) == 2 + 4
    assert paths.path_length(p.limit(0)).count() == 0
    with pytest.raises(ValueError):
        paths.resample(p, 0.0)


def test_transforms_and_fit_are_inverse(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, rng.normal(size=2) * 50)) for k in range(4) for _ in range(12)]
    p = spark.createDataFrame(rows, "path_id long, fx double, fy double")
    moved = p.withColumn("t", g.apply(C("fx"), C("fy"), L(10.0), L(-7.0), L(1.1), L(2.5))).select("path_id", "fx", "fy", C("t.x").alias("tx"), C("t.y").alias("ty"))
    for r in paths.fit_similarity(moved).collect():
        assert (r.scale, r.rotation, r.tx, r.ty) == pytest.approx((2.5, 1.1, 10, -7)) and r.residual == pytest.approx(0, abs=1e-4)
    same = spark.createDataFrame([(1, 3.0, 3.0, 5.0, 6.0)] * 2, "path_id long, fx double, fy double, tx double, ty double")
    assert paths.fit_similarity(same).first().scale == 1


def test_whole_ring_is_one_straight(spark):
    circle = [(100 * math.cos(k * math.pi / 40), 100 * math.sin(k * math.pi / 40)) for k in range(80)]
    square = [(0, 0), (50, 0), (100, 0), (100, 100), (0, 100)]
    got = {r.path_id: r for r in paths.longest_straight(path_frame(spark, circle, square)).collect()}
    assert got[0].length_m == pytest.approx(paths.path_length(path_frame(spark, circle)).first().length_m)
    assert (got[1].start_index, got[1].end_index, got[1].length_m, got[1].bearing) == (0, 2, 100, 0)


# --- planted optimum, raster soundness ---------------------------------------------


def test_search_recovers_a_planted_triangle(spark):
    tri = [(-150, -100), (250, -50), (0, 200)]
    ring = [tuple(np.array(a) + (np.array(b) - np.array(a)) * k / 20) for a, b in zip(tri, tri[1:] + tri[:1]) for k in range(20)]
    streets = [[(x + 1200, y + 900) for x, y in (a, b)] for a, b in zip(tri, tri[1:] + tri[:1])]
    segs = paths.segments(path_frame(spark, *streets), False).withColumnRenamed("path_id", "way")
    bounds = spark.createDataFrame([(0.0, 0.0, 2400.0, 1800.0)], "min_x double, min_y double, max_x double, max_y double")
    top = matching.search_placements(path_frame(spark, ring), segs, bounds, 1.0, SearchOptions(samples=(30, 60))).orderBy("rank").first()
    assert (top.x, top.y) == pytest.approx((1200, 900), abs=1) and top.rotation == pytest.approx(0) and top.coverage > 0.9


def test_pose_search_prunes_soundly_and_scores_like_a_loop(spark):
    o = RasterOptions(cell_m=10.0, margin_m=50.0)
    block = [[(x * 100, 0), (x * 100, 300)] for x in range(4)] + [[(0, y * 100), (300, y * 100)] for y in range(4)]
    segs = paths.segments(path_frame(spark, *block), False)
    bounds = paths.bounds(path_frame(spark, *block), None)
    frame = raster.raster_frame(bounds, o)
    cells = raster.near_cells(raster.source_cells(segs, frame, o), 6)
    corners = [(-100, -100), (100, -100), (100, 100), (-100, 100)]
    ring = [tuple(np.array(a) + (np.array(b) - np.array(a)) * k / 10) for a, b in zip(corners, corners[1:] + corners[:1]) for k in range(10)]
    rings = path_frame(spark, ring)
    options = PoseOptions(anchor_m=50.0, rotation_deg=90.0, count=100, dedup_m=1.0, dedup_deg=1.0)
    got = raster.search_poses(rings, bounds, cells, frame, 1.0, options, o).collect()
    assert (got[0].x, got[0].y) == (100, 100) or min(r.cost for r in got) == got[0].cost
    assert got[0].max_hole_m <= 40 and all(r.max_hole_m <= 200 for r in got)
    wide = raster.search_poses(rings, bounds, cells, frame, 1.0, PoseOptions(anchor_m=50.0, rotation_deg=90.0, count=100, dedup_m=1.0, dedup_deg=1.0, coarse_m=20.0), o)
    assert min(r.cost for r in wide.collect()) == pytest.approx(got[0].cost)


def test_generation_ladder(spark):
    streets = [[(x * 100, 0), (x * 100, 400)] for x in range(5)] + [[(0, y * 100), (400, y * 100)] for y in range(5)]
    corners = [(-100, -100), (100, -100), (100, 100), (-100, 100)]
    ring = [tuple(np.array(a) + (np.array(b) - np.array(a)) * k / 10) for a, b in zip(corners, corners[1:] + corners[:1]) for k in range(10)]
    ladder = LadderOptions(tiers=(Tier(3, 90.0, 8, 1), Tier(4, 120.0, 8, 1)))
    poses = PoseOptions(anchor_m=100.0, rotation_deg=90.0)
    grid = RasterOptions(cell_m=10.0, margin_m=50.0)
    got = generate.generate_routes(path_frame(spark, ring), path_frame(spark, *streets), 1.0, ladder, poses, grid, GraphOptions(exclusions=())).collect()
    best = min(got, key=lambda r: r["rank"])
    assert best.passes and best.tier == 0 and best.length_m == pytest.approx(800) and best.max_deviation_m < 1 and len(got) <= 3


# --- sources ------------------------------------------------------------------------


def circuit(**change):
    ring = [[-8.6 + 0.01 * math.cos(k * 0.3), 41.1 + 0.01 * math.sin(k * 0.3)] for k in range(20)]
    own = {
        "id": "a", "name": "A", "location": {"lat": 41.1, "lon": -8.6}, "officialLengthM": 6000.0,
        "attribution": {"source": "s", "license": "l", "url": "u", "retrieved": "r"}, "centreline": ring,
    }
    return {**own, **change}


def errors(spark, *circuits):
    df = spark.createDataFrame([(json.dumps(list(circuits)),)], "value string")
    return [r.error for r in validate.circuit_errors(files.parse_circuits(df, "value")).orderBy("pos").collect()]


def test_circuit_validation(spark, tmp_path):
    lap = 2 * math.pi * 1000
    assert errors(spark, circuit(officialLengthM=lap), circuit(id="b", officialLengthM=lap * 1.5))[0] is None
    for change, message in [
        ({"id": " "}, "non-empty string id"), ({"name": None}, "non-empty string name"), ({"location": None}, "location object"), ({"location": {"lat": 95, "lon": 0}}, "latitude"),
        ({"location": {"lat": 5, "lon": 181}}, "longitude"), ({"officialLengthM": -1}, "positive officialLengthM"), ({"attribution": None}, "attribution object"),
        ({"centreline": [[0, 0]]}, "at least 20 points"), ({"centreline": [[0, 0]] * 25}, "open ring"),
        ({"centreline": [[0.001 * k, 0.0] for k in (0, 1, 1, *range(2, 24))]}, "repeated point at 2"), ({"centreline": [[0.001 * k, 95.0 if k == 3 else 0.0] for k in range(24)]}, "point 3 is out of range"),
    ]:
        assert message in errors(spark, circuit(**change))[0]
    assert errors(spark, circuit(), circuit())[1] == "duplicate circuit id: a"
    (tmp_path / "c.json").write_text(json.dumps([circuit()]))
    assert files.load_circuits(spark, str(tmp_path / "c.json")).count() == 1
    with pytest.raises(Exception, match="latitude"):
        validate.fail_on_error(validate.circuit_errors(files.parse_circuits(spark.createDataFrame([(json.dumps([circuit(location={"lat": 99, "lon": 0})]),)], "value string"), "value"))).collect()


def test_network_files(spark, tmp_path):
    data = {
        "bbox": [-8.688, 41.135, -8.575, 41.183], "grid": 1e-5, "attribution": circuit()["attribution"], "ways": [[100, 100, 20, 0, 0, 20]],
    }
    (tmp_path / "porto-streets.json").write_text(json.dumps(data))
    w = files.decode_ways(files.load_network(spark, str(tmp_path / "porto-streets.json")), "file").orderBy("seq").collect()
    assert [(round(r.lon, 5), round(r.lat, 5)) for r in w] == [(-8.687, 41.136), (-8.6868, 41.136), (-8.6868, 41.1362)]
    assert files.load_region_network(spark, str(tmp_path), "porto").count() == 3
    lattice = spark.createDataFrame([(0, 0, 100, 100), (0, 1, 120, 100), (0, 2, 120, 100), (0, 3, 120, 90), (1, 0, 5, 5), (1, 1, 5, 5)], "path_id long, seq long, gx long, gy long")
    assert [(r.path_id, r.flat) for r in network.encode_lattice(lattice).collect()] == [(0, [100, 100, 20, 0, 0, -10])]
    clip = paths.clip_to_box(path_frame(spark, [(0, 0), (1, 0), (9, 9), (2, 0), (3, 0)]), (-1, -1, 5, 5)).collect()
    assert len(clip) == 4 and len({r.run for r in clip}) == 2


def test_map_elements(spark):
    nodes = [{"type": "node", "id": i, "lat": i / 10, "lon": i} for i in range(4)]
    ways = [
        {"type": "way", "id": 1, "nodes": [0, 1, 2], "tags": {"name": "Main"}}, {"type": "way", "id": 2, "nodes": [2, 3]}, {"type": "way", "id": 3, "nodes": [1]},
        {"type": "way", "id": 4, "nodes": [0, 3], "tags": {"name": "Pit lane"}},
    ]
    member = lambda ref, role: {"type": "way", "ref": ref, "role": role}
    relations = [{"type": "relation", "id": 9, "members": [member(1, "forward"), member(2, "")]}, {"type": "relation", "id": 8, "members": [member(1, "pit_lane")]}]

    def parse(elements):
        return files.parse_elements(spark.createDataFrame([(json.dumps({"elements": elements}),)], "value string"), "value")

    got = {r.way: r for r in files.parse_ways(parse(nodes + ways + relations)).collect()}
    assert sorted(got) == [1, 2, 4] and got[1].role == "pit_lane" and got[1].relation_id == 9 and got[1].lons == [0, 1, 2]
    assert got[2].role is None and got[2].in_relation and not got[4].in_relation and got[4].tags == {"name": "Pit lane"}
    assert [r.way for r in validate.candidate_ways(files.parse_ways(parse(nodes + ways + relations))).collect()] == [2]
    assert [r.id for r in files.relation_ids(parse(relations)).orderBy("pos").collect()] == [9, 8]
    with pytest.raises(Exception, match="references node 3"):
        files.parse_ways(parse(nodes[:3] + ways)).collect()


def test_placements(spark):
    ok = {"schemaVersion": 1, "circuitId": "a", "anchor": [1, 2], "rotationRad": 0, "scale": 1, "savedAt": "2026-01-02T03:04:05.000Z"}
    stored = {"a": ok, "b": ok, "c": {**ok, "circuitId": "c", "scale": 9}, "d": {**ok, "circuitId": "d", "route": [[1, 1]]}, "e": {**ok, "circuitId": "e", "route": [[1, 1], [2, 2]]}}
    df = spark.createDataFrame([(1, json.dumps(stored)), (2, None), (3, "not json"), (4, "[]")], "k int, raw string")
    got = {r.key: r.placement for r in validate.valid_placements(files.parse_placements(df, "raw", "k"), "k").collect()}
    assert sorted(got) == ["a", "e"] and got["a"].schemaVersion == 2 and got["a"].route is None and got["e"].route == [[1, 1], [2, 2]]


# --- texts ---------------------------------------------------------------------------


def test_texts(spark):
    r = one(
        spark,
        t.normalise_name(L("  Autódromo José-Carlos  Pace! ")).alias("a"), t.slug(L("Circuit de la Sarthe")).alias("b"), t.slug(L("The Circuit")).alias("c"),
        t.format_distance(L(999.4)).alias("d"), t.format_distance(L(1234.0)).alias("e"), t.format_percent(L(0.001)).alias("f"), t.format_percent(L(0.02)).alias("g"),
        t.fixed(L(-0.004), 2).alias("h"), t.fixed(L(2.5), 0).alias("i"), t.url_encode(L("a b'(~)é+")).alias("j"),
        F.array_join(t.bar_misses(L(30.2), L(99.0), L(1.2004), L(0.0504)), "|").alias("k"), F.size(t.bar_misses(L(30.0), L(100.0), L(1.2), L(0.05))).alias("l"),
    )
    assert tuple(r)[:10] == ("autodromo jose carlos pace", "la-sarthe", "the-circuit", "999 m", "1.23 km", "0.1 %", "2 %", "0.00", "3", "a%20b'(~)%C3%A9%2B")
    assert r.k == "mean 30.2 m, limit 30 m|length 1.200× the circuit, allowed 0.90× to 1.20×|retraces 5.0 % of its length, limit 5 %" and r.l == 0
    h = one(spark, t.parse_hash(L("#a-1/b_2/3")).alias("x"), t.parse_hash(L("a/b/0")).alias("y"), t.parse_circuit_hash(L("#a")).alias("z"), t.parse_circuit_hash(L("#-a")).alias("w"), t.parse_hash(L("a/b/99999999999999999999")).alias("v"))
    assert tuple(h.x) == ("a-1", "b_2", 3) and h.y is None and h.z == "a" and h.w is None and h.v is None


def test_match_names(spark):
    known = spark.createDataFrame([("monza", "Autodromo di Monza"), ("spa", "Spa Francorchamps"), ("monza-junior", "Monza Junior")], "id string, name string")
    q = spark.createDataFrame([(1, "MONZA"), (2, "spa-francorchamps"), (3, "junior"), (4, ""), (5, "di autodromo"), (6, "nothing")], "k int, query string")
    got = sorted((r.k, r.id) for r in names.match_names(q, known).collect())
    assert got == [(1, "monza"), (2, "spa"), (3, "monza-junior"), (5, "monza")]


def test_bar_and_colours(spark):
    r = one(
        spark, g.passes_bar(L(30.0), L(100.0), L(1.2), L(0.05)).alias("a"), g.passes_bar(L(1.0), L(1.0), L(1.2001), L(0.0)).alias("b"), g.coverage_colour(L(0.0)).alias("c"),
        g.coverage_colour(L(0.5)).alias("d"), g.coverage_colour(L(2.0)).alias("e"), g.bucket_of(L(1.0)).alias("f"), g.half_up(L(-2.5)).alias("g"),
    )
    assert tuple(r) == (True, False, "#c62828", "#f9a825", "#2e7d32", 7, -2)


# --- extraction ----------------------------------------------------------------------


def test_extraction_and_its_refusals(spark):
    answers = extract_fixture()
    none = files.parse_circuits(spark.createDataFrame([("[]",)], "value string"), "value")
    run = lambda a=answers, **o: extract.extract_circuit(spark, "Rectangle Circuit", none, a.__getitem__, extract.Options(**o))
    r = run(today="2026-01-01")
    assert r.kind == "extracted" and r.circuit["id"] == "rectangle" and r.circuit["officialLengthM"] == 3100 and len(r.circuit["centreline"]) >= 20
    assert r.circuit["attribution"]["url"].endswith("/way/77")
    missing = extract_fixture()
    missing["entities"] = '{"entities": {}}'
    assert run(missing).code == "no-entity"
    two = extract_fixture()
    own = json.loads(two["entities"])["entities"]["Q5"]
    two["entities"] = json.dumps({"entities": {"Q5": own, "Q6": own}})
    assert run(two).code == "ambiguous-entity"
    assert run(official_m=9000.0, lat=45.0, lon=9.0).code == "no-ring"


def test_claims_of_unexpected_shapes(spark):
    """A value of another kind is passed over, whatever it is, and can be told from a missing one."""
    snak = lambda v, kind="value": {"snaktype": kind, "datavalue": {"value": v, "type": "x"}}
    say = lambda v, **more: {"mainsnak": snak(v), "rank": "normal", **more}
    odd = ["a text", 7, None, [1, {"id": "Q2338524"}], {"text": "t", "language": "en"}, True, {"id": 12}]
    good = {"P31": [say(v) for v in odd] + [say({"id": "Q2338524", "numeric-id": 5})], "P625": [say("45, 9"), say({"latitude": "x", "longitude": 2}), say({"latitude": 45, "longitude": 9.5, "globe": {}})]}
    good["P2043"] = [say({"amount": "+3.5", "unit": "http://x/Q828224"}, qualifiers={"P580": [snak("soon"), snak({"time": "+2001-00-00T00:00:00Z"})]})]
    bad = {"P31": [say(v) for v in odd], "P625": [say(v) for v in odd], "Pnew": [say({"deep": {"er": [1, 2]}})]}
    text = json.dumps({"entities": {"Q1": {"labels": {}, "descriptions": {}, "claims": good}, "Q2": {"labels": {}, "descriptions": {}, "claims": bad}, "Q3": {}}})
    df = spark.createDataFrame([(text,)], "value string")
    got = files.parse_entities(df, "value", any_class=True).collect()
    assert [(r.id, r.lon, r.lat, r.length_m) for r in got] == [("Q1", 9.5, 45.0, 3500.0)]
    e = df.select(F.explode(F.from_json("value", files.ENTITIES)["entities"]).alias("id", "e")).select("id", C("e.claims").alias("c"))
    deep = F.try_variant_get(F.get(files.statements(C("c"), "Pnew"), 0)["mainsnak"]["datavalue"]["value"], "$.deep.er[1]", "int")
    shown = e.select("id", files.is_racetrack(C("c")).alias("track"), files.unreadable(C("c"), "P625", "latitude").alias("odd"), deep.alias("deep")).collect()
    assert [tuple(r) for r in shown] == [("Q1", True, True, None), ("Q2", False, True, 2), ("Q3", False, False, None)]


def test_store_and_load_routes(spark, tmp_path):
    r = spark.createDataFrame([("a", "porto", 1), ("b", "porto", 1)], "circuit_id string, region string, rank int")
    folder = str(tmp_path / "routes")
    assert generate.write_routes(r, folder, dry_run=True) == 2 and not (tmp_path / "routes").exists()
    generate.write_routes(r, folder)
    generate.write_routes(r.where("circuit_id = 'a'").withColumn("rank", L(2)), folder)
    got = files.load_routes(spark, folder)
    assert sorted((x.circuit_id, x["rank"]) for x in got.collect()) == [("a", 2), ("b", 1)]
    assert files.load_routes(spark, folder, "b").count() == 1


def test_a_set_is_stored_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "set")
    rows = lambda **texts: spark.createDataFrame(list(texts.items()), "circuit_id string, value string").repartition(3)
    check = lambda df: df.select("circuit_id", F.when(C("value").contains("bad"), "is bad").alias("error"))
    show = lambda: {r.circuit_id: r.value for r in files.read_set(spark, folder).collect()}
    assert show() == {} and files.manifest(spark, folder) is None
    with pytest.raises(ValueError, match="z: is bad"):
        files.commit_set(rows(y="1", z="bad"), folder, check)
    assert show() == {} and not list((tmp_path / "set").glob("*"))
    first = files.commit_set(rows(a="1", b="2", c="3"), folder, check)
    assert show() == {"a": "1", "b": "2", "c": "3"} and (first["keys"], first["texts"], first["before"]) == (3, 3, None)
    with pytest.raises(ValueError, match="nothing stored: c: is bad"):
        files.commit_set(rows(a="9", c="bad"), folder, check)
    assert show() == {"a": "1", "b": "2", "c": "3"} and files.manifest(spark, folder) == first
    at_it = files.read_set(spark, folder)  # a reader of the old set
    second = files.commit_set(rows(b="5", d="6"), folder, check)
    assert show() == {"a": "1", "b": "5", "c": "3", "d": "6"} and second["before"] == first["set"]
    assert at_it.count() == 3
    files.commit_set(rows(d="7"), folder, check)
    left = sorted(p.name for p in (tmp_path / "set").glob("[!.]*"))
    assert len(left) == 3 and first["set"] not in left and second["set"] in left and show()["d"] == "7"


def test_streamed_states_equal_the_batch(spark, tmp_path):
    from ringfold.streaming.reducers import fold_states, stream_states

    rows = [(f"u{k % 3}", k, ["add", "add", "undo", "clear", "move"][k * 7 % 5], float(k) if k % 4 == 0 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "user string, seq long, action string, scale double")
    want = {r.user: (r.scale, r.points) for r in fold_states(df, "user").collect()}
    for k in range(3):
        df.where((C("seq") >= k * 20) & (C("seq") < k * 20 + 20)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
        (tmp_path / "in" / f"part{k}" / "_SUCCESS").unlink()
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_states(source, "user").writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM states").collect():
        last[r.user] = (r.scale, r.points)
    assert set(last) == set(want)


def test_closest_approach_in_batches_equals_the_column(spark):
    from ringfold.functions import geometry as g

    rng = np.random.default_rng(5)
    rows = rng.integers(0, 6, (400, 8)).astype(float)
    rows[:20, 4:] = rows[:20, :4]  # equal segments
    rows[20:40, 2:4] = rows[20:40, :2]  # points
    names = [f"{s}_{c}" for s in "ab" for c in ("ax", "ay", "bx", "by")]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: r.near for r in spatial.with_approach(df, 2.0).collect()}
    side = lambda s: tuple(F.col(f"{s}_{c}") for c in ("ax", "ay", "bx", "by"))
    want = {r.i: r.near for r in df.withColumn("near", g.closest_approach(side("a"), side("b"))).where("near.d <= 2").collect()}
    assert set(got) == set(want) and all(tuple(got[i]) == pytest.approx(tuple(want[i])) for i in want)


def test_replace_text_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "circuits.json")
    files.replace_text(spark, path, "[1]\n")
    files.replace_text(spark, path, "[\"ü\"]\n")
    assert open(path, encoding="utf-8").read() == '["ü"]\n'
    blocked = tmp_path / "folder.json"
    (blocked / "inside").mkdir(parents=True)
    with pytest.raises(Exception):
        files.replace_text(spark, str(blocked), "x")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["circuits.json", "folder.json"]
