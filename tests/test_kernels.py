"""Sequential kernels against plain or exhaustive versions."""

import functools
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.operators import kernels, rings
from ringfold.params import MatchOptions, PruneOptions, RingOptions
from ringfold.sources.http import JsonClient, hash_key


def star(rng, n=None):
    """A star-shaped ring."""
    n = n or int(rng.integers(5, 40))
    a = np.sort(rng.random(n) * 2 * math.pi)
    r = rng.uniform(20, 400, n)
    return np.column_stack([r * np.cos(a), r * np.sin(a)]) + rng.uniform(-500, 500, 2)


def test_route_length_fixture():
    assert kernels.path_length(np.array([[0, 0], [3, 0], [3, 4.0]]), False) == 7


@pytest.mark.parametrize("closed", [True, False])
def test_resample(closed):
    rng = np.random.default_rng(1)
    for _ in range(30):
        p = star(rng)
        total = kernels.path_length(p, closed)
        s = kernels.resample(p, 25.0, closed)
        assert len(s) == max(3 if closed else 2, math.floor(total / 25 + 0.5))
        assert np.allclose(s[0], p[0]) and (closed or np.allclose(s[-1], p[-1]))
        assert kernels.polyline_distance(s, p, closed).max() < 1e-9
    assert len(kernels.resample(np.zeros((4, 2)), 5, True)) == 1


def plain_simplify(p, tol):
    if len(p) < 3:
        return list(range(len(p)))
    d = kernels.point_segment_distance(p[1:-1], p[0], p[-1])
    k = int(d.argmax())
    if d[k] <= tol:
        return [0, len(p) - 1]
    left, right = plain_simplify(p[: k + 2], tol), plain_simplify(p[k + 1 :], tol)
    return left[:-1] + [k + 1 + i for i in right]


def test_simplify():
    rng = np.random.default_rng(2)
    for _ in range(30):
        p = star(rng)
        assert np.flatnonzero(kernels.simplify(p, 60, False)).tolist() == plain_simplify(p, 60)
        ring = kernels.simplify(p, 60, True)
        assert ring[0] and kernels.polyline_distance(p, p[ring], True).max() <= 60 + 1e-9
        assert kernels.simplify(p, 0, True).all()


def test_corners_merge_like_a_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(40):
        p = star(rng)
        n = len(p)
        unit = [(p[(i + 1) % n] - p[i]) / np.linalg.norm(p[(i + 1) % n] - p[i]) for i in range(n)]
        c = [(i, math.acos(max(-1, min(1, float(unit[i - 1] @ unit[i]))))) for i in range(n)]
        c = [x for x in c if x[1] > 0.35]
        while len(c) > 1:
            gaps = [math.dist(p[c[k][0]], p[c[(k + 1) % len(c)][0]]) for k in range(len(c))]
            k = gaps.index(min(gaps))
            if gaps[k] >= 60:
                break
            a, b = c[k], c[(k + 1) % len(c)]
            c.remove(b if a[1] >= b[1] else a)
        assert [i for i, _ in kernels.corners(p, 0.35, 60)] == [i for i, _ in c]
    assert kernels.corners(np.zeros((2, 2)), 0.35, 60) == []


def test_frechet_is_the_recursive_definition():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.random((rng.integers(1, 9), 2)), rng.random((rng.integers(1, 9), 2))

        @functools.lru_cache(None)
        def f(i, j, a=a, b=b):
            d = math.dist(a[i], b[j])
            before = [f(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            return max(d, min(before)) if before else d

        assert kernels.discrete_frechet(a, b) == pytest.approx(f(len(a) - 1, len(b) - 1))
    line = rng.random((9, 2))
    assert kernels.discrete_frechet(line, line) == 0 and kernels.discrete_frechet(line, line + [3, 4]) == pytest.approx(5)


def test_distance_transform():
    rng = np.random.default_rng(5)
    for _ in range(30):
        grid = rng.random((rng.integers(1, 12), rng.integers(1, 15))) < 0.1
        got = kernels.distance_transform(grid)
        ys, xs = np.nonzero(grid)
        for y, x in itertools.product(*map(range, grid.shape)):
            assert got[y, x] == min(((ys - y) ** 2 + (xs - x) ** 2).tolist(), default=np.inf)


def random_graph(rng, n=9):
    nodes = [(f"n{i}", *map(float, rng.uniform(0, 200, 2))) for i in range(n)]
    edges = []
    for k, (a, b) in enumerate(itertools.combinations(range(n), 2)):
        if rng.random() < 0.45:
            p, q = nodes[a][1:], nodes[b][1:]
            mid = ((p[0] + q[0]) / 2 + float(rng.uniform(-9, 9)), (p[1] + q[1]) / 2)
            edges.append((f"e{k}", nodes[a][0], nodes[b][0], math.dist(p, mid) + math.dist(mid, q), [p, mid, q]))
    return kernels.Graph(nodes, edges)


def test_shortest_paths():
    rng = np.random.default_rng(6)
    for _ in range(20):
        g = random_graph(rng)
        ids = list(g.position)
        d = {(a, b): 0.0 if a == b else math.inf for a in ids for b in ids}
        for _, a, b, n, _ in g.edges.values():
            d[a, b] = d[b, a] = min(d[a, b], n)
        for k, i, j in itertools.product(ids, ids, ids):
            d[i, j] = min(d[i, j], d[i, k] + d[k, j])
        for a, b in itertools.product(ids, ids):
            got = g.shortest(a, b)
            assert (got[0] if got else math.inf) == pytest.approx(d[a, b])
            if got:
                assert kernels.path_length(np.array(g.polyline(a, got[1])), False) == pytest.approx(d[a, b])


def test_match_loop_is_the_cheapest_closed_walk():
    rng = np.random.default_rng(7)
    found = 0
    for _ in range(12):
        g = random_graph(rng)
        ring = star(rng, 6) * 0.1 + 100
        o = MatchOptions(step_m=60, radius_m=120, candidates=3, min_separation_m=5)
        ids = sorted(g.position)
        xy = np.array([g.position[i] for i in ids])
        states = [kernels.match_candidates(p, kernels.NodeGrid(ids, xy, o.radius_m), o) for p in kernels.resample(ring, o.step_m, True)]

        def hop(a, b, g=g, o=o):
            if a == b:
                return 0
            s = g.shortest(a, b)
            if s is None or g.distance(a, b) > 180:
                return math.inf
            return min(10, 3 * max(0, s[0] - 60) / 60 + 0.3 * max(0, 60 - s[0]) / 60)

        def cost(walk):
            hops = sum(hop(a[0], b[0]) for a, b in zip(walk, walk[1:] + walk[:1]))
            return hops + sum((d / 70) ** 2 for _, d in walk[1:])

        best = min((cost(list(w)) for w in itertools.product(*states)), default=math.inf) if all(states) else math.inf
        got = kernels.match_loop(ring, g, ids, o)
        assert (got is None) == math.isinf(best)
        if got:
            found += 1
            assert cost([(n, dict(s)[n]) for n, s in zip(got, states)]) == pytest.approx(best)
    assert found > 3


def test_prune_removes_exactly_the_spur():
    corners = [(0, 0), (100, 0), (200, 0), (200, 100), (200, 200), (100, 200), (0, 200), (0, 100), (100, 500)]
    nodes = [(f"n{i}", float(x), float(y)) for i, (x, y) in enumerate(corners)]
    pairs = [(i, (i + 1) % 8) for i in range(8)] + [(5, 8)]
    edges = [(f"e{a}-{b}", f"n{a}", f"n{b}", math.dist(corners[a], corners[b]), [corners[a], corners[b]]) for a, b in pairs]
    g = kernels.Graph(nodes, edges)
    walk = [f"n{i}" for i in (0, 1, 2, 3, 4, 5, 8, 5, 6, 7)]
    ring = np.array(corners[:8], dtype=float)
    kept = kernels.prune_spikes(walk, g, ring, 800.0)
    assert "n8" not in kept
    points, legs = g.loop(kept)
    assert kernels.path_length(points, False) == 800 and kernels.retraced_m(legs, g)[0] == 0


def test_greedy_choices():
    rows = [(0, 0, 0), (100, 0, 0), (900, 0, 0), (0, 0, 3), (1000, 0, 0)]
    assert kernels.greedy(rows, kernels.same_pose(150, 0.2)) == [0, 2, 3]
    assert kernels.greedy(rows, kernels.same_pose(150, 0.2), 2) == [0, 2]
    assert kernels.spread(rows, 800, 4) == [0, 2, 1, 3]


def plain_cycles(edges):
    """Simple cycles of a multigraph as sets of edge numbers."""
    out = set()
    for k in range(1, len(edges) + 1):
        for some in itertools.combinations(range(len(edges)), k):
            degree = {}
            for e in some:
                for v in edges[e]:
                    degree[v] = degree.get(v, 0) + 1
            if any(n != 2 for n in degree.values()):
                continue
            seen, todo = set(), [edges[some[0]][0]]
            while todo:
                v = todo.pop()
                if v not in seen:
                    seen.add(v)
                    todo += [w for e in some for w in edges[e] if v in edges[e]]
            if seen == set(degree):
                out.add(frozenset(some))
    return out


def test_simple_cycles():
    rng = np.random.default_rng(8)
    for _ in range(40):
        edges = [tuple(int(v) for v in rng.integers(0, 5, 2)) for _ in range(int(rng.integers(1, 9)))]
        got = [frozenset(c) for _, c in kernels.simple_cycles(edges)]
        assert len(got) == len(set(got)) and set(got) == plain_cycles(edges)
    full = list(itertools.combinations(range(9), 2))
    with pytest.raises(kernels.TooManyCycles):
        kernels.simple_cycles(full, RingOptions(max_cycles=50))
    with pytest.raises(kernels.TooManyCycles):
        kernels.simple_cycles(full, RingOptions(max_steps=50))


def rectangle(split):
    """1000 m by 500 m near the equator, in one way or several."""
    d = 1 / 111_195.0
    c = [(0.0, 0.0), (1000 * d, 0.0), (1000 * d, 500 * d), (0.0, 500 * d)]
    lines = [[0, 1, 2, 3, 0]] if not split else [[0, 1], [1, 2, 3], [3, 0]]
    return [{"way": k, "node_ids": n, "points": [c[i] for i in n], "in_relation": True} for k, n in enumerate(lines)]


@pytest.mark.parametrize("split", [False, True])
def test_rectangle_lap(split):
    found = rings.find_rings(rectangle(split))
    assert len(found) == 1 and found[0]["length_m"] == pytest.approx(3000, rel=0.01) and found[0]["gaps_m"] == []


def test_stitching_and_ambiguity():
    ways = rectangle(True)
    d = 1 / 111_195.0
    ways[0]["node_ids"] = [0, 9]
    ways[0]["points"] = [(0.0, 0.0), (997 * d, 0.0)]
    assert rings.find_rings(ways, stitch_m=1) == []
    one = rings.find_rings(ways, stitch_m=5)
    assert len(one) == 1 and one[0]["gaps_m"] == [pytest.approx(3, abs=0.05)]


def test_choice_among_laps(spark):
    d = 1 / 111_195.0
    square = [(0.0, 0.0), (1000 * d, 0.0), (1000 * d, 500 * d), (0.0, 500 * d)]
    moved = lambda dx: [[x + dx, y] for x, y in square]
    groups = {
        "twins": [(3000.0, moved(0), True), (3003.0, moved(1e-5), False), (3006.0, moved(0.1), True)],
        "one own": [(3000.0, moved(0), True), (3006.0, moved(0.1), False)],
        "taken over": [(3000.0, moved(0), False), (3001.0, moved(1e-5), True), (3002.0, moved(2e-5), True), (3300.0, moved(0.1), False)],
        "far": [(5000.0, moved(0), True)],
        "wide": [(3000.0, moved(0), True), (3200.0, moved(0.1), True)],
        "two points": [(3000.0, moved(0)[:2], True), (3001.0, moved(0)[:2], True)],
    }
    rows = [(g, k, n, [k], p, 0, own, False) for g, laps in groups.items() for k, (n, p, own) in enumerate(laps)]
    rows.append(("tangle", None, None, None, None, None, None, True))
    laps = spark.createDataFrame(rows, f"g string, {rings.LAP}").withColumn("official_m", F.lit(3000.0))
    ranked = rings.rank_laps(laps, "g").cache()
    distinct = {}
    for r in rings.distinct_laps(ranked, "g").orderBy("g", "place").collect():
        distinct.setdefault(r.g, []).append((r.rank, r.equivalent))
    assert distinct["twins"] == [(1, 1), (3, 0)] and distinct["taken over"] == [(2, 2), (4, 0)] and distinct["two points"] == [(1, 0), (2, 0)]
    got = {r.g: r for r in rings.choose_laps(ranked, "g").collect()}
    assert {g: (r.kind, r.chosen) for g, r in got.items()} == {
        "twins": ("ambiguous", None), "one own": ("picked", 1), "taken over": ("picked", 2), "far": ("none", None), "wide": ("picked", 1),
        "two points": ("ambiguous", None), "tangle": ("too_many", None),
    }
    assert got["twins"].top == [1, 3] and got["far"].note == "the closest ring is 66.7% off the official length (limit 5%)"
    assert got["taken over"].note == rings.COLLAPSED.format(n=2, m=60.0) and got["wide"].note == ""
    assert got["one own"].note == rings.CHOSEN.format(n=1, points=3.0)
    assert rings.choose_laps(ranked.limit(0), "g").count() == 0


def test_pruning_equals_single_removals():
    """Against plain passes that measure every loop anew."""
    rng = np.random.default_rng(6)
    nodes = [(f"n{i}", 100.0 * (i // 5), 100.0 * (i % 5)) for i in range(25)]
    at = {n: (x, y) for n, x, y in nodes}
    pairs = [(a, b) for a in at for b in at if a < b and math.dist(at[a], at[b]) == 100]
    g = kernels.Graph(nodes, [(f"{a}{b}", a, b, 100.0, [at[a], at[b]]) for a, b in pairs])
    ring = np.array([(0, 0), (400, 0), (400, 400), (0, 400)], dtype=float)

    def plain(walk, passes, least):
        def cost(some):
            points, legs = g.loop(some)
            return sum(kernels.bar_terms(kernels.route_metrics(points, legs, ring, 1600.0, g), kernels.Bar()))

        now = list(walk)
        for _ in range(passes):
            gone = False
            k = 0
            while k < len(now) and len(now) > least:
                if cost(now[:k] + now[k + 1 :]) < cost(now):
                    del now[k]
                    gone = True
                else:
                    k += 1
            if not gone:
                break
        return now

    for _ in range(12):
        walk = [f"n{k}" for k in rng.integers(0, 25, int(rng.integers(4, 14)))]
        for passes, least in ((1, 6), (3, 3)):
            assert kernels.prune_spikes(walk, g, ring, 1600.0, PruneOptions(passes, least)) == plain(walk, passes, least)


def test_skeleton_loop_and_move():
    """Legs, gaps, retracing and length against sums by hand; a move against a new loop."""
    corners = [(0, 0), (100, 0), (200, 0), (200, 100), (100, 100), (0, 100), (100, 300)]
    nodes = [(f"n{i}", float(x), float(y)) for i, (x, y) in enumerate(corners)]
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (4, 6)]
    g = kernels.Graph(nodes, [(f"e{a}{b}", f"n{a}", f"n{b}", math.dist(corners[a], corners[b]), [corners[a], corners[b]]) for a, b in pairs])
    expected = [(0.0, 5.0), (200.0, -5.0), (205.0, 100.0), (100.0, 290.0), (0.0, 400.0)]
    found = [(0.0, 0.0), (200.0, 0.0), (200.0, 100.0), (100.0, 300.0), None]
    loop = kernels.Skeleton(expected, found, ["n0", "n2", "n3", "n6", None], g)
    m = loop.measures()
    gap = math.dist((100, 300), (0, 400)) + math.dist((0, 400), (0, 0))
    assert m["gaps"] == 2 and m["length_m"] == pytest.approx(200 + 100 + 300 + gap) and m["retraced_m"] == 0
    assert [leg["edges"] for leg in loop.legs] == [("e01", "e12"), ("e23",), ("e34", "e46"), (), ()]
    back = loop.moved(4, (100.0, 100.0), "n4")
    new = kernels.Skeleton(expected, [*found[:4], (100.0, 100.0)], ["n0", "n2", "n3", "n6", "n4"], g)
    assert back.measures() == new.measures() and back.legs[:3] == loop.legs[:3] and all(a is b for a, b in zip(back.legs[:3], loop.legs[:3]))
    r = back.measures()
    assert r["gaps"] == 0 and r["retraced_m"] == 200 and sum(r["anchor_retraced_m"]) == pytest.approx(200)
    assert r["anchor_retraced_m"] == [0, 0, 50, 100, 50] and loop.measures() == m
    d = np.concatenate([kernels.polyline_distance(kernels.resample(kernels.leg_points(new.legs), 10, False), np.array(expected), True),
                        kernels.polyline_distance(kernels.resample(np.array(expected), 10, True), kernels.leg_points(new.legs), False)])
    assert r["mean_m"] == pytest.approx(d.mean()) and r["max_m"] == pytest.approx(d.max())


def test_skeleton_plan_equals_single_loops(spark):
    """Two regions in one run, with a move, against loops built one by one."""
    from ringfold.plans import generate, skeleton

    nodes, edges, anchors = [], [], []
    for region in range(2):
        at = {f"{region}-{i}{j}": (3000.0 * region + 100 * i, 100.0 * j) for i in range(4) for j in range(4)}
        nodes += [(n, x, y, f"{region}-00", region) for n, (x, y) in at.items()]
        edges += [(f"{a}:{b}", a, b, 100.0, [list(at[a]), list(at[b])], region) for a in at for b in at if a < b and math.dist(at[a], at[b]) == 100]
        for path in (10 * region, 10 * region + 1):
            for k, (i, j) in enumerate([(0, 0), (3, 1), (2, 3)]):
                n = f"{region}-{i}{j}"
                anchors.append((region, path, k, at[n][0] + 7, at[n][1] - 4, *(at[n] if k or path % 10 else (None, None)), n if k or path % 10 else None))
    n = spark.createDataFrame(nodes, "node string, x double, y double, component string, region long")
    e = spark.createDataFrame(edges, "edge string, a string, b string, length_m double, points array<array<double>>, region long")
    a = spark.createDataFrame(anchors, "region long, path_id long, k int, x double, y double, fx double, fy double, node string")
    moves = spark.createDataFrame([(1, 2, 100.0, 200.0, "0-12")], "path_id long, k int, x double, y double, node string")
    packed = generate.graph_rows(n, e, "region")
    got = {r.path_id: r for r in skeleton.skeleton_loops(a, packed, moves).collect()}
    assert set(got) == {0, 1, 10, 11}
    for path, r in got.items():
        region = path // 10
        g = kernels.Graph([x[:3] for x in nodes if x[4] == region], [x[:5] for x in edges if x[5] == region])
        own = [x for x in anchors if x[1] == path]
        loop = kernels.Skeleton([x[3:5] for x in own], [None if x[7] is None else x[5:7] for x in own], [x[7] for x in own], g)
        loop = loop.moved(2, (100.0, 200.0), "0-12") if path == 1 else loop
        m = loop.measures()
        assert (r.region, r.landmarks, r.gaps) == (region, 3, m["gaps"]) and r.length_m == pytest.approx(m["length_m"])
        assert r.max_m == pytest.approx(m["max_m"]) and r.anchor_retraced_m == pytest.approx(m["anchor_retraced_m"])


def test_node_grid_equals_a_scan():
    rng = np.random.default_rng(2)
    xy = rng.uniform(-500, 500, (300, 2)).round()
    grid = kernels.NodeGrid(list(range(300)), xy, 90.0)
    for p in rng.uniform(-600, 600, (40, 2)):
        d = np.sqrt(((xy - p) ** 2).sum(axis=1))
        want = [i for i in np.argsort(d, kind="stable").tolist() if d[i] <= 90]
        got, far = grid.near(p)
        assert got == want and (far == d[want]).all()


def test_hash_key():
    assert hash_key("") == hash_key("") and len(hash_key("a")) == 14 and hash_key("a") != hash_key("b")
    assert int(hash_key("some longer text"), 16) < 1 << 53
    # Published results of the cyrb53 hash with seed 0.
    assert hash_key("a") == f"{7929297801672961:014x}" and hash_key("b") == f"{8684336938537663:014x}"


def test_client_retries_caches_and_refuses():
    clock, slept, asked = [0.0], [], []

    def client(answers, **more):
        def fetch(url, body):
            asked.append(url)
            a = answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        def sleep(s):
            slept.append(s)
            clock[0] += s

        return JsonClient(fetch, sleep, lambda: clock[0], **more)

    c = client([(429, ""), OSError("down"), (200, "<html>"), (200, '{"remark": "runtime error: x"}'), (200, '{"a": 1}')])
    assert c.get(["u", "mirror"]) == {"a": 1} and c.get(["u"]) == {"a": 1}
    assert asked == ["u"] * 5 and [s for s in slept if s > 1] == [2, 4, 8, 16]
    asked.clear()
    assert client([(500, "")] * 5 + [(200, "[]")]).get(["u", "mirror"]) == [] and asked == ["u"] * 5 + ["mirror"]
    with pytest.raises(RuntimeError, match="not retryable"):
        client([(404, "no")]).get(["u"])
    with pytest.raises(RuntimeError, match="all attempts"):
        client([(503, "")] * 5).get(["u"])
    with pytest.raises(LookupError):
        client([], offline=True).get(["u"])
    with pytest.raises(ValueError):
        client([]).get([])


def test_frechet_of_many_pairs_at_once_is_that_of_each(monkeypatch):
    rng = np.random.default_rng(12)
    sizes = [(1, 1), (1, 9), (9, 1), (0, 3), (3, 0), (17, 4), (4, 17), *map(tuple, rng.integers(1, 40, (30, 2)).tolist())]
    pairs = [(rng.normal(0, 9, (n, 2)), rng.normal(0, 9, (m, 2))) for n, m in sizes]
    want = [kernels.discrete_frechet(a, b) for a, b in pairs]
    for some in (1, 5, 64):
        monkeypatch.setattr(kernels, "CURVES", some)
        assert kernels.discrete_frechets(pairs) == want
    assert kernels.discrete_frechets([]) == []


def test_points_keep_within_reach_as_measured():
    rng = np.random.default_rng(3)
    told = set()
    for k in range(300):
        t = np.sort(rng.uniform(0, 2 * np.pi, 40))
        line = 300 * np.column_stack([np.cos(t), np.sin(t)]) + rng.normal(0, 3, (40, 2))
        points = line[rng.permutation(40)] + rng.normal(0, 1, (40, 2)) + rng.uniform(-25, 25, 2)
        worst = kernels.polyline_distance(points, line, True).max()
        for reach in (20.0, worst, np.nextafter(worst, 0)):
            told.add(kernels.keeps_within(points, line, reach))
            assert kernels.keeps_within(points, line, reach) == (worst <= reach)
    assert told == {True, False}


def test_groups_of_ways_share_calls(spark):
    square = [(1, [0, 1, 2], [0.0, 0.01, 0.01], [41.0, 41.0, 41.01], True), (2, [2, 3, 0], [0.01, 0.0, 0.0], [41.01, 41.01, 41.0], True)]
    groups = [None, 2**60 + 1, *range(40)]
    ways = spark.createDataFrame([(k, *w) for k in groups for w in square], "g long, way long, node_ids array<long>, lons array<double>, lats array<double>, in_relation boolean")
    laps = rings.laps_by_group(ways, "g")
    assert "MapInPandas" in (plan := laps._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan
    got = laps.collect()
    assert sorted(map(str, groups)) == sorted(str(r.g) for r in got)
    assert all(r.ways == [1, 2] and len(r.points) == 4 and r.lap == 0 and not r.too_many for r in got)


def test_nearest_distances_are_a_row_a_path_until_they_are_made(spark):
    from ringfold.queries import geometry

    rng = np.random.default_rng(5)
    line, points = rng.normal(0, 100, (9, 2)), rng.normal(0, 100, (30, 2))
    line[4] = line[3]
    for closed in (True, False):
        a, b = (line, np.roll(line, -1, axis=0)) if closed else (line[:-1], line[1:])
        want = kernels.polyline_distance(points, line, closed)
        assert np.allclose(kernels.least_distances(*points.T, *a.T, *b.T, cells=20), want)
        rows = lambda xy: [(k, i, *map(float, v)) for k in (7, 8) for i, v in enumerate(xy)]
        at = lambda xy: spark.createDataFrame(rows(xy), "path_id long, seq long, x double, y double")
        near = geometry.polyline_nearest(at(points), at(line), closed)
        assert "MapInArrow" in near._jdf.queryExecution().toString()
        got = near.collect()
        assert {r.path_id for r in got} == {7, 8} and np.allclose(sorted(r.d for r in got), np.sort(np.repeat(want, 2)))
    # What is no number is passed over, as by an aggregate.
    assert kernels.least_distances(*points.T, *np.where(a == a[0], np.nan, a).T, *b.T)[0] >= want[0]
    assert geometry.polyline_nearest(at(points), at(line[:1]), True).count() == 0
