"""Inherently sequential algorithms on one group's arrays.

Operators run these with ``applyInPandas`` on groups of one path, pose or
region; none of them knows about Spark.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np

from ..params import Bar, MatchOptions, PruneOptions, RingOptions

Point = tuple[float, float]


def point_segment_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points (..., 2) to segments (..., 2)-(..., 2), broadcast."""
    d = b - a
    len2 = (d * d).sum(axis=-1)
    t = np.clip(((p - a) * d).sum(axis=-1) / np.where(len2 == 0, 1, len2), 0, 1)
    t = np.where(len2 == 0, 0, t)
    return np.sqrt((((a + t[..., None] * d) - p) ** 2).sum(axis=-1))


def closest_approaches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(d, k, x, y, ta, tb) of segment pairs (n, 4): zero at a crossing (k =
    -1), else the best of the four ends against the other segment, the first
    on ties; (x, y) is halfway between."""
    p, q = a.reshape(-1, 2, 2), b.reshape(-1, 2, 2)
    r, s, gap = p[:, 1] - p[:, 0], q[:, 1] - q[:, 0], q[:, 0] - p[:, 0]
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    den = cross(r, s)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(gap, s) / den, cross(gap, r) / den
    hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    d, x, y, ta, tb = (np.empty((4, len(a))) for _ in range(5))
    for k in range(4):
        end, (start, way) = (p[:, k], (q[:, 0], s)) if k < 2 else (q[:, k - 2], (p[:, 0], r))
        size = (way * way).sum(axis=1)
        at = ((end - start) * way).sum(axis=1) / np.where(size == 0, 1.0, size)
        at = np.where(size == 0, 0.0, np.clip(at, 0.0, 1.0))
        foot = start + at[:, None] * way
        d[k] = np.sqrt(((end - foot) ** 2).sum(axis=1))
        x[k], y[k] = ((end + foot) / 2).T
        own = np.full(len(a), float(k % 2))
        ta[k], tb[k] = (own, at) if k < 2 else (at, own)
    best, row = d.argmin(axis=0), np.arange(len(a))
    pick = lambda v, at_hit: np.where(hit, at_hit, v[best, row])
    with np.errstate(invalid="ignore"):
        place = p[:, 0] + t[:, None] * r
    k = np.where(hit, -1, best).astype(np.int32)
    return pick(d, 0.0), k, pick(x, place[:, 0]), pick(y, place[:, 1]), pick(ta, t), pick(tb, u)


def resample(path: np.ndarray, spacing: float, closed: bool) -> np.ndarray:
    """Points at even arc lengths; see ``paths.resample``."""
    if len(path) < 2:
        return path.copy()
    ring = np.vstack([path, path[:1]]) if closed else path
    step = np.sqrt((np.diff(ring, axis=0) ** 2).sum(axis=1))
    arc = np.concatenate([[0.0], np.cumsum(step)])
    total = arc[-1]
    if total == 0:
        return path[:1].copy()
    count = max(3 if closed else 2, math.floor(total / spacing + 0.5))
    target = np.arange(count) * (total / (count if closed else count - 1))
    if not closed:
        target[-1] = total
    at = np.clip(np.searchsorted(arc[1:], target, side="left"), 0, len(step) - 1)
    t = np.clip((target - arc[at]) / np.where(step[at] == 0, 1, step[at]), 0, 1)
    return ring[at] + (ring[at + 1] - ring[at]) * t[:, None]


def path_length(path: np.ndarray, closed: bool) -> float:
    ring = np.vstack([path, path[:1]]) if closed and len(path) > 1 else path
    return float(np.sqrt((np.diff(ring, axis=0) ** 2).sum(axis=1)).sum())


def polyline_distance(points: np.ndarray, line: np.ndarray, closed: bool) -> np.ndarray:
    """Each point's distance to the nearest segment of a polyline."""
    if len(line) < 2:
        return np.full(len(points), np.inf)
    a, b = (line, np.roll(line, -1, axis=0)) if closed else (line[:-1], line[1:])
    return point_segment_distance(points[:, None, :], a[None], b[None]).min(axis=1)


def least_distances(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """Each point's distance to the nearest of some segments; those that are
    no number are passed over. ``cells`` bounds what is held at once."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    safe = np.where(len2 == 0, 1.0, len2)
    some = max(1, cells // max(1, len(ax)))
    out = [np.zeros(0)]
    for k in range(0, len(x), some):
        px, py = x[k : k + some, None], y[k : k + some, None]
        t = np.clip(((px - ax) * dx + (py - ay) * dy) / safe, 0.0, 1.0)  # 0 on a segment of no length
        ex, ey = ax + t * dx - px, ay + t * dy - py
        out.append(np.sqrt(np.fmin.reduce(ex * ex + ey * ey, axis=1)))
    return np.concatenate(out)


def keeps_within(points: np.ndarray, line: np.ndarray, reach: float, some: int = 16) -> bool:
    """Whether all points lie within ``reach`` of a closed line, as by
    ``polyline_distance``. The nearest vertex bounds a point's distance from
    above and, less half of the longest segment, from below; only what that
    leaves open is measured. Every ``some``-th point goes first."""
    half = np.sqrt(((np.roll(line, -1, axis=0) - line) ** 2).sum(axis=1).max()) / 2
    for part in (points[::some], points):
        d = np.sqrt(((part[:, None, 0] - line[:, 0]) ** 2 + (part[:, None, 1] - line[:, 1]) ** 2).min(axis=1))
        if (d > reach + half + 1e-6).any():
            return False
    unsure = points[~(d <= reach - 1e-6)]
    return not len(unsure) or bool(polyline_distance(unsure, line, True).max() <= reach)


def route_deviation(route: np.ndarray, ring: np.ndarray, spacing: float) -> tuple[float, float]:
    """(mean, max) distance between a route and a ring, sampled both ways."""
    d = np.concatenate(
        [
            polyline_distance(resample(route, spacing, False), ring, True),
            polyline_distance(resample(ring, spacing, True), route, False),
        ]
    )
    return (float(d.mean()), float(d.max())) if len(d) else (0.0, 0.0)


def simplify(path: np.ndarray, tolerance: float, closed: bool) -> np.ndarray:
    """Boolean mask of the vertices that Douglas-Peucker keeps. A ring keeps
    its first vertex and is split at the one farthest from it."""
    n = len(path)
    if n < 3 or tolerance <= 0:
        return np.ones(n, dtype=bool)
    line = np.vstack([path, path[:1]]) if closed else path
    keep = np.zeros(len(line), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(line) - 1)]
    if closed:
        far = 1 + int(((path[1:] - path[0]) ** 2).sum(axis=1).argmax())
        keep[far] = True
        spans = [(0, far), (far, n)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d = point_segment_distance(line[a + 1 : b], line[a], line[b])
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep[:n]


def corners(path: np.ndarray, min_turn: float, min_spacing: float) -> list[tuple[int, float]]:
    """(index, turn) of a ring's joints over ``min_turn``; the closest pair of
    neighbours under ``min_spacing`` merges into its sharper one, repeatedly."""
    if len(path) < 3:
        return []
    d = np.roll(path, -1, axis=0) - path
    length = np.sqrt((d * d).sum(axis=1))
    u = d / np.where(length == 0, 1, length)[:, None]
    turns = np.arccos(np.clip((np.roll(u, 1, axis=0) * u).sum(axis=1), -1, 1))
    kept = [(int(i), float(turns[i])) for i in np.flatnonzero(turns > min_turn)]
    while len(kept) > 1:
        at = path[[i for i, _ in kept]]
        gaps = np.sqrt(((np.roll(at, -1, axis=0) - at) ** 2).sum(axis=1))
        k = int(gaps.argmin())
        if gaps[k] >= min_spacing:
            break
        other = (k + 1) % len(kept)
        loser = other if kept[k][1] >= kept[other][1] else k
        kept.pop(loser)
    return kept


def greedy(rows: Sequence, clash: Callable[[object, object], bool], limit: int | None = None) -> list[int]:
    """Numbers of the rows that clash with no earlier chosen one, in order."""
    chosen: list[int] = []
    for i, row in enumerate(rows):
        if limit is not None and len(chosen) >= limit:
            break
        if not any(clash(rows[k], row) for k in chosen):
            chosen.append(i)
    return chosen


def angle_delta(a: float, b: float) -> float:
    d = math.fmod(abs(a - b), 2 * math.pi)
    return 2 * math.pi - d if d > math.pi else d


def same_pose(distance_m: float, rotation_rad: float) -> Callable[[tuple, tuple], bool]:
    """Clash of poses (x, y, rotation, ...): close in both place and rotation."""
    return lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]) <= distance_m and angle_delta(a[2], b[2]) <= rotation_rad


def spread(rows: Sequence[tuple], distance_m: float, count: int) -> list[int]:
    """Up to ``count`` rows: first those ``distance_m`` apart from each other,
    in order, then the next ones whatever their distance."""
    far = greedy(rows, lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]) < distance_m, count)
    rest = [i for i in range(len(rows)) if i not in set(far)]
    return far + rest[: count - len(far)]


def discrete_frechet(a: np.ndarray, b: np.ndarray) -> float:
    """By anti-diagonals of the table of couplings: each needs only the two before."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    d = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))
    before = last = np.full(n + 1, np.inf)  # by row + 1; row 0 is outside
    for k in range(n + m - 1):
        rows = np.arange(max(0, k - m + 1), min(n, k + 1))
        reach = np.minimum(np.minimum(last[rows], last[rows + 1]), before[rows])
        if k == 0:
            reach = np.zeros(1)
        now = np.full(n + 1, np.inf)
        now[rows + 1] = np.maximum(reach, d[rows, k - rows])
        before, last = last, now
    return float(last[n])


#: Pairs of curves that share the steps of ``discrete_frechets``.
CURVES = 64


def discrete_frechets(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """``discrete_frechet`` of many pairs, some at a time: an anti-diagonal of
    all their tables is one step. A table is padded at its ends, which no
    coupling before them reads."""
    out = [0.0] * len(pairs)
    order = sorted((k for k, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda k: len(pairs[k][0]) + len(pairs[k][1]))
    for at in range(0, len(order), CURVES):
        some = order[at : at + CURVES]
        n, m = (max(len(pairs[k][s]) for k in some) for s in (0, 1))
        ax, ay, bx, by = (np.zeros((size, len(some))) for size in (n, n, m, m))
        ends: dict[int, list[tuple[int, int]]] = {}
        for j, k in enumerate(some):
            a, b = pairs[k]
            ax[: len(a), j], ay[: len(a), j] = a.T
            bx[m - len(b) :, j], by[m - len(b) :, j] = b[::-1].T  # backwards: an anti-diagonal is a slice of both
            ends.setdefault(len(a) + len(b) - 2, []).append((j, k))
        before, last, now = (np.full((n + 1, len(some)), np.inf) for _ in range(3))
        for step in range(max(ends) + 1):
            low, high = max(0, step - m + 1), min(n, step + 1)
            back = slice(m - 1 - step + low, m - 1 - step + high)
            d = np.sqrt((ax[low:high] - bx[back]) ** 2 + (ay[low:high] - by[back]) ** 2)
            if step:
                reach = np.minimum(last[low:high], last[low + 1 : high + 1])
                d = np.maximum(np.minimum(reach, before[low:high]), d)
            now[: low + 1] = np.inf
            now[low + 1 : high + 1] = d
            for j, k in ends.get(step, ()):
                out[k] = float(now[len(pairs[k][0]), j])
            before, last, now = last, now, before
    return out


def curves_to_ring(route: np.ndarray, ring: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """The samples of a route and of a ring that starts nearest to the route's start."""
    a, b = resample(route, spacing, False), resample(ring, spacing, True)
    if not len(a) or not len(b):
        return a, b
    return a, np.roll(b, -int(((b - a[0]) ** 2).sum(axis=1).argmin()), axis=0)


def frechet_to_ring(route: np.ndarray, ring: np.ndarray, spacing: float) -> float:
    """Discrete Frechet distance to a ring that starts nearest to the route's start."""
    return discrete_frechet(*curves_to_ring(route, ring, spacing))


def distance_transform(source: np.ndarray, reach: int | None = None) -> np.ndarray:
    """Exact squared distances, in cells, to the nearest true cell of a grid;
    infinite without any, and beyond ``reach`` cells. Down the columns by
    running minima, then along the rows as a lower envelope."""
    height, width = source.shape
    out = np.full(source.shape, np.inf)
    if not source.any():
        return out
    big = float(height + width + 1)
    column = np.where(source, 0.0, big)
    for y in range(1, height):
        column[y] = np.minimum(column[y], column[y - 1] + 1)
    for y in range(height - 2, -1, -1):
        column[y] = np.minimum(column[y], column[y + 1] + 1)
    column = np.where(column >= big, np.inf, column * column)
    for shift in range(width if reach is None else min(width, reach + 1)):
        # The source column ``shift`` away on either side.
        out[:, shift:] = np.minimum(out[:, shift:], column[:, : width - shift] + shift * shift)
        out[:, : width - shift] = np.minimum(out[:, : width - shift], column[:, shift:] + shift * shift)
        if shift and (out <= (shift + 1) ** 2).all():
            break
    if reach is not None:
        out[out > reach * reach] = np.inf
    return out


def posed_costs(
    samples: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray, s: np.ndarray, grid: np.ndarray, at: tuple, size: float, cell_m: float, scale: float,
    threshold_m: float, cap_m: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(costs, longest holes) of poses (x, y, cosine, sine of the rotation) of
    one outline's samples (x, y, hx, hy, spacing) in the order of the ring.

    ``grid[layer, y, x]`` has squared distances in cells, -1 for none, of cells
    of ``size`` metres from cell (at[2], at[3]) of the raster at (at[0], at[1]).
    Samples without a place or heading are infinitely far.
    """
    px, py, hx, hy, spacing = (v[None, :] for v in samples.T)
    x, y, c, s = (v[:, None] for v in (x, y, c, s))
    layers, height, width = grid.shape
    with np.errstate(invalid="ignore"):
        cx = np.floor((scale * (px * c - py * s) + x - at[0]) / size) - at[2]
        cy = np.floor((scale * (px * s + py * c) + y - at[1]) / size) - at[3]
        heading = np.arctan2(hx * s + hy * c, hx * c - hy * s)
        layer = np.floor(np.fmod(np.fmod(heading, math.pi) + math.pi, math.pi) / (math.pi / layers) + 0.5) % layers
        known = np.isfinite(cx) & np.isfinite(cy) & np.isfinite(layer)
        layer, cx, cy = (np.where(known, v, 0).astype(np.int64) for v in (layer, cx, cy))
    d2 = np.where(known, grid[layer, cy, cx], -1)
    d = np.where(d2 < 0, np.inf, np.sqrt(np.maximum(d2, 0)) * cell_m)
    cost = np.minimum(d, cap_m).sum(axis=1)
    run, head, longest, street = np.zeros(len(d)), np.zeros(len(d)), np.zeros(len(d)), np.zeros(len(d), dtype=bool)
    for k in range(d.shape[1]):  # a run at the end goes on at the start unless it is the whole ring
        off = d[:, k] > threshold_m
        run = np.where(off, run + spacing[0, k], 0.0)
        head = np.where(street | ~off, head, run)
        longest = np.maximum(longest, run)
        street |= ~off
    return cost, np.maximum(longest, np.where(street & (run > 0), run + head, 0.0))


class Graph:
    """A street graph in memory: node positions and edges with their polylines."""

    def __init__(self, nodes: Sequence[tuple], edges: Sequence[tuple]):
        """nodes: (id, x, y); edges: (id, a, b, length, points)."""
        self.position = {n[0]: (float(n[1]), float(n[2])) for n in nodes}
        self.edges = {e[0]: e for e in edges}
        self.adjacent: dict[object, list[tuple[object, object]]] = {}
        for ident, a, b, _, _ in edges:
            self.adjacent.setdefault(a, []).append((b, ident))
            self.adjacent.setdefault(b, []).append((a, ident))
        self._found: dict[tuple, tuple[float, tuple] | None] = {}
        self._grids: dict[tuple, NodeGrid] = {}

    def grid(self, ids: list, reach: float) -> NodeGrid:
        key = (reach, len(ids), ids[0], ids[-1])
        if key not in self._grids:
            self._grids[key] = NodeGrid(ids, np.array([self.position[i] for i in ids]), reach)
        return self._grids[key]

    def distance(self, a, b) -> float:
        (ax, ay), (bx, by) = self.position[a], self.position[b]
        return math.hypot(ax - bx, ay - by)

    def shortest(self, start, goal) -> tuple[float, tuple] | None:
        """(length, edge ids) of the shortest path; None if there is none."""
        if start == goal:
            return 0.0, ()
        key = (start, goal)
        if key not in self._found:
            self._found[key] = self._search(start, goal)
        return self._found[key]

    def _search(self, start, goal):
        best = {start: 0.0}
        via: dict = {}
        done = set()
        heap = [(self.distance(start, goal), 0, start)]
        pushed = 0
        while heap:
            _, _, at = heapq.heappop(heap)
            if at == goal:
                chain = []
                while at != start:
                    at, ident = via[at]
                    chain.append(ident)
                return best[goal], tuple(reversed(chain))
            if at in done:
                continue
            done.add(at)
            for other, ident in self.adjacent.get(at, ()):
                length = best[at] + self.edges[ident][3]
                if other not in done and length < best.get(other, math.inf):
                    best[other] = length
                    via[other] = (at, ident)
                    pushed += 1
                    heapq.heappush(heap, (length + self.distance(other, goal), pushed, other))
        return None

    def reach(self, start, goals, most: float = math.inf) -> dict:
        """{goal: (length, edge ids)} of the shortest paths to all ``goals`` that
        lie within ``most``, in one search; it ends when all are met."""
        best, via, done, left = {start: 0.0}, {}, set(), set(goals)
        heap, pushed = [(0.0, 0, start)], 0
        while heap and left:
            length, _, at = heapq.heappop(heap)
            if at in done or length > most:
                continue
            done.add(at)
            left.discard(at)
            for other, ident in self.adjacent.get(at, ()):
                there = length + self.edges[ident][3]
                if other not in done and there < best.get(other, math.inf):
                    best[other], via[other] = there, (at, ident)
                    pushed += 1
                    heapq.heappush(heap, (there, pushed, other))
        out = {}
        for goal in goals:
            if goal in done:
                chain, at = [], goal
                while at != start:
                    at, ident = via[at]
                    chain.append(ident)
                out[goal] = (best[goal], tuple(reversed(chain)))
        return out

    def polyline(self, start, edge_ids: Sequence) -> list[Point]:
        """The node's position, then the vertices of the edges as walked."""
        out, at = [self.position[start]], start
        for ident in edge_ids:
            _, a, b, _, points = self.edges[ident]
            walked = points if a == at else points[::-1]
            out.extend((float(p[0]), float(p[1])) for p in walked[1:])
            at = b if a == at else a
        return out

    def join(self, waypoints: Sequence[Point], nodes: Sequence) -> list[dict]:
        """Legs between consecutive waypoints: the shortest path between their
        nodes, or a straight gap where a node is missing or unreachable."""
        legs = []
        for (p, q), (a, b) in zip(zip(waypoints, waypoints[1:]), zip(nodes, nodes[1:])):
            found = self.shortest(a, b) if a is not None and b is not None else None
            if found is None:
                legs.append({"points": [p, q], "real": False, "edges": ()})
            else:
                legs.append({"points": self.polyline(a, found[1]), "real": True, "edges": found[1]})
        return legs

    def loop(self, nodes: Sequence) -> tuple[np.ndarray, list[dict]]:
        ring = [*nodes, nodes[0]]
        legs = self.join([self.position[n] for n in ring], ring)
        return leg_points(legs), legs


def leg_points(legs: Sequence[dict]) -> np.ndarray:
    points: list[Point] = []
    for leg in legs:
        points.extend(leg["points"] if not points else leg["points"][1:])
    return np.array(points, dtype=float).reshape(-1, 2)


def retraced_m(legs: Sequence[dict], graph: Graph) -> tuple[float, list[float]]:
    """(total, per leg) length walked again: an edge of n uses counts n - 1
    times, shared evenly by its uses."""
    users: dict[object, list[int]] = {}
    for i, leg in enumerate(legs):
        for ident in leg["edges"]:
            users.setdefault(ident, []).append(i)
    per = [0.0] * len(legs)
    for ident, who in users.items():
        for i in who:
            per[i] += (len(who) - 1) * graph.edges[ident][3] / len(who)
    return sum(per), per


def route_metrics(points: np.ndarray, legs: Sequence[dict], ring: np.ndarray, target_m: float, graph: Graph) -> dict[str, float]:
    """Length, its ratio to ``target_m``, deviations, Frechet distance and
    retraced fraction of a loop against its placed outline."""
    length = path_length(points, False)
    mean, longest = route_deviation(points, ring, 10.0)
    return {
        "length_m": length,
        "length_ratio": length / target_m if target_m else 0.0,
        "mean_deviation_m": mean,
        "max_deviation_m": longest,
        "frechet_m": frechet_to_ring(points, ring, 20.0),
        "retraced_fraction": retraced_m(legs, graph)[0] / length if length else 0.0,
    }


def bar_terms(m: dict[str, float], bar: Bar) -> tuple[float, float, float, float]:
    ratio = m["length_ratio"]
    over = max((bar.ratio_lo - ratio) / bar.ratio_lo, (ratio - bar.ratio_hi) / bar.ratio_hi)
    return (
        m["mean_deviation_m"] / bar.mean_m,
        m["max_deviation_m"] / bar.max_m,
        1 + over if over > 0 else 0.0,
        m["retraced_fraction"] / bar.retrace,
    )


class Skeleton:
    """A loop through anchors: leg k leads from anchor k to the next one.

    ``expected`` are the placed corners, ``found`` the places on streets that
    they resolved to and ``nodes`` the nodes there (None where none is in
    reach: a straight gap stands in). A skeleton never changes; ``moved`` gives
    another that shares all legs but two.
    """

    def __init__(self, expected: Sequence[Point], found: Sequence[Point | None], nodes: Sequence, graph: Graph, legs: Sequence[dict] | None = None):
        self.expected, self.found, self.nodes, self.graph = tuple(expected), tuple(found), tuple(nodes), graph
        self.legs = tuple(self._leg(k) for k in range(len(self.nodes))) if legs is None else tuple(legs)

    def waypoint(self, k: int) -> Point:
        return self.expected[k] if self.found[k] is None else self.found[k]

    def _leg(self, k: int) -> dict:
        after = (k + 1) % len(self.nodes)
        return self.graph.join([self.waypoint(k), self.waypoint(after)], [self.nodes[k], self.nodes[after]])[0]

    def moved(self, k: int, point: Point, node) -> Skeleton:
        """Anchor ``k`` put elsewhere; only the legs at it are searched for."""
        swap = lambda values, v: (*values[:k], v, *values[k + 1 :])
        out = Skeleton(self.expected, swap(self.found, point), swap(self.nodes, node), self.graph, self.legs)
        touched = {k, (k - 1) % len(self.nodes)}
        out.legs = tuple(out._leg(i) if i in touched else leg for i, leg in enumerate(self.legs))
        return out

    def measures(self) -> dict:
        """Length, deviation from the placed corners both ways, gaps, retraced
        length, and each anchor's half of what the legs at it retrace."""
        points = leg_points(self.legs)
        mean, longest = route_deviation(points, np.array(self.expected, dtype=float).reshape(-1, 2), 10.0)
        total, share = retraced_m(self.legs, self.graph)
        return {
            "length_m": path_length(points, False), "mean_m": mean, "max_m": longest,
            "gaps": sum(not leg["real"] for leg in self.legs), "retraced_m": total,
            "anchor_retraced_m": [(share[k - 1] + share[k]) / 2 for k in range(len(share))],
        }


class NodeGrid:
    """Nodes by cells of the reach asked for, so that a probe reads nine cells."""

    def __init__(self, ids: list, xy: np.ndarray, reach: float):
        self.ids, self.xy, self.reach = ids, xy, reach
        self.cells: dict[tuple[int, int], list[int]] = {}
        for i, cell in enumerate(map(tuple, np.floor(xy / reach).astype(int).tolist())):
            self.cells.setdefault(cell, []).append(i)

    def near(self, p: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(numbers, distances) of the nodes in reach, nearest first, then by number."""
        cx, cy = np.floor(np.asarray(p) / self.reach).astype(int).tolist()
        own = sorted(i for x in (cx - 1, cx, cx + 1) for y in (cy - 1, cy, cy + 1) for i in self.cells.get((x, y), ()))
        d = np.sqrt(((self.xy[own] - p) ** 2).sum(axis=1)) if own else np.zeros(0)
        order = [k for k in np.argsort(d, kind="stable").tolist() if d[k] <= self.reach]
        return [own[k] for k in order], d[order]


def match_candidates(p: np.ndarray, grid: NodeGrid, o: MatchOptions) -> list[tuple]:
    """(node, distance) of the nearest nodes in reach that keep their spacing."""
    near, d = grid.near(p)
    rows = [tuple(grid.xy[i]) for i in near]
    picked = greedy(rows, lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]) < o.min_separation_m, o.candidates)
    return [(grid.ids[near[k]], float(d[k])) for k in picked]


def match_loop(ring: np.ndarray, graph: Graph, main: Sequence, o: MatchOptions) -> list | None:
    """Nodes of the cheapest closed walk along a placed outline (Viterbi), or
    None where a sample has no node in reach.

    Every candidate of the first sample is tried as the start that the walk
    must close on; its own emission doesn't count.
    """
    ids = sorted(main)
    if not ids:
        return None
    samples = resample(ring, o.step_m, True)
    grid = graph.grid(ids, o.radius_m)
    states = [match_candidates(p, grid, o) for p in samples]
    if not all(states):
        return None
    costs: dict[tuple, float] = {}

    def hop(a, b) -> float:
        if a == b:
            return 0.0
        key = (a, b) if a < b else (b, a)
        if key not in costs:
            found = graph.shortest(*key) if graph.distance(a, b) <= o.step_m * o.hop_factor else None
            if found is None:
                costs[key] = math.inf
            else:
                over, under = max(0.0, found[0] - o.step_m), max(0.0, o.step_m - found[0])
                costs[key] = min(o.cost_cap, (o.excess_weight * over + o.deficit_weight * under) / o.step_m)
        return costs[key]

    layers = [np.array([[hop(a[0], b[0]) for b in after] for a in before]) for before, after in zip(states, states[1:] + states[:1])]
    walk = closed_walk(layers, [np.array([(d / o.emission_m) ** 2 for _, d in s]) for s in states])
    return None if walk is None else [states[i][k][0] for i, k in enumerate(walk)]


def closed_walk(layers: Sequence[np.ndarray], emission: Sequence[np.ndarray]) -> list[int] | None:
    """The cheapest closed walk through one candidate of each sample, by its
    numbers; None where every walk is infinite.

    ``layers[i]`` has the costs of hops from the candidates of sample i to those
    of the next one, after the last to the first. A min-plus product over the
    layers runs for all starts at once; a start's own emission doesn't count.
    """
    if len(layers) == 1:
        own = np.diagonal(layers[0])
        return [int(own.argmin())] if own.min() < math.inf else None
    total = layers[0] + emission[1][None, :]  # (starts, candidates)
    back = []
    for layer, more in zip(layers[1:-1], emission[2:]):
        reach = total[:, :, None] + layer[None] + more[None, None, :]
        back.append(reach.argmin(axis=1))
        total = reach.min(axis=1)
    closing = total + layers[-1].T
    start, k = np.unravel_index(int(closing.argmin()), closing.shape)
    if closing[start, k] == math.inf:
        return None
    walk = [int(k)]
    for step in reversed(back):
        walk.append(int(step[start, walk[-1]]))
    return [int(start), *reversed(walk)]


class _LoopCost:
    """The sum of the bar's terms of a loop through nodes of a graph.

    Legs are looked up once each; what the bar doesn't ask for (the Frechet
    distance) isn't measured, and no loop is measured twice.
    """

    def __init__(self, graph: Graph, ring: np.ndarray, target_m: float, bar: Bar):
        self.graph, self.ring, self.target_m, self.bar = graph, ring, target_m, bar
        self._legs: dict[tuple, dict] = {}
        self._known: dict[tuple, float] = {}

    def _leg(self, a, b) -> dict:
        if (a, b) not in self._legs:
            at = self.graph.position
            self._legs[a, b] = self.graph.join([at[a], at[b]], [a, b])[0]
        return self._legs[a, b]

    def __call__(self, nodes: tuple) -> float:
        if nodes not in self._known:
            legs = [self._leg(a, b) for a, b in zip(nodes, (*nodes[1:], nodes[0]))]
            points = leg_points(legs)
            length = path_length(points, False)
            mean, longest = route_deviation(points, self.ring, 10.0)
            self._known[nodes] = sum(
                bar_terms(
                    {
                        "length_ratio": length / self.target_m if self.target_m else 0.0,
                        "mean_deviation_m": mean,
                        "max_deviation_m": longest,
                        "retraced_fraction": retraced_m(legs, self.graph)[0] / length if length else 0.0,
                    },
                    self.bar,
                )
            )
        return self._known[nodes]


def prune_spikes(
    nodes: list, graph: Graph, ring: np.ndarray, target_m: float, o: PruneOptions = PruneOptions(), bar: Bar = Bar()
) -> list:
    """The loop without the waypoints that only lengthen it.

    A pass settles the waypoints in order: the next of the open ones is left
    out if the settled and the other open ones alone make a cheaper loop.
    Passes end when one settles all, or with the fewest waypoints allowed.
    """
    cost = _LoopCost(graph, ring, target_m, bar)
    settled: tuple = tuple(nodes)
    for _ in range(o.passes):
        waypoints, settled = settled, ()
        open_ = waypoints
        while open_ and len(settled) + len(open_) > o.min_waypoints:
            head, open_ = open_[:1], open_[1:]
            if not cost(settled + open_) < cost(settled + head + open_):
                settled += head
        settled += open_
        if settled == waypoints:
            break
    return list(settled)


class TooManyCycles(ValueError):
    """The ways form more cycles than can be enumerated."""


def simple_cycles(edges: Sequence[tuple[int, int]], o: RingOptions = RingOptions()) -> list[tuple[int, list[int]]]:
    """(start vertex, edge numbers) of every simple cycle of a multigraph.

    A cycle starts at its least vertex and in the direction whose first edge
    number is below its last; a loop is a cycle by itself.
    """
    adjacent: dict[int, list[tuple[int, int]]] = {}
    found: list[tuple[int, list[int]]] = []

    def add(start: int, path: list[int]) -> None:
        found.append((start, path))
        if len(found) > o.max_cycles:
            raise TooManyCycles(f"more than {o.max_cycles} candidate laps")

    for i, (u, v) in enumerate(edges):
        if u == v:
            add(u, [i])
        else:
            adjacent.setdefault(u, []).append((i, v))
            adjacent.setdefault(v, []).append((i, u))
    steps = 0
    for start in sorted(adjacent):
        # Frames of (vertex, iterator over its edges), depth first.
        seen, path = {start}, []
        frames = [iter(adjacent[start])]
        trail = [start]
        while frames:
            edge, other = next(frames[-1], (None, None))
            if edge is None:
                frames.pop()
                seen.discard(trail.pop())
                if path:
                    path.pop()
                continue
            steps += 1
            if steps > o.max_steps:
                raise TooManyCycles(f"more than {o.max_steps} steps")
            if other == start and path:
                if path[0] < edge:
                    add(start, [*path, edge])
            elif other > start and other not in seen:
                seen.add(other)
                path.append(edge)
                trail.append(other)
                frames.append(iter(adjacent[other]))
    return found


# --- refining a pose ------------------------------------------------------------


def closed_turning(lines: np.ndarray) -> np.ndarray:
    """Turning from the first segment to each one of closed lines (k, n, 2)."""
    d = np.roll(lines, -1, axis=1) - lines
    before, after = d[:, :-1], d[:, 1:]
    cross = before[..., 0] * after[..., 1] - before[..., 1] * after[..., 0]
    dot = before[..., 0] * after[..., 0] + before[..., 1] * after[..., 1]
    return np.concatenate([np.zeros((len(lines), 1)), np.cumsum(np.arctan2(cross, dot), axis=1)], axis=1)


def similarity_residuals(lines: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """RMS residual of the least-squares similarity of each line (k, n, 2) onto the points ``onto`` (n, 2)."""
    f, t = lines - lines.mean(axis=1, keepdims=True), onto - onto.mean(axis=0)
    a, b = (f * t).sum(axis=(1, 2)), (f[..., 0] * t[:, 1] - f[..., 1] * t[:, 0]).sum(axis=1)
    ff, tt, mag = (f * f).sum(axis=(1, 2)), (t * t).sum(), np.hypot(a, b)
    some = (ff > 0) & (mag > 0)
    size = np.where(some, mag / np.where(some, ff, 1.0), 1.0)
    return np.sqrt(np.maximum(0.0, size * size * ff - 2 * size * mag + tt) / lines.shape[1])


def best_neighbour(samples: np.ndarray, pose: tuple, segs: np.ndarray, offsets: np.ndarray, scale: float, o) -> tuple:
    """(step, x, y, rotation, coverage, mean, max, score) of the best of the
    poses at ``offsets`` (dx, dy, turn) from ``pose`` (x, y, rotation), scored
    as by ``matching.score_poses``.

    ``samples`` has (x, y, hx, hy) of the outline, ``segs`` (ax, ay, bx, by) the
    streets in reach, in the order in which equally near ones are taken. Poses
    of one turn share the test of which streets run along a sample.
    """
    tx, ty, rotation = pose
    own, heads = samples[:, :2], samples[:, 2:]
    n, m, reach = len(offsets), len(samples), o.search_m
    radius = np.sqrt((own * own).sum(axis=1).max())
    near_x, near_y = np.minimum(segs[:, 0], segs[:, 2]), np.minimum(segs[:, 1], segs[:, 3])
    far_x, far_y = np.maximum(segs[:, 0], segs[:, 2]), np.maximum(segs[:, 1], segs[:, 3])
    d, places, feet = np.full((n, m), float(reach)), np.empty((n, m, 2)), np.empty((n, m, 2))
    for turn in np.unique(offsets[:, 2]):
        rows = np.flatnonzero(offsets[:, 2] == turn)
        c, s = math.cos(rotation + turn), math.sin(rotation + turn)
        x, y = scale * (own[:, 0] * c - own[:, 1] * s), scale * (own[:, 0] * s + own[:, 1] * c)
        hx, hy = heads[:, 0] * c - heads[:, 1] * s, heads[:, 0] * s + heads[:, 1] * c
        at = np.stack([x + (tx + offsets[rows, 0])[:, None], y + (ty + offsets[rows, 1])[:, None]], axis=2)
        places[rows] = feet[rows] = at
        low, high = at.min(axis=0) - reach, at.max(axis=0) + reach
        (x0, y0), (x1, y1) = low.min(axis=0), high.max(axis=0)
        some = np.flatnonzero((near_x <= x1) & (far_x >= x0) & (near_y <= y1) & (far_y >= y0))
        if not len(some):
            continue
        part = segs[some]
        way = part[:, 2:] - part[:, :2]
        length2 = (way * way).sum(axis=1)
        both = np.sqrt(length2) * np.sqrt(hx * hx + hy * hy)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            along = np.abs((hx[:, None] * way[:, 0] + hy[:, None] * way[:, 1]) / both) >= math.cos(o.align_rad)
        along |= ((hx == 0) & (hy == 0))[:, None]
        along &= (near_x[some] <= high[:, 0, None]) & (far_x[some] >= low[:, 0, None])
        along &= (near_y[some] <= high[:, 1, None]) & (far_y[some] >= low[:, 1, None])
        own_s, own_g = np.nonzero(along)
        if not len(own_s):
            continue
        a, v = part[own_g, :2], way[own_g]
        p = at[:, own_s]
        safe = np.where(length2[own_g] == 0, 1.0, length2[own_g])
        t = ((p[..., 0] - a[:, 0]) * v[:, 0] + (p[..., 1] - a[:, 1]) * v[:, 1]) / safe
        t = np.where(length2[own_g] == 0, 0.0, np.clip(t, 0.0, 1.0))
        fx, fy = a[:, 0] + t * v[:, 0], a[:, 1] + t * v[:, 1]
        gap = np.sqrt((fx - p[..., 0]) ** 2 + (fy - p[..., 1]) ** 2)
        starts = np.flatnonzero(np.r_[True, own_s[1:] != own_s[:-1]])
        least = np.minimum.reduceat(gap, starts, axis=1)
        held = np.repeat(least, np.diff(np.r_[starts, len(own_s)]), axis=1)
        first = np.minimum.reduceat(np.where(gap == held, np.arange(len(own_s)), len(own_s) - 1), starts, axis=1)
        i, j = np.nonzero(least < reach)
        to, which = (rows[i], own_s[starts][j]), (i, first[i, j])
        d[to] = least[i, j]
        feet[to] = np.stack([fx[which], fy[which]], axis=1)
    coverage = (d < o.near_m).mean(axis=1)
    score = coverage - 1
    fit = np.flatnonzero(coverage >= o.min_coverage) if m > 1 else np.zeros(0, dtype=int)
    if len(fit):
        turning = np.std(closed_turning(places[fit]) - closed_turning(feet[fit]), axis=1)
        residual = similarity_residuals(feet[fit], own)
        score[fit] = coverage[fit] - o.w_turning * turning - o.w_procrustes * (residual / radius if radius > 0 else residual)
    k = int(np.argmax(score))
    dx, dy, dr = offsets[k].tolist()
    return k, tx + dx, ty + dy, rotation + dr, float(coverage[k]), float(d[k].mean()), float(d[k].max()), float(score[k])
