"""Operators on paths in long form: rows (path_id, seq, x, y).

All are window functions or aggregates over ``path_id``: one shuffle by path,
shared by operators that are chained, and partial aggregation where the
result is one row a path. ``closed`` adds the segment from the last vertex to
the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

KEY, SEQ = "path_id", "seq"


def _order(key: str = KEY, seq: str = SEQ):
    return Window.partitionBy(key).orderBy(seq)


def _whole(key: str = KEY, seq: str = SEQ):
    return _order(key, seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def segments(path: DataFrame, closed: bool, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """(key, seq, ax, ay, bx, by): each vertex with the next one."""
    w, whole = _order(key, seq), _whole(key, seq)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if closed else F.lead(c).over(w)
    s = path.select(
        key, seq, F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by"),
        F.count("*").over(whole).alias("__n"),
    )
    return (s.where("__n > 1") if closed else s.where("bx is not null")).drop("__n")


def _length() -> Column:
    return g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))


def path_length(path: DataFrame, closed: bool = True, key: str = KEY) -> DataFrame:
    """(key, length_m): 0 for a single point."""
    own = segments(path, closed, key).groupBy(key).agg(F.sum(_length()).alias("length_m"))
    return path.select(key).distinct().join(own, key, "left").fillna(0.0, ["length_m"])


def bounds(path: DataFrame, key: str | None = KEY) -> DataFrame:
    """(key, min_x, min_y, max_x, max_y); over all rows without a key."""
    keys = [key] if key else []
    return path.groupBy(*keys).agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y")
    )


def _shoelace(closed: DataFrame, key: str) -> DataFrame:
    w = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return closed.groupBy(key).agg(
        F.sum(w).alias("w"),
        F.sum((F.col("ax") + F.col("bx")) * w).alias("sx"),
        F.sum((F.col("ay") + F.col("by")) * w).alias("sy"),
        F.avg("ax").alias("mx"),
        F.avg("ay").alias("my"),
        F.count("*").alias("n"),
    )


def signed_area(path: DataFrame, key: str = KEY) -> DataFrame:
    """(key, area): positive counter-clockwise, 0 under three vertices."""
    own = _shoelace(segments(path, True, key), key)
    area = F.when(F.col("n") < 3, F.lit(0.0)).otherwise(F.col("w") / 2)
    return path.select(key).distinct().join(own.select(key, area.alias("area")), key, "left").fillna(0.0, ["area"])


def centroid(path: DataFrame, key: str = KEY) -> DataFrame:
    """(key, cx, cy): of the area, or the vertices' mean where that is nil."""
    w, whole = _order(key), _whole(key)
    s = path.select(
        key, F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("bx"),
        F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("by"),
    )
    a = _shoelace(s, key)
    flat = (F.col("n") < 3) | (F.abs(F.col("w") / 2) < 1e-9)
    safe = F.when(flat, F.lit(1.0)).otherwise(3 * F.col("w"))
    return a.select(
        key,
        F.when(flat, F.col("mx")).otherwise(F.col("sx") / safe).alias("cx"),
        F.when(flat, F.col("my")).otherwise(F.col("sy") / safe).alias("cy"),
    )


def recentre(path: DataFrame, key: str = KEY) -> DataFrame:
    """The path with its centroid moved to the origin."""
    c = centroid(path, key)
    moved = path.join(c, key)
    return moved.withColumns({"x": F.col("x") - F.col("cx"), "y": F.col("y") - F.col("cy")}).drop("cx", "cy")


def project_rings(path: DataFrame, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """(key, seq, x, y) in metres about each path's own mean (lon, lat)."""
    w = Window.partitionBy(key)
    p = path.withColumns({"__lon": F.avg("lon").over(w), "__lat": F.avg("lat").over(w)})
    p = p.withColumn("p", g.to_local(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat")))
    return p.select(key, seq, "p.x", "p.y")


def cumulative_turning(path: DataFrame, closed: bool = False, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """(key, seq, turning): signed turning from the first segment to each one."""
    w = _order(key, seq)
    d = segments(path, closed, key, seq).select(
        key, seq, (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")
    )
    d = d.withColumns({"px": F.lag("dx").over(w), "py": F.lag("dy").over(w)})
    angle = F.coalesce(g.angle_between(F.col("px"), F.col("py"), F.col("dx"), F.col("dy")), F.lit(0.0))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("angle", angle).select(key, seq, F.sum("angle").over(running).alias("turning"))


def turning_distance(pairs: DataFrame, key: str = KEY) -> DataFrame:
    """(key, distance): RMS of a - b about its mean, over rows (key, a, b)."""
    return pairs.groupBy(key).agg(F.sqrt(F.var_pop(F.col("a") - F.col("b"))).alias("distance"))


def cumulative_length(path: DataFrame, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """The path with ``arc_m``, the length walked to each vertex."""
    w = _order(key, seq)
    step = g.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn("__d", F.coalesce(step, F.lit(0.0))).withColumn("arc_m", F.sum("__d").over(running)).drop("__d")


def resample(path: DataFrame, spacing_m: float, closed: bool = True, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """(key, seq, x, y) at even arc lengths, ``spacing_m`` apart as nearly as
    a whole number of steps allows.

    The number of points is at least 3 closed and 2 open; an open path keeps
    its end exactly; a path of no length gives its first point. Each segment
    makes its own points, so there is no range join.
    """
    if not spacing_m > 0:
        raise ValueError("spacing_m must be above 0")
    w, whole = _order(key, seq), _whole(key, seq)
    s = segments(path, closed, key, seq).withColumn("len", _length())
    s = s.withColumns(
        {
            "end_m": F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("len").over(whole),
            "first": F.min(seq).over(whole) == F.col(seq),
            "last": F.max(seq).over(whole) == F.col(seq),
        }
    )
    count = F.greatest(F.lit(3 if closed else 2).cast("long"), g.half_up(F.col("total") / spacing_m))
    s = s.withColumn("count", count)
    s = s.withColumn("step", F.col("total") / (F.col("count") if closed else F.col("count") - 1))
    s = s.withColumn("start_m", F.coalesce(F.lag("end_m").over(w), F.lit(0.0))).where("total > 0")
    # Targets i * step in (start, end]; the first segment has 0 too and the last all that is left.
    lo = F.when(F.col("first"), F.lit(0).cast("long")).otherwise(F.floor(F.col("start_m") / F.col("step")) - 1)
    hi = F.when(F.col("last"), F.col("count") - 1).otherwise(F.floor(F.col("end_m") / F.col("step")) + 1)
    s = s.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), lo), F.least(F.col("count") - 1, F.greatest(hi, lo)))))
    target = F.col("i") * F.col("step")
    if not closed:
        target = F.when(F.col("i") == F.col("count") - 1, F.col("total")).otherwise(target)
    s = s.withColumn("target", target)
    inside = (F.col("first") | (F.col("target") > F.col("start_m"))) & (F.col("last") | (F.col("target") <= F.col("end_m")))
    t = F.when(F.col("len") == 0, F.lit(0.0)).otherwise(
        g.clamp((F.col("target") - F.col("start_m")) / F.when(F.col("len") == 0, F.lit(1.0)).otherwise(F.col("len")), 0.0, 1.0)
    )
    some = s.where(inside).withColumn("t", t)
    made = some.select(
        key,
        F.col("i").alias(seq),
        (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("t")).alias("x"),
        (F.col("ay") + (F.col("by") - F.col("ay")) * F.col("t")).alias("y"),
    )
    ranked = path.withColumns(
        {
            "__k": F.row_number().over(w),
            "__flat": (F.min("x").over(whole) == F.max("x").over(whole)) & (F.min("y").over(whole) == F.max("y").over(whole)),
        }
    )
    flat = ranked.where("__flat and __k = 1").select(key, F.lit(0).cast("long").alias(seq), "x", "y")
    return made.unionByName(flat)


def sample_segments(segs: DataFrame, sample_m: float, inclusive: bool, keep: list[str]) -> DataFrame:
    """Points along segments (ax, ay, bx, by) about ``sample_m`` apart with
    their heading: steps + 1 of them, or without the end."""
    steps = F.greatest(F.lit(1).cast("long"), g.half_up(_length() / sample_m))
    s = segs.withColumn("steps", steps)
    last = F.col("steps") if inclusive else F.col("steps") - 1
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("t", F.col("i") / F.col("steps"))
    return s.select(
        *keep, "i", "steps",
        (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("t")).alias("x"),
        (F.col("ay") + (F.col("by") - F.col("ay")) * F.col("t")).alias("y"),
        (F.col("bx") - F.col("ax")).alias("hx"), (F.col("by") - F.col("ay")).alias("hy"),
    )


def directed(path: DataFrame, closed: bool, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """Segments with their length and unit direction (0, 0 without length)."""
    s = segments(path, closed, key, seq).withColumn("len", _length())
    d = g.normalize(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return s.withColumn("d", d).select("*", F.col("d.x").alias("ux"), F.col("d.y").alias("uy")).drop("d")


def joints(path: DataFrame, closed: bool, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """``directed`` with ``turn_rad`` against the segment before (null at an
    open path's first)."""
    w, whole = _order(key, seq), _whole(key, seq)
    prev = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) if closed else F.lag(c).over(w)
    s = directed(path, closed, key, seq).withColumns({"px": prev("ux"), "py": prev("uy")})
    return s.withColumn("turn_rad", g.turn(F.col("px"), F.col("py"), F.col("ux"), F.col("uy"))).drop("px", "py")


def longest_straight(path: DataFrame, max_turn_rad: float = 0.12, closed: bool = True, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """(key, start_index, end_index, length_m, bearing) of the longest run of
    segments whose joints turn by at most ``max_turn_rad``.

    Gaps and islands. On a ring, the run before the first break goes on from
    the one at the end; without any break the ring is one run with the bearing
    of its first segment. Ties go to the lowest start.
    """
    w = _order(key, seq)
    s = joints(path, closed, key, seq)
    broke = F.coalesce(F.col("turn_rad") > max_turn_rad, F.lit(False))
    s = s.withColumn("island", F.sum(broke.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = Window.partitionBy(key)
    s = s.withColumns({"islands": F.max("island").over(runs), "n": F.count("*").over(runs), "s0": F.min(seq).over(runs)})
    s = s.withColumn("i", F.col(seq) - F.col("s0"))
    # On a ring island 0 joins the last island, whose segments come first.
    wraps = (F.col("island") == 0) & (F.col("islands") > 0) if closed else F.lit(False)
    s = s.withColumns({"island": F.when(wraps, F.col("islands")).otherwise(F.col("island")), "at": F.when(wraps, F.col("i") + F.col("n")).otherwise(F.col("i"))})
    r = s.groupBy(key, "island").agg(
        F.sum("len").alias("length_m"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("n").alias("n"),
        F.max("islands").alias("islands"),
        F.min_by(F.struct("ax", "ay", "bx", "by"), "at").alias("head"), F.max_by(F.struct("bx", "by"), "at").alias("tail"),
    )
    vertices = F.col("n") if closed else F.col("n") + 1
    whole_ring = (F.col("islands") == 0) if closed else F.lit(False)
    r = r.select(
        key,
        F.col("lo").alias("start_index"),
        ((F.col("hi") + 1) % vertices).alias("end_index"),
        "length_m",
        F.when(whole_ring, g.bearing(F.col("head.ax"), F.col("head.ay"), F.col("head.bx"), F.col("head.by")))
        .otherwise(g.bearing(F.col("head.ax"), F.col("head.ay"), F.col("tail.bx"), F.col("tail.by")))
        .alias("bearing"),
    )
    rest = [c for c in ("start_index", "end_index", "length_m", "bearing")]
    # Lengths within a nanometre are ties.
    best = F.max_by(F.struct(*rest), F.struct(g.half_up(F.col("length_m") * 1e8), -F.col("start_index")))
    return r.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def clip_to_box(path: DataFrame, box: tuple[float, float, float, float], key: str = KEY, seq: str = SEQ) -> DataFrame:
    """(key, run, seq, x, y): stretches of two or more consecutive vertices
    inside the box (min x, min y, max x, max y)."""
    w = _order(key, seq)
    inside = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    p = path.withColumn("__in", inside)
    p = p.withColumn("run", F.sum((~F.col("__in")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.where("__in").withColumn("__n", F.count("*").over(Window.partitionBy(key, "run")))
    return p.where("__n >= 2").select(key, "run", seq, "x", "y")


def drop_repeats(path: DataFrame, columns: list[str], key: str = KEY, seq: str = SEQ) -> DataFrame:
    """Rows that differ from the row before in any of ``columns``."""
    w = _order(key, seq)
    same = F.lit(True)
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    first = F.row_number().over(w) == 1
    return path.withColumn("__new", first | ~same).where("__new").drop("__new")


def headings(path: DataFrame, span: int = 2, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """The ring with (hx, hy), the chord from ``span`` vertices behind to as
    many ahead. Vertices are numbered 0, 1, ... in ``seq``."""
    ring = path.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seq, "x", "y"))).alias("p"))
    n = F.size("p")
    at = lambda k: F.get("p", F.pmod(F.col("i") + k, n))
    return ring.select(key, "p", F.posexplode("p").alias("i", "v")).select(
        key, F.col(f"v.{seq}").alias(seq), F.col("v.x").alias("x"), F.col("v.y").alias("y"),
        (at(span)["x"] - at(-span)["x"]).alias("hx"), (at(span)["y"] - at(-span)["y"]).alias("hy"),
    )


def fit_similarity(pairs: DataFrame, key: str = KEY) -> DataFrame:
    """(key, scale, rotation, tx, ty, residual): the least-squares similarity
    from (fx, fy) onto (tx, ty) without reflection, and its RMS residual.

    One aggregate: sums about each pair list's first row keep the precision
    that plain moments would lose.
    """
    n = F.count("*")
    cov = lambda a, b: F.covar_pop(a, b) * n
    m = pairs.groupBy(key).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("fx", "fy", "tx", "ty")],
        (cov("fx", "tx") + cov("fy", "ty")).alias("a"),
        (cov("fx", "ty") - cov("fy", "tx")).alias("b"),
        ((F.var_pop("fx") + F.var_pop("fy")) * n).alias("ff"),
        ((F.var_pop("tx") + F.var_pop("ty")) * n).alias("tt"),
        n.alias("n"),
    )
    mag = g.norm(F.col("a"), F.col("b"))
    some = (F.col("ff") > 0) & (mag > 0)
    m = m.withColumns({
        "rotation": F.atan2("b", "a"),
        "scale": F.when(some, mag / F.when(some, F.col("ff")).otherwise(F.lit(1.0))).otherwise(F.lit(1.0)),
    })
    turned = g.rotate(F.col("m_fx"), F.col("m_fy"), F.col("rotation"))
    m = m.withColumn("r", turned)
    # |T f' - t'|^2 summed: s^2 ff - 2 s |(a, b)| + tt.
    sq = F.col("scale") * F.col("scale") * F.col("ff") - 2 * F.col("scale") * mag + F.col("tt")
    return m.select(
        key, "scale", "rotation",
        (F.col("m_tx") - F.col("scale") * F.col("r.x")).alias("tx"),
        (F.col("m_ty") - F.col("scale") * F.col("r.y")).alias("ty"),
        F.sqrt(F.greatest(F.lit(0.0), sq) / F.col("n")).alias("residual"),
    )


def off_street_run(samples: DataFrame, key: list[str], spacing: Column, threshold: float, perimeter: Column, seq: str = "i") -> DataFrame:
    """(key..., max_hole_m): the longest run of samples with ``d`` over the
    threshold, where a run at the end goes on at the start unless it is the
    whole ring. ``spacing`` is what each sample stands for."""
    w = Window.partitionBy(*key).orderBy(seq)
    off = F.coalesce(F.col("d") > threshold, F.lit(False))
    s = samples.withColumns({"off": off, "spacing": spacing, "perimeter": perimeter})
    s = s.withColumn("island", F.sum((~F.col("off")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy(*key)
    s = s.withColumn("islands", F.max("island").over(per))
    r = s.groupBy(*key, "island").agg(
        F.sum(F.col("off").cast("double") * F.col("spacing")).alias("run"), F.max("islands").alias("islands"), F.max("perimeter").alias("perimeter")
    )
    r = r.groupBy(*key).agg(
        F.max("run").alias("longest"),
        F.sum(F.when(F.col("island") == 0, F.col("run")).otherwise(0.0)).alias("head"),
        F.sum(F.when(F.col("island") == F.col("islands"), F.col("run")).otherwise(0.0)).alias("tail"),
        F.max("islands").alias("islands"),
    )
    wrapped = F.when((F.col("islands") > 0) & (F.col("tail") > 0), F.col("tail") + F.col("head")).otherwise(F.lit(0.0))
    return r.select(*key, F.greatest("longest", wrapped).alias("max_hole_m"))
