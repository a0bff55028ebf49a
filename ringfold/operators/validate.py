"""Validation: an ``error`` column with the first problem of each record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..params import (
    BBOX_EPSILON,
    COORDINATE_EPSILON,
    LENGTH_TOLERANCE,
    MAX_SCALE,
    MIN_CENTRELINE_POINTS,
    MIN_ROUTE_POINTS,
    MIN_SCALE,
    PIT_NAME,
    REGIONS,
    RUNNABLE_CLASSES,
)

REGION_IDS = [r[0] for r in REGIONS]


def first_error(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first check that isn't true; null if all hold."""
    none = F.lit(None).cast("string")
    text = lambda m: F.lit(m) if isinstance(m, str) else m
    return reduce(lambda rest, c: F.when(~F.coalesce(c[0], F.lit(False)), text(c[1])).otherwise(rest), checks[::-1], none)


def fail_on_error(df: DataFrame, error: str = "error") -> DataFrame:
    """``df`` without the column, or an error as soon as a row has one."""
    ok = F.when(F.col(error).isNull(), F.lit(True)).otherwise(F.raise_error(F.col(error)).cast("boolean"))
    return df.where(ok).drop(error)


def non_empty(s: Column) -> Column:
    return s.isNotNull() & (F.trim(s) != "")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != g.INF)


def inside_box(lon: Column, lat: Column, box: Column) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def lonlat_pair(p: Column) -> Column:
    return (F.size(p) == 2) & finite(p[0]) & finite(p[1]) & p[0].between(-180, 180) & p[1].between(-90, 90)


def attribution_error(a: Column, where: Column) -> Column:
    keys = ("source", "license", "url", "retrieved")
    named = [(non_empty(a[k]), F.concat(where, F.lit(f" attribution.{k} must be a non-empty string"))) for k in keys]
    return first_error((a.isNotNull(), F.concat(where, F.lit(" must have an attribution object"))), *named)


def _same_place(p: Column, q: Column) -> Column:
    return (F.abs(p[0] - q[0]) < COORDINATE_EPSILON) & (F.abs(p[1] - q[1]) < COORDINATE_EPSILON)


def centreline_error(c: Column, where: Column) -> Column:
    bad = F.filter(F.transform(c, lambda p, i: F.when(~F.coalesce(lonlat_pair(p), F.lit(False)), i)), lambda i: i.isNotNull())
    repeats = F.filter(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - 1)),
        lambda i: F.coalesce(_same_place(F.get(c, i - 1), F.get(c, i)), F.lit(False)),
    )
    return first_error(
        (c.isNotNull() & (F.size(c) >= MIN_CENTRELINE_POINTS), F.concat(where, F.lit(f" centreline must have at least {MIN_CENTRELINE_POINTS} points"))),
        (F.size(bad) == 0, F.concat(where, F.lit(" centreline point "), F.get(bad, 0).cast("string"), F.lit(" is out of range"))),
        (~_same_place(F.get(c, 0), F.element_at(c, -1)), F.concat(where, F.lit(" centreline must be an open ring (first point repeated at the end)"))),
        (F.size(repeats) == 0, F.concat(where, F.lit(" centreline has a repeated point at "), F.get(repeats, 0).cast("string"))),
    )


def ring_length(points: Column) -> Column:
    """Metres around an array of [lon, lat], about its own mean."""
    n = F.size(points)
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / n
    at = F.struct(mean(0).alias("lon"), mean(1).alias("lat"))

    def total(o: Column) -> Column:
        xy = F.transform(points, lambda p: g.to_local(p[0], p[1], o["lon"], o["lat"]))
        step = lambda v, i: g.distance(F.get(v, i)["x"], F.get(v, i)["y"], F.get(v, (i + 1) % n)["x"], F.get(v, (i + 1) % n)["y"])
        return F.get(
            F.transform(F.array(xy), lambda v: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + step(v, i))), 0
        )

    return F.get(F.transform(F.array(at), total), 0)


def circuit_errors(circuits: DataFrame) -> DataFrame:
    """``circuits`` (pos and the record's fields) with ``error``."""
    where = F.concat(F.lit("circuit at index "), F.col("pos").cast("string"))
    copy = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    c = circuits.withColumn("__copy", copy)
    own = ring_length(F.col("centreline"))
    off = F.when(F.col("officialLengthM") > 0, own / F.col("officialLengthM"))
    attribution = attribution_error(F.col("attribution"), where)
    centreline = centreline_error(F.col("centreline"), where)
    official = F.col("officialLengthM")
    error = F.coalesce(
        first_error(
            (non_empty(F.col("id")), F.concat(where, F.lit(" must have a non-empty string id"))),
            (non_empty(F.col("name")), F.concat(where, F.lit(" must have a non-empty string name"))),
            (F.col("__copy") == 1, F.concat(F.lit("duplicate circuit id: "), F.col("id"))),
            (F.col("location").isNotNull(), F.concat(where, F.lit(" must have a location object"))),
            (finite(F.col("location.lat")) & F.col("location.lat").between(-90, 90), F.concat(where, F.lit(" has an invalid latitude"))),
            (finite(F.col("location.lon")) & F.col("location.lon").between(-180, 180), F.concat(where, F.lit(" has an invalid longitude"))),
            (finite(official) & (official > 0), F.concat(where, F.lit(" must have a positive officialLengthM"))),
        ),
        attribution,
        centreline,
        first_error(
            (
                off.between(1 - LENGTH_TOLERANCE, 1 + LENGTH_TOLERANCE),
                F.concat(where, F.lit(" projected centreline length is not within 20% of officialLengthM")),
            )
        ),
    )
    return c.withColumn("error", error).drop("__copy")


def _way_error(w: Column, k: Column, box: Column, grid: Column) -> Column:
    """First problem of one encoded way, in a single fold over its points."""
    where = F.concat(F.lit("street network way "), k.cast("string"))
    whole = lambda v: finite(v) & (v == F.floor(v))

    def step(s: Column, i: Column) -> Column:
        moved = F.struct((s["x"] + F.get(w, 2 * i)).alias("x"), (s["y"] + F.get(w, 2 * i + 1)).alias("y"))

        def judge(m: Column) -> Column:
            lon, lat = box[0] + m["x"] * grid, box[1] + m["y"] * grid
            inside = lon.between(box[0] - BBOX_EPSILON, box[2] + BBOX_EPSILON) & lat.between(box[1] - BBOX_EPSILON, box[3] + BBOX_EPSILON)
            still = (i > 0) & (F.abs(m["x"] - s["x"]) * grid < COORDINATE_EPSILON) & (F.abs(m["y"] - s["y"]) * grid < COORDINATE_EPSILON)
            return F.struct(
                m["x"].alias("x"), m["y"].alias("y"),
                F.when((s["out"] < 0) & ~inside, i).otherwise(s["out"]).alias("out"),
                F.when((s["still"] < 0) & still, i).otherwise(s["still"]).alias("still"),
            )

        return F.get(F.transform(F.array(moved), judge), 0)

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(-1).alias("out"), F.lit(-1).alias("still"))
    pairs = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(w) / 2).cast("int") - 1))
    shape = (F.size(w) >= 4) & (F.size(w) % 2 == 0) & F.forall(w, whole)
    walked = F.when(shape, F.aggregate(pairs, start, step))
    return F.get(
        F.transform(
            F.array(walked),
            lambda r: first_error(
                (r.isNotNull(), F.concat(where, F.lit(" must be an even-length array of at least 4 integers"))),
                (r["out"] < 0, F.concat(where, F.lit(" point "), r["out"].cast("string"), F.lit(" lies outside the bbox"))),
                (r["still"] < 0, F.concat(where, F.lit(" has a repeated point at "), r["still"].cast("string"))),
            ),
        ),
        0,
    )


def network_errors(networks: DataFrame) -> DataFrame:
    """Networks (bbox, grid, attribution, ways) with ``error``. Ways are
    checked as rows of their own, so that a large file spreads over tasks."""
    box, grid, ways = F.col("bbox"), F.col("grid"), F.col("ways")
    head = first_error(
        (box.isNotNull() & (F.size(box) == 4) & F.forall(box, finite), "street network bbox must be four finite numbers"),
        (box[0] < box[2], "street network bbox west must be < east"),
        (box[1] < box[3], "street network bbox south must be < north"),
        (finite(grid) & (grid > 0), "street network grid must be a positive number"),
    )
    some = first_error((ways.isNotNull() & (F.size(ways) > 0), "street network ways must be a non-empty array"))
    n = networks.withColumn("__error", F.coalesce(head, attribution_error(F.col("attribution"), F.lit("street network")), some))
    n = n.withColumn("__id", F.xxhash64(*networks.columns))
    each = n.where("__error is null").select("__id", "bbox", "grid", F.posexplode("ways").alias("__k", "__w"))
    each = each.withColumn("__e", _way_error(F.col("__w"), F.col("__k"), box, grid)).where("__e is not null")
    first = each.groupBy("__id").agg(F.min_by("__e", "__k").alias("__e"))
    return n.join(first, "__id", "left").withColumn("error", F.coalesce("__error", "__e")).drop("__error", "__e", "__id")


def route_file_errors(route_files: DataFrame, circuit_ids: DataFrame) -> DataFrame:
    """Parsed route files with ``error``; ``circuit_ids`` (id) are the known circuits."""
    known = circuit_ids.select(F.col("id").alias("__known")).distinct()
    f = route_files.join(known, F.col("circuitId") == F.col("__known"), "left")
    bar, regions, routes = F.col("generator.bar"), F.col("regions"), F.col("routes")
    region_error = F.get(
        F.filter(
            F.transform(
                regions,
                lambda r, i: first_error(
                    (r["id"].isin(*REGION_IDS), F.concat(F.lit("regions["), i.cast("string"), F.lit("].id must be a known region id"))),
                    (finite(r["poses"]) & (r["poses"] >= 0), F.concat(F.lit("regions["), i.cast("string"), F.lit("].poses must be a non-negative finite number"))),
                    (r["escalationTier"].isin(0, 1, 2), F.concat(F.lit("regions["), i.cast("string"), F.lit("].escalationTier must be 0, 1, or 2"))),
                ),
            ),
            lambda e: e.isNotNull(),
        ),
        0,
    )

    def route_error(r: Column, i: Column) -> Column:
        where = F.concat(F.lit("route at index "), i.cast("string"))
        expected = F.size(F.filter(F.slice(routes, 1, i + 1), lambda o: o["region"] == r["region"]))
        metrics = r["metrics"]
        names = ("lengthM", "lengthRatio", "meanDeviationM", "maxDeviationM", "frechetM", "retracedFraction")
        return first_error(
            (r["region"].isin(*REGION_IDS), F.concat(where, F.lit(".region must be a known region id"))),
            (
                r["rank"] == expected,
                F.concat(where, F.lit(" must have rank "), expected.cast("string"), F.lit(" (routes must be ranked 1..n, in order, within each region)")),
            ),
            (r["passesBar"].isNotNull(), F.concat(where, F.lit(".passesBar must be a boolean"))),
            (lonlat_pair(r["pose"]["anchor"]), F.concat(where, F.lit(".pose.anchor must be a [lon, lat] pair"))),
            (finite(r["pose"]["rotationRad"]), F.concat(where, F.lit(".pose.rotationRad must be a finite number"))),
            (F.size(r["points"]) >= MIN_ROUTE_POINTS, F.concat(where, F.lit(f".points must have at least {MIN_ROUTE_POINTS} points"))),
            (F.forall(r["points"], lonlat_pair), F.concat(where, F.lit(".points must be [lon, lat] pairs"))),
            *[(finite(metrics[n]), F.concat(where, F.lit(f".metrics.{n} must be a finite number"))) for n in names],
            (
                F.exists(regions, lambda g_: g_["id"] == r["region"]),
                F.concat(where, F.lit(' has region "'), r["region"], F.lit('" not listed in route file regions')),
            ),
        )

    routes_error = F.get(F.filter(F.transform(routes, route_error), lambda e: e.isNotNull()), 0)
    error = F.coalesce(
        first_error(
            (F.col("schemaVersion") == 2, "route file schemaVersion must be 2"),
            (non_empty(F.col("circuitId")), "route file must have a non-empty circuitId"),
            (F.col("__known").isNotNull(), F.concat(F.lit('route file circuitId "'), F.col("circuitId"), F.lit('" does not match any bundled circuit'))),
            (F.col("generatedAt").rlike(r"^\d{4}-\d{2}-\d{2}$"), "route file generatedAt must be a YYYY-MM-DD string"),
            (finite(F.col("scale")) & (F.col("scale") > 0), "route file scale must be a positive finite number"),
            *[(finite(bar[k]), f"route file generator.bar.{k} must be a finite number") for k in ("meanM", "maxM", "ratioLo", "ratioHi", "retrace")],
            (F.size(regions) > 0, "route file regions must be a non-empty array"),
        ),
        region_error,
        first_error((F.size(F.array_distinct(F.transform(regions, lambda r: r["id"]))) == F.size(regions), "route file regions must not repeat a region id")),
        attribution_error(F.col("streets"), F.lit("route file streets")),
        first_error((F.size(routes) > 0, "route file routes must be a non-empty array")),
        routes_error,
    )
    return f.withColumn("error", error).drop("__known")


def placement_error(p: Column, where: Column) -> Column:
    """First problem of a saved placement (versions 1 and 2)."""
    say = lambda m: F.concat(where, F.lit(m))
    route = p["route"]
    return first_error(
        (p.isNotNull(), say(" must be an object")),
        (p["schemaVersion"].isin(1, 2), say(" schemaVersion must be one of 1, 2")),
        (non_empty(p["circuitId"]), say(" circuitId must be a non-empty string")),
        (lonlat_pair(p["anchor"]), say(" anchor must be [lon, lat] within valid ranges")),
        (finite(p["rotationRad"]), say(" rotationRad must be a finite number")),
        (finite(p["scale"]) & p["scale"].between(MIN_SCALE, MAX_SCALE), say(" scale must be a finite number within [0.5, 3]")),
        (F.try_to_timestamp(p["savedAt"]).isNotNull(), say(" savedAt must be a valid date string")),
        (route.isNull() | (F.size(route) != 1), say(" route must have at least 2 points")),
        (route.isNull() | F.forall(route, lonlat_pair), say(" route must be [lon, lat] within valid ranges")),
    )


def normalise_placement(p: Column) -> Column:
    """Version 2 of a valid placement; a route of no points is none."""
    return F.struct(
        F.lit(2).alias("schemaVersion"), p["circuitId"].alias("circuitId"), p["anchor"].alias("anchor"), p["rotationRad"].alias("rotationRad"),
        p["scale"].alias("scale"), F.when(F.size(p["route"]) >= 2, p["route"]).alias("route"), p["savedAt"].alias("savedAt"),
    )


def valid_placements(stored: DataFrame, *keep: str) -> DataFrame:
    """(keep..., key, placement): the good records of stored maps (key,
    placement), as version 2; others and those under a wrong key are dropped."""
    error = placement_error(F.col("placement"), F.concat(F.lit('placements["'), F.col("key"), F.lit('"]')))
    good = stored.where(error.isNull() & (F.col("placement.circuitId") == F.col("key")))
    return good.select(*keep, "key", normalise_placement(F.col("placement")).alias("placement"))


def is_pit_lane(role: Column, tags: Column) -> Column:
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    any_of = (role == "pit_lane", tag("raceway") == "pit_lane", tag("service") == "pit_lane", tag("name").rlike(PIT_NAME))
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in any_of])


def candidate_ways(ways: DataFrame, exclude: list[int] | DataFrame = ()) -> DataFrame:
    """Ways that are no pit lane and not excluded (ids, or rows (way))."""
    w = ways.where(~is_pit_lane(F.col("role"), F.col("tags")))
    if isinstance(exclude, DataFrame):
        return w.join(exclude.select("way"), "way", "left_anti")
    return w.where(~F.col("way").isin(*exclude)) if exclude else w


def is_runnable(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit("highway")).isin(*RUNNABLE_CLASSES), F.lit(False))
