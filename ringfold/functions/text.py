"""Names, labels, links and documents as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ENTITY_API, MAP_SITE, METRES_PER_DEGREE, RUNNABLE_CLASSES, SLUG_STOP_WORDS, Bar
from .geometry import clamp, half_up

# Latin letters with a canonical decomposition into an ASCII
# letter and marks; normalisation drops the marks.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿŠšŽžČčĚěŘřŮůĀāĒēĪīŌōŪūĂăŞşŢţĞğİŃńŚśŹźŻżĆćŐőŰűĄąĘę"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyySsZzCcEeRrUuAaEeIiOoUuAaSsTtGgINnSsZzZzCcOoUuAaEe"
MARKS = "[\\u0300-\\u036f]"


def fixed(x: Column, decimals: int) -> Column:
    """Text with that many decimals, halves up, built from a whole number."""
    f = 10**decimals
    n = half_up(F.abs(x) * f)
    sign = F.when((x < 0) & (n > 0), F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(n / f).cast("string")
    return F.concat(sign, whole, F.lit("."), F.lpad((n % f).cast("string"), decimals, "0")) if decimals else F.concat(sign, n.cast("string"))


def normalise_name(s: Column) -> Column:
    """Lower case without accents; runs of anything but a-z and 0-9 are a space."""
    plain = F.translate(F.regexp_replace(s, MARKS, ""), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    """Words joined by dashes, without stop words unless nothing else is left."""
    words = F.filter(F.split(normalise_name(name), " "), lambda w: w != "")
    rest = F.filter(words, lambda w: ~w.isin(*SLUG_STOP_WORDS))
    return F.array_join(F.when(F.size(rest) > 0, rest).otherwise(words), "-")


def escape_markup(s: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, s)


def format_distance(m: Column) -> Column:
    return F.when(m >= 1000, F.concat(fixed(m / 1000, 2), F.lit(" km"))).otherwise(F.concat(half_up(m).cast("string"), F.lit(" m")))


def format_km(m: Column) -> Column:
    return F.concat(fixed(m / 1000, 2), F.lit(" km"))


def format_percent(fraction: Column) -> Column:
    """Whole percents, or one decimal where that would hide the figure."""
    pct = fraction * 100
    whole = F.concat(half_up(pct).cast("string"), F.lit(" %"))
    return F.when((pct >= 1) | (pct == 0), whole).otherwise(F.concat(fixed(pct, 1), F.lit(" %")))


def format_duration(ms: Column) -> Column:
    return F.concat(fixed(ms / 60000, 1), F.lit(" min ("), fixed(ms / 1000, 1), F.lit("s)"))


def format_coordinate(v: Column) -> Column:
    return fixed(v, 5)


def format_fraction(f: Column) -> Column:
    return F.concat(half_up(clamp(f, 0.0, 1.0) * 100).cast("string"), F.lit("%"))


def _number(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else repr(v)


def bar_misses(mean: Column, longest: Column, ratio: Column, retraced: Column, bar: Bar = Bar()) -> Column:
    """Array of a sentence for each criterion that a route misses. A figure
    gets one more decimal where it would read like its limit."""

    def metres(v: Column, limit: float) -> Column:
        same = half_up(v) == half_up(F.lit(limit))
        return F.concat(F.when(same, fixed(v, 1)).otherwise(fixed(v, 0)), F.lit(" m"))

    def times(v: Column, limit: Column) -> Column:
        return F.concat(F.when(fixed(v, 2) == fixed(limit, 2), fixed(v, 3)).otherwise(fixed(v, 2)), F.lit("×"))

    def percent(v: Column, limit: float) -> Column:
        same = half_up(v * 100) == half_up(F.lit(limit * 100))
        return F.concat(F.when(same, fixed(v * 100, 1)).otherwise(fixed(v * 100, 0)), F.lit(" %"))

    crossed = F.when(ratio < bar.ratio_lo, F.lit(bar.ratio_lo)).otherwise(F.lit(bar.ratio_hi))
    say = [
        F.when(mean > bar.mean_m, F.concat(F.lit("mean "), metres(mean, bar.mean_m), F.lit(f", limit {_number(bar.mean_m)} m"))),
        F.when(
            longest > bar.max_m,
            F.concat(F.lit("longest deviation "), metres(longest, bar.max_m), F.lit(f", limit {_number(bar.max_m)} m")),
        ),
        F.when(
            (ratio < bar.ratio_lo) | (ratio > bar.ratio_hi),
            F.concat(
                F.lit("length "), times(ratio, crossed), F.lit(f" the circuit, allowed {bar.ratio_lo:.2f}× to {bar.ratio_hi:.2f}×")
            ),
        ),
        F.when(
            retraced > bar.retrace,
            F.concat(
                F.lit("retraces "), percent(retraced, bar.retrace), F.lit(f" of its length, limit {_number(round(bar.retrace * 1000) / 10)} %")
            ),
        ),
    ]
    return F.filter(F.array(*say), lambda s: s.isNotNull())


def picker_line(mean: Column, longest: Column, ratio: Column) -> Column:
    return F.concat(
        half_up(mean).cast("string"), F.lit(" m on average, "), half_up(longest).cast("string"), F.lit(" m at most · "),
        fixed(ratio, 2), F.lit("× the circuit's length"),
    )


def route_length_label(length: Column, circuit: Column) -> Column:
    safe = F.when(circuit > 0, circuit).otherwise(F.lit(1.0))
    pct = F.when(circuit > 0, half_up((length - circuit) / safe * 100)).otherwise(F.lit(0).cast("long"))
    sign = F.when(pct > 0, F.lit("+")).when(pct < 0, F.lit("−")).otherwise(F.lit("±"))
    return F.concat(
        format_distance(length), F.lit(" — circuit "), format_distance(circuit), F.lit(", "), sign, F.abs(pct).cast("string"), F.lit("%")
    )


def deviation_label(mean: Column, longest: Column) -> Column:
    return F.concat(F.lit("~"), half_up(mean).cast("string"), F.lit(" m avg · "), half_up(longest).cast("string"), F.lit(" m max"))


def suggestion_label(coverage: Column, mean: Column) -> Column:
    return F.concat(format_fraction(coverage), F.lit(" on streets · ~"), half_up(mean).cast("string"), F.lit(" m avg"))


def saved_ago(saved: Column, now: Column) -> Column:
    """How long ago a timestamp was; ``now`` is given so that results repeat.
    Both are taken to the nearest second, half ones to the even."""
    whole = lambda t: F.rint(F.unix_micros(t.cast("timestamp")) / 1e6).cast("long")
    secs = F.greatest(F.lit(0).cast("long"), whole(now) - whole(saved))
    unit = lambda n, s: F.concat(F.floor(secs / n).cast("string"), F.lit(s))
    return (
        F.when(saved.isNull(), F.lit("at an unknown time"))
        .when(secs < 60, F.lit("just now"))
        .when(secs < 3600, unit(60, " min ago"))
        .when(secs < 86400, unit(3600, " h ago"))
        .when(secs < 7 * 86400, unit(86400, " d ago"))
        .otherwise(F.concat(F.lit("on "), F.date_format(saved, "yyyy-MM-dd")))
    )


def format_hash(circuit: Column, region: Column, rank: Column) -> Column:
    return F.concat(F.lit("#"), circuit, F.lit("/"), region, F.lit("/"), rank.cast("string"))


def map_link(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit(f"{MAP_SITE}/?mlat="), lat, F.lit("&mlon="), lon, F.lit("#map=16/"), lat, F.lit("/"), lon)


_PART = "[A-Za-z0-9][A-Za-z0-9_-]*"
ROUTE_HASH = rf"^#?({_PART})/({_PART})/([1-9][0-9]*)$"
CIRCUIT_HASH = rf"^#?({_PART})$"


def parse_hash(h: Column) -> Column:
    """struct(circuit, region, rank) of ``#circuit/region/rank``; null for
    anything else and for ranks beyond 2**53."""
    rank = F.try_to_number(F.regexp_extract(h, ROUTE_HASH, 3), F.lit("9" * 18)).cast("long")
    s = F.struct(F.regexp_extract(h, ROUTE_HASH, 1).alias("circuit"), F.regexp_extract(h, ROUTE_HASH, 2).alias("region"), rank.alias("rank"))
    return F.when(h.rlike(ROUTE_HASH) & rank.isNotNull() & (rank <= (1 << 53) - 1), s)


def parse_circuit_hash(h: Column) -> Column:
    return F.when(h.rlike(CIRCUIT_HASH), F.regexp_extract(h, CIRCUIT_HASH, 1))


def url_encode(s: Column) -> Column:
    """Percent-encoding of a URI component: spaces as %20, and ``!'()*~`` left alone."""
    e = F.url_encode(s)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def search_url(term: Column, class_id: Column) -> Column:
    query = F.concat(term, F.lit(" haswbstatement:P31="), class_id)
    return F.concat(F.lit(f"{ENTITY_API}?action=query&list=search&srsearch="), url_encode(query), F.lit("&srlimit=10&format=json"))


def entities_url(ids: Column) -> Column:
    return F.concat(
        F.lit(f"{ENTITY_API}?action=wbgetentities&ids="), F.array_join(F.transform(ids, url_encode), "%7C"),
        F.lit("&props=labels%7Cdescriptions%7Cclaims&languages=en&format=json"),
    )


def raceway_query(lat: Column, lon: Column, radius_m: Column, entity: Column | None = None) -> Column:
    """Query text for the raceways in a box about a point; with an entity id,
    also for the ways of its relations that touch one of them."""
    import math

    dlat = radius_m / METRES_PER_DEGREE
    dlon = radius_m / (METRES_PER_DEGREE * F.cos(lat * (math.pi / 180)))
    box = F.concat_ws(",", *[fixed(v, 5) for v in (lat - dlat, lon - dlon, lat + dlat, lon + dlon)])
    head, tail = "[out:json][timeout:60];\nway[\"highway\"=\"raceway\"](", ".ways >;\nout skel qt;"
    if entity is None:
        return F.concat(F.lit(head), box, F.lit(")->.ways;\n.ways out body;\n" + tail))
    entity = F.when(entity.rlike("^Q[0-9]+$"), entity).otherwise(F.raise_error(F.concat(F.lit("not an entity id: "), entity)).cast("string"))
    return F.concat(
        F.lit(head), box, F.lit(')->.near;\nrel(bw.near)["wikidata"="'), entity,
        F.lit('"]->.rels;\n(.near; way(r.rels);)->.ways;\n.rels out body;\n.ways out body;\n' + tail),
    )


def highway_query(west: Column, south: Column, east: Column, north: Column) -> Column:
    box = F.concat_ws(",", *[fixed(v, 6) for v in (south, west, north, east)])
    classes = "|".join(RUNNABLE_CLASSES)
    text = F.concat(
        F.lit(f'[out:json][timeout:120];\nway["highway"~"^({classes})$"]('), box, F.lit(")->.ways;\n.ways out body;\n.ways >;\nout skel qt;")
    )
    return F.when((west < east) & (south < north), text).otherwise(F.raise_error(F.lit("the box must have west < east and south < north")).cast("string"))


def element_query(kind: str, ident: Column) -> Column:
    """Query text for one relation's or one way's ways and nodes."""
    middle = (")->.rels;\nway(r.rels)->.ways;\n.rels out body;\n" if kind == "relation" else ")->.ways;\n") + ".ways out body;\n.ways >;\nout skel qt;"
    short = {"relation": "rel", "way": "way"}[kind]
    text = F.concat(F.lit(f"[out:json][timeout:60];\n{short}("), ident.cast("string"), F.lit(middle))
    return F.when(ident > 0, text).otherwise(F.raise_error(F.concat(F.lit("not an element id: "), ident.cast("string"))).cast("string"))


def relation_lookup_query(entity: Column) -> Column:
    text = F.concat(F.lit('[out:json][timeout:30];\nrelation["wikidata"="'), entity, F.lit('"];\nout ids tags;'))
    return F.when(entity.rlike("^Q[0-9]+$"), text).otherwise(F.raise_error(F.concat(F.lit("not an entity id: "), entity)).cast("string"))


def gpx(points: Column, name: Column) -> Column:
    """A GPX 1.1 document of a track; ``points`` is an array of structs with
    lon and lat as text."""
    lines = F.transform(points, lambda p: F.concat(F.lit('      <trkpt lat="'), p["lat"], F.lit('" lon="'), p["lon"], F.lit('"></trkpt>')))
    return F.concat(
        F.lit(
            '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="ringfold"'
            ' xmlns="http://www.topografix.com/GPX/1/1">\n  <trk>\n    <name>'
        ),
        escape_markup(name), F.lit("</name>\n    <trkseg>\n"), F.array_join(lines, "\n"), F.lit("\n    </trkseg>\n  </trk>\n</gpx>\n"),
    )


def route_gpx(points: Column, circuit: Column, region: Column, rank: Column) -> Column:
    """The GPX document of a ring, closed at its first point."""
    name = F.concat(circuit, F.lit(" — "), region, F.lit(" — route "), rank.cast("string"))
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.when(F.size(points) >= 2, gpx(closed, name)).otherwise(F.raise_error(F.lit("a route needs at least 2 points")).cast("string"))


def svg_path(points: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column, size: float = 220.0, padding: float = 14.0) -> Column:
    """Path data of a closed ring fitted to a square, north up."""
    span = lambda lo, hi: F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    sx, sy = span(min_x, max_x), span(min_y, max_y)
    whole = F.greatest(sx, sy)
    scale = (size - 2 * padding) / whole
    ox, oy = padding + (whole - sx) * scale / 2, padding + (whole - sy) * scale / 2
    one = lambda p: F.concat(fixed(ox + (p["x"] - min_x) * scale, 1), F.lit(" "), fixed(oy + (max_y - p["y"]) * scale, 1))
    ring = F.transform(F.concat(points, F.slice(points, 1, 1)), one)
    return F.when(F.size(points) > 0, F.concat(F.lit("M "), F.array_join(ring, " L "))).otherwise(F.lit(""))


def provenance_row(circuit: Column, name: Column, url: Column, ways: Column, points: Column, computed: Column, official: Column) -> Column:
    short = F.regexp_replace(F.replace(url, F.lit(MAP_SITE + "/"), F.lit("")), "^([^/]*)/", "$1 ")
    listed = F.when(F.size(ways) > 1, F.concat(F.lit(" (ways "), F.array_join(F.transform(ways, lambda w: w.cast("string")), " + "), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("| `"), circuit, F.lit("` | "), name, F.lit(" | ["), short, F.lit("]("), url, F.lit(")"), listed,
        F.lit(" | <layout — fill in> | "), points.cast("string"), F.lit(" | "), computed.cast("string"), F.lit(" m / "),
        official.cast("string"), F.lit(" m |"),
    )
