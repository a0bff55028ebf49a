"""Schemas and readers of the JSON files: circuits, street networks, stored
routes, placements, map elements and entities.

Readers give typed rows; what a file may not hold is for ``validate``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import geometry as g
from ..operators.components import cut_lineage, tidy
from ..params import METRES_PER_UNIT, PORTO_ORIGIN, RACETRACK_CLASSES, REGIONS

ATTRIBUTION = "struct<source:string,license:string,url:string,retrieved:string>"
CIRCUIT = (
    "struct<id:string,name:string,location:struct<lat:double,lon:double>,officialLengthM:double,"
    f"attribution:{ATTRIBUTION},centreline:array<array<double>>>"
)
NETWORK = f"struct<bbox:array<double>,grid:double,attribution:{ATTRIBUTION},ways:array<array<double>>>"
METRICS = (
    "struct<lengthM:double,lengthRatio:double,meanDeviationM:double,maxDeviationM:double,frechetM:double,retracedFraction:double>"
)
ROUTE = (
    "struct<region:string,rank:int,passesBar:boolean,pose:struct<anchor:array<double>,rotationRad:double>,"
    f"points:array<array<double>>,metrics:{METRICS}>"
)
BAR = "struct<meanM:double,maxM:double,ratioLo:double,ratioHi:double,retrace:double>"
ROUTE_FILE = (
    f"struct<schemaVersion:int,circuitId:string,generatedAt:string,scale:double,generator:struct<bar:{BAR}>,"
    f"regions:array<struct<id:string,poses:double,escalationTier:int>>,streets:{ATTRIBUTION},routes:array<{ROUTE}>>"
)
PLACEMENT = (
    "struct<schemaVersion:int,circuitId:string,anchor:array<double>,rotationRad:double,scale:double,"
    "route:array<array<double>>,savedAt:string>"
)
ELEMENT = (
    "struct<type:string,id:bigint,nodes:array<bigint>,lat:double,lon:double,tags:map<string,string>,"
    "members:array<struct<type:string,ref:bigint,role:string>>>"
)
ELEMENTS = f"struct<elements:array<{ELEMENT}>,remark:string>"
#: A value may have any shape (texts, ids, times, quantities, places, or what comes next), so it stays a variant.
SNAK = "struct<snaktype:string,datavalue:struct<type:string,value:variant>>"
STATEMENT = f"struct<mainsnak:{SNAK},rank:string,qualifiers:map<string,array<{SNAK}>>>"
TEXTS = "map<string,struct<value:string>>"
ENTITY = f"struct<labels:{TEXTS},descriptions:{TEXTS},claims:map<string,array<{STATEMENT}>>>"
ENTITIES = f"struct<entities:map<string,{ENTITY}>>"
SEARCH = "struct<query:struct<search:array<struct<title:string>>>>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): whole files as text, from any store that Spark reads."""
    return spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("file"))


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small text file in place at once: written beside it under a name
    of its own and renamed, in any store that Spark writes. A reader sees the
    old file or the new one, and a failure leaves the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    out = target.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        store.rename(beside, target, options)
    except BaseException:
        out.close()
        target.getFileSystem(conf).delete(beside, False)
        raise


MANIFEST = "manifest.json"


def commit_set(rows: DataFrame, folder: str, check: Callable[[DataFrame], DataFrame], key: str = "circuit_id") -> dict:
    """Stores texts (key, value), a file or more for each key, all or none of
    them, and gives the manifest of the new set.

    Keys that ``rows`` doesn't have keep their stored texts. The whole new set
    is written beside the old one and checked as written: ``check`` gives rows
    (key, error). With an error nothing changes; otherwise the set gets its name
    and the manifest, replaced at once, points to it. Readers go by the
    manifest, so they see the old set or the new one, and the set before the
    new one stays for those that are still at it.
    """
    spark = rows.sparkSession
    name, old = uuid.uuid4().hex, manifest(spark, folder)
    rows = cut_lineage(rows.select(key, "value"))
    if old:
        kept = read_set(spark, folder, key).join(rows.select(key).distinct(), key, "left_anti")
        rows = rows.unionByName(kept)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda n: jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
    staged, store = path(f"_staged-{name}"), path("").getFileSystem(conf)
    try:
        with tidy(spark):
            rows.write.partitionBy(key).text(staged.toString())
        found = _read_texts(spark, staged.toString(), rows.schema[key], key)
        wrong = check(found).where("error is not null").orderBy(key).limit(5).collect()
        if wrong:
            raise ValueError("nothing stored: " + "; ".join(f"{r[key]}: {r['error']}" for r in wrong))
        size = found.agg(F.count("*").alias("texts"), F.count_distinct(key).alias("keys")).first()
        if not store.rename(staged, path(f"set-{name}")):
            raise OSError(f"the new set could not be put in {folder}")
    except BaseException:
        store.delete(staged, True)
        raise
    entry = {"set": f"set-{name}", "before": old["set"] if old else None, "keys": size["keys"], "texts": size["texts"]}
    replace_text(spark, f"{folder}/{MANIFEST}", json.dumps(entry))
    if old and old.get("before"):
        store.delete(path(old["before"]), True)
    return entry


def manifest(spark: SparkSession, folder: str) -> dict | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(read_text(spark, path.toString()).first()["value"])


def read_set(spark: SparkSession, folder: str, key: str = "circuit_id") -> DataFrame:
    """(key, value) of the set that the manifest names; nothing before the first."""
    found = manifest(spark, folder)
    field = StructField(key, StringType())
    if not found or not found["texts"]:
        return spark.createDataFrame([], StructType([field, StructField("value", StringType())]))
    return _read_texts(spark, f"{folder}/{found['set']}", field, key)


def _read_texts(spark: SparkSession, path: str, field: StructField, key: str) -> DataFrame:
    return spark.read.schema(StructType([StructField("value", StringType()), field])).text(path).select(key, "value")


def load_circuits(spark: SparkSession, path: str) -> DataFrame:
    """One row per circuit of a JSON array, in order of ``pos``."""
    return parse_circuits(read_text(spark, path), "value")


def parse_circuits(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.from_json(column, f"array<{CIRCUIT}>")).alias("pos", "c")).select(*keep, "pos", "c.*")


def load_network(spark: SparkSession, path: str) -> DataFrame:
    """(file, bbox, grid, attribution, ways) of each network file."""
    return read_text(spark, path).select("file", F.from_json("value", NETWORK).alias("n")).select("file", "n.*")


def decode_ways(networks: DataFrame, *keep: str) -> DataFrame:
    """(keep..., way, seq, lon, lat) of networks (bbox, grid, ways): running
    sums of the steps on the lattice at the box's south-west corner."""
    w = Window.partitionBy(*keep, "way").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = networks.select(*keep, "bbox", "grid", F.posexplode("ways").alias("way", "flat"))
    n = n.select(*keep, "bbox", "grid", "way", F.posexplode("flat").alias("i", "v"))
    n = n.groupBy(*keep, "way", F.floor(F.col("i") / 2).alias("seq")).agg(
        F.first("bbox").alias("bbox"),
        F.first("grid").alias("grid"),
        F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("dx"),
        F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("dy"),
    )
    return n.select(
        *keep, F.col("way").cast("long").alias("way"), "seq",
        (F.col("bbox")[0] + F.sum("dx").over(w) * F.col("grid")).alias("lon"),
        (F.col("bbox")[1] + F.sum("dy").over(w) * F.col("grid")).alias("lat"),
    )


def regions(spark: SparkSession) -> DataFrame:
    """(region, label, west, south, east, north) of the known regions."""
    return spark.createDataFrame(
        list(REGIONS), "region string, label string, west double, south double, east double, north double"
    )


def project_ways(ways: DataFrame, origins: DataFrame, key: str = "region") -> DataFrame:
    """(key, way, seq, x, y): metres about each region's origin, which is fixed
    for one region and the middle of its box for the others."""
    o = origins.select(key, "lon0", "lat0")
    p = ways.join(F.broadcast(o), key).withColumn("p", g.to_local(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0")))
    return p.select(key, "way", "seq", "p.x", "p.y")


def region_origins(known: DataFrame) -> DataFrame:
    fixed = F.col("region") == "porto"
    return known.select(
        "region",
        F.when(fixed, F.lit(PORTO_ORIGIN[0])).otherwise((F.col("west") + F.col("east")) / 2).alias("lon0"),
        F.when(fixed, F.lit(PORTO_ORIGIN[1])).otherwise((F.col("south") + F.col("north")) / 2).alias("lat0"),
    )


def load_region_network(spark: SparkSession, folder: str, region: str) -> DataFrame:
    """(region, way, seq, x, y) of ``folder/<region>-streets.json``."""
    networks = load_network(spark, f"{folder}/{region}-streets.json").withColumn("region", F.lit(region))
    return project_ways(decode_ways(networks, "region"), region_origins(regions(spark)))


def parse_route_files(df: DataFrame, column: str) -> DataFrame:
    return df.select("*", F.from_json(column, ROUTE_FILE).alias("f")).select(*df.columns, "f.*")


def routes_of(files: DataFrame) -> DataFrame:
    """One row per stored route: (circuit_id, pos, region, rank, passes_bar, pose, points, metrics)."""
    r = files.select(F.col("circuitId").alias("circuit_id"), F.posexplode("routes").alias("pos", "r"))
    return r.select("circuit_id", "pos", "r.region", "r.rank", F.col("r.passesBar").alias("passes_bar"), "r.pose", "r.points", "r.metrics")


def load_routes(spark: SparkSession, folder: str, circuit_id: str | None = None) -> DataFrame:
    """Stored routes of a folder partitioned by circuit; with ``circuit_id``
    only that circuit's files are read."""
    df = spark.read.parquet(folder)
    return df.where(F.col("circuit_id") == circuit_id) if circuit_id else df


def available_circuits(routes: DataFrame) -> DataFrame:
    return routes.select("circuit_id").distinct()


def parse_placements(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., key, placement) of stored maps; nothing for a null or for text
    that isn't a JSON object."""
    parsed = F.from_json(column, f"map<string,{PLACEMENT}>", {"mode": "PERMISSIVE"})
    return df.select(*keep, F.explode(parsed).alias("key", "placement"))


def parse_elements(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., pos, element fields) of map responses."""
    e = df.select(*keep, F.posexplode(F.from_json(column, ELEMENTS)["elements"]).alias("pos", "e"))
    return e.select(*keep, "pos", "e.*")


def relation_ids(elements: DataFrame, *keep: str) -> DataFrame:
    return elements.where("type = 'relation' and id is not null").select(*keep, "pos", "id")


def parse_ways(elements: DataFrame, *keep: str) -> DataFrame:
    """(keep..., way, node_ids, lons, lats, tags, role, in_relation,
    relation_id): ways of two or more nodes with their nodes' places.

    A way's role is pit_lane if any relation says so, else that of its first
    membership; its relation is the first with an id. Duplicate nodes: the
    last one in the response. A node that is missing is an error.
    """
    k = list(keep)
    nodes = elements.where("type = 'node' and id is not null and lat is not null and lon is not null")
    nodes = nodes.groupBy(*k, F.col("id").alias("node")).agg(F.max_by(F.struct("lon", "lat"), "pos").alias("at"))
    m = elements.where("type = 'relation'").select(*k, "pos", "id", F.posexplode("members").alias("i", "m"))
    m = m.where("m.type = 'way' and m.ref is not null").select(
        *k, F.col("m.ref").alias("way"), F.coalesce("m.role", F.lit("")).alias("role"), "id", F.struct("pos", "i").alias("at")
    )
    m = m.groupBy(*k, "way").agg(
        F.min_by("role", F.struct(F.col("role") != "pit_lane", "at")).alias("role"),
        F.min_by("id", F.when(F.col("id").isNotNull(), F.col("at"))).alias("relation_id"),
    )
    ways = elements.where("type = 'way' and id is not null and size(nodes) >= 2")
    ways = ways.select(*k, "pos", F.col("id").alias("way"), "nodes", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"))
    refs = ways.select(*k, "pos", "way", F.posexplode("nodes").alias("i", "node")).join(nodes, [*k, "node"], "left")
    missing = F.concat(F.lit("way "), F.col("way"), F.lit(" references node "), F.col("node"), F.lit(", missing from the response"))
    refs = refs.withColumn("at", F.when(F.col("at").isNull(), F.raise_error(missing).cast("struct<lon:double,lat:double>")).otherwise(F.col("at")))
    lines = refs.groupBy(*k, "pos", "way").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("p"))
    lines = lines.select(*k, "pos", "way", F.transform("p", lambda p: p["at"]["lon"]).alias("lons"), F.transform("p", lambda p: p["at"]["lat"]).alias("lats"))
    return (
        ways.join(lines, [*k, "pos", "way"])
        .join(m, [*k, "way"], "left")
        .select(
            *k, "pos", "way", F.col("nodes").alias("node_ids"), "lons", "lats", "tags",
            F.nullif("role", F.lit("")).alias("role"), F.col("role").isNotNull().alias("in_relation"), "relation_id",
        )
    )


def search_ids(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., pos, entity): the hits of a search that are entity ids, in order."""
    hits = F.from_json(column, SEARCH)["query"]["search"]
    s = df.select(*keep, F.posexplode(hits).alias("pos", "h"))
    return s.where(F.col("h.title").rlike("^Q[0-9]+$")).select(*keep, "pos", F.col("h.title").alias("entity"))


def statements(claims: Column, prop: str) -> Column:
    return F.coalesce(F.try_element_at(claims, F.lit(prop)), F.array().cast(f"array<{STATEMENT}>"))


def snak_value(snak: Column, name: str, kind: str = "string") -> Column:
    """A field of a snak's value; null where the value has another shape."""
    return F.try_variant_get(snak["datavalue"]["value"], f"$.{name}", kind)


def unreadable(claims: Column, prop: str, *names: str) -> Column:
    """Whether a property has values of a shape without the given fields."""
    return F.exists(
        statements(claims, prop),
        lambda s: (s["mainsnak"]["snaktype"] == "value") & F.forall(F.array(*[snak_value(s["mainsnak"], n).isNull() for n in names]), lambda missing: missing),
    )


def qualifier_year(statement: Column, prop: str) -> Column:
    """Year of a qualifier's time, such as +2016-00-00T00:00:00Z."""
    time = snak_value(F.get(F.try_element_at(statement["qualifiers"], F.lit(prop)), 0), "time")
    return F.try_to_number(F.regexp_extract(time, r"^\s*\+?(-?[0-9]{1,9})", 1), F.lit("S999999999")).cast("long")


def length_m(statement: Column) -> Column:
    """Metres of a quantity; an error for a unit that isn't known."""
    unit = F.element_at(F.split(snak_value(statement["mainsnak"], "unit"), "/"), -1)
    factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in METRES_PER_UNIT.items()])
    amount = F.try_to_number(F.ltrim(snak_value(statement["mainsnak"], "amount"), F.lit("+")), F.lit("S9999999999D999999")).cast("double")
    bad = F.raise_error(F.concat(F.lit("a length has an unsupported unit "), F.coalesce(unit, F.lit("")))).cast("double")
    return F.when(factor.isNotNull() & amount.isNotNull(), amount * factor).otherwise(bad)


def choose_length(claims: Column) -> Column:
    """Metres of the current official length: valued, not deprecated and not
    ended, preferred ones first, then the latest start, then the first."""
    usable = F.filter(
        statements(claims, "P2043"),
        lambda s: (s["mainsnak"]["snaktype"] == "value") & ~F.coalesce(s["rank"] == "deprecated", F.lit(False)) & qualifier_year(s, "P582").isNull(),
    )
    ranked = F.transform(
        usable,
        lambda s, i: F.struct(
            (s["rank"] == "preferred").alias("p"), F.coalesce(qualifier_year(s, "P580"), F.lit(-(10**12)).cast("long")).alias("y"), (-i).alias("i")
        ),
    )
    return F.when(F.size(usable) > 0, length_m(F.get(usable, -F.array_max(ranked)["i"])))


def coordinate_of(claims: Column) -> Column:
    """struct(longitude, latitude) of the first coordinate that isn't deprecated."""
    place = lambda s: F.struct(*[snak_value(s["mainsnak"], c, "double").alias(c) for c in ("longitude", "latitude")])
    valid = F.filter(statements(claims, "P625"), lambda s: ~F.coalesce(s["rank"] == "deprecated", F.lit(False)))
    return F.get(F.filter(F.transform(valid, place), lambda p: p["longitude"].isNotNull() & p["latitude"].isNotNull()), 0)


def is_racetrack(claims: Column) -> Column:
    return F.exists(statements(claims, "P31"), lambda s: F.coalesce(snak_value(s["mainsnak"], "id").isin(*RACETRACK_CLASSES), F.lit(False)))


def parse_entities(df: DataFrame, column: str, *keep: str, any_class: bool = False) -> DataFrame:
    """(keep..., id, label, description, lon, lat, length_m) of the racetracks
    (or all entities) that have a coordinate; the length may be null."""
    e = df.select(*keep, F.explode(F.from_json(column, ENTITIES)["entities"]).alias("id", "e"))
    claims = F.col("e.claims")
    e = e.where(F.lit(True) if any_class else is_racetrack(claims)).withColumn("at", coordinate_of(claims)).where("at is not null")
    english = lambda c: F.try_element_at(F.col(f"e.{c}"), F.lit("en"))["value"]
    return e.select(
        *keep, "id", F.coalesce(english("labels"), "id").alias("label"), F.coalesce(english("descriptions"), F.lit("")).alias("description"),
        F.col("at.longitude").alias("lon"), F.col("at.latitude").alias("lat"), choose_length(claims).alias("length_m"),
    )
