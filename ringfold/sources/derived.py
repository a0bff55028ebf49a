"""Geometry derived from the TPC-H-like tables, for Spark and, as SQL text
with the same values, for any engine that reads the same Parquet files."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_measured, ship

#: Each path lies in a tile of its own, so that density doesn't grow with the table.
SCALE, TILE, ACROSS = 1000, 400, 25
#: Embeddings a region, and metres from one region's lattice to the next.
REGION_ROWS, REGION_M = 100, 1500


def lattice_x(node: str) -> Column:
    """Metres east of a crossing of the lattice."""
    return 100.0 * F.floor(F.col(node) % 121 / 11) + float(REGION_M) * F.floor(F.col(node) / 121)


def lattice_y(node: str) -> Column:
    return (100.0 * (F.col(node) % 11)).cast("double")


def slattice(node: str) -> tuple[str, str]:
    """The same in SQL."""
    return f"(100.0::DOUBLE * ({node} % 121 // 11) + {REGION_M} * ({node} // 121))", f"(100.0::DOUBLE * ({node} % 11))"


class Derived:
    """The views of one data folder, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)
        broadcast_measured(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def vertex(self) -> DataFrame:
        """(path_id, seq, x, y): every embedding as a path of 32 points, which
        serves as a street and as a closed outline."""
        e = self.table("embeddings").select(
            F.col("vec_id").alias("path_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")
        )
        at = lambda k: SCALE * F.get("embedding", 2 * F.col("i") + k).cast("double")
        return e.select(
            "path_id",
            F.col("i").cast("long").alias("seq"),
            (at(0) + TILE * (F.col("path_id") % ACROSS)).alias("x"),
            (at(1) + TILE * F.floor(F.col("path_id") / ACROSS)).alias("y"),
        )

    @cached_property
    def point(self) -> DataFrame:
        return self.vertex.where("seq = 5").select(F.col("path_id").alias("pid"), "x", "y")

    @cached_property
    def segment(self) -> DataFrame:
        """(way, seq, ax, ay, bx, by): the open segments of the streets."""
        w = Window.partitionBy("path_id").orderBy("seq")
        s = self.vertex.select(
            F.col("path_id").alias("way"), "seq", F.col("x").alias("ax"), F.col("y").alias("ay"),
            F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"),
        )
        return s.where("bx is not null")

    @cached_property
    def ring_segment(self) -> DataFrame:
        """(path_id, seq, ax, ay, bx, by): the closed segments of the outlines."""
        w = Window.partitionBy("path_id").orderBy("seq")
        whole = Window.partitionBy("path_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self.vertex.select(
            "path_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"),
            F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("bx"),
            F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("by"),
        )

    @cached_property
    def region(self) -> DataFrame:
        """(region): one for every hundred embeddings."""
        return self.table("embeddings").select(F.floor(F.col("vec_id") / REGION_ROWS).cast("long").alias("region")).distinct()

    @cached_property
    def lattice(self) -> DataFrame:
        """(a, b, len): in each region about 160 street edges on a grid of
        11 x 11 crossings, numbered region * 121 + column * 11 + row. Which
        are missing depends on the region."""
        ij = lambda n, m: self.region.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
        node = lambda di, dj: F.col("region") * 121 + (F.col("i") + di) * 11 + F.col("j") + dj
        across = ij(10, 11).where("i not in (3, 7) and (i * 31 + j * 17 + region) % 7 <> 0").select(node(0, 0).alias("a"), node(1, 0).alias("b"))
        up = ij(11, 10).where("(i * 13 + j * 29 + region) % 5 <> 0").select(node(0, 0).alias("a"), node(0, 1).alias("b"))
        return across.unionByName(up).withColumn("len", F.lit(100.0))

    @cached_property
    def lattice_nodes(self) -> DataFrame:
        """(id, x, y): the crossings that have an edge."""
        ids = self.lattice.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return ids.select("id", lattice_x("id").alias("x"), lattice_y("id").alias("y"))

    @cached_property
    def edge(self) -> DataFrame:
        """(a, b, len): both directions of the lattice."""
        back = self.lattice.select(F.col("b").alias("a"), F.col("a").alias("b"), "len")
        return self.lattice.unionByName(back)

    @cached_property
    def track(self) -> DataFrame:
        """(user_id, seq, x, y): every user's events in order, as a track."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(
            "user_id",
            (F.row_number().over(w) - 1).cast("long").alias("seq"),
            ((F.col("event_id") * 7919) % 4001).cast("double").alias("x"),
            F.col("value").alias("y"),
        )

    @cached_property
    def route(self) -> DataFrame:
        """(circuit, region, k, mean_dev, max_dev, ratio, retrace): line items as stored routes."""
        cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
        g = self.table("lineitem").groupBy(
            (F.col("l_orderkey") % 40).alias("circuit"), (F.col("l_partkey") % 6).alias("region"),
            (F.col("l_suppkey") % 5 + 1).alias("k"),
        )
        a = g.agg(
            F.sum(cents("l_quantity")).alias("q"), F.max(cents("l_extendedprice")).alias("p"),
            F.sum(cents("l_discount")).alias("d"), F.sum(cents("l_tax")).alias("t"), F.count("*").alias("n"),
        )
        hundred_n = 100.0 * F.col("n")
        return a.select(
            "circuit", "region", "k",
            (F.col("q") / hundred_n).alias("mean_dev"),
            (F.col("p") / 100000.0).alias("max_dev"),
            (0.7 + 8.0 * F.col("d") / hundred_n).alias("ratio"),
            (F.col("t") / hundred_n).alias("retrace"),
        )


_LEAD = "lead({0}) OVER (PARTITION BY path_id ORDER BY seq)"

#: The same views as common table expressions.
SQL = {
    "g_vertex": f"""SELECT e.vec_id AS path_id, t.i AS seq,
        {SCALE} * CAST(e.embedding[2 * t.i + 1] AS DOUBLE) + {TILE} * (e.vec_id % {ACROSS}) AS x,
        {SCALE} * CAST(e.embedding[2 * t.i + 2] AS DOUBLE) + {TILE} * (e.vec_id // {ACROSS}) AS y FROM embeddings e, range(32) t(i)""",
    "g_point": "SELECT path_id AS pid, x, y FROM g_vertex WHERE seq = 5",
    "g_segment": f"""SELECT * FROM (SELECT path_id AS way, seq, x AS ax, y AS ay, {_LEAD.format('x')} AS bx,
        {_LEAD.format('y')} AS by FROM g_vertex) WHERE bx IS NOT NULL""",
    "g_ring_segment": f"""SELECT path_id, seq, x AS ax, y AS ay,
        coalesce({_LEAD.format('x')}, first_value(x) OVER (PARTITION BY path_id ORDER BY seq)) AS bx,
        coalesce({_LEAD.format('y')}, first_value(y) OVER (PARTITION BY path_id ORDER BY seq)) AS by FROM g_vertex""",
    "g_quarter": f"SELECT DISTINCT vec_id // {REGION_ROWS} AS region FROM embeddings",
    "g_lattice": """SELECT region * 121 + i * 11 + j AS a, region * 121 + (i + 1) * 11 + j AS b, 100.0::DOUBLE AS len FROM g_quarter, range(10) x(i), range(11) y(j)
        WHERE i NOT IN (3, 7) AND (i * 31 + j * 17 + region) % 7 <> 0
        UNION ALL SELECT region * 121 + i * 11 + j, region * 121 + i * 11 + j + 1, 100.0::DOUBLE FROM g_quarter, range(11) x(i), range(10) y(j) WHERE (i * 13 + j * 29 + region) % 5 <> 0""",
    "g_edge": "SELECT a, b, len FROM g_lattice UNION ALL SELECT b, a, len FROM g_lattice",
    "g_node": f"SELECT DISTINCT a AS id, {slattice('a')[0]} AS x, {slattice('a')[1]} AS y FROM g_edge",
    "g_track": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
        CAST((event_id * 7919) % 4001 AS DOUBLE) AS x, value AS y FROM events""",
    "g_route": """SELECT circuit, region, k, q / (100.0::DOUBLE * n) AS mean_dev, p / 100000.0::DOUBLE AS max_dev,
        0.7::DOUBLE + 8.0::DOUBLE * d / (100.0::DOUBLE * n) AS ratio, t / (100.0::DOUBLE * n) AS retrace FROM (
        SELECT l_orderkey % 40 AS circuit, l_partkey % 6 AS region, l_suppkey % 5 + 1 AS k,
        CAST(sum(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS q, CAST(max(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS p,
        CAST(sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS d, CAST(sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS t,
        count(*) AS n FROM lineitem GROUP BY 1, 2, 3)""",
}

_NEEDS = {
    "g_point": ["g_vertex"],
    "g_segment": ["g_vertex"],
    "g_ring_segment": ["g_vertex"],
    "g_lattice": ["g_quarter"],
    "g_edge": ["g_lattice"],
    "g_node": ["g_edge"],
}


def with_views(query: str, *own: str, recursive: bool = False) -> str:
    """``query`` preceded by the views that it names and by its ``own`` common
    table expressions (``name AS (...)``)."""
    text = query + " ".join(own)
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", text):
            add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + list(own)
    # The column name ``by`` is a keyword; keywords are in capitals here.
    return re.sub(r"\bby\b", '"by"', _joined(query, parts, recursive))


def _joined(query: str, parts: list[str], recursive: bool) -> str:
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + query
