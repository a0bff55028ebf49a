"""Durable intermediates, and connected components of an edge list without collecting it."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is only broadcast when its counted rows stay below this.
BROADCAST_ROWS = 100_000


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """A context: queries made and run inside let go of their shuffle files as
    they end, instead of whenever the driver's collector finds them unused."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a local master a temporary folder takes its
    place; elsewhere its absence is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="ringfold-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def cut_dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt and sorted by the keys as a checkpoint that keeps this: joins
    and aggregates on them need no further shuffle. Adaptive execution, which
    would leave the number of partitions open, is off for this one step."""
    with _setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return cut_lineage(df.repartition(*keys).sortWithinPartitions(*keys))


#: Links that one task joins faster than rounds over the cluster would.
TASK_LINKS = 500_000
#: Neighbours from which a node is dealt to several tasks, how many, and the links from which such nodes are looked for.
HOT_DEGREE, SALTS, HOT_LINKS = 100_000, 64, 1_000_000


def _join_links(frames):
    """(u, v) by v <= u: each node with the least of its component, in one task."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    links = pd.concat(parts)
    names = np.unique(np.concatenate([links.u.to_numpy(), links.v.to_numpy()]))
    root = np.arange(len(names))
    a, b = np.searchsorted(names, links.u.to_numpy()), np.searchsorted(names, links.v.to_numpy())
    while True:  # the lower root of each link's two takes the other, then paths shorten
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    some = root != np.arange(len(names))
    yield pd.DataFrame({"u": names[some], "v": names[root[some]]})


def connected_components(
    edges: DataFrame, nodes: DataFrame | None = None, task_links: int | None = None, hot_degree: int = HOT_DEGREE, many: int = HOT_LINKS
) -> DataFrame:
    """(node, component): each node with the least node that it reaches.

    ``edges`` has (a, b) of any ordered type; ``nodes`` (node) may add
    isolated ones. Alternates two star steps until nothing moves, which takes
    rounds logarithmic in a component's size: larger neighbours hang on the
    least neighbour, then smaller ones do. Minima combine before the shuffle;
    with over ``many`` links, nodes of over ``hot_degree`` neighbours are dealt
    to several tasks. Up to
    ``task_links`` links are joined in one task instead, to the same result.
    """
    task_links = TASK_LINKS if task_links is None else task_links
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, state = cut_lineage(e), None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if not now[0] or now == state:
            break
        if state is None and now[0] <= task_links:
            e = cut_lineage(e.coalesce(1).mapInPandas(_join_links, e.schema))
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("u", "m"))
        large = _with_least(both.where("v > u"), least, now[0] > many, hot_degree).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(down.withColumnRenamed("m", "v")).distinct())
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    every = ends.unionByName(nodes.select("node")).distinct() if nodes is not None else ends.distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _with_least(links: DataFrame, least: DataFrame, many: bool, hot_degree: int) -> DataFrame:
    """``links`` (u, v) with ``m`` of ``least`` (u, m, degree)."""
    if not many:
        return links.join(least.drop("degree"), "u")
    hot = cut_lineage(least.where(F.col("degree") > hot_degree).select("u", F.lit(SALTS).alias("salts")))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    salt = F.coalesce(F.pmod(F.xxhash64("v"), F.col("salts")), F.lit(0).cast("long"))
    links = links.join(hot, "u", "left").withColumn("salt", salt).drop("salts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts") - 1, F.lit(0)).cast("long")))
    return links.join(least.join(hot, "u", "left").withColumn("salt", copies).drop("salts", "degree"), ["u", "salt"])
