"""What the operators of this package share: durable intermediates, hold-outs,
distributed running totals and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import BROADCAST_ROWS, connected_components, shared_dir, tidy
from ..operators.components import cut_lineage as cut
from ..session import ship  # the package as a zip for the workers

#: Rows of one key that a join may put in one task.
HOT_ROWS = 1_000_000

__all__ = ["BROADCAST_ROWS", "components", "cut", "shared_dir", "ship", "tidy", "written"]

_ROW_IN_PART = (1 << 33) - 1  # of monotonically_increasing_id


@dataclass
class Written:
    """A table in the shared folder that can go before the application ends."""

    table: DataFrame
    path: str

    def discard(self) -> None:
        """Deletes the table: its uses must be behind a checkpoint or another table."""
        path, files = folder(self.table.sparkSession, self.path)
        files.delete(path, True)


def folder(spark: SparkSession, path: str):
    """The path and its file system, as the cluster names them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written_table(df: DataFrame) -> Written:
    """``df`` as a compressed table in the shared folder, read back.

    For wide intermediates that are read more than once. The table goes when
    it is discarded, or else when the application ends.
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/ringfold-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(name)
    path, files = folder(spark, name)
    files.deleteOnExit(path)
    return Written(spark.read.schema(df.schema).parquet(name), name)


def written(df: DataFrame) -> DataFrame:
    """The table of ``written_table``, where it stays until the application ends."""
    return written_table(df).table


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint, if its rows (counted unless given) are few."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_hot(df: DataFrame, column: str, table: DataFrame, key: str, rows: str) -> DataFrame:
    """``df`` joined on ``column`` with ``table``, one row a ``key`` (null is a
    key too), whose column ``rows`` counts the key's rows in ``df``.

    For tables too big to broadcast: a key of over HOT_ROWS rows is dealt to
    several tasks. Such keys are few, at most all rows over HOT_ROWS.
    """
    salts = F.ceil(F.col(rows) / HOT_ROWS).cast("long")
    hot = cut(table.where(F.col(rows) > HOT_ROWS).select(F.col(key).alias("__rf_hot"), salts.alias("__rf_salts")))
    one = F.lit(1).cast("long")
    dealt = df.join(small(hot), F.col(column).eqNullSafe(F.col("__rf_hot")), "left").drop("__rf_hot")
    dealt = dealt.withColumn("__rf_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__rf_salts", one))).drop("__rf_salts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, one) - 1))
    table = table.withColumn("__rf_copy", copies)
    on = F.col(column).eqNullSafe(F.col(key)) & (F.col("__rf_salt") == F.col("__rf_copy"))
    return dealt.join(table, on).drop("__rf_salt", "__rf_copy")


def crc_of_id(column: str) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_fraction(*columns: Column | str, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the columns' values only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)) / F.lit(float(1 << 53))


def row_buckets(row: str, last: int, rows: int) -> Column:
    """Numbers runs of ``rows`` rows in the order of ``row``, a row number by
    monotonically_increasing_id whose part within a partition ends at ``last``.

    A bucket for ``running_total`` that no value of any column can crowd.
    """
    per = last // rows + 1
    return F.shiftright(row, 33) * per + F.floor(F.col(row).bitwiseAND(F.lit(_ROW_IN_PART)) / rows).cast("long")


def last_row(row: str) -> Column:
    """The aggregate that gives ``last`` to ``row_buckets``."""
    return F.coalesce(F.max(F.col(row).bitwiseAND(F.lit(_ROW_IN_PART))), F.lit(0).cast("long"))


def running_total(
    df: DataFrame,
    value: str,
    out: str,
    order: Sequence[str],
    bucket: str,
    group: Sequence[str] = (),
    fan: int = 4096,
    whole: str | None = None,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one, and,
    if ``whole`` is named, the group's total.

    Rows are ordered by ``bucket`` (a long that rises with the order and holds
    few rows a value), then ``order``, within each ``group``. Buckets are
    summed alone; their own totals are summed the same way one level up,
    ``fan`` buckets at a time, so that no task sees more than a bucket's rows
    or ``fan`` totals, whatever the number of rows. A group's total reaches
    its rows through its buckets, so that a big group is no hot key.
    """
    keys = [*group, bucket]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__rf_total"))
    before = _before(totals, keys, bucket, group, fan)
    if whole:
        sums = totals.groupBy(*group).agg(F.sum("__rf_total").alias("__rf_all"))
        sums = sums.select(*[F.col(g).alias(f"__rf_g{i}") for i, g in enumerate(group)], F.col("__rf_all").alias(whole))
        on = [F.col(g).eqNullSafe(F.col(f"__rf_g{i}")) for i, g in enumerate(group)]
        before = before.join(sums, on).drop(*[f"__rf_g{i}" for i in range(len(group))])
    return _attach(local, before, keys, out)


def _before(totals: DataFrame, keys: list[str], bucket: str, group: Sequence[str], fan: int) -> DataFrame:
    """For each bucket the total of those before it in its group."""
    high = totals.agg(F.max(bucket) - F.min(bucket)).first()[0] or 0
    if high < fan:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, F.coalesce(F.sum("__rf_total").over(w), F.lit(0)).alias("__rf_before"))
    up = f"__rf_up_{bucket}"
    tagged = totals.withColumn(up, F.floor(F.col(bucket) / fan).cast("long"))
    w = Window.partitionBy(*group, up).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    within = tagged.select(*keys, up, F.coalesce(F.sum("__rf_total").over(w), F.lit(0)).alias("__rf_within"))
    upper = tagged.groupBy(*group, up).agg(F.sum("__rf_total").alias("__rf_total"))
    above = _before(upper, [*group, up], up, group, fan)
    return _attach(within, above, [*group, up], "__rf_within").select(
        *keys, F.col("__rf_within").alias("__rf_before")
    )


def _attach(df: DataFrame, before: DataFrame, keys: Iterable[str], out: str) -> DataFrame:
    keys = list(keys)
    right = before.select(*[F.col(k).alias(f"__rf_k{i}") for i, k in enumerate(keys)], *[c for c in before.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__rf_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(right, on, "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("__rf_before", F.lit(0))).drop(
        "__rf_before", *[f"__rf_k{i}" for i in range(len(keys))]
    )


def components(edges: DataFrame, many: int = 1_000_000, hot_degree: int = 100_000) -> DataFrame:
    """Connected components of ``edges(u, v)``: (node, component), every node of
    an edge of two nodes with the smallest one that it reaches. In rounds over
    the cluster at any size; with over ``many`` edges, nodes of over
    ``hot_degree`` neighbours are dealt to several tasks."""
    links = edges.where("u <> v").select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"))
    return connected_components(links, task_links=0, hot_degree=hot_degree, many=many)
