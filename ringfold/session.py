"""A SparkSession with the settings that the operators assume."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: UTC keeps dates equal everywhere; adaptive execution sizes partitions and
#: splits skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: The size from which Spark broadcasts by itself: as estimated, and as measured while a query runs.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """The active session or a new one; a cluster's own settings stay."""
    builder = SparkSession.builder.appName("ringfold").config(map={**SETTINGS, **settings})
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    broadcast_measured(spark)
    return spark


def broadcast_measured(spark: SparkSession) -> None:
    """Lets Spark broadcast by itself only what it has measured. Its estimates
    leave out the rows that an ``explode`` or a Python function makes, so that by
    them a table of cells or samples of any size reaches the driver."""
    limit = spark.conf.get(ESTIMATED)
    if limit.startswith("-"):
        return
    if spark.conf.get(MEASURED, None) is None:
        spark.conf.set(MEASURED, limit)
    spark.conf.set(ESTIMATED, "-1")


def ship(spark: SparkSession) -> None:
    """Gives this package to the application's Python workers, once: a zip that
    the driver hands out with the job, so that workers need none of its paths."""
    sc = spark.sparkContext
    if getattr(sc, "_ringfold_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ringfold-zip-"), "ringfold.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    sc._ringfold_shipped = True
