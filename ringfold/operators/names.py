"""Looking circuits up by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_name


def match_names(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(k, id) of the known circuits (id, name) that each query (k, query)
    means: those whose normalised id or name equals it, or, if there are none,
    those that have all its words in either. An empty query means none.

    Both are equality joins: on the whole name, then on single words with as
    many hits as the query has words.
    """
    q = queries.select("k", normalise_name(F.col("query")).alias("q")).where("q <> ''")
    own = known.select("id", normalise_name(F.col("id")).alias("i"), normalise_name(F.col("name")).alias("n"))
    whole = own.select("id", F.explode(F.array_distinct(F.array("i", "n"))).alias("q"))
    exact = q.join(whole, "q").select("k", "id").distinct()
    left = q.join(exact.select("k").distinct(), "k", "left_anti")
    words = left.select("k", F.array_distinct(F.split("q", " ")).alias("w")).select("k", F.size("w").alias("n"), F.explode("w").alias("w"))
    have = own.select("id", F.explode(F.array_distinct(F.concat(F.split("i", " "), F.split("n", " ")))).alias("w"))
    hits = words.join(have, "w").groupBy("k", "id", "n").agg(F.count("*").alias("hits")).where("hits = n")
    return exact.unionByName(hits.select("k", "id"))
