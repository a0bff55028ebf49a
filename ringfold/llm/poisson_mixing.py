"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import BROADCAST_ROWS, cut, join_hot, small

TEMPERATURE = 0.7
SEED = 17


def uniform(ident: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the id and the seed: the
    same in any engine."""
    digest = F.md5(F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """The first k that matters and P(X <= k) from it on, until no number in
    [0, 1) of 52 bits is above; below the first, all are."""
    if not rate > 0:
        return 0, [1.0]
    first = 0 if rate <= 700 else int(rate - 10 * math.sqrt(rate))
    log_term = -rate + first * math.log(rate) - math.lgamma(first + 1) if first else -rate
    term, total, k, out = math.exp(log_term), 0.0, first, []
    while True:
        total += term
        out.append(total)
        if (not first and total >= 1 - 2.0**-53) or (k > rate and term < 2.0**-60):
            # Rounding of a large first term's logarithm scales all terms alike.
            return first, [c / total for c in out] if first else out
        k += 1
        term *= rate / k


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until no number in [0, 1) of 52 bits is above."""
    first, steps = poisson_steps(rate)
    return [0.0] * first + steps


def repetition_rates(sizes: DataFrame, targets: Mapping[str | None, float] | None, total: float | None = None) -> DataFrame:
    """``sizes(s, n)``, one row a source with its size, with ``rate``: its mean
    number of copies of a document.

    Targets are shares in any unit, by default the sizes to the power 0.7,
    which lifts small sources; a source that they don't name has none.
    ``total`` is the wanted size of the mix, by default that of the corpus.
    """
    if targets is None:
        weighed = sizes.withColumn("w", F.pow("n", F.lit(TEMPERATURE)))
    else:
        named = sizes.sparkSession.createDataFrame([(s, float(w)) for s, w in targets.items()], "q string, w double")
        weighed = sizes.join(small(named, len(targets)), F.col("s").cast("string").eqNullSafe(F.col("q")), "left").drop("q")
        weighed = weighed.withColumn("w", F.coalesce("w", F.lit(0.0)))
    whole, own = weighed.where("n > 0").agg(F.sum("w"), F.sum("n")).first()
    total = (own or 0.0) if total is None else total
    share = F.col("w") / F.lit(whole) * F.lit(float(total)) / F.col("n") if whole else F.lit(0.0)
    return weighed.withColumn("rate", F.when(F.col("n") > 0, share).otherwise(0.0)).drop("w")


def _with_steps(rates: DataFrame) -> DataFrame:
    """Adds the distribution of each source, ``first`` and ``cdf``."""

    def run(batches):
        for batch in batches:
            steps = [poisson_steps(r) for r in batch.column("rate").to_pylist()]
            first, cdf = pa.array([f for f, _ in steps], pa.int32()), pa.array([c for _, c in steps], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, first, cdf], names=[*batch.schema.names, "first", "cdf"])

    return rates.mapInArrow(run, rates.select("*").schema.add("first", "integer").add("cdf", ArrayType(DoubleType())))


def mix_sources(
    docs: DataFrame,
    targets: Mapping[str | None, float] | None = None,
    total: float | None = None,
    seed: int = SEED,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    detail: bool = True,
) -> DataFrame:
    """Every document as often as a Poisson draw says, globally shuffled.

    A source's mean is its repetition rate, so that its expected share of the
    characters (null texts and the empty count one) is its target. The draw
    inverts the Poisson distribution at a hash of (doc_id, seed): it depends
    on nothing else, repeated rows and rows with a null id draw alike, and
    any count may come out, zero too. Copies are dealt to partitions by a hash
    of (doc_id, copy, row) and sorted there by it, so that repeated and null
    ids spread like others. All columns stay; with ``detail``, ``copy`` (from
    0), ``copies`` and ``rate`` are added, in place of input columns of those
    names. A null source is a source of its own. There may be any number of
    sources; their table is only broadcast if it is small.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.greatest(F.length(text), F.lit(1)), F.lit(1)).cast("double")
    sizes = docs.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n"), F.count("*").alias("rows"))
    sources = cut(_with_steps(repetition_rates(cut(sizes), targets, total)))
    names = {"s": "__rf_source", "rows": "__rf_rows", "rate": "__rf_rate", "first": "__rf_first", "cdf": "__rf_cdf"}
    table = sources.select(*[F.col(c).alias(n) for c, n in names.items()])
    count, terms = sources.agg(F.count("*"), F.sum(F.size("cdf"))).first()
    columns = [c for c in docs.columns if not (detail and c in ("copy", "copies", "rate"))]
    rows = docs.withColumn("__rf_row", F.monotonically_increasing_id())
    if max(count, (terms or 0) / 32) <= BROADCAST_ROWS:
        drawn = rows.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("__rf_source")))
    else:
        drawn = join_hot(rows, source, table, "__rf_source", "__rf_rows")
    drawn = drawn.withColumn("__rf_u", uniform(F.col(doc_id), seed))
    drawn = drawn.withColumn("__rf_n", F.col("__rf_first") + F.size(F.filter("__rf_cdf", lambda c: F.col("__rf_u") >= c)))
    copies = drawn.where("__rf_n > 0").withColumn("__rf_copy", F.explode(F.sequence(F.lit(0), F.col("__rf_n") - 1)))
    key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col("__rf_copy"), F.col("__rf_row"))
    extra = [F.col("__rf_copy").alias("copy"), F.col("__rf_n").alias("copies"), F.col("__rf_rate").alias("rate")] if detail else []
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        copies.withColumn("__rf_key", key)
        .repartition(parts, "__rf_key")
        .sortWithinPartitions("__rf_key")
        .select(*[F.col(c) for c in columns], *extra)
    )
