"""Jump consistent hashing of stable keys to shards, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import last_row, row_buckets, running_total, written

#: Fixed value: the multiplier of the generator in the published jump hash
#: (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757

_LOW = 0xFFFFFFFF
_ROWS_A_BUCKET = 20_000


def _low32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_LOW).cast("long"))


def _stepped(s: Column) -> Column:
    """The generator's next state, s * MULTIPLIER + 1 modulo 2**64.

    Kept as two 32-bit halves and multiplied in pieces of 16 bits, since a
    long that overflows is an error under ANSI SQL.
    """
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    m1, m0 = m_low >> 16, m_low & 0xFFFF
    high, low = s["high"], s["low"]
    cross, own = low * F.lit(m1), high * F.lit(m1)
    low_sum = low * F.lit(m0) + 1 + cross.bitwiseAND(F.lit(0xFFFF)) * 65536
    high_sum = (
        F.shiftright(low_sum, 32)
        + F.shiftright(cross, 16)
        + _low32(low * F.lit(m_high))
        + _low32(high * F.lit(m0))
        + own.bitwiseAND(F.lit(0xFFFF)) * 65536
    )
    return F.struct(_low32(high_sum).alias("high"), _low32(low_sum).alias("low"))


def _jump(s: Column, shards: int, grown: int) -> Column:
    """One jump of the chain, or ``s`` itself where the chain is past its end."""
    state = F.element_at(F.transform(F.array(s), _stepped), 1)
    moved = F.transform(
        F.array(state),
        lambda t: F.struct(
            t["high"].alias("high"),
            t["low"].alias("low"),
            F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"),
            s["next"].alias("grown"),
            F.floor((s["next"] + 1) * (F.lit(2.0**31) / (F.shiftright(t["high"], 1) + 1))).alias("next"),
        ),
    )
    return F.when(s["next"] >= grown, s).otherwise(F.element_at(moved, 1))


def chain_steps(shards: int) -> int:
    """Jumps within which nearly every chain is past ``shards``.

    A chain has about ln n links below n; several times that and 16 more are
    passed by fewer than one key in a million.
    """
    return 16 + 4 * max(1, shards.bit_length())


def jump_shards(key: Column, shards: int, grown: int, steps: int | None = None) -> Column:
    """struct<shard, grown_shard>: the jump hash of a long for two counts.

    Both come from one fold over the key's rising chain of jumps: a shard is
    the chain's last value below the count. So an appended shard takes the
    rows whose chain reaches it, and no other row moves. The fold makes
    ``chain_steps`` jumps; for the rare key whose chain is not past the end by
    then it goes on, to as many as there are shards.
    """
    if not 1 <= shards <= grown:
        raise ValueError("needs 1 <= shards <= grown")
    steps = min(grown, chain_steps(grown) if steps is None else steps)
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        _low32(key).alias("low"),
        zero.alias("shard"),
        zero.alias("grown"),
        zero.alias("next"),
    )

    def fold(first: Column, last: int) -> Column:  # the chain rises by one at least
        return F.aggregate(F.sequence(F.lit(1), F.lit(last)), first, lambda s, _: _jump(s, shards, grown))

    bound = F.transform(F.array(fold(start, steps)), lambda s: F.when(s["next"] >= grown, s).otherwise(fold(s, max(1, grown - steps))))
    done = F.element_at(bound, 1)
    return F.struct(done["shard"].cast("int").alias("shard"), done["grown"].cast("int").alias("grown_shard"))


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    grown: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row with its shard, its slot in the shard and its shard after growth.

    Returns (key, size, text_crc32, law, shard, slot, grown_shard). ``size`` is
    the text's UTF-8 bytes plus 8; a null text counts as empty. A null key
    goes with key 0. Slots count from 0 without gaps in each shard, in the
    order of the input: its rows are numbered in runs and runs get offsets, so
    that neither a shard nor any number of equal rows is one task's. Repeated
    rows get slots of their own. Texts are read once, into a table without
    them; other columns are not read.
    """
    grown = shards + 1 if grown is None else grown
    jump = jump_shards(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), shards, grown)
    rows = docs.select(
        F.col(key).alias("__rf_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jump.alias("__rf_jump"),
        F.monotonically_increasing_id().alias("__rf_row"),
        F.lit(1).cast("long").alias("__rf_one"),
    )
    rows = written(rows.select("*", "__rf_jump.*").drop("__rf_jump"))
    last = rows.agg(last_row("__rf_row")).first()[0]
    placed = rows.withColumn("__rf_bucket", row_buckets("__rf_row", last, _ROWS_A_BUCKET * shards))
    numbered = running_total(placed, "__rf_one", "slot", order=["__rf_row"], bucket="__rf_bucket", group=["shard"])
    return numbered.select(
        F.col("__rf_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
