"""One-line descriptions of entities, laps and junction offenders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import half_up
from .text import fixed


def entity_text(ident: Column, label: Column, description: Column, length_m: Column) -> Column:
    """``id  label — description  (length)``; an empty description is left out."""
    more = F.when(description != "", F.concat(F.lit(" — "), description)).otherwise(F.lit(""))
    length = F.coalesce(F.concat(half_up(length_m).cast("string"), F.lit(" m")), F.lit("length unknown"))
    return F.concat(ident, F.lit("  "), label, more, F.lit("  ("), length, F.lit(")"))


def ring_text(length_m: Column, error: Column, official: Column, ways: Column, all_in_relation: Column, gaps: Column) -> Column:
    listed = F.array_join(F.transform(F.slice(ways, 1, 8), lambda w: w.cast("string")), ", ")
    return F.concat(
        half_up(length_m).cast("string"), F.lit(" m ("), fixed(error * 100, 1), F.lit("% off "), half_up(official).cast("string"), F.lit(" m), "),
        F.size(ways).cast("string"), F.lit(" way(s) ["), listed, F.when(F.size(ways) > 8, F.lit(", …")).otherwise(F.lit("")), F.lit("]"),
        F.when(all_in_relation, F.lit(", all relation members")).otherwise(F.lit("")),
        F.when(gaps > 0, F.concat(F.lit(", "), gaps.cast("string"), F.lit(" bridged gap(s)"))).otherwise(F.lit("")),
    )


def offender_text(way: Column, name: Column, junctions: Column) -> Column:
    named = F.coalesce(F.concat(F.lit(' "'), name, F.lit('"')), F.lit(""))
    return F.concat(F.lit("way "), way.cast("string"), named, F.lit(" — touches "), junctions.cast("string"), F.lit(" point(s) where 3+ ways meet"))
