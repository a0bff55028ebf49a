"""Registration of queries and pieces of SQL that their oracles share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.derived import Derived, with_views


@dataclass(frozen=True)
class Query:
    build: Callable[[Derived], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Derived(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
    """Registers a function of the derived views under ``name``."""

    def add(build: Callable[[Derived], DataFrame]) -> Callable[[Derived], DataFrame]:
        REGISTRY[name] = Query(build, with_views(sql, *ctes, recursive=recursive) if sql else None)
        return build

    return add


def q(c: Column, decimals: int = 3) -> Column:
    """Quantised so that engines agree: halves up, as a double."""
    f = float(10**decimals)
    return F.floor(c * f + 0.5) / f


def sq(e: str, decimals: int = 3) -> str:
    f = f"{10**decimals}::DOUBLE"
    return f"floor(({e}) * {f} + 0.5) / {f}"


def sdist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"


def sproj(px: str, py: str, ax: str = "ax", ay: str = "ay", bx: str = "bx", by: str = "by") -> str:
    """Place along a segment, from 0 to 1, that is closest to a point."""
    len2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    return (
        f"(CASE WHEN {len2} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
        f"(({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {len2})) END)"
    )


def ssegdist(px: str, py: str, ax: str = "ax", ay: str = "ay", bx: str = "bx", by: str = "by") -> str:
    t = sproj(px, py, ax, ay, bx, by)
    return sdist(px, py, f"({ax} + {t} * ({bx} - {ax}))", f"({ay} + {t} * ({by} - {ay}))")


def sfix(e: str, decimals: int) -> str:
    """Text with that many decimals, built from a whole number, halves up."""
    f = 10**decimals
    n = f"CAST(floor(abs({e}) * {f} + 0.5) AS BIGINT)"
    sign = f"CASE WHEN ({e}) < 0 AND {n} > 0 THEN '-' ELSE '' END"
    if not decimals:
        return f"({sign} || CAST({n} AS VARCHAR))"
    return f"({sign} || CAST({n} // {f} AS VARCHAR) || '.' || lpad(CAST({n} % {f} AS VARCHAR), {decimals}, '0'))"


def shalf(e: str) -> str:
    return f"CAST(floor(({e}) + 0.5) AS BIGINT)"


def sgreedy(ranked: str, clash: str, limit: int | None = None, spread: int | None = None) -> str:
    """Recursive CTEs that choose, in each group ``g`` of the view ``ranked``
    (g, rn from 1, x, y, r), the rows that clash with none chosen before:
    ``{ranked}_kept`` (g, rank, rn). ``clash`` is on a chosen ``k`` and the row
    ``q``; ``spread`` fills up to that many rows with the next ones."""
    more = f" AND len(p.kept) < {limit or spread}" if limit or spread else ""
    kept = f"SELECT g, kept FROM {ranked}_pick QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1"
    if spread:
        fill = f"SELECT g, list(rn ORDER BY rn) AS rns FROM {ranked} GROUP BY 1"
        chosen = "list_transform(kept, lambda k: k.rn)"
        kept = (
            f"SELECT g, list_transform(list_slice(list_concat({chosen}, list_filter(rns, lambda v: NOT list_contains({chosen}, v))), 1, {spread}), "
            f"lambda v: {{'rn': v}}) AS kept FROM ({kept}) JOIN ({fill}) USING (g)"
        )
    return f"""{ranked}_pick AS (SELECT g, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(rn BIGINT, x DOUBLE, y DOUBLE, r DOUBLE)[]) AS kept FROM (SELECT DISTINCT g FROM {ranked})
        UNION ALL SELECT p.g, q.rn, CASE WHEN len(list_filter(p.kept, lambda k: {clash})) = 0{more} THEN list_append(p.kept, {{'rn': q.rn, 'x': q.x, 'y': q.y, 'r': q.r}}) ELSE p.kept END
        FROM {ranked}_pick p JOIN {ranked} q ON q.g = p.g AND q.rn = p.n + 1),
    {ranked}_kept AS (SELECT g, rank, kept[rank].rn AS rn FROM ({kept}), LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS rank))"""


def sclose(metres: float, degrees: float | None = None) -> str:
    """Clash of a chosen row ``k`` and a row ``q`` by place, and rotation if given."""
    near = "sqrt((k.x - q.x) * (k.x - q.x) + (k.y - q.y) * (k.y - q.y))"
    if degrees is None:
        return f"{near} < {metres}"
    turn = "abs(k.r - q.r) % (2 * pi())"
    return f"{near} <= {metres} AND CASE WHEN {turn} > pi() THEN 2 * pi() - {turn} ELSE {turn} END <= radians({degrees})"
