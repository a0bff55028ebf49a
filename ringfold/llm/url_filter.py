"""URL filtering by host rules and a blocked Bloom filter, in SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: What marks a crawled page as symbol noise; its URL goes on the block list.
NOISE = r"(\*\*\*|%%%|\$\$\$|###)"

_WORDS = 8  # of a block, with 32 bits each


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; all empty without ``://`` or for null.

    The host keeps a port or user name and is lower-cased from A to Z only.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw_host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw_host) + 1, F.length(rest))
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    query = F.regexp_extract(F.substring(tail, F.length(path) + 1, F.length(tail)), r"^\?([^#]*)", 1)
    blank = F.coalesce(at, F.lit(0)) == 0
    host = F.translate(raw_host, UPPER, LOWER)
    return tuple(F.when(blank, F.lit("")).otherwise(c) for c in (host, path, query))


def canonical_url(url: Column) -> Column:
    """host + path + query without scheme, ``www.``, trailing slashes, fragment
    and the parameters ``utm_*`` and ``ref``; null where there is no host."""
    host, path, query = url_parts(url)
    bare = F.regexp_replace(host, r"^www\.", "")
    kept = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^&=]*|ref)=[^&]*", ""), "^&+", "")
    query_part = F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", ""), query_part))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.

    A rule fits its host and all subdomains, if the path starts with its path.
    """
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in longest_first]

    def first(values: list[str]) -> Column:
        pairs = list(zip(fits, values, strict=True))
        return reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), pairs[::-1], F.lit(None).cast("string"))

    return first([h + p for _, h, p in longest_first]), first([v for v, _, _ in longest_first])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """One of a word's 32 bits, by five bits of the key's hash."""
    return F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key), 5 * word).bitwiseAND(F.lit(31)).cast("int")
    )


def bloom_filter(keys: DataFrame, column: str, count: int, bits_a_key: int = 16) -> tuple[DataFrame, int]:
    """(table of blocks, number of blocks): each key sets a bit in every word
    of the one block that its hash picks, so a probe reads one row."""
    blocks = max(1, -(-count * bits_a_key // (32 * _WORDS)))
    bits = [F.bit_or(_mask(F.col(column), i)).alias(f"__rf_w{i}") for i in range(_WORDS)]
    return keys.groupBy(_block(F.col(column), blocks).alias("__rf_block")).agg(*bits), blocks


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    page_id: str = "page_id",
    url: str = "url",
    listed_column: str = "canonical",
) -> DataFrame:
    """Judges every row of ``pages``.

    ``listed`` holds canonical URLs (``canonical_url``) in ``listed_column``;
    nulls and repeats in it don't matter. Returns (page_id, host, path, rule,
    verdict, canonical, possible, listed): a fitting rule decides, else a
    listed URL is blocked and any other allowed. ``possible`` tells what the
    Bloom filter let through, of which the exact join keeps the true hits.
    Rows with a null or odd URL have an empty host and path and are allowed;
    repeated rows are judged one by one; other columns are not read. The list
    and the filter are broadcast only when counted as small.
    """
    keys = cut(listed.select(F.col(listed_column).alias("__rf_listed")).where("__rf_listed is not null").distinct())
    count = keys.count()
    bloom, blocks = bloom_filter(keys, "__rf_listed", count)
    host, path, _ = url_parts(F.col(url))
    judged = pages.select(
        F.col(page_id).alias(page_id), host.alias("host"), path.alias("path"), canonical_url(F.col(url)).alias("canonical")
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("__rf_verdict"))
    # A null can't hit; where the filter is joined by shuffle, nulls are dealt to all blocks.
    anywhere = F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    judged = judged.withColumn("__rf_at", F.when(F.col("canonical").isNotNull(), _block(F.col("canonical"), blocks)).otherwise(anywhere))
    probed = judged.join(F.broadcast(bloom) if blocks <= BROADCAST_ROWS else bloom, F.col("__rf_at") == F.col("__rf_block"), "left")
    masks = [F.col(f"__rf_w{i}").bitwiseAND(_mask(F.col("canonical"), i)) != 0 for i in range(_WORDS)]
    possible = F.coalesce(F.col("canonical").isNotNull() & reduce(lambda a, b: a & b, masks), F.lit(False))
    probed = probed.select(page_id, "host", "path", "rule", "__rf_verdict", "canonical", possible.alias("possible"))
    # Rows that the filter stops get keys of their own: no pile of nulls in one task.
    probed = probed.withColumn(
        "__rf_key", F.when(F.col("possible"), F.col("canonical")).otherwise(F.monotonically_increasing_id().cast("string"))
    )
    exact = keys.select(F.col("__rf_listed"), F.lit(True).alias("__rf_hit"))
    hit = F.coalesce(F.col("__rf_hit"), F.lit(False))
    on = (F.col("__rf_key") == F.col("__rf_listed")) & (F.col("possible") == F.col("__rf_hit"))
    return probed.join(small(exact, count), on, "left").select(
        page_id,
        "host",
        "path",
        "rule",
        F.coalesce("__rf_verdict", F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "canonical",
        "possible",
        hit.alias("listed"),
    )


def noisy_urls(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The block list that the crawl itself yields: the canonical URLs of pages
    whose whole html holds symbol noise. A null html is clean."""
    return pages.where(F.col(html).rlike(NOISE)).select(canonical_url(F.col(url)).alias("canonical")).distinct()
