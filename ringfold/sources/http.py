"""Requests as a job: cached answers joined, the others fetched politely by host
with retries and mirrors; and the hash that names cache entries."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut_lineage
from ..params import RUNTIME_ERROR

MIN_GAP_S = 1.0
BACKOFF_S = (2.0, 4.0, 8.0, 16.0)

_MASK = 0xFFFFFFFF


def hash_key(text: str) -> str:
    """53-bit hash of a text's UTF-16 units as 14 hex digits."""
    # Seeds and multipliers of the cyrb53 mix.
    a, b = 0xDEADBEEF, 0x41C6CE57
    units = text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        c = units[k] | units[k + 1] << 8
        a = (a ^ c) * 2654435761 & _MASK
        b = (b ^ c) * 1597334677 & _MASK
    a = ((a ^ a >> 16) * 2246822507 & _MASK) ^ ((b ^ b >> 13) * 3266489909 & _MASK)
    b = ((b ^ b >> 16) * 2246822507 & _MASK) ^ ((a ^ a >> 13) * 3266489909 & _MASK)
    return f"{(b & 0x1FFFFF) << 32 | a:014x}"


def hash_key_column(text: Column) -> Column:
    """``hash_key`` of a column, a batch at a time; null stays null."""

    def run(s):
        return s.map(hash_key, na_action="ignore")

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(text)


def is_retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def is_runtime_error(remark: Column) -> Column:
    return F.coalesce(remark.rlike(RUNTIME_ERROR), F.lit(False))


@dataclass
class JsonClient:
    """GET or POST with at least a second between requests.

    A cached answer is returned as it is; offline, a missing one is an error.
    The first address is retried with growing pauses, the others are tried
    once each. ``fetch(url, body)`` gives (status, text) or raises OSError.
    """

    fetch: Callable[[str, str | None], tuple[int, str]]
    sleep: Callable[[float], None]
    now: Callable[[], float]
    cache: dict[str, str] = field(default_factory=dict)
    offline: bool = False
    _last: float = float("-inf")

    def get(self, urls: Sequence[str], body: str | None = None) -> object:
        if not urls:
            raise ValueError("no address to request")
        key = hash_key(f"{'GET' if body is None else 'POST'} {urls[0]}\n{body or ''}")
        if key in self.cache:
            return json.loads(self.cache[key])
        if self.offline:
            raise LookupError(f"offline: no cached response for {urls[0]}")
        failures = []
        for n, url in enumerate(urls):
            pauses = [*(BACKOFF_S if n == 0 else ()), None]
            for pause in pauses:
                text, why, final = self._attempt(url, body)
                if not why:
                    self.cache[key] = text
                    return json.loads(text)
                failures.append(f"{url}: {why}")
                if final:
                    raise RuntimeError(f"request failed and is not retryable: {why}")
                if pause is not None:
                    self.sleep(pause)
        raise RuntimeError("all attempts failed:\n  " + "\n  ".join(failures))

    def _attempt(self, url: str, body: str | None) -> tuple[str, str, bool]:
        """(text, reason of failure, whether that is final)."""
        wait = self._last + MIN_GAP_S - self.now()
        if wait > 0:
            self.sleep(wait)
        self._last = self.now()
        try:
            status, text = self.fetch(url, body)
        except OSError as e:
            return "", f"network error: {e}", False
        if status == 429 or status >= 500:
            return "", f"HTTP {status}", False
        if not 200 <= status < 300:
            return "", f"HTTP {status}: {text[:200]}", True
        try:
            answer = json.loads(text)
        except ValueError:
            return "", "body is not JSON" if text.strip() else "empty body", False
        remark = answer.get("remark") if isinstance(answer, dict) else None
        if isinstance(remark, str) and re.search(RUNTIME_ERROR, remark):
            return "", "the service reported a runtime error", False
        return text, "", False


def no_pause(seconds: float) -> None:
    """For recorded answers, which need no politeness."""


def request_key(urls: Column, body: Column) -> Column:
    """The cache's key of a request: of its method, first address and body."""
    method = F.when(body.isNull(), F.lit("GET ")).otherwise(F.lit("POST "))
    return hash_key_column(F.concat(method, F.get(urls, F.lit(0)), F.lit("\n"), F.coalesce(body, F.lit(""))))


def fetch_answers(
    requests: DataFrame,
    fetch: Callable[[str, str | None], tuple[int, str]],
    cache: DataFrame | None = None,
    offline: bool = False,
    sleep: Callable[[float], None] = time.sleep,
    now: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """(key, source, attempts, text, error): an answer for every distinct
    request (urls, body) of a table.

    Answers in ``cache`` (key, text) are taken as they are; offline, a missing
    one is an error. Requests are dealt by the host of their first address: a
    task asks a host's one after the other, with a pause between, retries the
    first address with growing pauses and the others once each
    (``JsonClient``). A request that fails has an ``error`` and harms no other;
    one without an address fails without being sent. The answers are a
    checkpoint, since asking again on each use would be impolite; what is
    ``fetched`` is for the caller to add to the cache. ``fetch(url, body)``
    gives (status, text) and runs in the tasks.
    """
    asked = requests.select("urls", "body").withColumn("key", F.coalesce(request_key(F.col("urls"), F.col("body")), F.lit("")))
    asked = asked.groupBy("key").agg(F.min(F.struct("urls", "body")).alias("r")).select("key", "r.*")
    if cache is not None:
        known = cache.groupBy("key").agg(F.min("text").alias("known"))
        asked = asked.join(known, "key", "left")
    else:
        asked = asked.withColumn("known", F.lit(None).cast("string"))
    here = asked.where("known is not null").select("key", F.lit("cached").alias("source"), F.lit(0).cast("long").alias("attempts"), F.col("known").alias("text"), F.lit(None).cast("string").alias("error"))
    open_ = asked.where("known is null").withColumn("host", F.coalesce(F.try_parse_url(F.get("urls", F.lit(0)), F.lit("HOST")), F.lit("")))

    def run(batches):
        clients: dict[str, JsonClient] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sent = []

                def counted(url, body, sent=sent):
                    sent.append(url)
                    return fetch(url, body)

                client = clients.setdefault(r["host"], JsonClient(counted, sleep, now, offline=offline))
                client.fetch, client.cache = counted, {}
                try:
                    urls = [u for u in r["urls"] or [] if u is not None]
                    text, error = json.dumps(client.get(urls, r["body"]), ensure_ascii=False), None
                except (ValueError, LookupError, RuntimeError) as e:
                    text, error = None, str(e)
                out.append((r["key"], "failed" if error else "fetched", len(sent), text, error))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "source", "attempts", "text", "error"])

    dealt = open_.repartition("host").sortWithinPartitions("host", "key").select("key", "urls", "body", "host")
    got = dealt.mapInArrow(run, "key string, source string, attempts long, text string, error string")
    return cut_lineage(here.unionByName(got))
