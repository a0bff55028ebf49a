"""Requests as a job: caches, offline runs, retries, mirrors, pauses by host."""

import json
import os
import time

from pyspark.sql import functions as F

from ringfold.sources import http


def table(spark, *rows):
    return spark.createDataFrame([(u, b) for u, b in rows], "urls array<string>, body string").repartition(3)


def keys(spark, *rows):
    t = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "i long, urls array<string>, body string")
    return [r.key for r in t.select("i", http.request_key(F.col("urls"), F.col("body")).alias("key")).orderBy("i").collect()]


def test_cached_and_offline(spark):
    rows = [(["http://a/1"], None), (["http://a/1"], "q"), (["http://b/2", "http://c/2"], None), ([], None), (None, None)]
    k = keys(spark, *rows)
    assert k[0] == http.hash_key("GET http://a/1\n") and k[1] == http.hash_key("POST http://a/1\nq") and k[3] is None
    cache = spark.createDataFrame([(k[0], '{"x": 1}'), (k[0], '{"x": 1}'), ("other", "[]")], "key string, text string")

    def never(url, body):
        raise AssertionError(url)

    got = {r.key: r for r in http.fetch_answers(table(spark, *rows, rows[0]), never, cache, offline=True, sleep=http.no_pause).collect()}
    assert got[k[0]].source == "cached" and got[k[0]].text == '{"x": 1}' and got[k[0]].attempts == 0
    for i in (1, 2):
        assert got[k[i]].source == "failed" and "offline: no cached response for http" in got[k[i]].error and got[k[i]].attempts == 0
    assert got[""].error == "no address to request" and len(got) == 4
    assert http.fetch_answers(table(spark).limit(0), never).count() == 0


def test_retries_mirrors_and_pauses(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(url, body):
        with open(log, "a") as f:
            f.write(json.dumps([url, body, time.time(), os.getpid()]) + "\n")
        with open(log) as f:
            tries = sum(json.loads(x)[0] == url for x in f)
        name = url.rsplit("/", 1)[1]
        if name == "down":
            raise OSError("no route")
        if name == "gone":
            return 404, "not here"
        if name.startswith("late") and tries < 3:
            return (429, "") if tries == 1 else (200, "<html>")
        if name == "busy":
            return 200, '{"remark": "runtime error: out of memory"}'
        return 200, json.dumps({"url": url, "body": body})

    rows = [(["http://h/ok"], None), (["http://h/late"], "b"), (["http://g/down", "http://m/ok2"], None), (["http://g/gone", "http://m/ok3"], None), (["http://f/busy"], None), (["http://h/late2"], None)]
    got = http.fetch_answers(table(spark, *rows), fetch, sleep=http.no_pause)
    by = dict(zip(keys(spark, *rows), rows))
    seen = {by[r.key][0][0]: r for r in got.collect()}
    got.count()  # a checkpoint: nothing is asked again
    with open(log) as f:
        asked = [json.loads(x) for x in f]
    assert len(asked) == 1 + 3 + 6 + 1 + 5 + 3
    assert {u: (r.source, r.attempts) for u, r in seen.items()} == {
        "http://h/ok": ("fetched", 1), "http://h/late": ("fetched", 3), "http://g/down": ("fetched", 6), "http://g/gone": ("failed", 1),
        "http://f/busy": ("failed", 5), "http://h/late2": ("fetched", 3),
    }
    assert json.loads(seen["http://h/late"].text) == {"url": "http://h/late", "body": "b"} and json.loads(seen["http://g/down"].text)["url"] == "http://m/ok2"
    assert "404" in seen["http://g/gone"].error and "runtime error" in seen["http://f/busy"].error
    assert len({pid for url, _, _, pid in asked if url.startswith("http://h/")}) == 1  # one task a host


def test_a_second_between_requests_of_a_host(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(url, body):
        with open(log, "a") as f:
            f.write(json.dumps([url, time.time()]) + "\n")
        return 200, "{}"

    http.fetch_answers(table(spark, *[([f"http://slow/{i}"], None) for i in range(3)], (["http://other/"], None)), fetch).count()
    with open(log) as f:
        times = sorted(t for url, t in map(json.loads, f) if "slow" in url)
    assert all(b - a > 0.95 for a, b in zip(times, times[1:])) and len(times) == 3
