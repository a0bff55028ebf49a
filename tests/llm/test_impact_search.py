"""The bit-sliced impact index against plain scores."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from ringfold.llm import entry, impact_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, queries, top=50):
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(queries):
        scored = []
        for d, c in found:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank + 1, r[3], -r[0]) for rank, r in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def shown(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_equal_the_pattern():
    texts = ["", "a", "A-b_c", "Çà ÉTİx9 日本語  \u0085", "x" * 50_000, "\x00\x7f~{|}@[`^", "tab\tnew\nline\x0b\x0c\r\x1c9", "1.5e3 😀😀"]
    for t in texts:
        assert [w.decode() for w in impact_search.terms(t.encode())] == plain_terms(t)
    assert impact_search.terms(None) == []


def test_slices_add_and_rank_like_numbers():
    rng = np.random.default_rng(5)
    for docs, rows, terms in ((1, 1, 1), (64, 3, 5), (130, 7, 40)):
        values = rng.integers(0, 1 << rng.integers(1, 40, (terms, rows, 1)), (terms, rows, docs))
        values[rng.random(values.shape) < 0.5] = 0
        values[:, :, docs // 2 :] = values[:, :, :1]  # many ties
        total = []
        for v in values:
            bits = max(1, int(v.max()).bit_length())
            planes = impact_search.pack_bits(((v[None] >> np.arange(bits)[:, None, None]) & 1).astype(np.uint8), -(-docs // 64))
            impact_search.add_slices(total, planes)
        want = values.sum(axis=0)
        bits = [np.unpackbits(p.view(np.uint8), axis=1, bitorder="little")[:, :docs].astype(np.int64) for p in total]
        assert (sum(b << i for i, b in enumerate(bits)) == want).all()
        for k in (1, 3, docs, docs + 5):
            best = np.unpackbits(impact_search.top_places(total, k).view(np.uint8), axis=1, bitorder="little")
            for got, row in zip(best, want):
                order = sorted((-s, i) for i, s in enumerate(row.tolist()) if s > 0)[:k]
                assert sorted(i for _, i in order) == np.flatnonzero(got).tolist()


DOCS = [
    (5, "the cat sat"), (3, "the cat sat"), (9, "The CAT, the cat!"), (1, None), (2, ""), (4, "..."), (None, "the cat sat"), (5, "the cat sat"),
    (7, "dog " * 3000), (8, "Ünïcode cat 日本 9 lives"), (10, "dog cat"), (11, "one two three four five six seven"),
]
ITEMS = [(1, "cat"), (2, "The cat cat sat"), (3, None), (4, "?!"), (5, "dog 日本 nine 9"), (None, "seven cat"), (1, "cat"), (1, "dog"), (6, "unseen words only")]


@pytest.mark.parametrize("top,sizes", [(50, {}), (2, {}), (3, {"block_docs": 2}), (50, {"block_postings": 1, "batch_queries": 2}), (4, {"batch_terms": 1, "block_docs": 3})])
def test_rows_equal_plain_scores(spark, top, sizes):
    rng = np.random.default_rng(top)
    words = [f"w{i}" for i in range(30)]
    docs = DOCS + [(100 + i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(150)]
    items = ITEMS + [(50 + i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(12)]
    table = spark.createDataFrame([(d, t, 0, 1) for d, t in docs], "doc_id long, text string, rank int, score int").repartition(3)
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = impact_search.ranked_search(table, queries, top, **sizes)
    assert shown(got) == plain(docs, items, top)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert impact_search.ranked_search(docs.limit(0), items).collect() == []
    assert impact_search.ranked_search(docs, items.limit(0)).collect() == []


def test_query_equals_plain_scores(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert shown(entry.op12_ranked_search(spark, sf)) == plain(docs, items)
