"""The pipeline's near-duplicate stage against all pairs of exact similarities."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import jaccard_dedup, simhash_dedup
from tests.llm.test_dedup import classes

pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted(seed, copies=1):
    """Texts with scattered edits, so that pairs lie from J = 0.7 to 1."""
    rng = np.random.default_rng(seed)
    texts = [None, "", "one", "One"]
    for edits in range(14):
        base = [f"w{k}" for k in rng.integers(0, 3000, 300)]
        texts.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for at in rng.choice(300, edits, replace=False):
                own[at] = f"x{rng.integers(1 << 40)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("copies,paired,block", [(1, 12, 4096), (4, 2, 3), (6, 3, 4096)])
def test_similar_pairs_link(spark, copies, paired, block):
    texts = planted(copies, copies)
    sets = [shingles(t) for t in texts]
    levels = [jaccard(a, b) for a, b in itertools.combinations(sets, 2)]
    assert sum(0.8 <= j < 0.9 for j in levels) > 2 and sum(0.7 <= j < 0.8 for j in levels) > 1
    want = classes(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = jaccard_dedup.drop_similar(docs, paired=paired, block=block)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))


def test_stage_drops_scattered_edits(spark, sf):
    texts = planted(9, 2)
    sets = [shingles(t) for t in texts]
    want = classes(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, sf).collect()) == sorted(set(want.values()))


def test_stage_keeps_texts_that_share_only_a_filler(spark, sf):
    texts = ["- " * 500 + " ".join(f"t{k}w{i}" for i in range(200)) for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pipeline.near_duplicates(spark, docs, sf).count() == 4


def test_rows_are_told_apart_by_text(spark):
    """Reused and null ids: texts alone link, and no unlike text goes."""
    w = [f"w{k}" for k in range(200)]
    near = " ".join([*w[:100], "changed", *w[101:]])
    rows = [
        (1, " ".join(w), "a"), (1, "two unlike texts under one id are two documents", "b"), (7, near, "c"), (7, "of id seven something else", "d"),
        (7, "of id seven something else", "e"), (None, near, "f"), (None, "only a null id has this", "g"), (None, "only a null id has this", "h"),
        (5, None, "i"), (3, " ", "j"), (None, "", "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same string")
    got = sorted(((r.doc_id, r.text) for r in jaccard_dedup.drop_similar(docs).collect()), key=str)
    want = [(1, rows[0][1]), (1, rows[1][1]), (7, rows[3][1]), (None, rows[6][1]), (3, " ")]
    assert got == sorted(want, key=str)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert jaccard_dedup.drop_similar(named).count() == 5
    assert jaccard_dedup.drop_similar(docs.limit(0)).count() == 0


def test_a_big_group_of_near_copies_is_one(spark):
    """Copies that all share their shingles: held against hubs, not all in pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(400):
        own = list(base)
        for at in rng.choice(120, k % 4, replace=False):
            own[at] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    texts += [" ".join(base[:60]) + f" and then in text {k} other " + " ".join(f"t{k}v{i}" for i in range(60)) for k in range(40)]
    sets = [shingles(t) for t in texts]
    want = classes(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for paired, block in ((32, 4096), (4, 50)):
        out = jaccard_dedup.drop_similar(docs, paired=paired, block=block)
        assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))


def test_recall_of_planted_near_copies(spark):
    """Every pair of a similarity of 0.8 or more, against the share that the SimHash finds alone."""
    texts = planted(31, 3)
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in jaccard_dedup.drop_similar(docs).collect()}
    assert all(a not in kept or b not in kept for a, b in pairs) and len(pairs) > 30
    prints = simhash_dedup.fingerprints(texts, 5)
    assert sum(int(prints[a] ^ prints[b]).bit_count() <= 3 for a, b in pairs) < len(pairs)


def test_prefixes_go_before_the_sets_are_made(spark, monkeypatch):
    import os

    texts = [" ".join(f"w{i}x{k}" for k in range(40 + i % 2)) for i in range(6)] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wrote, plain = [], jaccard_dedup.written_table

    def watched(df):
        if "own" in df.columns:
            assert not [p for columns, p in wrote if "head" in columns and os.path.exists(p.removeprefix("file:"))]
        table = plain(df)
        wrote.append((df.columns, table.path))
        return table

    monkeypatch.setattr(jaccard_dedup, "written_table", watched)
    assert sorted(r.doc_id for r in jaccard_dedup.drop_similar(docs).collect()) == list(range(6))
    assert any("own" in columns for columns, _ in wrote) and any("head" in columns for columns, _ in wrote)
