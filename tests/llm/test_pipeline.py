"""The pipeline's stages against brute-force versions on the smallest data."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import language_id, poisson_mixing, quality_gbt
from tests.llm.test_dedup import classes
from tests.llm.test_jaccard import jaccard, shingles
from tests.llm.test_layout import library_ids

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    seen = {}
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        seen[name] = (before, after)
        if name != "packing":
            assert after.columns == docs.columns
        before = after

    first, kept = seen["quality classifier"]
    model = quality_gbt.fit(first, spark.read.parquet(f"{sf}/labels.parquet"))
    x = {r.doc_id: quality_gbt.text_features((r.text or "").encode()) for r in first.collect()}
    good = {i for i, s in zip(x, model.score(np.array(list(x.values())))) if s >= 0.3}
    assert {r.doc_id for r in kept.collect()} == good

    _, tagged = seen["language ID"]
    m = language_id.fit(kept)
    sure = set()
    for r in kept.collect():
        if any(c.isalpha() for c in r.text or ""):
            bits = m.bits([r.text.encode()])[0]
            if 1 / np.exp2(bits.min() - bits).sum() >= 0.5:
                sure.add(r.doc_id)
    assert {r.doc_id for r in tagged.collect()} == sure

    _, single = seen["SimHash near-dedup"]
    sets = {r.doc_id: shingles(r.text) for r in tagged.collect()}
    comp = classes(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for c in comp.values()})

    _, mix = seen["mixing sources to target weights"]
    size, docs_of = Counter(), {}
    for r in single.collect():
        size[r.source] += max(1, len(r.text or ""))
        docs_of[r.doc_id] = r.source
    weight = {s: n**poisson_mixing.TEMPERATURE for s, n in size.items()}
    want = {}
    for i, s in docs_of.items():
        rate = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"{i}:{poisson_mixing.SEED}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        if n := int((u >= np.array(poisson_mixing.poisson_cdf(rate))).sum()):
            want[i] = n
    assert Counter(r.doc_id for r in mix.collect()) == want

    mixed, packed = seen["packing"]
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in mixed.collect()}
    assert sum(r.start == 0 for r in rows) == mixed.count()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 for s, n in fill.items() if s != max(fill))
    ids = {r.doc_id: x for r, x in zip(mixed.collect(), library_ids([r.text for r in mixed.collect()]))}
    for r in rows:
        own = np.array(ids[r.doc_id], dtype="<u4")
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0 and pipeline.ORACLE_SQL is None


def test_stages_take_clashing_columns_and_odd_rows(spark, sf):
    """Extra columns with the operators' names, null and repeated ids, null and empty texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(5)).unionByName(
        docs.limit(6).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    )
    docs = docs.unionByName(odd).cache()
    names = ["score", "predicted", "lang_pred", "window", "copy", "copies", "rate", "offset", "start", "ids", "n", "same", "node", "id", "row", "key"]
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        after, want = stage(spark, docs, sf), stage(spark, plain, sf)
        if name != "packing":
            assert after.columns == docs.columns and all(r[c] == c for r in after.select(*names).collect() for c in names)
        key = ["doc_id"] if name == "packing" else ["doc_id", "text"]
        assert Counter(map(tuple, after.select(*key).collect())) == Counter(map(tuple, want.select(*key).collect()))


def test_run_leaves_only_its_result(spark, sf, tmp_path):
    from ringfold.llm.common import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    out = pipeline.run(spark, sf)
    assert out.count() == out.count() > 0
    left = [d for d in set(os.listdir(shared_dir(spark))) - before if d.startswith("pipeline-")]
    assert len(left) == 1 and len(os.listdir(os.path.join(shared_dir(spark), left[0]))) == 1


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
