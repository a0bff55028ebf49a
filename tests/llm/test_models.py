"""PPM and boosted trees against plain versions, and on held-out rows."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import entry, language_id, quality_gbt


class PlainPpm:
    """Method C with escapes down to an even chance, without exclusion."""

    def __init__(self, model, texts, order):
        self.m, self.order = model, order
        self.counts = {lang: defaultdict(lambda: defaultdict(int)) for lang in texts}
        for lang, docs in texts.items():
            for t in docs:
                s = [0, *model.codes[np.frombuffer(t, dtype=np.uint8)].tolist()]
                for i in range(1, len(s)):
                    for k in range(min(order, i) + 1):
                        self.counts[lang][tuple(s[i - k : i])][s[i]] += 1

    def bits(self, text, lang):
        s = [0, *self.m.codes[np.frombuffer(text, dtype=np.uint8)].tolist()]
        total = 0.0
        for i in range(1, len(s)):
            for k in range(min(self.order, i), -1, -1):
                seen = self.counts[lang].get(tuple(s[i - k : i]))
                if not seen:
                    continue
                n, kinds = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total -= math.log2(seen[s[i]] / (n + kinds))
                    break
                total -= math.log2(kinds / (n + kinds))
            else:
                total += math.log2(self.m.alphabet - 1)
        return total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_are_exact(order):
    texts = {"xx": [b"abracadabra", b"banana band", b"abba"], "yy": [b"zebra zoo", "où ça".encode(), b"aaaa"], "zz": [b"q"]}
    model = language_id.train(texts, order)
    plain = PlainPpm(model, texts, order)
    probes = [b"abra", b"banana zebra", "ça où".encode(), b"!?", b"a", b"QUEUE Abba", bytes(range(256)), b"ab" * 300]
    got = model.bits(probes)
    for p, row in zip(probes, got):
        for lang, bits in zip(model.languages, row):
            assert bits == pytest.approx(plain.bits(p, lang), rel=1e-4)


def test_long_texts_are_scored_like_short_ones(monkeypatch):
    model = language_id.train({"a": [b"the cat sat on the mat"], "b": [b"le chat est sur le tapis"]})
    text = b"the cat and le chat " * 50
    whole = model.bits([text])
    monkeypatch.setattr(language_id, "_CHUNK", 64)
    assert model.bits([text]) == pytest.approx(whole, rel=1e-5)


def test_language_rows(spark):
    model = language_id.train({"en": [b"the cat sat on the mat"], "fr": [b"le chat est sur le tapis"]})
    rows = [(1, "the cat", "x"), (1, "le chat", "x"), (2, None, "x"), (3, "", "x"), (4, "12 !?", "x"), (None, "the mat", "x"), (5, "é" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify_languages(df, model).collect()]
    assert [g[:2] for g in got[:6]] == [(1, "en"), (1, "fr"), (2, "und"), (3, "und"), (4, "und"), (None, "en")]
    assert all(0 <= g[2] <= 1 for g in got)
    assert {r.lang_pred for r in language_id.identify_languages(df, None).collect()} == {"und"}
    assert language_id.identify_languages(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(empty) is None


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, "the cat sat on the mat and slept ", "en") for i in range(30)]
    rows += [(100 + i, "le chat est sur le tapis et dort " * 1000, "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    got = language_id.identify_languages(docs, model, keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)
    sample = language_id.training_sample(docs, F.lit(True), "doc_id", "text", "lang", per_language=40)
    assert {k: len(v) for k, v in sample.items()} == {"en": 30, "fr": 30}
    assert {len(t) for t in sample["fr"]} == {33000}  # whole texts


def test_long_labelled_texts_alone_are_learned(spark):
    """No text is too long to learn from, and the sample stays bounded in rows and bytes."""
    rows = [(i, f"the cat sat on mat {i} and slept " * 2000, "en") for i in range(12)]
    rows += [(100 + i, f"le chat est sur le tapis {i} et dort " * 2000, "fr") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_languages(docs, language_id.fit(docs), keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got) and len(got) == 24
    sample = language_id.training_sample(docs, F.lit(True), "doc_id", "text", "lang", nbytes=100_000)
    assert all(1 <= len(v) <= 3 for v in sample.values())


def test_repeated_ids_are_told_apart(spark):
    rows = [(7, f"text number {i}", "en") for i in range(3000)] + [(7, "the same text", "en")] * 3000 + [(8, "un texte", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs, F.lit(True), "doc_id", "text", "lang", per_language=50)
    assert len(sample["en"]) == 50 == len(set(sample["en"])) and sample["fr"] == [b"un texte"]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    assert quality_gbt.fit(docs, labels, learn=F.lit(True), rows=100) is not None


def test_sparse_tables_give_the_same_costs(monkeypatch):
    texts = {"a": [b"the cat sat on the mat"] * 3, "b": [b"le chat est sur le tapis"]}
    probes = [b"the chat", b"", b"zzz the", bytes(range(256))]
    dense = language_id.train(texts).bits([p for p in probes if p])
    monkeypatch.setattr(language_id, "_DENSE", 1)
    sparse = language_id.train(texts)
    assert any(not isinstance(t, np.ndarray) for t in sparse.tables)
    assert (sparse.bits([p for p in probes if p]) == dense).all()


def test_outputs_of_kept_names(spark):
    df = spark.createDataFrame([(1, "the cat", "x", 5)], "doc_id long, text string, score string, predicted int")
    model = language_id.train({"en": [b"the cat sat on the mat"], "fr": [b"le chat"]})
    a = language_id.identify_languages(df, model, keep=["score", "text"])
    assert a.columns == ["doc_id", "text", "lang_pred", "score"] and a.first().score > 0.5
    b = language_id.identify_languages(df, model, keep=["score"], score="own")
    assert b.first().score == "x" and b.first().own > 0.5
    c = quality_gbt.score_quality(df, None, keep=["score", "predicted"], score="s", predicted="p").first()
    assert (c.score, c.predicted, c.s, c.p) == ("x", 5, 1.0, 1)


def test_language_query_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = entry.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = quality_gbt.train(x, y, trees=40, depth=3)
    plain = np.full(len(x), t.base)
    for k in range(len(t.feature)):
        for i, row in enumerate(x):
            at = 0
            while at < t.feature.shape[1]:
                at = 2 * at + (2 if row[t.feature[k, at]] > t.cut[k, at] else 1)
            plain[i] += t.leaf[k, at - t.feature.shape[1]]
    assert t.score(x) == pytest.approx(1 / (1 + np.exp(-plain)))
    assert ((t.score(x) > 0.5) == y).mean() > 0.95
    same = quality_gbt.train(np.ones((20, 2)), np.ones(20))
    assert (same.score(np.ones((3, 2))) > 0.9).all() and len(same.score(np.ones((0, 2)))) == 0


def test_a_tree_s_splits_are_the_best_of_all():
    """Depth two against a search over all cuts of every node."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (60, 4)).astype(float)
    y = ((x[:, 1] > 5) & (x[:, 2] > 3) | (x[:, 0] > 10)).astype(float)
    t = quality_gbt.train(x, y, trees=1, depth=2, rate=0.5, l2=2.0, min_child=1.0)
    p = 1 / (1 + np.exp(-t.base))
    assert p == pytest.approx(y.mean(), abs=0.05)
    g, h = p - y, np.full(60, p * (1 - p))
    at = np.zeros(60, dtype=int)
    for level in range(2):
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            own = at == node
            best, value = 1e-9, lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
            for f in range(4):
                for c in np.unique(x[:, f])[:-1]:
                    left, right = own & (x[:, f] <= c), own & (x[:, f] > c)
                    if h[left].sum() >= 1 and h[right].sum() >= 1:
                        best = max(best, value(left) + value(right) - value(own))
            f, c = t.feature[0, node], t.cut[0, node]
            left, right = own & (x[:, f] <= c), own & (x[:, f] > c)
            if best > 1e-9:
                assert value(left) + value(right) - value(own) == pytest.approx(best)
            at[left], at[right] = 2 * node + 1, 2 * node + 2
    for leaf in range(4):
        own = at == 3 + leaf
        assert t.leaf[0, leaf] == pytest.approx(-g[own].sum() / (h[own].sum() + 2.0) * 0.5)


def test_features_equal_plain_counts():
    text = "Hello, World! 12 cats & dogs | a@b/c\n\nHello, World! 12 cats & dogs | a@b/c\n(naïve) x."
    got = dict(zip(quality_gbt.FEATURES, quality_gbt.text_features(text.encode())))
    raw, words = text.encode(), text.encode().split()
    lines = [x for x in text.split("\n") if x]
    letters = [c for c in text if c.isascii() and c.isalpha()]
    want = {
        "log_bytes": math.log(1 + len(raw)), "upper": sum(c.isupper() for c in letters) / (1 + len(letters)), "digit": sum(c.isdigit() for c in text) / len(raw),
        "space": sum(c in " \t\n\r" for c in text) / len(raw), "newline": text.count("\n") / len(raw), "high": 2 / len(raw), "bang": 2 / len(words),
        "pipe": 2 / len(words), "symbol": 2 / len(words), "comma_stop": 3 / len(words), "other_punct": 2 / len(words), "at_slash": 4 / len(words),
        "entropy": -sum(raw.count(b) / len(raw) * math.log2(raw.count(b) / len(raw)) for b in set(raw)), "log_words": math.log(1 + len(words)),
        "word_bytes": len(raw) / len(words), "distinct_words": len(set(words)) / len(words), "lines": 3 / len(words), "repeated_lines": 1 / 3,
        "line_bytes": math.log(1 + len(raw) / 3), "longest_line": math.log(1 + max(map(len, lines))), "top_word": 2 / len(words),
        "upper_start": 4 / len(words), "punct_end": 5 / len(words),
    }
    assert got == pytest.approx(want)


def test_features_of_odd_texts():
    for t in (b"", b" ", b"\n\n", "é".encode() * 10, b"\xff\x00", b"word", b"a b " * 50_000):
        f = quality_gbt.text_features(t)
        assert len(f) == len(quality_gbt.FEATURES) and np.isfinite(f).all()
    assert quality_gbt.text_features(b"") == [0.0] * len(quality_gbt.FEATURES)


def test_quality_query_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = entry.op9_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out]
    assert (held.quality == held.predicted).mean() > 0.95 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here."), (2, None), (2, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit(7))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_gbt.fit(docs, none) is None
    odd = spark.createDataFrame([(1, None), (2, 5), (None, 1), (9, 1)], "doc_id long, quality int")
    assert quality_gbt.fit(docs, odd) is None
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    model = quality_gbt.fit(docs, labels, learn=F.lit(True))
    rows = quality_gbt.score_quality(docs, model).collect()
    assert len(rows) == 4 and rows[1].score == rows[2].score
    assert all(r.predicted == 1 for r in quality_gbt.score_quality(docs, None).collect())
    assert quality_gbt.score_quality(docs.limit(0), model).count() == 0


def repeated(df, times):
    """``df`` with a million repeats of its first row."""
    first = df.orderBy("doc_id").limit(1)
    return df.unionByName(first.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("k"))


def held_out_texts(n, words, lead):
    rng = np.random.default_rng(n)
    return [f"{lead}{i} " + " ".join(rng.choice(words, 30)) for i in range(n)]


def test_quality_is_learned_alike_where_a_row_repeats(spark):
    good = held_out_texts(300, "some plain words in a row and more of them".split(), "Text ")
    bad = held_out_texts(300, "*** $$$ ### 123 !!! ||| zz".split(), "??? ")
    rows = [(i, t) for i, t in enumerate([x for pair in zip(good, bad) for x in pair])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(600)], "doc_id long, quality int")
    one = quality_gbt.fit(docs, labels, rows=150)
    many = quality_gbt.fit(repeated(docs, 1_000_000), labels.unionByName(repeated(labels, 5)), rows=150)
    for a, b in ((one.feature, many.feature), (one.cut, many.cut), (one.leaf, many.leaf)):
        assert (a == b).all()
    held = [(r.doc_id, r.predicted) for r in quality_gbt.score_quality(docs, one).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 90 and all(p == 1 - i % 2 for i, p in held)


def test_quality_widens_its_ids_where_documents_miss_them(spark):
    docs = spark.createDataFrame([(i, ("fine words here. " if i % 2 else "$$$ *** ") * 9 + str(i)) for i in range(40)], "doc_id long, text string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    model = quality_gbt.fit(docs, labels, learn=F.lit(True), rows=30)
    assert all(r.predicted == r.doc_id % 2 for r in quality_gbt.score_quality(docs, model).collect())


def test_languages_are_learned_alike_where_a_row_repeats(spark):
    en, de = "the cat sat on a mat and then it slept".split(), "der hund lief schnell nach haus und schlief".split()
    rows = [(i, t, "en") for i, t in enumerate(held_out_texts(200, en, ""))] + [(1000 + i, t, "de") for i, t in enumerate(held_out_texts(200, de, ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = [language_id.training_sample(d, F.lit(True), "doc_id", "text", "lang", per_language=50) for d in (docs, repeated(docs, 1_000_000))]
    assert sample[0] == sample[1] and {k: len(v) for k, v in sample[0].items()} == {"en": 50, "de": 50}


def test_many_languages_take_room_in_proportion():
    """Code lengths of a language don't depend on the others, and the model grows with their number."""
    rng = np.random.default_rng(4)
    texts = {}
    for k in range(32):
        letters = rng.choice(list(b"abcdefghijklmnopqrstuvwxyz"), 9, replace=False)
        texts[f"l{k:02}"] = [bytes(rng.choice([*letters, 32], 4000).astype(np.uint8).tolist()) for _ in range(3)]
    few, many = language_id.train(dict(list(texts.items())[:8])), language_id.train(texts)
    assert many.nbytes < 6 * few.nbytes and many.languages == sorted(texts)
    probe = [texts["l03"][0], texts["l30"][1][:100]]
    plain = PlainPpm(many, {k: texts[k] for k in ("l03", "l30")}, language_id.ORDER)
    got = many.bits(probe)
    for text, row in zip(probe[1:], got[1:]):
        for lang in ("l03", "l30"):
            assert row[many.languages.index(lang)] == pytest.approx(plain.bits(text, lang), rel=1e-4)
    assert [many.languages[i] for i in got.argmin(axis=1)] == ["l03", "l30"]
