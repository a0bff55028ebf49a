"""SimHash and embedding near-duplicates against brute force."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ringfold.llm import common, embedding_dedup, simhash_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def plain_fingerprint(text, words=3):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens, now = [], ""
    for c in (text or "").translate(table) + " ":
        if c in " \t\n\v\f\r":
            if now:
                tokens.append(now)
            now = ""
        else:
            now += c
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    """Least id reachable, by items' order-free search."""
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


TEXTS = [
    None, "", " \t\n", "one", "ONE", "Two words", "three words here", "É A b\x85c  d", "a\u00a0b c d e", "x " * 3000,
    "x " * 3001, "emoji 😀 words here too", "x" * 100_000,
]


def test_fingerprints_equal_the_plain_definition():
    rng = np.random.default_rng(1)
    texts = TEXTS + [" ".join(rng.choice(WORDS, rng.integers(1, 700))) for _ in range(40)]
    for words in (3, 5):
        got = simhash_dedup.fingerprints(texts, words)
        assert [int(x) for x in got] == [plain_fingerprint(t, words) for t in texts]
    assert len(simhash_dedup.fingerprints([])) == 0


@pytest.mark.parametrize("distance,block", [(3, 4096), (3, 5), (5, 4096), (5, 7), (1, 4), (7, 50)])
def test_near_pairs_span_all_links(spark, distance, block):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(map(int, base))
    for b in base:  # near copies in chains around each
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    df = spark.createDataFrame(rows, "fingerprint long")
    got = {(int(np.int64(r.u).astype(np.uint64)), int(np.int64(r.v).astype(np.uint64))) for r in simhash_dedup.near_pairs(df, distance=distance, block=block).collect()}
    assert all((a ^ b).bit_count() <= distance for a, b in got)
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= distance)
    assert classes(prints, lambda a, b: (a, b) in got or (b, a) in got) == want


def test_simhash_groups(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(rng.choice(WORDS, 400)) for _ in range(20)]
    for t in texts[-20:]:  # a word changed in 400
        w = t.split()
        w[int(rng.integers(400))] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "y") for i, t in enumerate(texts)] + [(0, None, "z"), (None, "lonely text of a row without id", "n"), (None, "one", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash_dedup.simhash_groups(df).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for r in got:
        if r.doc_id is None:
            assert r.kept
            continue
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)
    assert simhash_dedup.simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("many,hot", [(1_000_000, 100_000), (1, 3)])
def test_components(spark, many, hot):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000, k) for k in range(1001, 1060)] + [(7, 7)]
    edges += [(k, k + 1) for k in range(2000, 2040)]
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    want = classes(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    got = common.components(spark.createDataFrame(edges, "u long, v long"), many, hot).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_links(rows, threshold):
    def good(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [r for r in rows if good(r)]

    def linked(a, b):
        if a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], float), np.array(b[1], float)
        return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold

    n = {i: sum(linked(a, b) for j, b in enumerate(ok) if i != j) for i, a in enumerate(ok)}
    comp = classes(range(len(ok)), lambda i, j: linked(ok[i], ok[j]))
    least = {}
    for i, c in comp.items():
        least[c] = min(least.get(c, ok[i][0]), ok[i][0])
    out = [(ok[i][0], n[i], least[comp[i]]) for i in range(len(ok))]
    return sorted(out + [(r[0], 0, r[0]) for r in rows if not good(r)], key=str)


@pytest.mark.parametrize("block_rows,leading", [(1024, 8), (9, 3)])
def test_embedding_groups(spark, block_rows, leading):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 12))
    rows = []
    for k in range(140):
        v = centres[k % 9] + rng.normal(size=12) * rng.choice([0.02, 0.1, 0.4])
        rows.append((k, [float(np.float32(x)) for x in v], [1, 1, 1, 2, None][k % 5]))
    rows += [(200 + k, rows[0][1], 1) for k in range(30)] + [(5, rows[5][1], 1)]  # exact copies, a repeated row
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 12, 1), (303, [float("nan")] * 12, 1), (304, [None] * 12, 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (None, rows[0][1], 1), (307, [float("inf")] + [1.0] * 11, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = embedding_dedup.embedding_groups(df, 0.98, leading=leading, block_rows=block_rows).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == plain_links(rows, 0.98)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_embedding_groups_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_groups(df).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.kept) for r in embedding_dedup.embedding_groups(bad).collect()) == [(1, 0, True), (2, 0, True)]


def test_interval_join_equals_all_pairs():
    rng = np.random.default_rng(2)
    a, b = (embedding_dedup._unit(rng.normal(size=(n, 6)) + 3) for n in (300, 270))
    axes = embedding_dedup.principal_axes(a)
    got = embedding_dedup.join_intervals(a, b, a @ axes[:, :3], b @ axes[:, :3], 0.98, 0.04 + 1e-9)
    assert (got == (a @ b.T >= 0.98)).all() and got.any() and not got.all()


def test_tiny_and_huge_vectors_link_like_others(spark):
    tiny = [1e-200, 2e-200, -1e-200]
    rows = [(1, tiny, 1), (2, [5e-324, 1e-323, -5e-324], 1), (3, [1e300, 2e300, -1e300], 1), (4, [1.0, 0.0, 0.0], 1)]
    for n in (1, 3, 4):
        df = spark.createDataFrame(rows[:n], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(df).collect()}
        assert got == {k: (min(n, 3) - 1, 1) if k < 4 else (0, 4) for k in range(1, n + 1)}


def test_distant_intervals_never_meet(spark):
    """On clustered vectors the recursion opens few pairs of intervals, and all near ones."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    x = embedding_dedup._unit(centres[np.repeat(np.arange(40), 100)] + rng.normal(size=(4000, 16)) * 0.02)
    x = (x @ embedding_dedup.principal_axes(x))[:, :8]
    eps2 = 0.04
    x = x[np.lexsort(np.floor(x / eps2**0.5).T[::-1])].reshape(125, 32, 8)
    lo, hi = x.min(axis=1), x.max(axis=1)
    rows = [(k // 50 << 32 | k % 50, "l", 16, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(lo, hi))]
    df = spark.createDataFrame(rows, "block long, label string, dims int, lo array<double>, hi array<double>")
    ids = [r[0] for r in rows]
    want = {(ids[i], ids[j]) for i in range(125) for j in range(i + 1, 125) if embedding_dedup._gap2(lo[i], hi[i], lo[j], hi[j]) <= eps2}
    for fan in (2, 8, 200):
        got = embedding_dedup.interval_pairs(df, 8, eps2, fan).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert len(want) < 0.1 * 125 * 124 / 2


@pytest.mark.parametrize("lengths", [16, 1, 0])
def test_every_length_has_a_selective_grid(spark, lengths):
    """Of vectors of two lengths side by side most pairs of intervals never meet, with axes of their own or without."""
    rng = np.random.default_rng(21)
    rows = []
    for dims, n in ((24, 2000), (16, 2400)):
        centres = rng.normal(size=(40, dims))
        rows += [(len(rows) + k, (centres[k % 40] + rng.normal(size=dims) * 0.02).tolist(), "x", 1) for k in range(n)]
    reps = spark.createDataFrame(rows, "rep long, vec array<double>, label string, copies long")
    grid = embedding_dedup.Grid(embedding_dedup._fit_axes(reps, 1000, lengths) if lengths else {}, 8)
    assert len(grid.axes) == min(2, lengths)
    blocks = embedding_dedup.sequence_blocks(reps, grid, 0.2, 50)
    pairs = embedding_dedup.interval_pairs(blocks, 8, 0.04)
    count = {r.dims: r["count"] for r in blocks.groupBy("dims").count().collect()}
    met = {r.dims: r["count"] for r in pairs.join(blocks.select(F.col("block").alias("a"), "dims"), "a").groupBy("dims").count().collect()}
    for dims, n in count.items():
        assert met.get(dims, 0) < 0.25 * n * (n - 1) / 2, (dims, n, met)
    got = embedding_dedup.embedding_groups(reps.select(F.col("rep").alias("vec_id"), F.col("vec").alias("embedding"), "label"), 0.98, block_rows=50, basis_lengths=max(1, lengths))
    assert {r.component_id for r in got.collect()} == {*range(40), *range(2000, 2040)}
