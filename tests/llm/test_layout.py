"""Media, shards, URL rules, mixing and packing."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import bfd_packing, entry, matroska, mixture_packing, poisson_mixing, sharding, tokenization, url_filter
from ringfold.llm.matroska import element, read_media, uint, vint, write_media

# --- Matroska ------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 512, 513, 4096, 4097, 4200, 131072, 131073, 400_000])
def test_media_round_trip(n):
    payload = matroska.text_payload(np.random.default_rng(n).bytes(n))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
    data = write_media(payload)
    m = read_media(data)
    assert matroska.payload_of(data, m) == payload
    assert m.duration == len(payload) / 8 and m.tracks[1]["bits"] == 8
    assert [c[2] for c in m.cues] == m.clusters
    origin = data.index(bytes.fromhex("18538067"))
    assert all(p[4] == k * 64_000_000 for k, p in enumerate(m.packets)) and origin > 0


def frame(sizes):
    return [bytes([i]) * s for i, s in enumerate(sizes)]


def lace(kind, frames):
    head = vint(2) + struct.pack(">h", -3)
    if kind == "xiph":
        sizes = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
        return head + bytes([0x02, len(frames) - 1]) + sizes + b"".join(frames)
    return matroska.block_body(frames, 2, -3, 0)


def test_all_kinds_of_lacing_and_unknown_sizes():
    groups = [("none", [7]), ("fixed", [5, 5, 5]), ("ebml", [300, 10, 400, 1]), ("xiph", [255, 0, 600, 3])]
    blocks = [element(matroska.SIMPLE_BLOCK, lace(k, frame(s))) for k, s in groups]
    key = element(matroska.BLOCK_GROUP, element(matroska.BLOCK, lace("none", [b"k"])), uint(matroska.BLOCK_DURATION, 9))
    ref = element(matroska.BLOCK_GROUP, element(matroska.REFERENCE_BLOCK, b"\x01"), element(matroska.BLOCK, lace("none", [b"r"])))
    void = element(0xEC, b"\0" * 9)
    body = uint(matroska.CLUSTER_TIMESTAMP, 1000) + void + b"".join(blocks) + key + ref
    live = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7 + body
    known = element(matroska.CLUSTER, body)
    segment = bytes.fromhex("18538067") + b"\xff" + element(matroska.INFO, uint(matroska.TIMESTAMP_SCALE, 500)) + live + known + live
    m = read_media(matroska._HEADER + segment)
    assert len(m.clusters) == 3
    one = [p for p in m.packets if p[0] == 1]
    assert [p[6] for p in one] == [7, 5, 5, 5, 300, 10, 400, 1, 255, 0, 600, 3, 1, 1]
    assert [p[8] for p in one] == ["none"] + ["fixed"] * 3 + ["ebml"] * 4 + ["xiph"] * 4 + ["none"] * 2
    assert {p[4] for p in one} == {997 * 500} and [p[7] for p in one][-2:] == [True, False] and {p[3] for p in one} == {2}


def test_malformed_media_is_an_error(spark):
    good = write_media(b"\1" * 64)
    bad = [b"", b"\0", b"abc", good[:-1], good[:30], bytes.fromhex("1A45DFA3") + b"\x88", good.replace(b"\xa3", b"\xa3\x7f", 1)]
    for data in bad:
        with pytest.raises(matroska.MatroskaError):
            read_media(data)
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"abc")), (None, bytearray(good))]
    table = matroska.packet_table(spark.createDataFrame(rows, "k long, m binary"), "m", "k").collect()
    assert [(r.k, r.byte_length, r.error is None) for r in table] == [(1, 64, True), (3, None, False), (None, 64, True)]
    assert [(r.cue_ns, r.codec, r.sample_rate, r.track_type) for r in table][0] == (0, "A_PCM/INT/LIT", float(matroska.RATE), 2)


def test_packet_table_holds_cues_and_tracks(spark):
    data = write_media(bytes(range(256)) * 1600)
    m = read_media(data)
    rows = matroska.packet_table(spark.createDataFrame([(7, bytearray(data))], "k long, m binary"), "m", "k").orderBy("byte_start").collect()
    assert len(rows) == len(m.packets) and {r.codec for r in rows} == {"A_PCM/INT/LIT"} and len(m.clusters) > 1
    assert [(r.cue_ns, r.track, r.cluster_position) for r in rows if r.cue_ns is not None] == [(t * m.timestamp_scale, k, p) for t, k, p in m.cues]
    assert all(r.cue_ns == r.timestamp_ns for r in rows if r.cue_ns is not None)
    late = matroska.Media(packets=m.packets, clusters=m.clusters, cues=[(50, 1, m.clusters[0]), (9, 2, m.clusters[0])])
    led = [r for r in matroska.packets_of(late) if r[10] is not None]
    assert [(r[10], r[4] >= 50_000_000) for r in led] == [(50_000_000, True)]


def test_media_digests(spark):
    texts = ["", None, "é" * 33, "a" * 64, "a" * 64, "b" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("feature", F.lit(1))
    got = {r.doc_id: r for r in matroska.media_digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[3][1:] == got[4][1:] and got[0][1:] == got[1][1:]
    stored = {r.doc_id: bytes(r.media) for r in matroska.with_media(df).collect()}
    assert all(hashlib.sha256(stored[i]).hexdigest() == got[i].media_sha256 and len(stored[i]) == got[i].media_bytes for i in got)
    assert matroska.media_digests(df.limit(0)).count() == 0


# --- shards ----------------------------------------------------------------------


def plain_jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    keys = [0, 1, 2, 41, -1, -(2**63), 2**63 - 1, 10**12] + list(range(100, 400))
    rows = [(k, f"t{k}") for k in keys] + [(7, None), (7, None), (None, "x"), (8, "ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    got = sharding.shard_documents(df, 24, 25).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard) == (plain_jump(r.doc_id or 0, 24), plain_jump(r.doc_id or 0, 25)) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r.doc_id: r for r in got}
    assert (by[7].size, by[7].text_crc32, by[8].size, by[8].text_crc32) == (8, 0, 10, zlib.crc32("ü".encode()))
    assert sharding.shard_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("fan", [2, 3, 4096])
def test_running_total(spark, fan):
    from ringfold.llm.common import running_total

    rng = np.random.default_rng(fan)
    rows = [(["a", "b", None][int(rng.integers(3))], int(rng.integers(0, 40)), i, int(rng.integers(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, b long, i long, v long")
    got = {r.i: r.t for r in running_total(df, "v", "t", ["i"], "b", ["g"], fan).collect()}
    seen = Counter()
    for grp, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == seen[grp]
        seen[grp] += v


# --- URLs --------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


URLS = [
    None, "", "no scheme", "HTTP://WWW.Example.ORG/es/", "http://a.example.org/en/12?x#y", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1",
    "http://com/de/", "http://y.com", "http://y.com?de/", "http://É.com/de/x", "a://b://c.org/", "http://z.net/p/?utm_source=a&q=1&ref=b#f", "https://z.net/p?q=1",
    "http://listed.net/x", "https://www.listed.net/x/#top", "http://listed.net/X", "x://\n.org/",
]


def test_url_filter(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(15, "http://listed.net/x"), (None, "http://listed.net/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    listed = spark.createDataFrame([("listed.net/x",), ("listed.net/x",), (None,), ("com/de/",), ("15",)], "canonical string")
    got = url_filter.filter_urls(df, listed).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://listed.net/x" if r.page_id is None else URLS[r.page_id]
        host, path = plain_parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        on_list = url is not None and (r.canonical in ("listed.net/x", "com/de/"))
        assert (r.host, r.path, r.rule) == (host, path, rule[0])
        assert r.verdict == (rule[1] or ("block" if on_list else "allow")) and r.listed <= r.possible
    by = {r.page_id: r for r in got}
    assert by[13].canonical == by[14].canonical == "z.net/p?q=1" and by[16].verdict == "block" and by[17].verdict == "allow"
    assert {r.verdict for r in url_filter.filter_urls(df, listed.limit(0)).collect()} == {"allow", "block"}
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0


def test_bloom_filter_passes_all_members(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host/"), F.col("id").cast("string")).alias("canonical"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://host/"), F.col("id").cast("string")).alias("url"))
    got = url_filter.filter_urls(pages, keys).toPandas()
    assert (got.listed == (got.page_id < 3000)).all() and got.possible[got.page_id < 3000].all()
    assert got.possible[got.page_id >= 3000].mean() < 0.02


# --- mixing ------------------------------------------------------------------------


def test_poisson_inversion():
    for rate in (0.0, 0.3, 1.0, 7.5, 300.0):
        cdf = poisson_mixing.poisson_cdf(rate)
        term, total = math.exp(-rate), 0.0
        for k, c in enumerate(cdf):
            total += term
            assert c == pytest.approx(total, abs=1e-12)
            term *= rate / (k + 1)
        assert cdf[-1] > 1 - 1e-12


def test_mix_sources(spark):
    rows = [(i, f"text {i}", ["a", "b", None][i % 3 if i % 2 else 0]) for i in range(3000)] + [(None, None, "c"), (1, "text 1", "b"), (5, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("clash"))
    targets = {"a": 1.0, "b": 2.0, None: 1.0, "c": 0.001}
    got = poisson_mixing.mix_sources(df, targets).toPandas()
    again = poisson_mixing.mix_sources(df.repartition(7), targets).toPandas()
    order = ["doc_id", "copy", "text", "source"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    size = got.assign(n=got.text.fillna("").str.len().clip(lower=1)).groupby("source", dropna=False).n.sum()
    assert size["b"] / size["a"] == pytest.approx(2.0, rel=0.15)
    for (doc, source), g in got.groupby(["doc_id", "source"]):
        want = int(sum(poisson_mixing_u(doc) >= np.array(poisson_mixing.poisson_cdf(g.rate.iloc[0]))))
        assert set(g["copy"]) == set(range(want)) and (g.copies == want).all()
    assert poisson_mixing.mix_sources(df.limit(0)).count() == 0
    assert poisson_mixing.mix_sources(df, targets, detail=False).columns == df.columns


def test_any_rate_is_drawn(spark):
    for rate in (701.0, 1390.0, 1e6):
        cdf = np.array(poisson_mixing.poisson_cdf(rate))
        assert cdf[-1] == pytest.approx(1, abs=1e-9) and (1 - cdf).sum() == pytest.approx(rate, rel=1e-6)
    rows = [(i, "x" * 1000, "big") for i in range(2000)] + [(None, None, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = poisson_mixing.mix_sources(df, {"big": 1.0, "tiny": 0.001}).where("source = 'tiny'").collect()
    rate = 2_000_001 * 0.001 / 1.001
    u = int(hashlib.md5(f":{poisson_mixing.SEED}".encode()).hexdigest()[:13], 16) / float(1 << 52)
    assert all(r.rate == pytest.approx(rate) for r in got)
    assert len(got) == int((u >= np.array(poisson_mixing.poisson_cdf(rate))).sum()) == got[0].copies and abs(len(got) - rate) < 400


def test_mixing_of_many_sources_and_hot_keys(spark, monkeypatch):
    """Beyond the broadcast's bound, with a hot source, null ids and equal rows."""
    from ringfold.llm import common

    rows = [(i, f"text {i}", f"s{i % 40}") for i in range(400)] + [(None, "same", "hot")] * 300 + [(5, "same", None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = ["source", "doc_id", "copy", "copies", "rate"]
    want = poisson_mixing.mix_sources(df).toPandas()
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(poisson_mixing, "BROADCAST_ROWS", 1)
    got = poisson_mixing.mix_sources(df).toPandas()
    assert got.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True))
    spread = poisson_mixing.mix_sources(df).where("source = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1 or not (want.source == "hot").any()


def test_mixing_sql_draws_any_rate(spark, tmp_path):
    import duckdb

    rows = [(i, "x" * 2000, "big") for i in range(1500)] + [(5000 + i, "y", f"tiny{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.ORACLE_SQL["op8_poisson_mixing"]).df()
    got = entry.op8_poisson_mixing(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "copy"]
    assert got.rate.max() > 60 and (got.sort_values(key)[["doc_id", "copy", "copies", "rate"]].values == want.sort_values(key)[["doc_id", "copy", "copies", "rate"]].values).all()


def poisson_mixing_u(doc, seed=poisson_mixing.SEED):
    return int(hashlib.md5(f"{int(doc)}:{seed}".encode()).hexdigest()[:13], 16) / float(1 << 52)


# --- tokens and packing --------------------------------------------------------------

ODD = [
    None, "", "a", "It's we'll they've I'm he'd 'tis", "two  spaces\n\n\nand tabs\t\t end  ", "naïve café ½ ٣ 漢字 😀👍🏽", "<|endoftext|> as text", "before<|endoftext|>", "  <|endoftext|> \n <|endoftext|><|endoftext|>  x", "<|endoftext |>", "x" * 5000, " lead", "trail ",
    "a\u00a0\u2003b", "\u2028\u2029\x1c\x1d", "\r\n mixed \r\n\r\n", "word " * 3000, "´`'s", "12345 67 8,9",
]


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenization.vocabulary_path())
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_ids_are_the_library_s(spark, sf):
    import pyarrow as pa

    own = tokenization.encoder(tokenization.share_vocabulary(spark))
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [list(x) for x in own.encode(pa.array(texts))] == library_ids(texts)
    assert own._slow("two  spaces's") == list(next(own.encode(pa.array(["two  spaces's"]))))[:-1]


def test_pack_mixture(spark):
    texts = ODD + [f"number {i} " * (i % 50) for i in range(300)]
    rows = [(i if i % 97 else 3, t, ["a", "b", None][i % 3]) for i, t in enumerate(texts)] + [(None, "no id", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("offset", F.lit("clash")).repartition(5)
    got = mixture_packing.pack_mixture(df, sequence=64, window=512).toPandas()
    want = Counter((-1 if r[0] is None else r[0], tuple(ids)) for r, ids in zip(rows, library_ids([r[1] for r in rows])))
    got["id"] = [-1 if v != v else int(v) for v in got.doc_id]
    pieces = got.assign(ids=got.ids.map(lambda b: np.frombuffer(b, "<u4")))
    assert (pieces.ids.map(len) == pieces.length).all()
    stream = pieces.sort_values(["sequence_id", "offset"])
    assert (stream.sequence_id * 64 + stream.offset == np.concatenate([[0], stream.length.cumsum()[:-1]])).all()
    whole, now = Counter(), []
    for r in stream.itertuples():  # a document's pieces follow each other
        if r.start == 0:
            now = []
        assert r.start == len(now)
        now += r.ids.tolist()
        if len(now) == r.doc_tokens:
            whole[(r.id, tuple(now))] += 1
    assert whole == want
    assert mixture_packing.pack_mixture(df.limit(0)).count() == 0


def test_pack_mixture_spreads_repeats(spark):
    df = spark.createDataFrame([(i // 20, f"text of {i // 20}", "a") for i in range(1000)], "doc_id long, text string, source string")

    def neighbours(spread):
        rows = mixture_packing.pack_mixture(df, sequence=64, window=512, spread=spread).where("start = 0")
        ids = [r.doc_id for r in rows.orderBy("sequence_id", "offset").collect()]
        assert sorted(ids) == [i // 20 for i in range(1000)]
        return sum(a == b for a, b in zip(ids, ids[1:]))

    assert neighbours(False) == 950 and neighbours(True) < 100


def test_schedule_is_exact_far_out(spark):
    """Windows at 10**14 tokens, where doubles of the time no longer tell tokens apart."""
    n, big = 1000, 10**11
    rows = [(i, "ab"[i % 2], big + i % 7) for i in range(n)]
    got = {r.rid: r for r in mixture_packing.schedule(spark.createDataFrame(rows, "rid long, source string, n long"), None, 131072).collect()}
    whole = sum(r[2] for r in rows)
    for s in "ab":
        own = [r for r in rows if r[1] == s]
        mine, end = sum(r[2] for r in own), 0
        for rid, _, k in own:
            end += k
            assert got[rid].window == (whole * end - 1) // (mine * 131072)


def test_schedule_of_equal_rows_and_null_sources(spark):
    rows = [(None, "same text", None)] * 500 + [(1, "same text", "a")] * 700 + [(None, None, "a")] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixture_packing.pack_mixture(df, sequence=64, window=512).collect()
    assert sum(r.start == 0 for r in got) == 1210
    ends = sorted((r.sequence_id * 64 + r.offset, r.length) for r in got)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    with pytest.raises(ValueError):
        mixture_packing.pack_mixture(df, {"a": 1.0}).count()
    assert mixture_packing.whole_weights({"a": 3.0, "b": 1.5}) == {"a": 6, "b": 3}
    assert mixture_packing.whole_weights({"a": 1e30, "b": 1e-30})["b"] == 1
    assert mixture_packing.pack_mixture(df.limit(0), {"a": 1.0}).count() == 0


def test_row_buckets_split_equal_rows(spark):
    from ringfold.llm.common import last_row, row_buckets

    df = spark.range(0, 1000, 1, 4).select(F.monotonically_increasing_id().alias("rid"))
    last = df.agg(last_row("rid")).first()[0]
    rows = df.withColumn("b", row_buckets("rid", last, 30)).orderBy("rid").collect()
    assert last == 249 and [r.b for r in rows] == sorted(r.b for r in rows)
    assert max(Counter(r.b for r in rows).values()) <= 30


def test_many_shards(spark):
    """Beyond the chain's usual length, and where it is cut short."""
    keys = [0, 1, -1, 10**12] + list(range(500, 560))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for steps in (None, 1, 3):
        got = df.select("k", sharding.jump_shards(F.col("k"), 400, 450, steps).alias("j")).collect()
        assert all((r.j.shard, r.j.grown_shard) == (plain_jump(r.k, 400), plain_jump(r.k, 450)) for r in got)


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0, "c": 2.0}, {"a": 0.3, "b": 1e-3, "c": 7.7}, {"a": 1, "b": 1, "c": 1, "unused": 5}])
def test_schedule_is_deficit_round_robin(spark, targets):
    """Against a queue-by-queue simulation with carried deficits."""
    from fractions import Fraction

    rng = np.random.default_rng(4)
    rows = [(i, i, "abc"[int(rng.integers(3))], int(rng.integers(1, 400))) for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, doc_id long, source string, n long")
    window = 1000
    got = {r.rid: r for r in mixture_packing.schedule(df, targets, window).collect()}
    queues = {s: sorted((r for r in rows if r[2] == s), key=lambda r: r[0]) for s in "abc"}
    left = {s: sum(r[3] for r in q) for s, q in queues.items()}
    weight = {s: Fraction(left[s] if targets is None else targets[s]) for s in "abc"}
    deficit = dict.fromkeys("abc", Fraction(0))
    granted = dict.fromkeys("abc", Fraction(0))
    want, number = {}, 0
    total = dict(left)
    while any(queues.values()):
        room = Fraction(window)
        while room > 0 and any(granted[s] < total[s] for s in "abc"):  # shares of dry queues go to the others
            live = [s for s in "abc" if granted[s] < total[s]]
            step = min([room / sum(weight[s] for s in live)] + [(total[s] - granted[s]) / weight[s] for s in live])
            for s in live:
                granted[s] += step * weight[s]
                deficit[s] += step * weight[s]
                room -= step * weight[s]
        for s in "abc":
            while queues[s] and queues[s][0][3] <= deficit[s]:
                r = queues[s].pop(0)
                deficit[s] -= r[3]
                want[r[0]] = number
        number += 1
    assert {i: r.window for i, r in got.items()} == want
    ends = sorted((r.at, r.n, r.window) for r in got.values())
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0


def test_capacity_tree_equals_plain_best_fit():
    rng = np.random.default_rng(6)
    for size in (1, 2, 7, 64, 100):
        lengths = [int(v) for v in rng.integers(1, size + 1, 200)]
        bins, free = [], []
        for i in sorted(range(200), key=lambda i: -lengths[i]):
            fit = [(f, b) for b, f in enumerate(free) if f >= lengths[i]]
            if fit:
                least = min(f for f, _ in fit)
                b = max(b for f, b in fit if f == least)
            else:
                b = len(bins)
                bins.append([])
                free.append(size)
            bins[b].append(i)
            free[b] -= lengths[i]
        got = bfd_packing.best_fit_decreasing(lengths, size)
        load = lambda bs: sorted(sum(lengths[i] for i in b) for b in bs)
        assert load(got) == load(bins) and sorted(i for b in got for i in b) == list(range(200))
        assert all(sum(lengths[i] for i in b) <= size for b in got)
    assert bfd_packing.best_fit_decreasing([], 5) == []


def test_pack_best_fit(spark):
    texts = ODD + [f"number {i} " * (i % 50) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("used", F.lit("clash")).repartition(3)
    got = bfd_packing.pack_best_fit(df, sequence=128, group=40).collect()
    parts = defaultdict(dict)
    for r in got:
        ids, pos, cu = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4"), r.cu_seqlens
        assert len(ids) == len(pos) == 128 and cu[0] == 0 and cu[-1] == r.used <= 128 and (ids[r.used :] == 0).all()
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts)):
            assert pos[cu[k] : cu[k + 1]].tolist() == list(range(cu[k + 1] - cu[k]))
            parts[doc][start] = ids[cu[k] : cu[k + 1]].tolist()
    for (doc, _), want in zip(rows, library_ids([t for _, t in rows])):
        assert sum((parts[doc][s] for s in sorted(parts[doc])), []) == want
    assert len({r.sequence_id for r in got}) == len(got)
    assert bfd_packing.pack_best_fit(df.limit(0)).count() == 0 and bfd_packing.fill(bfd_packing.pack_best_fit(df.limit(0))) == 1


def test_fill_does_not_depend_on_the_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = bfd_packing.pack_best_fit(docs.coalesce(1)).cache()
    tokens = whole.agg(F.sum("used")).first()[0]
    assert whole.count() <= -(-tokens // 2048) + 1 and bfd_packing.fill(whole) > 0.98
    tiny = bfd_packing.pack_best_fit(docs.repartition(60))
    assert tiny.count() <= whole.count() + 1 and tiny.agg(F.sum("used")).first()[0] == tokens


def test_shards_and_manifest(spark, sf, tmp_path):
    packed = bfd_packing.pack_best_fit(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    manifest = bfd_packing.write_shards(packed, str(tmp_path / "out"), rows_a_file=30)
    files = {r.file: r for r in manifest.collect()}
    assert set(files) == {p.name for p in (tmp_path / "out/shards").glob("*.parquet")} and max(r.sequences for r in files.values()) <= 30
    assert sum(r.sequences for r in files.values()) == packed.count()
    assert sum(r.tokens for r in files.values()) == packed.agg(F.sum("used")).first()[0]
    assert all(r.tokens + r.padding == 2048 * r.sequences for r in files.values())
    back = spark.read.parquet(str(tmp_path / "out/shards"))
    assert back.exceptAll(packed).count() == 0 == packed.exceptAll(back).count()
    again = bfd_packing.write_manifest(spark, str(tmp_path / "out"))
    assert {r.file: r.checksum for r in again.collect()} == {f: r.checksum for f, r in files.items()}


# --- queries -------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_every_query_runs(spark, sf, name):
    df = entry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    table = "embeddings" if name.startswith("op1_") else "pages" if name.startswith("op7") else "documents"
    if not name.startswith(("op6", "op8", "op10")):
        assert len(rows) == spark.read.parquet(f"{sf}/{table}.parquet").count()
