"""Document quality by histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, cut, small

TRAIN_ROWS = 20_000  # bound on the labelled sample
BINS = 64
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "upper", "digit", "space", "newline", "high", "bang", "pipe", "symbol", "comma_stop", "other_punct",
    "at_slash", "entropy", "log_words", "word_bytes", "distinct_words", "lines", "repeated_lines", "line_bytes",
    "longest_line", "top_word", "upper_start", "punct_end",
)

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*+<=>^_~`\\", dtype=np.uint8)
_OTHER = np.frombuffer(b"\"'()-:;?[]{}", dtype=np.uint8)


def text_features(text: bytes) -> list[float]:
    """Statistics of one whole text in UTF-8; an empty one has zeros only."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    p = c[c > 0] / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    w = max(1, len(words))
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    return [
        np.log1p(n),
        c[_UPPER].sum() / (1 + c[_UPPER].sum() + c[_LOWER].sum()),
        c[_DIGIT].sum() / n,
        (c[32] + c[9] + c[10] + c[13]) / n,
        c[10] / n,
        c[128:].sum() / n,
        c[33] / w,
        c[124] / w,
        c[_SYMBOL].sum() / w,
        (c[44] + c[46]) / w,
        c[_OTHER].sum() / w,
        (c[64] + c[47]) / w,
        float(-(p * np.log2(p)).sum()),
        np.log1p(len(words)),
        n / w,
        len(kinds) / w,
        float(len(lines)) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        np.log1p(max(map(len, lines), default=0)),
        max(kinds.values(), default=0) / w,
        sum(65 <= x[0] <= 90 for x in words) / w,
        sum(x[-1] in b".,!?;:" for x in words) / w,
    ]


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node i has children 2i+1 and
    2i+2; a row goes right where its feature exceeds the cut."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all rows and trees a level at a time."""
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), trees), dtype=np.int64)
            tree = np.arange(trees)[None, :]
            while trees and at[0, 0] < inner:
                at = 2 * at + 1 + (part[rows, self.feature[tree, at]] > self.cut[tree, at])
            if trees:
                out[k : k + 4096] += self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def train(
    x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.12, l2: float = 2.0, min_child: float = 2.0
) -> Trees:
    """Boosts the logistic loss on histograms of binned features.

    Deterministic: no rows or features are drawn. A node without a gainful
    split sends all its rows left.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], axis=1)
    flat = bins + np.arange(m) * BINS
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    features = np.zeros((trees, inner), dtype=np.int64)
    cuts = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (m * BINS) + flat).ravel()
            shape = (nodes, m, BINS)
            gs = np.bincount(slot, np.repeat(g, m), nodes * m * BINS).reshape(shape).cumsum(axis=2)
            hs = np.bincount(slot, np.repeat(h, m), nodes * m * BINS).reshape(shape).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < min_child) | (ht - hs < min_child)] = 0
            gain = gain.reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, best[k]] > 1e-9 and b < len(edges[f]):
                    features[t, first + k], cuts[t, first + k] = f, edges[f][b]
            node_f, node_c = features[t, at], cuts[t, at]
            at = 2 * at + 1 + (x[np.arange(n), node_f] > node_c)
        at -= inner
        value = -np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2) * rate
        leaves[t] = value
        margin += value[at]
    return Trees(features, cuts, leaves, base)


def _features(batches, text: str):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts = part.column(text).cast(pa.binary()).to_pylist()
            yield part, np.array([text_features(t or b"") for t in texts], dtype=np.float64)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    rows: int = TRAIN_ROWS,
) -> Trees | None:
    """Learns from ``rows`` distinct labelled documents (id, text) at most:
    those with the least hashes, so that neither repeats of a row nor the
    table's size change what is learned.

    Only rows where ``learn`` holds (by default crc32(id as text) mod 5 is not
    0). Null labels and labels beyond 0 and 1 are passed over; of several labels
    of one id the largest counts. None without any labelled text. The labels of
    at first 4 * ``rows`` ids meet the documents, those with the least hashes;
    where these have too few documents, more ids do.
    """
    learn = F.coalesce(crc_of_id(doc_id) % 5 != 0, F.lit(False)) if learn is None else learn
    usable = labels.where(learn & F.col(quality).isin(0, 1)).select(
        F.col(doc_id).alias("__rf_id"), F.col(quality).cast("double").alias("__rf_label")
    )
    usable = cut(usable.groupBy("__rf_id").agg(F.max("__rf_label").alias("__rf_label")))
    count, ids = usable.count(), 4 * rows
    texts = docs.select(F.col(doc_id).alias("__rf_doc"), F.col(text).alias("__rf_text"))
    texts = texts.withColumn("__rf_same", F.xxhash64(F.lit(9), F.col("__rf_doc").cast("string"), F.col("__rf_text")))
    while True:
        some = usable
        if count > ids:
            some = usable.orderBy(F.xxhash64(F.lit(9), F.col("__rf_id").cast("string")), "__rf_id").limit(ids)
        mine = F.col("__rf_doc") == F.col("__rf_id")
        found = texts.select("__rf_doc", "__rf_same").join(small(some, min(count, ids)), mine)
        found = cut(found.select("__rf_id", "__rf_same", "__rf_label").distinct())
        if ids >= count or found.count() >= rows:
            break
        ids *= 8
    least = found.orderBy("__rf_same", "__rf_id").limit(rows).withColumnRenamed("__rf_same", "__rf_hash")
    same = mine & (F.col("__rf_same") == F.col("__rf_hash"))
    chosen = texts.join(F.broadcast(least), same).drop("__rf_id", "__rf_hash")  # ``rows`` rows at most
    chosen = chosen.groupBy("__rf_doc", "__rf_same", "__rf_label").agg(F.max("__rf_text").alias("__rf_text"))

    def run(batches):
        for part, x in _features(batches, "__rf_text"):
            packed = pa.array([row.astype("<f8").tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("__rf_doc").cast(pa.string()), part.column("__rf_label"), packed], names=["id", "label", "x"]
            )

    got = chosen.select("__rf_doc", "__rf_text", "__rf_label").mapInArrow(run, "id string, label double, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], dtype="<f8") for r in got])
    return train(x, np.array([r["label"] for r in got]))


def score_quality(
    docs: DataFrame,
    model: Trees | None,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    score: str = "score",
    predicted: str = "predicted",
) -> DataFrame:
    """(doc_id, *keep, score, predicted) of every row, from its whole text.

    ``score`` is the chance of label 1, ``predicted`` 1 from 0.3 on. Null texts
    score as empty ones. Without a model every row scores 1. Ids may be null
    or repeat; columns beyond those named are not read. ``score`` and
    ``predicted`` name the outputs; of the kept columns, those of these names
    give way to them.
    """
    keep = [c for c in keep if c not in (doc_id, score, predicted)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = text if text in keep else "__rf_text"
    rows = docs.select(doc_id, *keep, *([] if text in keep else [F.col(text).alias(column)]))
    fields = [f for f in rows.schema.fields if f.name != "__rf_text"]

    def run(batches):
        m = shared.value
        for part, x in _features(batches, column):
            chance = m.score(x) if m is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(f.name) for f in fields], pa.array(chance), pa.array((chance >= THRESHOLD).astype(np.int32))],
                names=[*[f.name for f in fields], score, predicted],
            )

    return rows.mapInArrow(run, rows.drop("__rf_text").schema.add(score, "double").add(predicted, "integer"))
