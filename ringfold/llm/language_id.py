"""Language identification by prediction by partial matching (PPM).

For every language a variable-order tree of byte contexts holds counts. The
code length of a byte in a context is exact: its count in the longest context
that has seen it, after the escapes of the longer ones (method C), and an even
chance over the alphabet at the end. Statistics are frozen after training, so
all code lengths are tabulated once and texts are scored by table lookups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, cut, small

UNDETERMINED = "und"
ORDER = 3  # bytes of context
TRAIN_DOCS = 400  # bound on the training sample, in texts a language
TRAIN_BYTES = 4_000_000  # and in bytes; the text that passes it is the last
TRAIN_TOTAL = 64_000_000  # bytes of all languages, shared evenly
PART = 4  # languages whose trees share their nodes
_CHUNK = 1 << 19  # positions scored at once, with four languages
_DENSE = 1 << 25  # entries up to which the lookups of one level are plain arrays, in all parts


@dataclass
class SparseTable:
    """A level's lookup by search, for trees whose plain array would be too long."""

    keys: np.ndarray

    def of(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0).astype(np.int32)


@dataclass
class PpmPart:
    """Union of some languages' trees, one level an order, with tabulated costs.

    A node of level k is a string of k + 1 codes; level tables lead from
    (node of the string without its last code) * alphabet + code to the node.
    Node 0 of a level is "never seen".
    """

    languages: list[str]
    codes: np.ndarray  # of a byte
    alphabet: int
    tables: list[np.ndarray | SparseTable]  # level k: (nodes of level k - 1) * alphabet
    cost: list[np.ndarray]  # level k: code length of the last code after the rest, (nodes, languages)
    escape: list[np.ndarray]  # level k: sum of the escapes of the string and its suffixes as contexts

    def _nodes(self, codes: np.ndarray) -> list[np.ndarray]:
        """For every position the node of each level that ends there."""
        levels = [self.tables[0][codes]]
        for table in self.tables[1:]:
            node = np.zeros_like(levels[0])
            key = levels[-1][:-1].astype(np.int64) * self.alphabet + codes[1:]
            node[1:] = table[key] if isinstance(table, np.ndarray) else table.of(key)
            levels.append(node)
        return levels

    @property
    def chunk(self) -> int:
        """Positions scored at once: their costs in all languages are held."""
        return max(64, 4 * _CHUNK // max(4, len(self.languages)))

    def position_costs(self, codes: np.ndarray) -> np.ndarray:
        """(positions, languages) code lengths in bits; the first position's is zero."""
        levels = self._nodes(codes)
        top = len(levels) - 1
        out = self.cost[top][levels[top]]  # a row of zeros where never seen
        open_ = np.flatnonzero(levels[top] == 0)
        open_ = open_[open_ > 0]
        if len(open_):
            before = [level[open_ - 1] for level in levels[:top]]  # contexts
            full = np.zeros((len(open_), len(self.languages)), dtype=np.float32)
            for k in range(top):
                full = np.where((before[k] > 0)[:, None], self.escape[k][before[k]], full)
            rest = np.ones(len(open_), dtype=bool)
            for k in range(top - 1, -1, -1):
                here = rest & (levels[k][open_] > 0)
                at = np.flatnonzero(here)
                used = self.escape[k - 1][before[k - 1][at]] if k else 0
                out[open_[at]] = self.cost[k][levels[k][open_[at]]] + full[at] - used
                rest &= ~here
            # The alphabet is whole, so that level 0 has every code.
        out[0] = 0
        return out

    def bits(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, languages) code lengths in bits of whole texts."""
        total = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                total[i] = self._long(text)
                continue
            group.append(i)
            held += len(text) + 1
            if held > self.chunk:
                total[group] = self._many([texts[k] for k in group])
                group, held = [], 0
        if group:
            total[group] = self._many([texts[k] for k in group])
        return total

    def _many(self, texts: list[bytes]) -> np.ndarray:
        """Each text follows a start mark, code 0, and no context passes a mark
        (training texts begin with it too)."""
        raw = np.frombuffer(b"".join(b"\0" + t for t in texts), dtype=np.uint8)
        codes = self.codes[raw]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        codes[starts] = 0
        costs = self.position_costs(codes)
        costs[starts] = 0
        return np.add.reduceat(costs, starts, axis=0, dtype=np.float64)

    def _long(self, text: bytes) -> np.ndarray:
        total = np.zeros(len(self.languages))
        lead = len(self.tables)
        codes = np.concatenate(([0], self.codes[np.frombuffer(text, dtype=np.uint8)])).astype(self.codes.dtype)
        for k in range(1, len(codes), self.chunk):
            back = max(0, k - lead)
            costs = self.position_costs(codes[back : k + self.chunk])
            total += costs[k - back :].sum(axis=0, dtype=np.float64)
        return total


@dataclass
class PpmModel:
    """The languages' trees, ``PART`` languages together. A node takes room for
    the languages of its own part only, so that the model grows with the sum of
    the trees and not with nodes times languages. All parts have one alphabet;
    a language's code lengths depend on its own counts alone.
    """

    parts: list[PpmPart]

    @property
    def languages(self) -> list[str]:
        return [lang for p in self.parts for lang in p.languages]

    @property
    def codes(self) -> np.ndarray:
        return self.parts[0].codes

    @property
    def alphabet(self) -> int:
        return self.parts[0].alphabet

    @property
    def tables(self) -> list[np.ndarray | SparseTable]:
        return [t for p in self.parts for t in p.tables]

    @property
    def nbytes(self) -> int:
        plain = [t.keys if isinstance(t, SparseTable) else t for t in self.tables]
        return sum(a.nbytes for a in [*plain, *(a for p in self.parts for a in (*p.cost, *p.escape))])

    def bits(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, languages) code lengths in bits of whole texts."""
        return np.concatenate([p.bits(texts) for p in self.parts], axis=1)


def train(texts: dict[str, list[bytes]], order: int = ORDER) -> PpmModel:
    """Counts the contexts of every language and tabulates the code lengths."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32  # ASCII case carries little about the language
    seen = np.zeros(256, dtype=bool)
    for docs in texts.values():
        for t in docs:
            seen |= np.bincount(fold[np.frombuffer(t, dtype=np.uint8)], minlength=256) > 0
    # Codes: 0 the start mark, 1 any byte not seen in training, then the others.
    kinds = np.flatnonzero(seen)
    rank = np.ones(256, dtype=np.int64)
    rank[kinds] = np.arange(2, 2 + len(kinds))
    codes, size, languages = rank[fold], len(kinds) + 2, sorted(texts)
    groups = [languages[k : k + PART] for k in range(0, len(languages), PART)]
    dense = _DENSE // max(1, len(groups))
    return PpmModel([_train_part({lang: texts[lang] for lang in group}, codes, size, order, dense) for group in groups])


def _train_part(texts: dict[str, list[bytes]], codes: np.ndarray, size: int, order: int, dense: int) -> PpmPart:
    languages, streams = list(texts), {}
    for lang in languages:
        parts = [np.concatenate(([0], codes[np.frombuffer(t, dtype=np.uint8)])) for t in texts[lang]]
        streams[lang] = np.concatenate(parts) if parts else np.zeros(1, dtype=np.int64)

    # Strings of k + 1 codes as numbers, with their counts by language.
    grams: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for k in range(order + 1):
        by = []
        for lang in languages:
            s = streams[lang]
            n = len(s) - k
            if n <= 0:
                by.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
                continue
            key = np.zeros(n, dtype=np.int64)
            clean = np.ones(n, dtype=bool)
            for j in range(k + 1):
                code = s[j : j + n]
                key = key * size + code
                if j:
                    clean &= code != 0  # a mark only ever begins a string
            by.append(np.unique(key[clean], return_counts=True))
        union = np.unique(np.concatenate([b[0] for b in by] + ([np.arange(size)] if not k else [])))
        table = np.zeros((len(union), len(languages)), dtype=np.int64)
        for i, (key, n) in enumerate(by):
            table[np.searchsorted(union, key), i] = n
        if k == 0:
            table[0] = 0  # the start mark is never coded
        grams.append(union)
        counts.append(table)

    tables, cost, escape = [], [], []
    uniform = np.log2(size - 1.0)
    for k in range(order + 1):
        union, n = grams[k], counts[k]
        parent = np.searchsorted(grams[k - 1], union // size) if k else np.zeros(len(union), dtype=np.int64)
        parents = len(grams[k - 1]) if k else 1
        sums = np.zeros((parents, n.shape[1]))
        kinds_after = np.zeros_like(sums)
        np.add.at(sums, parent, n)
        np.add.at(kinds_after, parent, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            own_escape = np.where(sums > 0, np.log2(sums + kinds_after) - np.log2(kinds_after), 0.0)
            direct = np.log2(sums + kinds_after)[parent] - np.log2(n)
        if k:
            suffix = np.searchsorted(grams[k - 1], union % size ** k)
            shorter = cost[k - 1][1:][suffix]
            # Escapes of the contexts of level k - 1 and of all their suffixes.
            chain = own_escape.copy()
            if k > 1:
                chain += escape[k - 2][1:][np.searchsorted(grams[k - 2], grams[k - 1] % size ** (k - 1))]
            else:
                chain += root_escape
            escape.append(np.concatenate([np.zeros((1, n.shape[1])), chain]))
            cost.append(np.concatenate([np.zeros((1, n.shape[1])), np.where(n > 0, direct, own_escape[parent] + shorter)]))
            key = (parent + 1) * size + union % size  # rises with the node
            if (parents + 1) * size <= dense:
                lookup = np.zeros((parents + 1) * size, dtype=np.int32)
                lookup[key] = np.arange(1, len(union) + 1)
            else:
                lookup = SparseTable(key)
        else:
            root_escape = np.zeros((1, n.shape[1]))
            cost.append(np.concatenate([np.zeros((1, n.shape[1])), np.where(n > 0, direct, own_escape[parent] + uniform)]))
            lookup = np.arange(1, size + 1, dtype=np.int32)
        tables.append(lookup)
    f32 = [c.astype(np.float32) for c in cost]
    return PpmPart(languages, codes.astype(np.int32), size, tables, f32, [e.astype(np.float32) for e in escape])


def training_sample(
    docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str, per_language: int = TRAIN_DOCS, nbytes: int = TRAIN_BYTES
) -> dict[str, list[bytes]]:
    """Up to ``per_language`` texts and, beyond the first text, ``nbytes`` bytes
    of each language: the bound on what training reads, whatever the texts'
    lengths, and on what the driver holds.

    Rows are taken whole, those with the least hashes of (id, text), so that
    rows of one id are told apart, the same row twice is taken once, and
    neither repeats nor the table's size change what is taken. Hashes below a
    language's own limit, set by an estimate of its distinct ones, are a bounded
    first choice of them; running bytes then end a language's sample.
    """
    labelled = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(F.lit(2), F.col(doc_id).cast("string"), F.col(text)).alias("chance"), F.col(text).alias("text")
    )
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("chance").alias("kinds")).collect()
    if not sizes:
        return {}
    nbytes = min(nbytes, TRAIN_TOTAL // len(sizes))
    limits = [(r["lang"], _limit(r["kinds"], per_language)) for r in sizes]
    table = docs.sparkSession.createDataFrame(limits, "q string, most long")
    near = labelled.join(small(table, len(limits)), F.col("lang") == F.col("q")).where(F.col("chance") <= F.col("most"))
    first = near.groupBy("lang", "chance").agg(F.max(F.octet_length("text")).cast("long").alias("n"))
    w = Window.partitionBy("lang").orderBy("chance").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("lang", "chance", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.coalesce(F.count("*").over(w), F.lit(0)).alias("at"))
    chosen = cut(first.where((F.col("at") < per_language) & (F.col("before") < nbytes)).select("lang", "chance"))
    picked = labelled.join(small(chosen), ["lang", "chance"]).groupBy("lang", "chance").agg(F.max("text").alias("text"))
    out: dict[str, list[bytes]] = {r["lang"]: [] for r in sizes}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["chance"])):
        out[r["lang"]].append(r["text"].encode("utf-8", "surrogatepass"))
    return out


def _limit(kinds: int, wanted: int) -> int:
    """A signed hash under which the wanted ones lie: about twice as many and
    some more, since the estimate of all is a few hundredths off."""
    share = min(1.0, (2 * wanted + 100) / max(1, kinds))
    return min(2**63 - 1, int(-(2**63) + share * 2.0**64))


def identify_languages(
    docs: DataFrame,
    model: PpmModel | None,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    pred: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) of every row; texts are read whole.

    ``lang_pred`` is the language whose model codes the text shortest (ties:
    the first by name), ``score`` its share of the likelihoods under an even
    prior. Null texts and texts without a letter are ``und`` with score 0, as
    is everything without a model. Ids may be null or repeat; columns beyond
    those named are not read. ``pred`` and ``score`` name the outputs; of the
    kept columns, those of these names give way to them.
    """
    keep = [c for c in keep if c not in (doc_id, pred, score)]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    column = text if text in keep else "__rf_text"
    rows = docs.select(
        doc_id,
        *keep,
        *([] if text in keep else [F.col(text).alias(column)]),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__rf_letter"),
    )
    fields = [f for f in rows.schema.fields if f.name not in ("__rf_text", "__rf_letter")]

    def run(batches):
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(column).cast(pa.binary()).to_pylist()
                letter = part.column("__rf_letter").to_pylist()
                found = [UNDETERMINED] * len(texts)
                share = np.zeros(len(texts))
                at = [i for i, has in enumerate(letter) if has]
                if at and m is not None and m.languages:
                    bits = m.bits([texts[i] for i in at])
                    best = bits.argmin(axis=1)
                    gain = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
                    share[at] = 1 / np.exp2(-gain).sum(axis=1)
                    for i, b in zip(at, best.tolist(), strict=True):
                        found[i] = m.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in fields], pa.array(found), pa.array(share)],
                    names=[*[f.name for f in fields], pred, score],
                )

    schema = rows.drop("__rf_text", "__rf_letter").schema.add(pred, "string").add(score, "double")
    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> PpmModel | None:
    """The production model: learned where crc32(id as text) mod 3 is not 1."""
    learn = F.coalesce(crc_of_id(doc_id) % 3 != 1, F.lit(False))
    sample = training_sample(docs, learn, doc_id, text, lang)
    return train(sample) if sample else None
