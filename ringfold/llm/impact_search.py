"""Ranked lexical search over a bit-sliced impact index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

TOP = 50
BLOCK_DOCS = 4096  # documents of one block, the width of its bitmaps
BLOCK_POSTINGS = 500_000  # a block ends early beyond it
BATCH_TERMS = 100_000  # distinct terms of the queries that are searched at once
BATCH_QUERIES = 2_000  # and their number
GROUP_TASKS = 1_000  # tasks whose best rows meet first
_PLANE_WORDS = 1 << 15  # words of one bit slice of all queries that are added at once

#: Every byte that can't be part of a term becomes a space, A-Z their small
#: letters; bytes from 0x80 on belong to letters beyond ASCII.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, in order, repeats included."""
    return (text or b"").translate(_TERM_BYTES).split()


def length_factor(n, docs: int, total: int):
    """A document's m: 100 - 50 + ((50 * n * docs) div total)."""
    return 50 + (50 * n * docs) // max(1, total)


@dataclass
class Batch:
    """Queries that are searched at once: distinct terms of each, as numbers."""

    items: list
    words: list[bytes]
    queries: list[np.ndarray]
    weights: np.ndarray | None = None


def _batches(queries: DataFrame, item_id: str, text: str, most_terms: int, most_queries: int) -> Iterator[Batch]:
    """The queries a batch at a time; the driver holds one batch."""
    rows = queries.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text")).where("text is not null")
    number: dict[bytes, int] = {}
    items, sets = [], []
    for r in rows.distinct().toLocalIterator():
        own = sorted(set(terms(bytes(r["text"]))))
        if not own:
            continue
        new = sum(w not in number for w in own)
        if items and (len(number) + new > most_terms or len(items) >= most_queries):
            yield Batch(items, list(number), sets)
            number, items, sets = {}, [], []
        items.append(r["item"])
        sets.append(np.array([number.setdefault(w, len(number)) for w in own], dtype=np.int64))
    if items:
        yield Batch(items, list(number), sets)


# ---------------------------------------------------------------- the index


def _postings(words, block_docs: int, block_postings: int):
    """Blocks of a task's documents: ids, numbers of terms, and for each of the
    searched terms the places of its documents with its occurrences."""

    def emit(pid: int, number: int, docs: list) -> pa.RecordBatch:
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0))  # places rise with the ids
        at = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(d[2]) for d in docs])
        term = np.concatenate([d[2] for d in docs]).astype(np.int32)
        tf = np.concatenate([d[3] for d in docs])
        order = np.argsort(term, kind="stable")
        kinds, counts = np.unique(term, return_counts=True)
        values = [
            pa.array([pid], pa.int64()),
            pa.array([(pid << 32) + number], pa.int64()),
            pa.array([[d[0] for d in docs]], pa.list_(pa.int64())),
            pa.array([[d[1] for d in docs]], pa.list_(pa.int64())),
            pa.array([kinds], pa.list_(pa.int32())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([at[order].tobytes()], pa.binary()),
            pa.array([tf[order].astype("<i8").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["task", "block", "ids", "lengths", "terms", "counts", "places", "tf"])

    def run(batches):
        number_of = {w: i for i, w in enumerate(words.value)}
        pid, number, docs, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, text in enumerate(batch.column("text")):
                found = terms(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                own = counts.keys() & number_of.keys()
                term = np.array([number_of[w] for w in own], dtype=np.int32)
                tf = np.array([counts[w] for w in own], dtype=np.int64)
                docs.append((ids[i], len(found), term, tf))
                held += len(own)
                if len(docs) >= block_docs or held >= block_postings:
                    yield emit(pid, number, docs)
                    number, docs, held = number + 1, [], 0
        if docs:
            yield emit(pid, number, docs)

    schema = "task long, block long, ids array<long>, lengths array<long>, terms array<int>, counts array<long>, places binary, tf binary"
    return run, schema


def pack_bits(bits: np.ndarray, words: int) -> np.ndarray:
    """Boolean columns as words of 64 bits, the first bit lowest."""
    out = np.zeros((*bits.shape[:-1], words * 8), dtype=np.uint8)
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out[..., : packed.shape[-1]] = packed
    return out.view("<u8")


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bit slices of whole values, packed: row b has bit b of every value."""
    bits = int(values.max(initial=0)).bit_length()
    flags = (values[None, :] >> np.arange(bits)[:, None]) & 1
    return np.packbits(flags.astype(bool), axis=1, bitorder="little")


def _sliced(weights, docs: int, total: int):
    """Blocks with, for each term, the bit slices of its impacts over the
    documents that hold it."""

    def run(batches):
        w = weights.value
        for batch in batches:
            for row in batch.to_pylist():
                places = np.frombuffer(row["places"], dtype="<u2")
                tf = np.frombuffer(row["tf"], dtype="<i8")
                m = np.array([length_factor(n, docs, total) for n in row["lengths"]], dtype=np.int64)
                term = np.repeat(np.array(row["terms"], dtype=np.int64), row["counts"])
                impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))
                starts = np.cumsum([0, *row["counts"]])
                planes = [slices_of(impact[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                packed = b"".join(p.tobytes() for p in planes)
                values = [
                    pa.array([row["task"]], pa.int64()),
                    pa.array([row["ids"]], pa.list_(pa.int64())),
                    pa.array([row["terms"]], pa.list_(pa.int32())),
                    pa.array([row["counts"]], pa.list_(pa.int64())),
                    pa.array([[len(p) for p in planes]], pa.list_(pa.int32())),
                    pa.array([row["places"]], pa.binary()),
                    pa.array([packed], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(values, names=["task", "ids", "terms", "counts", "bits", "places", "slices"])

    return run, "task long, ids array<long>, terms array<int>, counts array<long>, bits array<int>, places binary, slices binary"


# ---------------------------------------------------------------- the search


def add_slices(total: list[np.ndarray], more: np.ndarray) -> None:
    """Adds numbers in bit slices to others in place, by carries."""
    carry = np.zeros_like(more[0])
    for b in range(max(len(more), len(total))):
        if b == len(total):
            total.append(np.zeros_like(carry))
        x = total[b]
        if b < len(more):
            y = more[b]
            half = x ^ y
            total[b] = half ^ carry
            carry = (x & y) | (half & carry)
        else:
            if not carry.any():
                return
            total[b] = x ^ carry
            carry = x & carry
    if carry.any():
        total.append(carry)


def top_places(total: Sequence[np.ndarray], k: int) -> np.ndarray:
    """Bitmaps of the k highest sums above 0 of every row (fewer, if there are
    fewer), equal ones by ascending place.

    Slices are met from the most significant down. ``sure`` are places that
    belong to the result, ``open_`` those equal so far to the k-th.
    """
    sure = np.zeros_like(total[0])
    open_ = reduce(np.bitwise_or, total)
    need = np.full(len(sure), k, dtype=np.int64)
    for plane in reversed(total):
        ones = open_ & plane
        n = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        many = n >= need
        sure = np.where(many[:, None], sure, sure | ones)
        need = np.where(many, need, need - n)
        open_ = np.where(many[:, None], ones, open_ & ~plane)
    # Equal sums: the first places that are still needed.
    n = np.bitwise_count(open_).sum(axis=1, dtype=np.int64)
    for row in np.flatnonzero((n > need) & (need > 0)):
        bits = np.unpackbits(open_[row].view(np.uint8), bitorder="little")
        bits[np.flatnonzero(bits)[need[row] :]] = 0
        open_[row] = np.packbits(bits, bitorder="little").view("<u8")
    return np.where((need > 0)[:, None], sure | open_, sure)


class _Block:
    """One block of the index with its searched terms' slices, on demand at full width."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.words = -(-len(self.ids) // 64)
        self.slot = {t: i for i, (t, b) in enumerate(zip(row["terms"], row["bits"], strict=True)) if b}  # the others add nothing
        self.counts, self.bits = row["counts"], row["bits"]
        self.at = np.cumsum([0, *self.counts])
        nbytes = [b * (-(-n // 8)) for b, n in zip(self.bits, self.counts, strict=True)]
        self.byte = np.cumsum([0, *nbytes])
        self.places = np.frombuffer(row["places"], dtype="<u2")
        self.slices = np.frombuffer(row["slices"], dtype=np.uint8)

    def planes(self, term: int) -> np.ndarray:
        """(bits, words) of a term that the block holds."""
        i = self.slot[term]
        n, bits = self.counts[i], self.bits[i]
        packed = self.slices[self.byte[i] : self.byte[i + 1]].reshape(bits, -1)
        flags = np.zeros((bits, self.words * 64), dtype=np.uint8)
        flags[:, self.places[self.at[i] : self.at[i + 1]]] = np.unpackbits(packed, axis=1, count=n, bitorder="little")
        return pack_bits(flags, self.words)


def search_block(block: _Block, queries: Sequence[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, sums) of the block's best documents for each query that
    finds any."""
    present = [(q, [t for t in own.tolist() if t in block.slot]) for q, own in enumerate(queries)]
    present = sorted((p for p in present if p[1]), key=lambda p: -len(p[1]))  # those that go on are a stretch in front
    step = max(1, _PLANE_WORDS // block.words)
    for a in range(0, len(present), step):
        part = present[a : a + step]
        wide: dict[int, np.ndarray] = {}
        total: list[np.ndarray] = []
        for j in range(len(part[0][1])):
            going = [own[j] for _, own in part if len(own) > j]
            for t in going:
                if t not in wide:
                    wide[t] = block.planes(t)
            high = max(len(wide[t]) for t in going)
            more = np.zeros((high, len(part), block.words), dtype=np.uint64)
            for i, t in enumerate(going):
                more[: len(wide[t]), i] = wide[t]
            add_slices(total, more)
        best = top_places(total, k)
        for i, (q, _) in enumerate(part):
            at = np.flatnonzero(np.unpackbits(best[i].view(np.uint8), bitorder="little"))
            if len(at):
                word, bit = at >> 6, (at & 63).astype(np.uint64)
                sums = np.zeros(len(at), dtype=np.int64)
                for b, plane in enumerate(total):
                    sums |= ((plane[i, word] >> bit) & np.uint64(1)).astype(np.int64) << b
                yield q, at, sums


def _best(queries, k: int):
    """A task's best documents for each query over all its blocks."""

    def run(batches):
        kept: dict[int, tuple[list, int]] = {}
        task = None
        for batch in batches:
            for row in batch.to_pylist():
                task = row["task"] if task is None else task
                block = _Block(row)
                for q, at, sums in search_block(block, queries.value, k):
                    found = [(-s, block.ids[i] is None, block.ids[i] or 0, block.ids[i]) for i, s in zip(at.tolist(), sums.tolist(), strict=True)]
                    kept[q] = sorted(kept.get(q, []) + found)[:k]
        rows = [(task, q, r[3], -r[0]) for q, found in kept.items() for r in found]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        for a in range(0, len(rows), 50_000):
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(c[a : a + 50_000], t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["task", "query", "doc", "score"])

    return run, "task long, query int, doc long, score long"


def _first(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build_index(docs: DataFrame, batch: Batch, doc_id: str, text: str, block_docs: int, block_postings: int) -> tuple[DataFrame, dict[int, int]]:
    """The bit-sliced impact index of all documents for a batch's terms, a row
    per block, and the terms' document frequencies."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(batch.words)
    run, schema = _postings(words, block_docs, block_postings)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    blocks = written(rows.mapInArrow(run, schema))
    sizes = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n))).first()
    count, total = sizes[0] or 0, sizes[1] or 0
    # As many rows as the batch has terms, which is bounded.
    found = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1))).cast("long")
    frequency = {}
    batch.weights = np.zeros(len(batch.words), dtype=np.int64)
    for r in found.select("terms", "df", weight.alias("w")).collect():
        frequency[r["terms"]], batch.weights[r["terms"]] = r["df"], r["w"]
    run, schema = _sliced(spark.sparkContext.broadcast(batch.weights), count, total)
    return blocks.mapInArrow(run, schema), frequency


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_docs: int = BLOCK_DOCS,
    block_postings: int = BLOCK_POSTINGS,
    batch_terms: int = BATCH_TERMS,
    batch_queries: int = BATCH_QUERIES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with the highest
    scores above 0 for each item, equal scores by ascending doc_id (null last).

    Terms are the maximal runs of ASCII letters, digits and characters beyond
    ASCII in the whole texts, A-Z lower-cased. With N documents that hold a
    term, L their terms, n those of one, df the documents with a term and tf
    its occurrences, a term's weight is floor(1000 * ln((2N + 2) / (2df + 1)))
    and its impact w * ((10^9 * tf) div (1000 * tf + 20 * m)), where m is 50 +
    ((50 * n * N) div L); a score sums the impacts of the item's terms, once
    each. Null and empty texts have no terms. Every distinct row of ``queries``
    is one item (a null item_id too), rows of one id and other texts each have
    their ranks; repeated documents count and rank each. Other columns are not
    read.

    The index has blocks of documents; a block holds, for each term, bit slices
    of its impacts over the documents that have it. A query's slices are added
    by bitwise carries, all documents of a block at once, and its best are
    found from the most significant slice down. It is made for the terms of a
    batch of queries, whose sizes are bounded, so that what is broadcast doesn't
    grow with the tables; more queries make more batches. Tasks keep the best
    of all their blocks; these meet in groups of tasks, then for each item.
    """
    spark = docs.sparkSession
    parts = []
    for batch in _batches(queries, item_id, item_text, batch_terms, batch_queries):
        index, _ = build_index(docs, batch, doc_id, text, block_docs, block_postings)
        run, schema = _best(spark.sparkContext.broadcast(batch.queries), top)
        best = index.mapInArrow(run, schema)
        best = _first(best.withColumn("group", F.floor(F.col("task") / GROUP_TASKS)), ["query", "group"], top)
        best = _first(best.drop("rank"), ["query"], top)
        items = spark.createDataFrame([(i, item) for i, item in enumerate(batch.items)], f"number int, item {queries.schema[item_id].dataType.simpleString()}")
        named = best.join(F.broadcast(items), F.col("query") == F.col("number"))  # BATCH_QUERIES rows at most
        parts.append(written(named.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")))
    if not parts:
        return _empty(spark, queries, item_id, doc_id)
    return reduce(DataFrame.unionByName, parts)


def _empty(spark: SparkSession, queries: DataFrame, item_id: str, doc_id: str) -> DataFrame:
    kind = queries.schema[item_id].dataType.simpleString()
    return spark.createDataFrame([], f"{item_id} {kind}, rank int, {doc_id} long, score long")
