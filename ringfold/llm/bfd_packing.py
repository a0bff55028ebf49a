"""Best-fit-decreasing packing with a segment tree over free capacities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenization import encoder, share_vocabulary

SEQUENCE = 2048
#: Pieces that are packed against each other: enough for a tight fit, and a
#: bound on what a task holds.
GROUP = 8192
TASK_BYTES = 32 << 20  # text that a task reads at the least, or else a group of documents


class CapacityTree:
    """Open bins by free capacity; finds the fullest that still fits.

    A segment tree over the capacities 0..size counts the bins below each
    node; bins of one capacity are a stack.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of a bin with the least capacity of at least
        ``need``, removed; None if there is none."""
        count, at = self.count, need + self.leaves
        while not count[at]:
            while at & 1:  # a right child: its parent has nothing more to the right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of item numbers; every length is from 1 to ``size``.

    Longest first (ties: by number), each into the bin that it fills best.
    """
    tree = CapacityTree(size)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = size, len(bins)
            bins.append([])
        bins[found[1]].append(i)
        if found[0] > lengths[i]:
            tree.add(found[0] - lengths[i], found[1])
    return bins


def pack_best_fit(
    docs: DataFrame,
    sequence: int = SEQUENCE,
    group: int = GROUP,
    pad: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Packs all documents into rows of ``sequence`` ids, document ends included.

    One row per sequence: (sequence_id, used, doc_ids, starts, cu_seqlens,
    input_ids, position_ids). ``doc_ids`` and ``starts`` tell each segment's
    document and its place there; ``cu_seqlens`` are the cumulative segment
    lengths from 0 to ``used``; ``input_ids`` is the padded row of the id
    matrix and ``position_ids`` counts from 0 in every segment (0 in the
    padding), both as little-endian 32-bit numbers.

    A document over ``sequence`` tokens gives full rows and a rest, without
    loss. Rests and short documents are packed best fit first in groups of
    ``group`` as they stand in the partition: one pass, no shuffle, bounded
    memory. Partitions too small for a group are read together, so that the
    fill does not depend on the file layout. Null texts are documents of just
    the end id; repeated and null ids stay separate documents; other columns
    are not read.
    """
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length(text).cast("long"))).first()
    docs = docs.coalesce(max(1, -(-count // group), -(-(size or 0) // TASK_BYTES)))
    vocabulary = share_vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["sequence_id", "used", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"]

    def batch_of(bins: list[list[tuple]], first: int) -> pa.RecordBatch:
        matrix = np.full((len(bins), sequence), pad, dtype="<u4")
        positions = np.zeros((len(bins), sequence), dtype="<u4")
        cumulative = []
        for k, segments in enumerate(bins):
            at = [0]
            for _, _, ids in segments:
                matrix[k, at[-1] : at[-1] + len(ids)] = ids
                positions[k, at[-1] : at[-1] + len(ids)] = np.arange(len(ids))
                at.append(at[-1] + len(ids))
            cumulative.append(at)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(first, first + len(bins)), pa.int64()),
                pa.array([c[-1] for c in cumulative], pa.int32()),
                pa.array([[s[0] for s in b] for b in bins], pa.list_(pa.int64())),
                pa.array([[s[1] for s in b] for b in bins], pa.list_(pa.int64())),
                pa.array(cumulative, pa.list_(pa.int32())),
                pa.array([row.tobytes() for row in matrix], pa.binary()),
                pa.array([row.tobytes() for row in positions], pa.binary()),
            ],
            names=names,
        )

    def run(batches):
        own = encoder(vocabulary)
        number = TaskContext.get().partitionId() << 33
        full: list[list[tuple]] = []
        rests: list[tuple] = []

        def out(bins: list[list[tuple]]):
            nonlocal number
            for k in range(0, len(bins), 512):
                yield batch_of(bins[k : k + 512], number)
                number += len(bins[k : k + 512])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for ident, packed in zip(part.column(0).to_pylist(), own.encode(part.column(1)), strict=True):
                    ids = np.frombuffer(packed, dtype=np.uint32)
                    whole = len(ids) // sequence * sequence
                    full += [[(ident, a, ids[a : a + sequence])] for a in range(0, whole, sequence)]
                    if whole < len(ids):
                        rests.append((ident, whole, ids[whole:].astype("<u2") if ids.max() < 1 << 16 else ids[whole:]))
                if len(full) >= 512:
                    yield from out(full)
                    full = []
                if len(rests) >= group:
                    yield from out([[rests[i] for i in b] for b in best_fit_decreasing([len(r[2]) for r in rests], sequence)])
                    rests = []
        yield from out(full)
        yield from out([[rests[i] for i in b] for b in best_fit_decreasing([len(r[2]) for r in rests], sequence)])

    schema = (
        "sequence_id long, used int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>,"
        " input_ids binary, position_ids binary"
    )
    return rows.mapInArrow(run, schema)


def write_shards(packed: DataFrame, path: str, rows_a_file: int = 16_384) -> DataFrame:
    """Writes packed rows as shard files under ``path``/shards and a manifest
    under ``path``/manifest; returns the manifest.

    One manifest row a file: (file, sequences, tokens, padding, segments,
    first_sequence, last_sequence, checksum); the checksum is the xor of the
    XXH64 of the rows' ids and segment bounds. The files hold at most
    ``rows_a_file`` rows each and come into place by the writer's commit, so a
    lost task leaves no half a shard; the manifest tells what was committed,
    read from the files themselves.
    """
    packed.write.option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").mode("overwrite").parquet(f"{path}/shards")
    return write_manifest(packed.sparkSession, path)


def write_manifest(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/shards")
    room = F.octet_length("input_ids").cast("long") / 4 - F.col("used")
    manifest = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("sequences"),
        F.sum(F.col("used").cast("long")).alias("tokens"),
        F.sum(room.cast("long")).alias("padding"),
        F.sum(F.size("doc_ids").cast("long")).alias("segments"),
        F.min("sequence_id").alias("first_sequence"),
        F.max("sequence_id").alias("last_sequence"),
        F.bit_xor(F.xxhash64("sequence_id", "input_ids", "cu_seqlens")).alias("checksum"),
    )
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def fill(packed: DataFrame, sequence: int = SEQUENCE) -> float:
    """The share of the rows' places that hold ids."""
    rows, used = packed.agg(F.count("*"), F.sum(F.col("used").cast("long"))).first()
    return used / (rows * sequence) if rows else 1.0
