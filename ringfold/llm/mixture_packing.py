"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents. In each window of ``window`` tokens a
queue's deficit grows by its quantum, its target share of the window (shares
of queues that have run dry go to the others in proportion), and the queue
serves documents while its deficit covers them; what is left carries into the
next window. A document is therefore served in the first window by whose end
its queue's quanta add up to the document's end in the queue. That needs only
running totals, so the schedule is computed for all documents at once, and
deficits carry across windows and partitions alike.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_fraction, last_row, row_buckets, running_total, small, written
from .tokenization import END, encoder, share_vocabulary

SEQUENCE = 2048
WINDOW = 64 * SEQUENCE
_ROWS_A_BUCKET = 5_000


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(doc_id, source, n, ids): ids as little-endian numbers of 2 bytes
    (4 if the vocabulary needs them: see ``width``), with the end id."""
    vocabulary = share_vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.frombuffer(x, dtype=np.uint32) for x in own.encode(part.column("text"))]
                width = [2 if x.max() < 1 << 16 else 4 for x in ids]
                packed = [x.astype("<u2" if w == 2 else "<u4").tobytes() for x, w in zip(ids, width, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(width, pa.int32()), pa.array(packed, pa.binary())],
                    names=[doc_id, "source", "n", "width", "ids"],
                )

    schema = rows.drop("text").schema.add("n", "long").add("width", "integer").add("ids", "binary")
    return rows.mapInArrow(run, schema)


def whole_weights(targets: Mapping[str | None, float]) -> dict[str | None, int]:
    """The target shares as whole numbers: exactly, if that takes at most 60
    bits, else to a 2**40th of their sum."""
    shares = {s: Fraction(t) for s, t in targets.items()}
    if not shares or min(shares.values()) <= 0:
        raise ValueError("every source needs a target share above 0")
    scale = math.lcm(*(f.denominator for f in shares.values()))
    total = sum(shares.values())
    if (total * scale).numerator.bit_length() > 60:
        return {s: max(1, round(f / total * 2**40)) for s, f in shares.items()}
    return {s: int(f * scale) for s, f in shares.items()}


def _exact(c: Column | str | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _by_targets(lined: DataFrame, targets: Mapping[str | None, float], tokens: list[tuple[str | None, int]]) -> DataFrame:
    """Adds ``x`` and ``y`` with the time x / y of each row's end, under target shares.

    Virtual time: a queue of weight w has received w * v tokens at v and is dry
    at v = tokens / w. Until then all have received the tokens of the dry
    queues and, for each other, its weight times v. Sorted by their dry times,
    queues have running sums of both, in which each row finds its place by
    halving.
    """
    weight = whole_weights({s: targets.get(s, 0.0) for s, _ in tokens})
    dry = sorted((Fraction(n, weight[s]), n, weight[s]) for s, n in tokens)
    gone, alive = [0], [sum(weight.values())]
    for _, n, w in dry:
        gone.append(gone[-1] + n)
        alive.append(alive[-1] - w)
    column = lambda values: F.lit(np.array(values, dtype=np.int64))
    spark = lined.sparkSession
    # The table's rows are the caller's own targets.
    weights = spark.createDataFrame(list(weight.items()), "q string, w long")
    lined = lined.join(small(weights, len(weight)), F.col("source").eqNullSafe(F.col("q"))).withColumn("end", F.col("before") + F.col("n"))
    lined = lined.withColumns({"__rf_n": column([n for _, n, _ in dry]), "__rf_w": column([w for _, _, w in dry])})

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        over = _exact("end") * _exact(F.get("__rf_w", mid)) > _exact(F.get("__rf_n", mid)) * _exact("w")
        more = s["lo"] < s["hi"]
        return F.struct(F.when(more & over, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(more & ~over, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(dry)).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(0), F.lit(len(dry).bit_length())), start, halve, lambda s: s["lo"])
    lined = lined.withColumn("__rf_at", at)
    gone_, alive_ = (F.get(column(v), F.col("__rf_at")) for v in (gone, alive))
    x = _exact(gone_) * _exact("w") + _exact(alive_) * _exact("end")
    return lined.select("rid", "source", "n", "before", x.alias("x"), _exact("w").alias("y"))


def schedule(
    queue: DataFrame, targets: Mapping[str | None, float] | None, window: int, seed: int = 0, spread: bool = False
) -> DataFrame:
    """(rid, n, window, at): for each row (rid, source, n) its window and its
    place in the stream of tokens; ``rid`` is a monotonically_increasing_id.

    Queues are in the order of ``rid``, with ``spread`` of its hash. Windows
    are reckoned in whole numbers, exact up to 10**18 tokens.
    """
    whole, rows, last = queue.agg(F.sum("n"), F.count("*"), last_row("rid")).first()
    if spread:
        chance = hash_fraction("rid", seed=seed)
        lined = queue.withColumn("chance", chance)
        lined = lined.withColumn("slot", F.floor(F.col("chance") * max(1, -(-rows // _ROWS_A_BUCKET))))
        order = ["chance", "rid"]
    else:
        lined, order = queue.withColumn("slot", row_buckets("rid", last, _ROWS_A_BUCKET)), ["rid"]
    lined = running_total(lined.select("rid", "source", "n", *order[:-1], "slot"), "n", "before", order, "slot", ["source"], whole="mine")
    if targets is None:
        # Shares of its own tokens: all queues run dry together, at the end.
        end = F.col("before") + F.col("n")
        timed = lined.select("rid", "source", "n", "before", (_exact(whole or 0) * _exact(end)).alias("x"), _exact("mine").alias("y"))
    else:
        tokens = queue.groupBy("source").agg(F.sum("n").alias("n")).limit(len(targets) + 1).collect()
        if any(r["source"] not in targets for r in tokens):
            raise ValueError("every source needs a target share above 0")
        if not tokens:
            return queue.select("rid", "n", F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("at"))
        timed = _by_targets(lined, targets, [(r["source"], r["n"]) for r in tokens])
    # ceil(x / (y * window)) - 1 in whole numbers
    timed = timed.select(
        "rid", "source", "n", "before", (F.col("x").cast("double") / F.col("y").cast("double")).alias("time"),
        F.expr(f"(x - 1) div (y * {window})").alias("window"),
    )
    placed = running_total(cut(timed), "n", "at", ["time", "source", "before", "rid"], "window")
    return placed.select("rid", "n", "window", "at")


def pack_mixture(
    docs: DataFrame,
    targets: Mapping[str | None, float] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    path: str | None = None,
    seed: int = 0,
    spread: bool = False,
) -> DataFrame:
    """Packs all documents into sequences of ``sequence`` tokens.

    One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id,
    offset, window, source); ``ids`` are little-endian 32-bit numbers. The
    stream of windows is cut at every ``sequence`` tokens, so that documents
    are split there without loss and only the last sequence has room left.

    ``targets`` are the sources' shares of each window in any unit; by
    default the corpus's own shares of tokens, under which no queue runs dry
    early; given targets must name every source. A null source is a queue of
    its own, a null text an empty document of just the end id, and repeated
    or null ids stay separate documents. Queues keep the order of the input;
    with ``spread`` each row is placed by a draw of its own. Other columns are
    not read.
    """
    # The stored row number is the key from here on, since ids may repeat.
    rid = F.monotonically_increasing_id().alias("rid")
    tokens = written(tokenize(docs, doc_id, text, source, path).select(rid, F.col(doc_id).alias("doc_id"), "source", "n", "width", "ids"))
    plan = schedule(tokens.select("rid", "source", "n"), targets, window, seed, spread)
    placed = tokens.select("rid", "doc_id", "source", "width", "ids").join(plan, "rid")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                col = {c: part.column(c).to_pylist() for c in ("width", "ids", "at", "window")}
                out = {c: [] for c in ("row", "start", "length", "ids", "tokens", "sequence", "offset", "window")}
                for i, (width, raw, at, number) in enumerate(zip(*col.values(), strict=True)):
                    ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                    cuts = [0, *range(sequence - at % sequence, len(ids), sequence), len(ids)]
                    for a, b in zip(cuts, cuts[1:]):
                        values = (i, a, b - a, ids[a:b].tobytes(), len(ids), (at + a) // sequence, (at + a) % sequence, number)
                        for c, x in zip(out.values(), values, strict=True):
                            c.append(x)
                rows = pa.array(out.pop("row"), pa.int32())
                kinds = {"ids": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("source").take(rows), *[pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()]],
                    names=[doc_id, "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window"],
                )

    schema = tokens.select(F.col("doc_id").alias(doc_id), "source").schema
    for name in ("start", "length"):
        schema = schema.add(name, "long")
    schema = schema.add("ids", "binary")
    for name in ("doc_tokens", "sequence_id", "offset", "window"):
        schema = schema.add(name, "long")
    pieces = placed.select("doc_id", "source", "width", "ids", "at", "window").mapInArrow(run, schema)
    return pieces.select(doc_id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "source")


__all__ = ["END", "SEQUENCE", "WINDOW", "pack_mixture", "schedule", "tokenize", "whole_weights"]
