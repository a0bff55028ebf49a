"""SimHash near-duplicates by deletion-variant signatures of wide segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small

SEED = 42
BITS = 64
#: Members of a signature that one task compares at once; signatures with more
#: are dealt out as pairs of blocks of about this size.
BLOCK = 4096
_SHORT = 32  # members of a key that are compared without a walk

#: For a byte, its bits spread over the eight byte lanes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8).copy().view("<u8").ravel()
_FEW = 255  # rows that a byte lane can count


def shingle_hashes(text: str, words: int = 3, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, in blocks of at most ``chunk``."""
    # For bytes, lower() and split() know the ASCII letters and white space only.
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    coded = b" ".join(tokens)
    if len(tokens) <= words:
        yield np.array([xxhash.xxh64_intdigest(coded, SEED)], dtype=np.uint64)
        return
    at = np.flatnonzero(np.frombuffer(coded, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], at + 1))[: len(tokens) - words + 1].tolist()
    ends = np.concatenate((at, [len(coded)]))[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), chunk):
        some = zip(starts[k : k + chunk], ends[k : k + chunk], strict=True)
        yield np.fromiter((digest(coded[a:b], SEED) for a, b in some), dtype=np.uint64)


def _bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(len(bounds), 64) counts of set bits of the hashes from each bound to the next."""
    cuts = np.unique(np.concatenate([bounds, np.arange(0, len(hashes), _FEW)]))
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    lanes = np.stack([np.add.reduceat(_LANES[raw[:, j]], cuts) for j in range(8)], axis=1)
    counts = lanes.astype("<u8").view(np.uint8).reshape(len(cuts), BITS)
    return np.add.reduceat(counts, np.searchsorted(cuts, bounds), axis=0, dtype=np.int64)


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """SimHash fingerprints: a bit is set if it is in over half of the text's
    shingle hashes; zero for texts without words."""
    return fingerprints_of([shingle_hashes(text or "", words) for text in texts])


def fingerprints_of(hashes: Sequence[Iterable[np.ndarray]]) -> np.ndarray:
    """The fingerprints of texts given by their shingle hashes, in blocks."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    parts: list[np.ndarray] = []
    owners: list[int] = []
    held = 0
    counts = np.zeros((len(hashes), BITS), dtype=np.int64)
    totals = np.zeros(len(hashes), dtype=np.int64)

    def flush() -> None:
        nonlocal held
        if parts:
            lengths = np.array([len(p) for p in parts])
            bounds = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            np.add.at(counts, owners, _bit_counts(np.concatenate(parts), bounds))
            np.add.at(totals, owners, lengths)
        parts.clear()
        owners.clear()
        held = 0

    for i, own in enumerate(hashes):
        for h in own:
            parts.append(h)
            owners.append(i)
            held += len(h)
            if held > 1 << 18:
                flush()
    flush()
    majority = (2 * counts > totals[:, None]).astype(np.uint8)
    if len(hashes):
        out = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row; texts are read whole."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                f = fingerprints(part.column(1).to_pylist(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f)], names=[doc_id, "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{doc_id} long, fingerprint long")


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``count`` nearly equal segments."""
    at = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _bits(f: F.Column, first: int, width: int) -> F.Column:
    return F.shiftrightunsigned(f, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _variants(fingerprint: str, segments: int) -> F.Column:
    """All one-wildcard variants of the segments as keys: the wildcard's bit
    above its segment's bits with that bit cleared.

    Two fingerprints at most 2 * segments - 1 bits apart have a segment that
    differs in at most one bit; with a wildcard there, both give the same key.
    """
    f, one = F.col(fingerprint), F.lit(1).cast("long")

    def keys(first: int, width: int) -> F.Column:
        own = _bits(f, first, width)
        return F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: own.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i)))
            + (i.cast("long") + F.lit(first)) * F.lit(1 << 32),
        )

    return F.concat(*[keys(*s) for s in _segments(segments)])


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of ``fps`` at up to ``distance`` bits.

    A breadth-first walk: each member is held against those not yet reached,
    so the cost is members times members at worst and the output is linear.
    """
    out = []
    left = np.arange(len(fps))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            if near.any():
                met = left[near]
                out.extend(zip(repeat(int(at)), met.tolist()))
                front.extend(met.tolist())
                left = left[~near]
    return out


def _links(distance: int):
    """Spanning links of each run of equal units in sorted (unit..., fingerprint) rows."""

    def emit(fps: np.ndarray, bounds: np.ndarray, sizes: np.ndarray):
        a, b = [], []
        # Short runs: every row against the next ones of its run, all at once.
        short = np.repeat(np.where(sizes <= _SHORT, bounds + sizes, 0), sizes)
        at = np.arange(len(short)) + bounds[0]
        for step in range(1, min(_SHORT, int(sizes.max()))):
            at = at[at + step < short[at - bounds[0]]]
            if not len(at):
                break
            near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
            a.append(fps[near])
            b.append(fps[near + step])
        for k, n in zip(bounds[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist(), strict=True):
            own = fps[k : k + n]
            if tree := _forest(own, distance):
                t = np.array(tree)
                a.append(own[t[:, 0]])
                b.append(own[t[:, 1]])
        if sum(map(len, a)):
            cols = [pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)]
            yield pa.RecordBatch.from_arrays(cols, names=["u", "v"])

    def run(batches):
        rest = None
        for batch in batches:
            unit = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            fps = batch.column(2).to_numpy().view(np.uint64)
            if rest is not None:
                unit, fps = np.concatenate([rest[0], unit]), np.concatenate([rest[1], fps])
            if not len(fps):
                continue
            new = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], new))
            whole, last = bounds[:-1], bounds[-1]
            if len(whole):
                yield from emit(fps, whole, np.diff(bounds))
            rest = unit[last:].copy(), fps[last:].copy()
        if rest is not None:
            yield from emit(rest[1], np.array([0]), np.array([len(rest[1])]))

    return run


def _may_be_heavy(distinct: DataFrame, column: str, segments: int, block: int) -> bool:
    """Whether a key could have over ``block`` members: each key keeps one half
    of its segment whole, and the values of all halves are counted."""
    halves = []
    for first, width in _segments(segments):
        halves += [(first, width // 2), (first + width // 2, width - width // 2)]
    values = [_bits(F.col(column), *h) + F.lit(k << 32) for k, h in enumerate(halves)]
    most = distinct.select(F.explode(F.array(*values)).alias("q")).groupBy("q").count().agg(F.max("count")).first()[0]
    return (most or 0) > block


def near_pairs(
    distinct: DataFrame, column: str = "fingerprint", distance: int = 3, block: int = BLOCK
) -> DataFrame:
    """(u, v): links between distinct fingerprints that span every component
    of the graph of pairs at up to ``distance`` (7 at most) differing bits.

    Keys of more than ``block`` members are split into blocks, and every pair
    of blocks is a unit of its own, so no comparison is lost and no task holds
    more than two blocks of a key.
    """
    segments = distance // 2 + 1
    if not 1 <= distance <= 7:
        raise ValueError("distance must be from 1 to 7")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fp = F.col(column)
    distinct = distinct.select(column).repartition(parts, column)  # every core makes variants
    keyed = distinct.select(F.explode(_variants(column, max(2, segments))).alias("key"), fp.alias("fp"))
    zero = F.lit(0).cast("long")
    units = keyed.select("key", zero.alias("unit"), "fp")
    if _may_be_heavy(distinct, column, max(2, segments), block):
        heavy = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
        heavy = cut(heavy.select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks")))
        dealt = keyed.join(small(heavy), "key", "left").select(
            "key", "fp", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks")
        )
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.sequence(zero, F.col("blocks") - 1))
        spread = dealt.select("key", "fp", "blocks", own.alias("own"), other.alias("other"))
        pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
        units = spread.select("key", pair.alias("unit"), "fp")
    # A named number of tasks keeps each signature whole; the sort lets it stream.
    ordered = units.repartition(parts, "key", "unit").sortWithinPartitions("key", "unit", "fp")
    return ordered.mapInArrow(_links(distance), "u long, v long").distinct()


def fingerprint_classes(prints: DataFrame, doc_id: str = "doc_id", distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(fingerprint, component_id) of every fingerprint: the smallest id that
    any document of its component has."""
    reps = cut(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("rep")))
    links = cut(near_pairs(reps.where("rep is not null"), distance=distance, block=block))
    by = reps.select("fingerprint", "rep")
    edges = (
        links.join(by.select(F.col("fingerprint").alias("u"), F.col("rep").alias("ru")), "u")
        .join(by.select(F.col("fingerprint").alias("v"), F.col("rep").alias("rv")), "v")
        .select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    )
    comps = components(edges)
    return reps.join(comps, F.col("rep") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("component", "rep").alias("component_id")
    )


def simhash_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 3,
    distance: int = 3,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id, kept).

    Texts are lower-cased from A to Z and shingled whole; null texts count as
    empty, and all texts without words share fingerprint zero. Documents link
    at ``distance`` or fewer differing bits; ``component_id`` is the smallest
    id reachable, ``kept`` marks the document of that id. Rows with a null id
    get their fingerprint, but a component only if a row with an id has the
    same fingerprint or links; they are kept. Repeated rows all come back. Other columns
    are not read.
    """
    prints = cut(with_fingerprint(docs, doc_id, text, words))
    classes = fingerprint_classes(prints, doc_id, distance, block)
    return prints.join(classes, "fingerprint").select(
        doc_id,
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)).alias("kept"),
    )
