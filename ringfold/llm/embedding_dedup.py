"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hash_fraction, running_total, written

LEADING = 8  # dimensions of the grid
BLOCK_ROWS = 256  # vectors of one interval of the sequence
FAN = 8  # intervals of a longer one, a level up
BASIS_ROWS = 4096  # vectors that the axes are fitted on
BASIS_LENGTHS = 16  # commonest lengths that get axes of their own; of others the first components lead
_LEAF = 64


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, by falling variance of the unit vectors."""
    _, axes = np.linalg.eigh(np.cov(_unit(vectors).T, bias=True))
    return axes[:, ::-1]


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Grid:
    """Coordinates of unit vectors on leading axes: principal ones of their
    length where these were fitted, the first components otherwise."""

    def __init__(self, axes: dict[int, np.ndarray], leading: int):
        self.axes, self.leading = {d: a[:, :leading] for d, a in axes.items()}, leading

    def of(self, unit: np.ndarray) -> np.ndarray:
        axes = self.axes.get(unit.shape[1])
        x = unit[:, : self.leading] if axes is None else unit @ axes
        return x if x.shape[1] == self.leading else np.pad(x, ((0, 0), (0, self.leading - x.shape[1])))


def _fit_axes(reps: DataFrame, rows: int, lengths: int) -> dict[int, np.ndarray]:
    """Axes for the ``lengths`` commonest lengths of vectors, each from a
    bounded sample.

    Any orthonormal axes give the same links; these make the grid selective.
    """
    sizes = reps.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(lengths).collect()
    found = {}
    for dims, count in sizes:
        own = reps.where(F.size("vec") == dims)
        sample = own.where(hash_fraction("rep", seed=11) < 2.0 * rows / count) if count > rows else own
        sample = np.array([r[0] for r in sample.select("vec").limit(rows).collect()], dtype=float)
        found[dims] = principal_axes(sample) if len(sample) > 1 and dims > 1 else np.eye(dims)
    return found


def _grid(grid: Grid, eps: float):
    """Adds each vector's cell on the leading axes."""

    def run(batches):
        for batch in batches:
            cells = np.zeros((batch.num_rows, grid.leading), dtype=np.int32)
            vecs = batch.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vecs])
            for dims in np.unique(sizes):
                same = np.flatnonzero(sizes == dims)
                cells[same] = np.floor(grid.of(_unit(np.array([vecs[i] for i in same], dtype=float))) / eps)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(cells[:, k]) for k in range(grid.leading)]],
                names=[*batch.schema.names, *[f"c{k}" for k in range(grid.leading)]],
            )

    return run


def _cut_blocks(grid: Grid, rows: int):
    """One row per interval of the sorted sequence: its box on the leading axes
    and its vectors, packed."""
    names = ["block", "label", "dims", "lo", "hi", "reps", "copies", "vecs"]

    def emit(pid: int, number: int, part: pa.RecordBatch) -> pa.RecordBatch:
        vecs = np.array(part.column("vec").to_pylist(), dtype=np.float64)
        x = grid.of(_unit(vecs))
        values = [
            (pid << 32) + number,
            part.column("label")[0].as_py(),
            vecs.shape[1],
            x.min(axis=0).tolist(),
            x.max(axis=0).tolist(),
            part.column("rep").to_numpy().astype("<i8").tobytes(),
            part.column("copies").to_numpy().astype("<i8").tobytes(),
            vecs.astype("<f8").tobytes(),
        ]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches):
        pid, number, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = list(zip(table["label"].to_pylist(), table["dims"].to_pylist(), strict=True))
            at = 0
            while at < len(key):
                end = at
                while end < len(key) and end - at < rows and key[end] == key[at]:
                    end += 1
                if end == len(key) and end - at < rows:
                    break
                yield emit(pid, number, table.slice(at, end - at).combine_chunks().to_batches()[0])
                number, at = number + 1, end
            held = table.slice(at) if at < len(key) else None
        if held is not None:
            yield emit(pid, number, held.combine_chunks().to_batches()[0])

    schema = (
        "block long, label string, dims int, lo array<double>, hi array<double>, reps binary, copies binary, vecs binary"
    )
    return run, schema


def _gap2(lo1, hi1, lo2, hi2) -> float:
    return float((np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1)) ** 2).sum())


def join_intervals(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, threshold: float, eps2: float) -> np.ndarray:
    """Boolean matrix of the links between two intervals of unit vectors.

    Recursive: intervals whose boxes on the leading axes (xa, xb) are further
    apart than epsilon are skipped, the longer one is halved, and short ones
    are multiplied out.
    """
    links = np.zeros((len(a), len(b)), dtype=bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if _gap2(xa[i:j].min(axis=0), xa[i:j].max(axis=0), xb[k:m].min(axis=0), xb[k:m].max(axis=0)) > eps2:
            continue
        if max(j - i, m - k) <= _LEAF:
            links[i:j, k:m] = a[i:j] @ b[k:m].T >= threshold
        elif j - i >= m - k:
            half = (i + j) // 2
            todo += [(i, half, k, m), (half, j, k, m)]
        else:
            half = (k + m) // 2
            todo += [(i, j, k, half), (i, j, half, m)]
    return links


def _span(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    edges, left = [], np.ones(len(links), dtype=bool)
    for start in range(len(links)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            at = front.pop()
            met = np.flatnonzero(links[at] & left)
            left[met] = False
            edges.extend((at, int(m)) for m in met)
            front.extend(met.tolist())
    return edges


def interval_pairs(blocks: DataFrame, leading: int, eps2: float, fan: int = FAN) -> DataFrame:
    """(a, lo_a, hi_a, b, lo_b, hi_b): pairs a < b of intervals (rows (block,
    label, dims, lo, hi) in the order of the sequence) whose boxes lie within
    epsilon.

    The recursion of the join above the single interval: ``fan`` neighbours in
    the sequence make an interval a level up, with the box around theirs. It
    starts at a label's whole sequence with itself, and a pair of intervals is
    only opened into pairs of their parts while the boxes are near, so that
    distant parts of the sequence are skipped a stretch at a time.
    """
    head = blocks.select("block", "label", "dims", "lo", "hi", F.lit(1).cast("long").alias("one"), F.shiftright("block", 32).alias("part"))
    head = cut(running_total(head, "one", "at", ["block"], "part", ["label", "dims"]).drop("one", "part"))
    top, width = head.agg(F.max("at")).first()[0] or 0, 1
    sizes = [1]
    while top >= width:
        width *= fan
        sizes.append(width)

    def level(size: int) -> DataFrame:
        tagged = head.withColumn("node", F.floor(F.col("at") / size).cast("long"))
        if size > 1:
            ends = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("lo", F.min), ("hi", F.max)) for k in range(leading)]
            tagged = tagged.groupBy("label", "dims", "node").agg(*ends).select(
                "label", "dims", "node", *[F.array(*[f"{c}{k}" for k in range(leading)]).alias(c) for c in ("lo", "hi")]
            )
        return tagged.withColumn("up", F.floor(F.col("node") / fan).cast("long"))

    def side(table: DataFrame, s: str, *more: str) -> DataFrame:
        return table.select("label", "dims", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "up", "lo", "hi", *more)])

    gaps = F.zip_with(
        F.zip_with("lo_a", "hi_b", lambda x, y: x - y),
        F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
        lambda x, y: F.pow(F.greatest(F.lit(0.0), x, y), F.lit(2.0)),
    )
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) <= eps2
    pairs = level(sizes[-1]).select("label", "dims", F.col("node").alias("up_a"), F.col("node").alias("up_b"))
    for size in sizes[-2::-1]:
        table, more = level(size), ["block"] if size == 1 else []
        met = pairs.join(side(table, "a", *more), ["label", "dims", "up_a"]).join(side(table, "b", *more), ["label", "dims", "up_b"])
        met = met.where(F.col("node_a") <= F.col("node_b")).where(near)
        if size > 1:
            pairs = met.select("label", "dims", F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"))
    if len(sizes) == 1:
        met = pairs.join(side(level(1), "a", "block"), ["label", "dims", "up_a"]).join(side(level(1), "b", "block"), ["label", "dims", "up_b"])
    met = met.where(F.col("node_a") < F.col("node_b"))
    return met.select(F.col("block_a").alias("a"), "lo_a", "hi_a", F.col("block_b").alias("b"), "lo_b", "hi_b")


class _Joiner:
    """The join of intervals' vectors, on Arrow batches."""

    def __init__(self, grid: Grid, threshold: float, eps2: float):
        self.grid, self.threshold, self.eps2 = grid, threshold, eps2

    def load(self, row: dict):
        ids = np.frombuffer(row["reps"], dtype="<i8")
        copies = np.frombuffer(row["copies"], dtype="<i8")
        raw = np.frombuffer(row["vecs"], dtype="<f8").reshape(len(ids), -1)
        unit = _unit(raw)
        return ids, copies, raw, unit, self.grid.of(unit)

    def near(self, x: np.ndarray, lo: list[float], hi: list[float]) -> np.ndarray:
        gap = np.maximum(0, np.maximum(x - np.array(hi), np.array(lo) - x))
        return (gap**2).sum(axis=1) <= self.eps2

    def within(self, batches):
        """Each interval with itself."""
        for batch in batches:
            for row in batch.to_pylist():
                ids, copies, _, unit, x = self.load(row)
                links = join_intervals(unit, unit, x, x, self.threshold, self.eps2)
                np.fill_diagonal(links, False)
                links |= links.T
                yield from self.out(ids, links @ copies, links)

    def send(self, batches):
        """Of interval b only what lies within epsilon of the box of a."""
        names = ["a", "lo_b", "hi_b", "sent"]
        for batch in batches:
            for row in batch.to_pylist():
                ids, copies, raw, _, x = self.load(row)
                some = self.near(x, row["lo_a"], row["hi_a"])
                if some.any():
                    sent = {"reps": ids[some].tobytes(), "copies": copies[some].tobytes(), "vecs": raw[some].tobytes()}
                    values = (row["a"], x[some].min(axis=0).tolist(), x[some].max(axis=0).tolist(), sent)
                    box, packed = pa.list_(pa.float64()), pa.struct([(c, pa.binary()) for c in sent])
                    kinds = (pa.int64(), box, box, packed)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def across(self, batches):
        """Interval a with what was sent of b."""
        for batch in batches:
            for row in batch.to_pylist():
                ia, ca, _, a, xa = self.load(row)
                some = self.near(xa, row["lo_b"], row["hi_b"])
                if not some.any():
                    continue
                ia, ca, a, xa = ia[some], ca[some], a[some], xa[some]
                ib, cb, _, b, xb = self.load(row["sent"])
                links = join_intervals(a, b, xa, xb, self.threshold, self.eps2)
                if links.any():
                    square = np.zeros((len(ia) + len(ib),) * 2, dtype=bool)
                    square[: len(ia), len(ia) :] = links
                    square[len(ia) :, : len(ia)] = links.T
                    yield from self.out(np.concatenate([ia, ib]), np.concatenate([links @ cb, ca @ links]), square)

    @staticmethod
    def out(ids: np.ndarray, n: np.ndarray, square: np.ndarray):
        """Weighted link counts by vector (u, null, n) and links (u, v, null)
        that span the components of the pair."""
        some = np.flatnonzero(n)
        if not len(some):
            return
        tree = _span(square)
        us = ids[some].tolist() + [int(ids[i]) for i, _ in tree]
        vs = [None] * len(some) + [int(ids[j]) for _, j in tree]
        ns = n[some].tolist() + [None] * len(tree)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (us, vs, ns)], names=["u", "v", "n"])


def sequence_blocks(reps: DataFrame, grid: Grid, eps: float, rows: int) -> DataFrame:
    """The vectors ``reps(label, vec, rep, copies)`` sorted by their cells and
    cut into intervals of one label and length."""
    cells = [f"c{k}" for k in range(grid.leading)]
    gridded = reps.select("label", "vec", "rep", "copies", F.size("vec").alias("dims")).mapInArrow(
        _grid(grid, eps), "label string, vec array<double>, rep long, copies long, dims int, " + ", ".join(f"{c} int" for c in cells)
    )
    parts = max(1, -(-reps.count() // rows))
    order = ["label", "dims", *cells, "rep"]
    run, schema = _cut_blocks(grid, rows)
    return written(gridded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))


def embedding_groups(
    df: DataFrame,
    threshold: float = 0.98,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str | None = "label",
    leading: int = LEADING,
    block_rows: int = BLOCK_ROWS,
    basis_rows: int = BASIS_ROWS,
    basis_lengths: int = BASIS_LENGTHS,
) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    Vectors of equal, non-null label (all vectors without ``label``) and equal
    length link at a cosine of ``threshold`` (over 0) or more in double
    precision. Null, empty and zero vectors, those with null or non-finite
    elements, and rows with a null id or label link with nothing. A null id
    has a null component and is kept; repeated rows count as separate vectors
    in ``n_links``. Other columns are not read.

    Equal vectors are joined as one with a weight. Unit vectors within the
    cosine are within epsilon; they are sorted by their grid cells on the
    leading principal axes and cut into intervals, which are joined
    recursively, from the whole sequence with itself down, skipping whatever
    lies further apart than epsilon. Of two near intervals only the vectors
    near the other's box meet. A pair of intervals gives counts and a spanning
    forest of its links, never all its pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    eps2 = 2 - 2 * threshold + 1e-9
    eps = math.sqrt(eps2)
    vec = F.col(embedding)
    rows = df.select(
        F.col(vec_id).cast("long").alias("id"),
        (F.col(label).cast("string") if label else F.lit("")).alias("label"),
        F.transform(vec, lambda x: x.cast("double")).alias("vec"),
    )
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & (F.coalesce(F.size("vec"), F.lit(0)) > 0)
        & ~F.coalesce(bad, F.lit(True))
        & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    )
    good_rows = rows.where(good)
    reps = written(good_rows.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    axes = _fit_axes(reps, basis_rows, basis_lengths)
    if not axes:
        return rows.select(
            F.col("id").alias(vec_id),
            F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"),
            F.lit(True).alias("kept"),
        )

    grid = Grid(axes, leading)
    blocks = sequence_blocks(reps, grid, eps, block_rows)
    join, payload = _Joiner(grid, threshold, eps2), ["reps", "copies", "vecs"]
    pairs = interval_pairs(blocks, leading, eps2)
    vectors = blocks.select("block", *payload)
    sent = pairs.join(vectors, F.col("b") == F.col("block")).select("a", "lo_a", "hi_a", *payload)
    packed = "struct<reps: binary, copies: binary, vecs: binary>"
    sent = sent.mapInArrow(join.send, f"a long, lo_b array<double>, hi_b array<double>, sent {packed}")
    met = sent.join(vectors, F.col("a") == F.col("block")).select(*payload, "lo_b", "hi_b", "sent")
    links = "u long, v long, n long"
    found = cut(vectors.select(*payload).mapInArrow(join.within, links).unionByName(met.mapInArrow(join.across, links)))

    counts = found.where("v is null").groupBy(F.col("u").alias("counted")).agg(F.sum("n").alias("n"))
    comps = components(found.where("v is not null").select("u", "v"))
    classes = (
        reps.join(counts, F.col("rep") == F.col("counted"), "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "vec",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = good_rows.join(classes, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(vec_id),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
