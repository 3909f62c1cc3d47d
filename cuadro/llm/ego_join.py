"""Embedding near-duplicates by an epsilon grid order join.

Vectors link if their labels are equal and their cosine reaches a threshold. Of unit vectors that is a
distance of at most e = sqrt(2 - 2 threshold). Axes of largest variance (principal directions) are
found first; a vector's cell is its position on the leading ones in steps of e. Sorted by label and
cell (epsilon grid order), vectors are cut into blocks: intervals of the sequence. The join is a
recursion over intervals: a pair of intervals whose boxes on the leading axes, and whose lengths off
them, are over e apart holds no link and is dropped; any other is split into the pairs of its parts.
Above the blocks a recursion step is a Spark join of interval pairs with their parts (``FAN`` each);
below, a task halves the two intervals until ``LEAF`` vectors are left and multiplies those in double
precision. Axes never decide a result, only which blocks are compared.

Equal vectors of a label are one point that counts them, however many there are. A task sends no
pairs: of each point that has links in its two blocks it sends how many vectors it links with, and one
edge of a spanning forest of those links, so its output is bounded by its input.

Defined results: labels are compared as text, and a null label, a null, empty or zero vector, and one
with a null or a non-finite component link with nothing; vectors of different lengths do not link;
every row is a vector of its own, also one that repeats an id; a null id is passed over when a
component's smallest id is taken, and ``kept`` is true if the row's id is that smallest id (both null
included); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuadro.llm.common import join_by_count
from cuadro.llm.components import components
from cuadro.session import materialise

THRESHOLD = 0.98
LEADING = 8                      # axes that make a cell
BLOCK_BYTES = 4_000_000          # of vectors in a block
LEAF = 256                       # vectors that are multiplied at once
FAN = 8                          # parts of an interval
#: Points with the smallest digests whose variance gives the axes.
AXES_SAMPLE = 2000
#: The widest block has fewer points than this, so block and place make one number.
PLACES = 1 << 20


# ---- points ------------------------------------------------------------------------------------

PREPARED = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("label", pa.string()), ("dims", pa.int32()),
                      ("unit", pa.binary())])


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the usable vectors of a list column, by length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(float)      # null components become NaN
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        for some in np.array_split(rows, max(1, len(rows) * d // 1_000_000)):
            v = values[offsets[some][:, None] + np.arange(d)]
            top = np.abs(v).max(axis=1)
            good = np.isfinite(v).all(axis=1) & (top > 0)
            v = v[good] / top[good, None]                                    # no overflow, no underflow to zero
            yield some[good], v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] + 0.0


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, digest (of label and direction; null if the vector links with nothing), label, dims, unit."""

    def run(batches):
        for batch in batches:
            digests, units, dims = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            labels = batch.column(1).to_pylist()
            for rows, unit in unit_rows(batch.column(2)):
                for row, u in zip(rows.tolist(), unit):
                    if labels[row] is not None:
                        units[row], dims[row] = u.tobytes(), len(u)
                        digests[row] = hashlib.blake2b(labels[row].encode() + b"\0" + units[row], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), batch.column(1), pa.array(dims, pa.int32()),
                 pa.array(units, pa.binary())], schema=PREPARED)

    fields = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"),
                            vectors[embedding].cast("array<double>").alias("embedding"))
    return fields.mapInArrow(run, "vec_id long, digest binary, label string, dims int, unit binary")


def axes(points: DataFrame, sample: int = AXES_SAMPLE) -> dict[int, np.ndarray]:
    """Leading principal directions by vector length: matrices (dims, LEADING or fewer)."""
    by_dims: dict[int, list] = {}
    for row in points.orderBy("digest").limit(sample).select("unit").collect():
        by_dims.setdefault(len(row["unit"]) // 8, []).append(np.frombuffer(row["unit"]))
    found = {}
    for d, units in by_dims.items():
        _, directions = np.linalg.eigh(np.cov(np.array(units).T, bias=True).reshape(d, d))
        found[d] = directions[:, ::-1][:, :LEADING].copy()
    return found


def leading(units: np.ndarray, by_dims: dict[int, np.ndarray]) -> np.ndarray:
    """Positions on the leading axes and the length off them, LEADING + 1 numbers a vector.

    Their distance never exceeds that of the vectors. Lengths without axes use the first coordinates.
    """
    d = units.shape[1]
    on = units @ by_dims[d] if d in by_dims else units[:, :LEADING]
    off = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", on, on)))
    return np.hstack([on, np.zeros((len(on), LEADING - on.shape[1])), off[:, None]])


def reach(threshold: float) -> float:
    """The largest distance of linked unit vectors, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6


# ---- blocks --------------------------------------------------------------------------------------

def in_grid_order(points: DataFrame, by_dims: dict[int, np.ndarray], step: float) -> DataFrame:
    """``points`` with their cell, sorted by label, length, cell and digest over all partitions."""
    schema = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("cell", pa.binary()), ("digest", pa.binary()),
                        ("low", pa.int64()), ("n", pa.int64()), ("unit", pa.binary())])

    def run(batches):
        for batch in batches:
            cells = []
            for unit in batch.column("unit"):
                at = leading(np.frombuffer(unit.as_py())[None, :], by_dims)[0, :LEADING]
                cells.append((np.floor(at / step).astype(np.int64) + (1 << 31)).astype(">u4").tobytes())   # sorts as it counts
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("dims"), pa.array(cells, pa.binary()),
                                              *(batch.column(c) for c in ("digest", "low", "n", "unit"))], schema=schema)

    order = ["label", "dims", "cell", "digest"]
    celled = points.mapInArrow(run, "label string, dims int, cell binary, digest binary, low long, n long, unit binary")
    return celled.repartitionByRange(*order).sortWithinPartitions(*order)


BOX = [f"{side}{i}" for side in ("lo", "hi") for i in range(LEADING + 1)]
BLOCK = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("part", pa.int64()), ("seq", pa.int64()), ("n", pa.list_(pa.int64())),
                   ("low", pa.list_(pa.int64())), ("digests", pa.binary()), ("units", pa.binary()), *((c, pa.float64()) for c in BOX)])


def blocks(ordered: DataFrame, by_dims: dict[int, np.ndarray], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a block of ``ordered``: its partition, its place there, its points and their box."""

    def packed(part: int, seq: int, key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        units = b"".join(r[3] for r in rows)
        at = leading(np.frombuffer(units).reshape(len(rows), -1), by_dims)
        values = [*key, part, seq, [r[2] for r in rows], [r[1] for r in rows], b"".join(r[0] for r in rows), units,
                  *at.min(axis=0).tolist(), *at.max(axis=0).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, BLOCK)], schema=BLOCK)

    def run(batches):
        part, seq, key, rows = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for label, dims, *row in zip(*(batch.column(c).to_pylist() for c in ("label", "dims", "digest", "low", "n", "unit"))):
                full = rows and (len(rows) + 1) * 8 * dims > block_bytes or len(rows) >= PLACES
                if rows and (full or (label, dims) != key):
                    yield packed(part, seq, key, rows)
                    seq, rows = seq + 1, []
                key = (label, dims)
                rows.append(tuple(row))
        if rows:
            yield packed(part, seq, key, rows)

    return ordered.mapInArrow(run, "label string, dims int, part long, seq long, n array<long>, low array<long>, digests binary, "
                                   "units binary, " + ", ".join(f"{c} double" for c in BOX))


def box_gap(a: str, b: str) -> Column:
    """Squared distance of two boxes whose columns carry the prefixes ``a`` and ``b``."""
    total = F.lit(0.0)
    for i in range(LEADING + 1):
        gap = F.greatest(F.lit(0.0), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"))
        total = total + gap * gap
    return total


def near_blocks(boxes: DataFrame, levels: int, e: float) -> DataFrame:
    """a, b (a <= b): the pairs of block positions that the recursion from the whole sequences keeps.

    ``boxes``: label, dims, pos and box of every block. A node of level l is the interval of positions
    that share pos div FAN^l; its box covers theirs.
    """

    def nodes(level: int, name: str) -> DataFrame:
        node = F.expr(f"pos div {FAN ** level}L")
        covered = boxes if level == 0 else boxes.groupBy("label", "dims", node.alias("pos")).agg(
            *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in BOX])
        return covered.select("label", "dims", F.col("pos").alias(name), F.expr(f"pos div {FAN}L").alias(f"{name}_of"),
                              *[F.col(c).alias(name + c) for c in BOX])

    pairs = nodes(levels, "a").select("label", "dims", "a", F.col("a").alias("b"))
    for level in range(levels - 1, -1, -1):
        above = pairs.select("label", "dims", F.col("a").alias("a_of"), F.col("b").alias("b_of"))
        split = above.join(nodes(level, "a"), ["label", "dims", "a_of"]).join(nodes(level, "b"), ["label", "dims", "b_of"])
        pairs = split.where((F.col("a") <= F.col("b")) & (box_gap("a", "b") <= e * e)).select("label", "dims", "a", "b")
    return pairs.select("a", "b")


# ---- two blocks in a task --------------------------------------------------------------------------

def near_leaves(lo_a, hi_a, lo_b, hi_b, e: float, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that may hold a link: intervals are halved, distant pairs of them dropped."""
    stack = [(0, len(lo_a), 0, len(lo_b))]
    while stack:
        i, i_end, j, j_end = stack.pop()
        if same and j_end <= i:                                    # the mirror image is taken
            continue
        gap = np.maximum(0, np.maximum(lo_a[i:i_end].min(axis=0) - hi_b[j:j_end].max(axis=0),
                                       lo_b[j:j_end].min(axis=0) - hi_a[i:i_end].max(axis=0)))
        if gap @ gap > e * e:
            continue
        if i_end - i == 1 and j_end - j == 1:
            if not same or i <= j:
                yield i, j
            continue
        rows = [(i, i_end)] if i_end - i == 1 else [(i, (i + i_end) // 2), ((i + i_end) // 2, i_end)]
        cols = [(j, j_end)] if j_end - j == 1 else [(j, (j + j_end) // 2), ((j + j_end) // 2, j_end)]
        stack += [(*r, *c) for r in rows for c in cols]


def connect(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each point's smallest known one, itself a root) after adding the edges a-b."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def links_within(a: np.ndarray, n_a: np.ndarray, b: np.ndarray | None, n_b: np.ndarray | None, by_dims: dict[int, np.ndarray],
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the points of two blocks (or of one, ``b`` None): how many vectors each links with, and
    the smallest point of its component. Points of ``b`` follow those of ``a``."""
    same, e = b is None, reach(threshold)
    if same:
        b, n_b = a, n_a
    shift = 0 if same else len(a)
    count, root = np.zeros(shift + len(b), np.int64), np.arange(shift + len(b))

    def boxes(units):
        at = leading(units, by_dims)
        cuts = range(0, len(units), LEAF)
        return np.array([at[c:c + LEAF].min(axis=0) for c in cuts]), np.array([at[c:c + LEAF].max(axis=0) for c in cuts])

    box_a = boxes(a)
    box_b = box_a if same else boxes(b)
    for i, j in near_leaves(*box_a, *box_b, e, same):
        i, j = i * LEAF, j * LEAF
        hit = a[i:i + LEAF] @ b[j:j + LEAF].T >= threshold
        within = same and i == j
        if within:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        rows, cols = slice(i, i + len(hit)), slice(shift + j, shift + j + hit.shape[1])
        count[rows] += hit @ n_b[j:j + LEAF]
        if not within:
            count[cols] += n_a[i:i + LEAF] @ hit
        x, y = root[rows], root[cols]
        at, to = np.nonzero(hit & (x[:, None] != y[None, :]))
        if len(at):
            root = connect(root, at + i, to + shift + j)
    return count, root


def linked_points(packed: DataFrame, pairs: DataFrame, by_dims: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """node, links, root: of each pair of blocks, the points that have links in it."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pos_a, pos_b, dims = (batch.column(c)[i].as_py() for c in ("a", "b", "dims"))
                unit, n = ([np.frombuffer(batch.column(f"units_{s}")[i].as_buffer()).reshape(-1, dims) for s in "ab"],
                           [batch.column(f"n_{s}")[i].values.to_numpy() for s in "ab"])
                alone = pos_a == pos_b
                count, root = links_within(unit[0], n[0], None if alone else unit[1], None if alone else n[1], by_dims, threshold)
                place = np.arange(len(unit[0])) + pos_a * PLACES
                if not alone:
                    place = np.concatenate([place, np.arange(len(unit[1])) + pos_b * PLACES])
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array(count[at]), pa.array(place[root[at]])], schema=schema)

    side = lambda s: packed.select(F.col("pos").alias(s), F.col("units").alias(f"units_{s}"), F.col("n").alias(f"n_{s}"), "dims")
    both = pairs.join(side("a"), "a").join(side("b").drop("dims"), "b")
    return both.select("a", "b", "dims", "units_a", "n_a", "units_b", "n_b").mapInArrow(run, "node long, links long, root long")


# ---- all -------------------------------------------------------------------------------------------

def intervals(n: int) -> int:
    """Levels of intervals over n parts: the least l with FAN^l >= n."""
    levels = 0
    while FAN ** levels < n:
        levels += 1
    return levels


def members(packed: DataFrame) -> DataFrame:
    """node, digest, low, n of every point."""
    schema = pa.schema([("node", pa.int64()), ("digest", pa.binary()), ("low", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for pos, low, n, digests in zip(*(batch.column(c) for c in ("pos", "low", "n", "digests"))):
                whole = digests.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(low)) + pos.as_py() * PLACES), pa.array([whole[i:i + 16] for i in range(0, len(whole), 16)], pa.binary()),
                     low.values, n.values], schema=schema)

    return packed.select("pos", "low", "n", "digests").mapInArrow(run, "node long, digest binary, low long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = materialise(prepared(vectors), "ego-rows")
    points = materialise(rows.where("digest is not null").groupBy("digest", "label", "dims", "unit")
                         .agg(F.min("vec_id").alias("low"), F.count("*").alias("n")), "ego-points")
    by_dims = axes(points)
    cut = materialise(blocks(in_grid_order(points, by_dims, reach(threshold)), by_dims, block_bytes), "ego-blocks")
    last_part, last_seq = cut.agg(F.max("part"), F.max("seq")).first()
    width = intervals((last_seq or 0) + 1)                        # positions of a partition
    packed = cut.withColumn("pos", F.col("part") * FAN ** width + F.col("seq"))
    levels = intervals((last_part or 0) + 1) + width
    pairs = materialise(near_blocks(packed.select("label", "dims", "pos", *BOX), levels, reach(threshold)), "ego-pairs")
    found = materialise(linked_points(packed, pairs, by_dims, threshold), "ego-links")
    joined = components(found, "node", "root")
    points_ = members(packed)
    lowest = joined.join(points_, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    groups_ = joined.join(lowest, "root").select("node", "component_id", F.lit(True).alias("linked"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = points_.join(links, "node", "left").join(groups_, "node", "left").select(
        "digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    usable = rows.where("digest is not null").select("vec_id", "digest")
    total = usable.count()
    linked = join_by_count(usable, known, "digest", total).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
