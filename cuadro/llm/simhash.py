"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints: words are runs of characters outside space and \\x09-\\x0D with A-Z lower-cased;
shingles are ``shingle`` consecutive words, repeats included, joined by spaces (a shorter text is
one shingle, a text without words has fingerprint zero). A bit is 1 if it is set in over half of
the shingles' XXH64 hashes (seed 42).

Links: two fingerprints link at ``bits`` or fewer differing bits. The 64 bits lie on a ring of
``segments`` boxes. If d_0..d_{m-1} are the differing bits by box and their sum is within the
budget t, some start i exists from which every chain of l boxes has at most l * t / m differing
bits (the strong form of the pigeonhole principle). The first box of such a chain therefore
agrees, and at least m - t boxes agree in all. Fingerprints are matched on every choice of m - t
equal boxes (a key of 32 bits by default, so chance buckets stay small); a candidate must pass
the chain test before its full Hamming distance is taken.

Only distinct fingerprints are matched, so a group of exact copies is one row however large it
is. Within a bucket no list of all pairs is made: a bucket yields the edges of a spanning forest
of its links. Buckets over ``BUCKET`` fingerprints are cut into blocks, and every pair of blocks
becomes a group of its own in a second step, so no task holds an unbounded bucket.

Defined results: a null text counts as empty; rows are kept one for one; a component's id is the
smallest doc_id in it (null ids are passed over; null if there is no other); an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadro.llm.common import groups, id_text, join_by_count, words_of
from cuadro.llm.components import components
from cuadro.session import materialise

SEED = 42
BUCKET = 4096                    # fingerprints of a bucket that one group holds
ALL_PAIRS = 24                   # buckets up to this size are compared by shifting the array


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    start = (ends - size)[:len(words) - shingle + 1].tolist()
    end = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start, end)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[at:at + 100_000].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for rows in groups(batches):
            fps = np.array([fingerprint(t, shingle) for _, t in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(fps)], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def boxes(segments: int) -> list[int]:
    """Masks of the boxes, as even in width as 64 allows, lowest bits first."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def on_ring(x: np.ndarray, masks: list[int], bits: int) -> np.ndarray:
    """Whether the differing bits ``x`` have a start from which every chain keeps its budget."""
    m = len(masks)
    by_box = [np.bitwise_count(x & np.uint64(mask)).astype(np.int16) for mask in masks]
    found = np.zeros(len(x), bool)
    for i in range(m):
        total, good = np.zeros(len(x), np.int16), np.ones(len(x), bool)
        for length in range(1, m + 1):
            total = total + by_box[(i + length - 1) % m]
            good &= total * m <= length * bits
        found |= good
    return found


def linked(a: np.ndarray, b: np.ndarray, masks: list[int], bits: int) -> np.ndarray:
    """Positions at which the two arrays of fingerprints link: chain test, then full distance."""
    x = a ^ b
    at = np.flatnonzero(on_ring(x, masks, bits))
    return at[np.bitwise_count(x[at]) <= bits]


def forest(fps: np.ndarray, masks: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly what the links among ``fps`` connect.

    Stars first: a pivot takes all its free links. Then stars whose pivots are near enough for a
    link between members (triangle inequality) and that are not connected yet are compared.
    """
    left, right, stars = [], [], []
    free = fps
    while len(free):
        at = linked(np.broadcast_to(free[0], len(free) - 1), free[1:], masks, bits) + 1
        left.append(np.repeat(free[0], len(at)))
        right.append(free[at])
        stars.append(free[np.concatenate([[0], at])])
        keep = np.ones(len(free), bool)
        keep[0] = False
        keep[at] = False
        free = free[keep]
    root = list(range(len(stars)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pivots = np.array([s[0] for s in stars], np.uint64)
    for i in range(len(stars) - 1):
        near = np.flatnonzero(np.bitwise_count(pivots[i + 1:] ^ pivots[i]) <= 3 * bits) + i + 1
        for j in near.tolist():
            if find(i) == find(j):
                continue
            for member in stars[i]:
                at = linked(np.broadcast_to(member, len(stars[j])), stars[j], masks, bits)
                if len(at):
                    left.append(np.array([member], np.uint64))
                    right.append(stars[j][at[:1]])
                    root[find(i)] = find(j)
                    break
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def bucket_edges(key: np.ndarray, fps: np.ndarray, masks: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all buckets of rows sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], np.int64)
    size = np.diff(np.append(first, len(key)))
    small = np.repeat((size > 1) & (size <= ALL_PAIRS), size)
    left, right = [fps[:0]], [fps[:0]]
    for shift in range(1, int(size[size <= ALL_PAIRS].max(initial=1))):
        at = np.flatnonzero(small[:-shift] & (key[shift:] == key[:-shift]))
        if len(at):
            at = at[linked(fps[at], fps[at + shift], masks, bits)]
            left.append(fps[at])
            right.append(fps[at + shift])
    for at, n in zip(first[size > ALL_PAIRS].tolist(), size[size > ALL_PAIRS].tolist()):
        a, b = forest(fps[at:at + n], masks, bits)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


ROWS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _rows(key, a, b) -> pa.RecordBatch:
    keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key, np.int64))
    return pa.RecordBatch.from_arrays([keys, pa.array(np.ascontiguousarray(a).view(np.int64)),
                                       pa.array(np.ascontiguousarray(b).view(np.int64))], schema=ROWS)


def match_sorted(batches, masks: list[int], bits: int, bucket: int):
    """Rows (key, fp) sorted by key: edges (null, a, b); of larger buckets (key, fp, block) instead.

    Holds the open bucket only, and at most ``bucket`` rows of it.
    """
    open_key, block = None, 0
    key, fps = np.array([], np.int64), np.array([], np.uint64)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        while len(key):
            if block and key[0] == open_key:                        # more of a bucket that is too large
                end = int(np.searchsorted(key != open_key, True)) if key[-1] != open_key else len(key)
                take = min(end, bucket)
                if take < bucket and end == len(key) and batch is not None:
                    break
                yield _rows(open_key, fps[:take], np.full(take, block, np.int64))
                block += 1
                key, fps = key[take:], fps[take:]
                continue
            block = 0
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            bounds = np.concatenate([[0], change, [len(key)]])
            large = np.flatnonzero(np.diff(bounds) > bucket)
            stop = bounds[large[0]] if len(large) else len(key) if batch is None else bounds[-2]
            if stop:
                a, b = bucket_edges(key[:stop], fps[:stop], masks, bits)
                if len(a):
                    yield _rows(None, a, b)
                key, fps = key[stop:], fps[stop:]
            if len(large):
                open_key, block = key[0], 1
                yield _rows(open_key, fps[:bucket], np.zeros(bucket, np.int64))
                key, fps = key[bucket:], fps[bucket:]
                continue
            break


def links(distinct: DataFrame, bits: int, segments: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly what links within ``bits`` connect; input: distinct ``fp``."""
    if not 0 <= bits < segments:
        raise ValueError("segments must exceed bits")
    masks = boxes(segments)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    chosen = [signed(sum(c)) for c in itertools.combinations(masks, segments - bits)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in chosen]))) \
        .select(F.xxhash64("pos", "col").alias("key"), "fp")

    def match(batches):
        yield from match_sorted(batches, masks, bits, bucket)

    found = materialise(keyed.repartition("key").sortWithinPartitions("key")
                        .mapInArrow(match, "key long, a long, b long"), "simhash-match")
    large = found.where("key is not null")
    blocks = large.groupBy("key").agg(F.max("b").alias("last"))
    pairs = large.join(blocks, "key").select(
        "key", "a", F.col("b").alias("own"), F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("other"))
    grouped = pairs.where("own <> other").select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.col("a").alias("fp"))

    def rest(batches):                                              # groups are two blocks: no cutting here
        yield from match_sorted(batches, masks, bits, 1 << 62)

    more = grouped.repartition("key").sortWithinPartitions("key").mapInArrow(rest, "key long, a long, b long")
    return found.where("key is null").select("a", "b").unionByName(more.select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, segments: int = 8) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) for every row."""
    fps = materialise(fingerprints(docs, shingle), "simhash-fp")
    by_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n"))
    joined = components(links(by_fp.select("fp"), bits, segments), "a", "b")      # node, root
    lowest = joined.join(by_fp, joined.node == by_fp.fp).groupBy("root").agg(F.min("lowest").alias("lowest"))
    linked_ids = joined.join(lowest, "root").select(F.col("node").alias("fp"), F.col("lowest").alias("component_id"))
    ids = by_fp.join(linked_ids, "fp", "left").select("fp", F.coalesce("component_id", "lowest").alias("component_id"), "n")
    return join_by_count(fps, ids, "fp", fps.count()).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
