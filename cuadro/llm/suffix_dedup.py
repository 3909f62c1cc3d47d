"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

Every byte covered by a 50-byte string that also starts in a document with a smaller doc_id is
removed. Matches never cross documents and are judged on the input.

Suffixes are sorted at anchors only. The anchors of a text are the positions whose 24-byte hash is
the least of some 50-byte window (ties all count). The choice depends on the window's bytes alone,
so two equal windows hold an anchor at the same place, and it is enough to compare what surrounds
anchors: 50 bytes to the right and 26 to the left hold every window around an anchor.

1. Documents are packed into runs of about ``RUN_BYTES`` (a longer document is a run alone),
   written once as one compressed row a run. Of documents with the same text only those with the
   smallest doc_id go on: all windows of the others start in a smaller doc_id.
2. Each run sends its distinct anchor hashes, mixed again so that ranges of them are even, as sorted,
   delta-coded blocks by hash range. A range answers with one bit a hash: does another run have it?
3. Each run sorts the suffixes of its shared anchors by range (key: bytes to the right, bytes to
   the left), keeps each different key once with its smallest doc_id, and sends the sorted run,
   front-coded: the length of the prefix shared with the key before, and the rest.
4. A range merges its runs with a loser tree that carries common-prefix lengths: two heads whose
   known prefixes differ in length need no comparison, others are compared from the known prefix
   on. Keys with the same 24 bytes come out together; their windows are compared and each run is
   told which windows around its keys also start in a smaller doc_id (27 bits a key).
5. Each run removes the bytes of these windows.

A run sends a hash or key once however many of its documents hold it, so a passage that a third of
all documents share adds one entry a run. A group of over ``GROUP_KEYS`` different keys around the
same 24 bytes leaves the merge as rows; its windows are grouped by Spark instead.

Defined results: a null text counts as empty; a null doc_id counts as larger than any other (null
ids do not remove from each other); rows with the same doc_id do not remove from each other;
repeated rows repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadro.llm.common import groups, id_text, join_by_count
from cuadro.session import materialise, scratch_path

WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1         # starts of a gram inside a window, and windows around an anchor
LEFT = SPAN - 1
RUN_BYTES = 8_000_000
RANGE_BYTES = 8_000_000          # text bytes for each hash range
GROUP_KEYS = 20_000
KEYS_AT_ONCE = 40_000
SCAN = 1 << 16                   # window starts handled at once
KEY = WINDOW + LEFT + 2          # right, left (nearest first), their lengths + 1
NO_ID = (1 << 63) - 1
ALL = (1 << SPAN) - 1

RUN_DDL = "run long, ids array<long>, sizes array<long>, digests array<binary>, body binary, n_bytes long"
RUN_SCHEMA = pa.schema([("run", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                        ("digests", pa.list_(pa.binary())), ("body", pa.binary()), ("n_bytes", pa.int64())])
BLOCK_DDL = "run long, range long, block binary"
BLOCK_SCHEMA = pa.schema([("run", pa.int64()), ("range", pa.int64()), ("block", pa.binary())])


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; integers by byte planes, so that small ones cost little."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), -1).T if raw.size else raw.view(np.uint8)
        parts.append(np.ascontiguousarray(planes).tobytes())
    head = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _loose(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = np.frombuffer(raw, "<u8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(width, size // width)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def pack(docs: DataFrame, run_bytes: int) -> DataFrame:
    """One row a run: ids, sizes and digests of its documents, and their bytes in one compressed body."""

    def row(run, ids, texts):
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array([run], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
             pa.array([[hashlib.blake2b(t, digest_size=16).digest() for t in texts]], pa.list_(pa.binary())), pa.array([body], pa.binary()),
             pa.array([sum(map(len, texts))], pa.int64())], schema=RUN_SCHEMA)

    def run(batches):
        at, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for rows in groups(batches, limit=1 << 20):
            for doc_id, text in rows:
                ids.append(doc_id)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= run_bytes:
                    yield row(at, ids, texts)
                    at, ids, texts, size = at + 1, [], [], 0
        if ids:
            yield row(at, ids, texts)

    return id_text(docs).mapInArrow(run, RUN_DDL)


def copies(runs: DataFrame) -> DataFrame:
    """(run, gone): positions in a run of documents whose whole text a smaller doc_id has too."""
    each = runs.select("run", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "doc")) \
        .select("run", "at", F.coalesce("doc.ids", F.lit(NO_ID)).alias("id"), F.col("doc.digests").alias("digest"))
    groups_ = each.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_by_count(each, groups_, "digest", each.count()).where("id > first")
    return later.groupBy("run").agg(F.collect_list("at").alias("gone"))


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    mask = (1 << 64) - 1
    base = 0x9E3779B97F4A7C15
    h = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    done, have, length, power = None, 0, 1, base
    left = GRAM
    while left:
        if left & 1:
            if done is None:
                done, have = h, length
            else:
                done = done[:len(h) - have] * np.uint64(power) + h[have:have + len(done[:len(h) - have])]
                have += length
        left >>= 1
        if left:
            h = h[:-length] * np.uint64(power) + h[length:]
            power = power * power & mask
            length *= 2
    done = done[:len(a) - GRAM + 1].copy()
    done ^= done >> np.uint64(31)
    done *= np.uint64(0x7FB5D329728EA185)
    done ^= done >> np.uint64(29)
    return done


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, by doubling."""
    length = 1
    while length * 2 <= width:
        x = pick(x[:-length], x[length:])
        length *= 2
    rest = width - length
    return pick(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions in the concatenated texts and their hashes; ``ends``: where each text ends.

    The hashes returned are mixed again, one to one: those chosen are least ones, so they crowd at the low end,
    where the first ranges would hold most of them.
    """
    at, found = [np.array([], np.int64)], [np.array([], np.uint64)]
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    for first in range(0, len(buf) - WINDOW + 1, SCAN):
        piece = buf[first:first + SCAN + WINDOW - 1]
        h = _gram_hashes(piece)
        least = _sliding(h, SPAN, np.minimum)                          # by window start
        near = slice(np.searchsorted(ends, first, side="right"), np.searchsorted(begins, first + len(least)))
        for b, e in zip(begins[near].tolist(), ends[near].tolist()):    # a window across texts chooses nothing
            least[max(b, e - WINDOW + 1, first) - first:max(e - first, 0)] = 0
        edge = np.zeros(SPAN - 1, np.uint64)
        chosen = np.flatnonzero((_sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum) == h) & (h > 0))
        at.append(chosen + first)
        mixed = h[chosen] * np.uint64(0xA24BAED4963EE407)
        found.append((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9FB21C651E98DF25))
    at, index = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(found)[index]


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text ends and doc_ids of a run, without its copies of smaller documents."""
    buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]) or b"", np.uint8)
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    sizes = np.array(row["sizes"], np.int64)
    if row["gone"]:
        live = np.ones(len(ids), bool)
        live[row["gone"]] = False
        buf, ids, sizes = buf[np.repeat(live, sizes)], ids[live], sizes[live]
    return buf, np.cumsum(sizes), ids


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cuts(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, from, to) of the stretches of sorted hashes."""
    r = _range_of(h, ranges)
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.array([], np.int64)
    return r[first], first, np.append(first[1:], len(r))


def _rows(batches, names) -> Iterator[dict]:
    """Rows of Arrow batches, one at a time: each may hold a whole run."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}


def hash_blocks(runs: DataFrame, ranges: int) -> DataFrame:
    """Step 2, the runs' side: distinct anchor hashes by range, sorted and delta-coded."""

    def run(batches):
        for row in _rows(batches, ("run", "ids", "sizes", "body", "gone")):
            buf, ends, _ = _opened(row)
            h = np.unique(anchors(buf, ends)[1])
            name, first, last = _cuts(h, ranges)
            blocks = [_squeeze(np.diff(h[a:b], prepend=np.uint64(0))) for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays([pa.array([row["run"]] * len(blocks), pa.int64()), pa.array(name),
                                              pa.array(blocks, pa.binary())], schema=BLOCK_SCHEMA)

    return runs.select("run", "ids", "sizes", "body", "gone").mapInArrow(run, BLOCK_DDL)


def shared_bits(blocks: DataFrame) -> DataFrame:
    """Step 2, the ranges' side: for each run a bit a hash, set if another run has the hash."""

    def merge(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(_loose(b, "<u8")[0], dtype=np.uint64) for b in table.column("block").to_pylist()]
        h = np.concatenate(lists)
        ordered = np.sort(h, kind="stable")                            # sorted runs: a merge
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        bits = []
        for x in lists:
            at = np.searchsorted(twice, x).clip(max=max(len(twice) - 1, 0))
            bits.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
        return pa.table([table.column("run"), table.column("range"), pa.array(bits, pa.binary())], schema=BLOCK_SCHEMA)

    return blocks.groupBy("range").applyInArrow(merge, BLOCK_DDL)


def _keys(buf: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The key of every anchor as a row of KEY bytes; ``begin``, ``end``: its text."""
    right, left = np.minimum(end - at, WINDOW), np.minimum(at - begin, LEFT)
    padded = np.concatenate([np.zeros(LEFT, np.uint8), buf, np.zeros(WINDOW, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WINDOW)[at]
    key = np.empty((len(at), KEY), np.uint8)
    key[:, :WINDOW] = around[:, LEFT:]
    key[:, WINDOW:WINDOW + LEFT] = around[:, LEFT - 1::-1]
    for some, have, first, width in ((np.flatnonzero(right < WINDOW), right, 0, WINDOW), (np.flatnonzero(left < LEFT), left, WINDOW, LEFT)):
        key[some, first:first + width] *= np.arange(width) < have[some, None]      # beyond the text: zero
    key[:, KEY - 2], key[:, KEY - 1] = right + 1, left + 1
    return key


def _sorted_run(buf: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: dict, ranges: int):
    """Step 3 for one run: (ranges and front-coded blocks, listing of the anchors).

    Keys are made and sorted for a few ranges at a time, ``KEYS_AT_ONCE`` anchors or one range.
    """
    at, h = anchors(buf, ends)
    distinct, place = np.unique(h, return_inverse=True)
    shared = np.zeros(len(distinct), bool)
    for name, a, b in zip(*_cuts(distinct, ranges)):
        shared[a:b] = np.unpackbits(np.frombuffer(bits[int(name)], np.uint8), count=int(b - a)).astype(bool)
    owner = np.searchsorted(ends, at, side="right")
    low = np.full(len(distinct), NO_ID, np.int64)
    high = np.full(len(distinct), -NO_ID, np.int64)
    np.minimum.at(low, place, ids[owner])
    np.maximum.at(high, place, ids[owner])
    keep = np.flatnonzero((shared | (low < high))[place])              # also those of two documents of this run
    part = _range_of(h[keep], ranges)
    order = np.argsort(part, kind="stable")
    at, owner, part = at[keep][order], owner[keep][order], part[order]
    del h, distinct, place, low, high, keep, order
    begins = np.concatenate([[0], ends])
    blocks: list[tuple[int, bytes]] = []
    number, mine, first, count = np.empty(len(at), np.int32), np.empty(len(at), bool), 0, 0
    while first < len(at):
        last = int(np.searchsorted(part, part[min(first + KEYS_AT_ONCE, len(at) - 1)]))
        if last <= first:
            last = int(np.searchsorted(part, part[first], side="right"))
        if first + KEYS_AT_ONCE >= len(at):
            last = len(at)
        some = slice(first, last)
        key = _keys(buf, at[some], begins[owner[some]], ends[owner[some]])
        order = np.lexsort((ids[owner[some]], key.view(f"S{KEY}").ravel(), part[some]))
        at[some], owner[some], part[some], key = at[some][order], owner[some][order], part[some][order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)                    # equal keys are of one range
        place = np.cumsum(new) - 1
        key, smallest, ranges_here = key[new], ids[owner[some][new]], part[some][new]      # sorted by id within a key
        number[some] = place + count
        mine[some] = ids[owner[some]] == smallest[place]
        cuts = np.flatnonzero(np.concatenate([[True], ranges_here[1:] != ranges_here[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            own = np.zeros(b - a, np.uint8)
            own[1:] = (key[a + 1:b] != key[a:b - 1]).argmax(axis=1)
            rest = key[a:b][np.arange(KEY) >= own[:, None]]
            blocks.append((int(ranges_here[a]), _squeeze(own, rest, smallest[a:b], np.arange(count + a, count + b, dtype=np.int32))))
        first, count = last, count + len(key)
    return blocks, _squeeze(at.astype(np.int64), number, mine.astype(np.uint8))


def suffix_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """Step 3: front-coded sorted runs by range, and one row a run (range null) that lists its anchors."""

    def run(batches):
        for row in _rows(batches, ("run", "ids", "sizes", "body", "gone", "bits")):
            blocks, listed = _sorted_run(*_opened(row), {b["range"]: b["block"] for b in row["bits"] or []}, ranges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["run"]] * (len(blocks) + 1), pa.int64()), pa.array([n for n, _ in blocks] + [None], pa.int64()),
                 pa.array([b for _, b in blocks] + [listed], pa.binary())], schema=BLOCK_SCHEMA)

    return runs.select("run", "ids", "sizes", "body", "gone", "bits").mapInArrow(run, BLOCK_DDL)


class Run:
    """A front-coded sorted run, decoded key by key."""

    def __init__(self, run: int, block: bytes):
        own, rest, docs, number = _loose(block, "u1", "u1", "<i8", "<i4")
        self.run, self.lcps, self.rest = run, own.tolist(), rest.tobytes()
        self.docs, self.numbers = docs.tolist(), number.tolist()
        self.i, self.at, self.key = -1, 0, b""

    def advance(self) -> bool:
        """The next key into ``key``; False at the end."""
        self.i += 1
        if self.i == len(self.lcps):
            self.key = None
            return False
        known = self.lcps[self.i]
        end = self.at + KEY - known
        self.key = self.key[:known] + self.rest[self.at:end]
        self.at = end
        return True


def merged(runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """(common prefix with the key before, run at its current key) in key order.

    A loser tree. ``known[r]`` is the prefix that run r's head shares with the key it was last
    compared against, which is the last output whenever the head is played again. Of two heads the
    one with the longer known prefix is smaller; equal ones are compared from that length on.
    """
    k = len(runs)
    known = [0] * k
    live = [r.advance() for r in runs]
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one it shares with the winner."""
        if not live[a]:
            return b, a
        if not live[b]:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = known[a]
        x, y = runs[a].key[h:], runs[b].key[h:]
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        common = h + len(x) - (differ.bit_length() + 7) // 8
        if x < y or x == y and a < b:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while live[winner]:
        run = runs[winner]
        yield known[winner], run
        live[winner] = run.advance()
        if live[winner]:
            known[winner] = run.lcps[run.i]
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def windows_of(key: bytes) -> Iterator[tuple[int, bytes]]:
    """(bytes left of the anchor, window) of every window around the anchor of a key."""
    right, left = key[KEY - 2] - 1, key[KEY - 1] - 1
    text = key[WINDOW:WINDOW + left][::-1] + key[:right]
    for o in range(max(0, WINDOW - right), left + 1):
        yield o, text[left - o:left - o + WINDOW]


def judge(group: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(run, number, bits) of the keys (key, doc, run, number) around one gram.

    Bit o is set if the window that begins o bytes before the anchor starts in a smaller doc too.
    Windows are compared for one o after the other, so a group needs one window a key at a time.
    """
    lowest: dict[bytes, int] = {}
    for key, doc, _, _ in group:
        if doc < lowest.get(key, NO_ID + 1):
            lowest[key] = doc
    bits = dict.fromkeys(lowest, 0)
    if len(lowest) > 1:
        texts = [(key, doc, key[WINDOW:WINDOW + key[KEY - 1] - 1][::-1] + key[:key[KEY - 2] - 1], key[KEY - 1] - 1)
                 for key, doc in lowest.items()]
        for o in range(SPAN):
            first: dict[bytes, int] = {}
            here = [(key, doc, w) for key, doc, text, left in texts
                    if left >= o and len(w := text[left - o:left - o + WINDOW]) == WINDOW]
            for _, doc, w in here:
                if doc < first.get(w, NO_ID + 1):
                    first[w] = doc
            for key, doc, w in here:
                if first[w] < doc:
                    bits[key] |= 1 << o
    for key, doc, run, number in group:
        b = ALL if doc > lowest[key] else bits[key]
        if b:
            yield run, number, b


ANSWER_DDL = "run long, answer long, key binary, doc long"
ANSWER_SCHEMA = pa.schema([("run", pa.int64()), ("answer", pa.int64()), ("key", pa.binary()), ("doc", pa.int64())])


def merge_ranges(blocks: DataFrame, group_keys: int) -> DataFrame:
    """Step 4: rows (run, number << 32 | bits), or for oversized groups (run, number << 32, key, doc)."""

    def merge(table: pa.Table) -> pa.Table:
        runs = [Run(r, b) for r, b in zip(table.column("run").to_pylist(), table.column("block").to_pylist())]
        cols: tuple[list, list, list, list] = ([], [], [], [])
        group: list[tuple[bytes, int, int, int]] = []
        large = False

        def put(*row):
            for c, v in zip(cols, row):
                c.append(v)

        def close():
            if large:
                for key, doc, run, number in group:
                    put(run, number << 32, key, doc)
            elif len(group) > 1:
                for run, number, bits in judge(group):
                    put(run, number << 32 | bits, None, None)
            group.clear()

        for common, run in merged(runs):
            if common < GRAM:
                close()
                large = False
            group.append((run.key, run.docs[run.i], run.run, run.numbers[run.i]))
            if len(group) > group_keys:
                large = True
                close()
        close()
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, ANSWER_SCHEMA)], schema=ANSWER_SCHEMA)

    return blocks.groupBy("range").applyInArrow(merge, ANSWER_DDL)


def judge_large(rows: DataFrame) -> DataFrame:
    """Step 4 for oversized groups: group their windows by Spark. Rows (run, answer)."""
    schema = pa.schema([("run", pa.int64()), ("answer", pa.int64()), ("doc", pa.int64()), ("window", pa.binary())])

    def explode(batches):
        for row in _rows(batches, ("run", "answer", "key", "doc")):
            parts = list(windows_of(row["key"]))
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["run"]] * n, pa.int64()), pa.array([row["answer"] | 1 << o for o, _ in parts], pa.int64()),
                 pa.array([row["doc"]] * n, pa.int64()), pa.array([w for _, w in parts], pa.binary())], schema=schema)

    windows = rows.select("run", "answer", "key", "doc").mapInArrow(explode, "run long, answer long, doc long, window binary")
    lowest = windows.groupBy("window").agg(F.min("doc").alias("low"))
    return windows.join(lowest, "window").where("doc > low").select("run", "answer")


OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _answered(row: dict, at_most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The live texts of a run in stretches of about ``at_most`` bytes.

    Yields (first text, last text, bytes, ends within the stretch, which bytes go).
    """
    buf, ends, _ = _opened(row)
    at, number, mine = _loose(row["listed"], "<i8", "<i4", "u1")
    answers = np.array(row["answers"] or [], np.int64)
    bits = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    np.bitwise_or.at(bits, answers >> 32, answers & ALL)
    order = np.argsort(at)
    at = at[order]
    mask = np.where(mine[order] == 1, bits[number[order]] if len(bits) else 0, ALL)
    first = 0
    while first < len(ends):
        start = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + at_most, side="right")))
        stop = int(ends[last - 1])
        here = slice(*np.searchsorted(at, [start, stop]))
        own_ends = ends[first:last] - start
        place = at[here] - start
        owner = np.searchsorted(own_ends, place, side="right")
        begin, end = np.concatenate([[0], own_ends])[owner], own_ends[owner] if len(place) else place
        change = np.zeros(stop - start + 1, np.int32)
        for o in range(SPAN):
            go = place[(mask[here] >> o & 1 == 1) & (place - begin >= o) & (place - o + WINDOW <= end)] - o
            np.add.at(change, go, 1)
            np.add.at(change, go + WINDOW, -1)
        yield first, last, buf[start:stop], own_ends, np.cumsum(change[:-1], dtype=np.int32) > 0
        first = last


def cut(runs: DataFrame, with_text: bool) -> DataFrame:
    """Step 5: one row a document."""

    def result(doc_id, size, kept, spans):
        return doc_id, size, size - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT_SCHEMA)], schema=OUT_SCHEMA)

    def run(batches):
        for row in _rows(batches, ("run", "ids", "sizes", "body", "gone", "listed", "answers")):
            copy = set(row["gone"] or [])
            live = [i for i in range(len(row["ids"])) if i not in copy]
            for first, last, buf, ends, gone in _answered(row):
                out, begin = [], 0
                for i, end in zip(live[first:last], ends.tolist()):
                    g = gone[begin:end]
                    kept = buf[begin:end][~g].tobytes()
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
                    out.append(result(row["ids"][i], end - begin, kept, spans))
                    begin = end
                yield batch(out)
            if copy:
                whole = zstandard.ZstdDecompressor().decompress(row["body"])
                start = np.concatenate([[0], np.cumsum(row["sizes"])]).tolist()
                yield batch([result(row["ids"][i], size, *((b"", 1) if size >= WINDOW else (whole[start[i]:start[i] + size], 0)))
                             for i in sorted(copy) for size in [row["sizes"][i]]])

    return runs.select("run", "ids", "sizes", "body", "gone", "listed", "answers").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _by_run(runs: DataFrame) -> DataFrame:
    """The runs written once, bucketed by run, so that later joins by run move the answers only."""
    spark = runs.sparkSession
    name = f"suffix_runs_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs.write.bucketBy(buckets, "run").option("path", scratch_path(spark, name)).option("compression", "uncompressed") \
        .saveAsTable(name)
    table = spark.table(name)
    table.schema                                                       # resolved before the name goes
    spark.sql(f"drop table {name}")                                    # the files stay
    return table


def dedup(docs: DataFrame, with_text: bool = False, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES,
          group_keys: int = GROUP_KEYS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes, if ``with_text``)."""
    runs = _by_run(pack(docs, run_bytes))
    runs = runs.join(materialise(copies(runs), "suffix-copies"), "run", "left")
    total = runs.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = 1 + total // range_bytes
    bits = shared_bits(hash_blocks(runs, ranges)).groupBy("run").agg(F.collect_list(F.struct("range", "block")).alias("bits"))
    sorted_runs = materialise(suffix_runs(runs.join(bits, "run", "left"), ranges), "suffix-blocks")
    answers = materialise(merge_ranges(sorted_runs.where("range is not null"), group_keys), "suffix-answers")
    all_answers = answers.where("key is null").select("run", "answer") \
        .unionByName(judge_large(answers.where("key is not null"))) \
        .groupBy("run").agg(F.collect_list("answer").alias("answers"))
    listed = sorted_runs.where("range is null").select("run", F.col("block").alias("listed"))
    # the rows are small against the runs they come from: gathered into fewer, even partitions
    return cut(runs.join(listed, "run").join(all_answers, "run", "left"), with_text).hint("rebalance")
