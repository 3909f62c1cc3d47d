"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex. Every code point becomes a class; a token boundary depends only
on the class and on the kind of token that is open, so each class is a function from states to
states. The functions are composed by an associative scan: inside blocks column by column, then
over the blocks by doubling; a last pass with the known entry states marks the boundaries. The
slices between boundaries go through a cache of pair merges. Every token keeps the byte offset
where it starts in the UTF-8 text, and decoding checks the bytes against these offsets.

The boundaries are those of the pattern that the tokenizer files come with::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Defined results: a null text counts as empty (no ids, the digests of no bytes); rows are kept
one for one, so repeated rows repeat; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuadro.llm.common import groups, id_text

# Classes of a code point; those of white space and of apostrophes depend on what follows, see classify().
LETTER, NUMBER, OTHER, APOS2, APOS3, RUN, PREFIX, SINGLE, BREAK = range(9)
# What is open after a code point: nothing, a run of a class, a lone space that may lead a run, or
# a contraction that takes one or two more letters.
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_PREFIX, IN_RUN, TAKE1, TAKE2 = range(8)
STATES = 8

# Unicode White_Space, and the letters that follow an apostrophe in a contraction.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
               8201, 8202, 8232, 8233, 8239, 8287, 12288]
CONTRACT1 = ("s", "t", "m", "d")
CONTRACT2 = ("re", "ve", "ll")

BLOCK = 256
SENTINEL = 0x10FFFF + 1          # between texts; no character
MAX_SPAN = 1_000_000             # code points per scan; longer texts are scanned in spans
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
PAIR_BITS = 24                   # a pair of ids as one integer


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space for every code point; the sentinel is 4."""
    kind = np.full(0x110000 + 1, 2, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = 0
        elif c == "N":
            kind[cp] = 1
    kind[WHITE_SPACE] = 3
    kind[SENTINEL] = 4
    return kind


@lru_cache(1)
def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a token starts here', both indexed by class * STATES + state."""
    nxt = np.zeros((9, STATES), np.uint8)
    start = np.ones((9, STATES), bool)
    run_of = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    for cls in range(9):
        for state in range(STATES):
            if cls == BREAK:
                nxt[cls, state] = NONE
            elif state == TAKE2:
                nxt[cls, state], start[cls, state] = TAKE1, False
            elif state == TAKE1:
                nxt[cls, state], start[cls, state] = NONE, False
            elif cls in run_of:
                nxt[cls, state], start[cls, state] = run_of[cls], state not in (run_of[cls], IN_PREFIX)
            elif cls in (APOS2, APOS3):
                joins = state in (IN_OTHER, IN_PREFIX)      # then the apostrophe is an ordinary symbol
                nxt[cls, state] = IN_OTHER if joins else (TAKE1 if cls == APOS2 else TAKE2)
                start[cls, state] = not joins
            elif cls == RUN:
                nxt[cls, state], start[cls, state] = IN_RUN, state != IN_RUN
            else:
                nxt[cls, state] = IN_PREFIX if cls == PREFIX else NONE
    return nxt.ravel(), start.ravel()


def classify(cp: np.ndarray) -> np.ndarray:
    """Class of each code point; white space and apostrophes look at what follows."""
    kind = _kinds()[cp]
    cls = np.array([LETTER, NUMBER, OTHER, RUN, BREAK], np.uint8)[kind]
    after = np.append(kind[1:], 4)
    last_space = (kind == 3) & (after < 3)
    cls[last_space] = np.where(cp[last_space] == 32, PREFIX, SINGLE)
    at = np.flatnonzero(cp == 39)
    if len(at):
        padded = np.append(cp, [SENTINEL, SENTINEL])
        one, two = padded[at + 1], padded[at + 2]
        cls[at[np.isin(one, [ord(x) for x in CONTRACT1])]] = APOS2
        cls[at[np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in CONTRACT2])]] = APOS3
    return cls


def starts(cls: np.ndarray) -> np.ndarray:
    """Positions where a token starts, by composing the transition functions of the classes."""
    nxt, begins = _transitions()
    n = len(cls)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, BREAK, np.uint8)
    grid[:n] = cls
    cols = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)          # position in block, block
    fun = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))       # what a block does to each state
    for col in cols:
        fun = nxt.take(col[:, None] * np.uint8(STATES) + fun)
    step = 1
    while step < blocks:                                                # inclusive scan over the blocks
        fun[step:] = np.take_along_axis(fun[step:], fun[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = fun[:-1, NONE]
    out = np.empty((BLOCK, blocks), bool)
    for j, col in enumerate(cols):
        key = col * np.uint8(STATES) + state
        out[j] = begins.take(key)
        state = nxt.take(key)
    return np.flatnonzero(out.T.ravel()[:n])


def _spans(text: str) -> Iterator[str]:
    """A long text in spans that end before a lone space between two visible characters.

    A token always starts at such a space, so spans can be scanned alone. A stretch without one
    stays whole.
    """
    at = 0
    while len(text) - at > MAX_SPAN:
        cut = at + MAX_SPAN
        while cut < len(text) - 1 and not (text[cut] == " " and not text[cut - 1].isspace()
                                           and not text[cut + 1].isspace()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the text, its next pre-tokens), vectorised over groups of texts."""
    pending: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for span in _spans(text):
            if span:
                pending.append((i, span))
                size += len(span)
            if size >= MAX_SPAN:
                yield from _cut(pending)
                pending, size = [], 0
    yield from _cut(pending)


def _cut(pending: list[tuple[int, str]]) -> Iterator[tuple[int, list[str]]]:
    if not pending:
        return
    lengths = np.array([len(s) for _, s in pending])
    joined = "".join(s for _, s in pending)
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    cp = np.insert(raw, ends, SENTINEL)                                # a sentinel after every span
    at = starts(classify(cp))
    at = at[cp[at] != SENTINEL]
    at = at - np.searchsorted(ends + np.arange(len(ends)), at, side="right")    # back to positions without them
    owner = np.searchsorted(ends, at, side="right")
    first = np.searchsorted(owner, np.arange(len(pending) + 1))
    bounds = np.append(at, len(joined)).tolist()
    for k, (i, _) in enumerate(pending):
        lo, hi = first[k], first[k + 1]
        cuts = bounds[lo:hi + 1]
        yield i, [joined[a:b] for a, b in zip(cuts, cuts[1:])]


class Vocabulary:
    """Merge ranks of byte strings. ``encode_piece`` merges one pre-token and caches the result.

    The id of a token is its rank, so pairs of ids map straight to the id of their merge.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys()))
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a << PAIR_BITS | b] = r
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = (whole,)
        elif len(raw) <= 100:
            ids = self._merge_short(raw)
        else:
            ids = self._merge_long(raw)
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def _merge_short(self, raw: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of the lowest rank, the leftmost first, until none is known."""
        merged, top = self.pair.get, 1 << 60
        byte_id = self.byte_id
        parts = [byte_id[b] for b in raw]
        pairs = [merged(a << PAIR_BITS | b, top) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == top:
                break
            i = pairs.index(best)
            parts[i] = best
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merged(parts[i - 1] << PAIR_BITS | best, top)
            if i < len(pairs):
                pairs[i] = merged(best << PAIR_BITS | parts[i + 1], top)
        return tuple(parts)

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list: n log n for any length."""
        n = len(raw)
        part = [self.byte_id[b] for b in raw]                           # -1: merged into its left neighbour
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n:
                r = self.pair.get(part[i] << PAIR_BITS | part[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, j, a, b = heapq.heappop(heap)
            if part[i] != a or part[j] != b or right[i] != j:
                continue                                                # one side was merged meanwhile
            part[i], part[j] = r, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return tuple(p for p in part if p >= 0)

    def encode_texts(self, texts: list[str]) -> list[array]:
        out = [array("I") for _ in texts]
        cached, merge = self.cache.get, self.encode_piece
        for i, pieces in slices(texts):
            out[i].extend(itertools.chain.from_iterable([cached(p) or merge(p) for p in pieces]))
        return out

    def offsets(self, ids: array) -> np.ndarray:
        """Byte offset in the text at which each token starts, and last the length of the text."""
        size = [0] + [len(self.bytes_of[i]) for i in ids]
        return np.cumsum(np.array(size, np.int64))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(4)
def _vocabulary(key: str, packed: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(t): int(r) for t, r in (x.split() for x in packed.splitlines())})


def _shared(docs: DataFrame, path: str):
    """The rank file as a broadcast (its size is checked); workers build the vocabulary once."""
    with open(path, "rb") as f:
        packed = f.read()
    if len(packed) > 64_000_000:
        raise ValueError(f"rank file of {len(packed)} bytes is over the broadcast bound of 64 MB")
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(packed).hexdigest(), packed))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every text: doc_id, ids (array), offsets (array: byte offset of each token)."""
    shared = _shared(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])

    def run(batches):
        voc = _vocabulary(*shared.value)
        for rows in groups(batches):
            ids = voc.encode_texts([t or "" for _, t in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()),
                 pa.array([np.frombuffer(x, np.uint32).astype(np.int32) for x in ids], pa.list_(pa.int32())),
                 pa.array([voc.offsets(x)[:-1] for x in ids], pa.list_(pa.int64()))], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes of encoded texts: doc_id, content (binary).

    Null ids count as none. Offsets, where the input has them, must agree with the decoded tokens.
    """
    shared = _shared(encoded, path)
    has_offsets = "offsets" in encoded.columns

    def run(batches):
        voc = _vocabulary(*shared.value)
        for batch in batches:
            out = []
            for ids, offsets in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = ids or []
                if offsets is not None and offsets != voc.offsets(ids)[:-1].tolist():
                    raise ValueError("offsets do not belong to these ids")
                out.append(voc.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    given = encoded.selectExpr("doc_id", "ids", "offsets" if has_offsets else "cast(null as array<long>) as offsets")
    return given.mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass and return digests of both directions.

    doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256
    (decoded bytes), n_bytes (end offset of the last token).
    """
    shared = _shared(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())])

    def run(batches):
        voc = _vocabulary(*shared.value)
        for rows in groups(batches):
            ids = voc.encode_texts([t or "" for _, t in rows])
            decoded = [voc.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(np.frombuffer(x, np.uint32).astype("<u4").tobytes()).hexdigest() for x in ids]),
                 pa.array([hashlib.sha256(b).hexdigest() for b in decoded]),
                 pa.array([len(b) for b in decoded], pa.int64())], schema=schema)

    return id_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
