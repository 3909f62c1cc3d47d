"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. A document is contaminated by an item of L
words if a local alignment of words (match 2, mismatch -1, gap -2) reaches 2 L - 3 e, where
e = floor(L / 5): an exact copy scores 2 L, and an edit of up to a fifth of the words still passes,
i.e. a similarity of 0.8.

Seeds are complete for this rule. Every unit of score lost breaks at most one 3-gram of the item,
so an alignment that passes leaves all but 3 e of them whole, and among any 3 e + 1 of the item's
3-grams one occurs in the passage. The operator takes the 3 e + 1 that are rarest over all
documents (ties by position), so common phrases start few alignments. Around a seed the passage
can drift by at most 1.5 e words; only that window is aligned.

Items travel with the tasks. Their size is measured first; over ``BLOCK_BYTES`` they are dealt
into blocks by a hash of their id and all documents are read once for each block.

Defined results: null or wordless texts and items match nothing; a row of documents gives one row
for each item it matches, so repeated rows and repeated items repeat; empty tables give an empty
result; other columns are not read by ``find`` and are kept by ``remove``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadro.llm.common import GROUP_BYTES, groups, id_text

WORD = re.compile(r"[^\W_]+")
N = 3
MATCH, MISMATCH, GAP = 2, -1, -2
BLOCK_BYTES = 16_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def allowed(length: int) -> int:
    """Edits allowed in an item of so many words."""
    return length // 5


def gram_length(length: int) -> int:
    """3, or less for items so short that the edits allowed could break all their 3-grams."""
    return min(length, N if length < N or length - N + 1 > N * allowed(length) else 2)


def local_score(passage: np.ndarray, item: np.ndarray) -> int:
    """Best local alignment score; one vector step a word of the item."""
    slope = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best = 0
    for word in item:
        step = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP, out=step[1:])
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope            # gaps along the passage
        best = max(best, int(row.max()))
    return best


class Items:
    """A block of items: word numbers from 1 (0 is any other word) and all their n-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        kept = [(i, w) for i, t in rows if (w := words(t))]
        self.item_ids = [i for i, _ in kept]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int64) for _, w in kept]
        self.base = len(self.number) + 1
        if self.base >= 1 << 21:
            raise ValueError("a block of items has too many different words; lower BLOCK_BYTES")
        per_item = [self.codes(w, gram_length(len(w))) for w in self.words]
        self.item = np.repeat(np.arange(len(kept)), [len(c) for c in per_item])
        self.offset = np.concatenate([np.arange(len(c)) for c in per_item]) if kept else np.array([], np.int64)
        self.code = np.concatenate(per_item) if kept else np.array([], np.int64)
        self.lengths = sorted({gram_length(len(w)) for w in self.words})
        self.table = np.unique(self.code)

    def codes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Codes of the n-grams; those with another word are -1. Lengths never collide."""
        if len(ids) < n:
            return np.array([], np.int64)
        code = ids[:len(ids) - n + 1].copy()
        known = code > 0
        for k in range(1, n):
            part = ids[k:len(ids) - n + 1 + k]
            code = code * self.base + part
            known &= part > 0
        return np.where(known, code, -1)

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def hits(self, texts: list[str | None], table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and (text, position, place in table) of every n-gram found in ``table``."""
        ids = [self.numbers(t) for t in texts]
        gap = np.zeros(N, np.int64)
        joined = np.concatenate([x for i in ids for x in (i, gap)]) if ids else gap
        begin = np.cumsum([0] + [len(i) + N for i in ids])
        where, place = [], []
        for n in self.lengths:
            codes = self.codes(joined, n)
            at = np.searchsorted(table, codes)
            at[at == len(table)] = 0
            found = np.flatnonzero((table[at] == codes) & (codes >= 0)) if len(table) else np.array([], np.int64)
            where.append(found)
            place.append(at[found])
        where = np.concatenate(where) if where else np.array([], np.int64)
        place = np.concatenate(place) if place else np.array([], np.int64)
        text = np.searchsorted(begin, where, side="right") - 1
        return ids, text, where - begin[text], place


class Seeds:
    """The rarest 3 e + 1 n-grams of every item, by how often each occurs in the documents."""

    def __init__(self, items: Items, frequency: np.ndarray):
        self.items = items
        rare = frequency[np.searchsorted(items.table, items.code)]
        order = np.lexsort((items.offset, rare, items.item))
        rank = np.arange(len(order)) - np.searchsorted(items.item[order], items.item[order])
        quota = np.array([3 * allowed(len(w)) + 1 for w in items.words], np.int64)
        order = order[rank < quota[items.item[order]]] if len(order) else order
        order = order[np.argsort(items.code[order], kind="stable")]
        self.table, self.first = np.unique(items.code[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.item, self.offset = items.item[order], items.offset[order]

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text, item, score) of every contaminated pair."""
        ids, text, position, place = self.items.hits(texts, self.table)
        windows: dict[tuple[int, int], list[int]] = {}
        for t, p, k in zip(text.tolist(), position.tolist(), place.tolist()):
            for s in range(self.first[k], self.last[k]):
                windows.setdefault((t, int(self.item[s])), []).append(p - int(self.offset[s]))
        for (t, i), diagonals in windows.items():
            item = self.items.words[i]
            e = allowed(len(item))
            drift = (3 * e + 1) // 2
            best = 0
            diagonals = sorted(set(diagonals))
            start = end = diagonals[0]
            for d in [*diagonals[1:], None]:
                if d is not None and d - end <= len(item) + 2 * drift:
                    end = d
                    continue
                window = ids[t][max(0, start - drift):end + len(item) + drift]
                best = max(best, local_score(window, item))
                start = end = d
            if best >= MATCH * len(item) - 3 * e:
                yield t, i, best


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text")) \
        .where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        block = Items([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()])
        if block.item_ids:
            yield block


def rare_seeds(docs: DataFrame, items: Items) -> Seeds:
    """Count the items' n-grams over all documents, then choose each item's rarest."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(len(items.table), np.int64)
        for rows in groups(batches):
            *_, place = items.hits([t for t, in rows], items.table)
            total += np.bincount(place, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], schema=schema)

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(items.table), np.int64)
    for r in counts.collect():                                       # no more rows than the block has n-grams
        frequency[r.gram] = r.n
    return Seeds(items, frequency)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated pair: doc_id, item_id, score (1 for an exact copy), n_words of the item."""
    docs = id_text(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64())])
    ddl = "doc_id long, item_id long, score double, n_words long"
    out = docs.sparkSession.createDataFrame([], ddl)
    for items in blocks(benchmark):
        seeds = rare_seeds(docs, items)

        def run(batches, seeds=seeds):
            items = seeds.items
            for rows in groups(batches):
                found = list(seeds.matches([t for _, t in rows]))
                size = [len(items.words[i]) for _, i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[t][0] for t, _, _ in found], pa.int64()),
                     pa.array([items.item_ids[i] for _, i, _ in found], pa.int64()),
                     pa.array([s / (MATCH * n) for (_, _, s), n in zip(found, size)], pa.float64()),
                     pa.array(size, pa.int64())], schema=schema)

        out = out.unionByName(docs.mapInArrow(run, ddl))
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns kept."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        seeds = rare_seeds(docs, items)

        def run(batches, seeds=seeds):
            for batch in batches:
                for part in _parts(batch, at):
                    hit = {t for t, *_ in seeds.matches(part.column(at).to_pylist())}
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about GROUP_BYTES of text."""
    per_row = max(1, batch.column(at).nbytes // max(1, batch.num_rows))
    step = max(1, GROUP_BYTES // per_row)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
