"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (1 to 3 characters) of a language, most
frequent first. A document's own profile is compared with each language by the out-of-place
distance: the sum, over the document's n-grams, of how far each one's rank is from its rank in
the language; an n-gram the language does not list costs the length of a profile.

Text is lower-cased; anything but letters becomes one blank; n-grams with a blank inside are left
out, those that begin or end with one are kept. Ties of frequency are broken by the n-gram, ties
of distance by the name of the language, so results do not depend on partitions.

Learning counts the n-grams of all training rows; only the profiles (``size`` n-grams a language)
reach the driver. ``max_languages`` bounds that: more label values raise an error.

Defined results: a null text or one without a letter is ``und`` with score 0; with no training
rows every text is ``und``; rows are kept one for one; rows with a null label or null text teach
nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuadro.llm.common import groups, id_text

UNKNOWN = "und"
SIZE = 400
MAX_LANGUAGES = 10_000
BLANK = 32
BITS = 21                       # a code point
HELD_ENTRIES = 1_000_000        # counts a task holds before it hands them on


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to itself for letters, to a blank for all else."""
    table = np.full(0x110000, BLANK, np.int64)
    cps = np.array([cp for cp in range(0x110000) if chr(cp).isalpha()], np.int64)
    table[cps] = cps
    return table


def letters(text: str) -> np.ndarray:
    """Lower-cased letters with one blank for every stretch of anything else, a blank at both ends."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32)
    cp = _letters()[raw]
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != BLANK) | (cp[:-1] != BLANK)
    return cp[keep]


def ngrams(cp: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams as integers. Grams of different lengths never collide: no code is zero."""
    is_letter = cp != BLANK
    one = cp[is_letter]
    pair = (cp[:-1] << BITS) | cp[1:]
    triple = (pair[:-1] << BITS) | cp[2:]
    return np.concatenate([one, pair, triple[is_letter[1:-1]]])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in ascending order, and how often each occurs."""
    if not len(grams):
        return grams, grams
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


PIECE = 300_000               # characters counted at once


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counted n-grams of a text. A long one is cut before characters that are no letters: no
    n-gram reaches across such a place, so the counts of the pieces add up."""
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        parts.append(counted(ngrams(letters(text[at:end]))))
        at = end
    return _summed(parts)


def ranked(keys: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent grams, most frequent first, ties by the gram."""
    return keys[np.argsort(-n, kind="stable")[:size]]


def learn(docs: DataFrame, lang: Column, size: int = SIZE, text_col: str = "text",
          max_languages: int = MAX_LANGUAGES) -> dict[str, list[int]]:
    """Profiles from all rows with a non-null text and label: {language: grams by rank}."""
    rows = docs.select(lang.cast("string").alias("lang"), docs[text_col].cast("string").alias("text")) \
        .where("lang is not null and text is not null")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def emit(held):
        for name, parts in held.items():
            keys, n = _summed(parts)
            for at in range(0, len(keys), 50_000):
                k = keys[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n[at:at + 50_000])], schema=schema)

    def run(batches):
        held: dict[str, list] = {}
        entries = 0
        for group in groups(batches):
            by_lang: dict[str, list[str]] = {}
            for name, text in group:
                by_lang.setdefault(name, []).append(text)
            for name, texts in by_lang.items():
                new = text_counts("\n".join(texts))
                before = sum(len(k) for k, _ in held.get(name, []))
                held[name] = [_summed([*held.get(name, []), new])]
                entries += len(held[name][0][0]) - before
            if entries > HELD_ENTRIES:
                yield from emit(held)
                held, entries = {}, 0
        yield from emit(held)

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams")) \
        .limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"over {max_languages} label values; raise max_languages if they are languages")
    return {r.lang: [g.gram for g in r.grams] for r in sorted(found, key=lambda r: r.lang)}


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) < 2:
        return parts[0] if parts else (np.array([], np.int64), np.array([], np.int64))
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class Profiles:
    """All profiles in one sorted table of grams with a rank for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)   # the last row: unlisted
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked grams to each language."""
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = len(self.grams) - 1
        at = np.where(self.grams[at] == grams, at, len(self.grams))
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(grams))[:, None])
        return np.where(ranks < 0, self.size, np.minimum(away, self.size)).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / the largest possible distance."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        keys, n = text_counts(text)
        if not len(keys):                                     # no letter
            return UNKNOWN, 0.0
        grams = ranked(keys, n, self.size)
        distance = self.distances(grams)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (self.size * len(grams)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, lang_pred, score. The profiles (languages x size integers) go with the tasks."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        table = Profiles(profiles, size)
        for rows in groups(batches):
            out = [table.predict(text) for _, text in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()), pa.array([p for p, _ in out]),
                 pa.array([s for _, s in out])], schema=schema)

    return id_text(docs, id_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def label(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE) -> DataFrame:
    """The input with columns ``lang_pred`` and ``score`` after its own; their names must be free."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        table = Profiles(profiles, size)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [table.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
