"""Source divergence audit: how far the word use of a language's sources lies apart.

Identical texts of a language are collapsed before anything else: a text is tokenised once, and its
word counts enter each source's totals, and the document counts, times the number of its copies
there. A map task sends a text the first time it meets it and counts further copies; a text's parts
meet by its digest, are sorted so that the text comes first, and are tokenised as they stream by.

The counts are sparse (lang, source, term). Of a pair of sources, only terms that occur in both need
both counts: with p0 the value of an absent term and f0 = f(p0, q0), the sum of f over all V terms is
V f0, plus (f(p, q0) - f0) for each term of one source, plus (f(p0, q) - f0) for each of the other,
plus f(p, q) - f(p, q0) - f(p0, q) + f0 for each term in both. The first sums are over each source's
different counts, the last over terms, grouped by how many sources hold them. Sources of a language
are dealt into tiles of about ``TILE``, terms into buckets of about ``BUCKET`` counts, so a task holds a
bounded piece of a matrix and emits a sum a pair, whatever the number of terms.

All arithmetic is on whole numbers: p <= 10^9 + 1, so (p - q)^2 stays within 64 bits; the quotient
that gives p is taken in DECIMAL(38).

Defined results: null text, lang and source are ''; of a lang without kept terms every pair is 0; a
lang with one source has no pair; repeated rows are documents of their own; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuadro.llm.common import groups
from cuadro.session import materialise

SCALE = 1_000_000_000
MIN_DOCUMENTS = 10
TOP_TERMS = 10
TILE, BUCKET = 256, 32_768
#: Different texts and counts that a task holds before it sends them on.
HELD_TEXTS, HELD_COUNTS = 100_000, 300_000
#: Bytes between the terms become blanks; ASCII capitals are lowered; bytes of other letters stay.
TERM_BYTES = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
PIECE = 1 << 20


def terms(text: str) -> Counter[bytes]:
    """The terms of a text and how often each occurs; about 1 MB of the text is split at a time."""
    raw, found, at = text.encode(), Counter(), 0
    while at < len(raw):
        gap = GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        found.update(raw[at:end].translate(TERM_BYTES).split())
        at = end
    return found


# ---- collapse --------------------------------------------------------------------------------

COLLAPSED = pa.schema([("lang", pa.string()), ("digest", pa.binary()), ("source", pa.string()), ("n", pa.int64()),
                       ("text", pa.string())])


def collapse(docs: DataFrame) -> DataFrame:
    """lang, digest, source, n, text: a text once a task (n null there), and copies by source (text null)."""

    def flush(seen: dict) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()),
             pa.array([k[2] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64()),
             pa.nulls(len(keys), pa.string())], schema=COLLAPSED)

    def run(batches):
        copies: Counter = Counter()
        sent: set = set()
        for rows in groups(batches):
            new = []
            for lang, source, text in rows:
                digest = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
                copies[lang, digest, source] += 1
                if (lang, digest) not in sent:
                    sent.add((lang, digest))
                    new.append((lang, digest, text or ""))
            if new:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in new], pa.string()), pa.array([r[1] for r in new], pa.binary()),
                     pa.nulls(len(new), pa.string()), pa.nulls(len(new), pa.int64()),
                     pa.array([r[2] for r in new], pa.string())], schema=COLLAPSED)
            if len(copies) >= HELD_TEXTS:
                yield flush(copies)
                copies, sent = Counter(), set()
        if copies:
            yield flush(copies)

    named = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*named, docs["text"].cast("string").alias("text")) \
        .mapInArrow(run, "lang string, digest binary, source string, n long, text string")


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                     ("docs", pa.int64())])


def _counts(held: dict) -> Iterator[pa.RecordBatch]:
    """Rows of {(lang, source): {term: [n, docs]}}; the documents of a group are under the term None."""
    for (lang, source), by_term in held.items():
        size = len(by_term)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
             pa.array([None if t is None else t.decode() for t in by_term], pa.string()),
             pa.array([v[0] for v in by_term.values()], pa.int64()),
             pa.array([v[1] for v in by_term.values()], pa.int64())], schema=COUNTED)


def term_counts(collapsed: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: summed by task. A null term counts a group's documents.

    Every text arrives with its copies: rows meet by digest, with the text first.
    """

    def run(batches):
        held: dict = defaultdict(dict)
        size, key, counts = 0, None, {}
        for rows in groups(batches):
            for lang, digest, source, n, text in rows:
                if text is not None:
                    if (lang, digest) != key:                     # later ones are the same text from other tasks
                        key, counts = (lang, digest), terms(text)
                    continue
                into = held[lang, source]
                size -= len(into)
                for term, c in counts.items():
                    if (sums := into.get(term)) is None:
                        into[term] = [c * n, n]
                    else:
                        sums[0] += c * n
                        sums[1] += n
                into.setdefault(None, [0, 0])[1] += n
                size += len(into)
                if size >= HELD_COUNTS:
                    yield from _counts(held)
                    held.clear()
                    size = 0
        yield from _counts(held)

    met = collapsed.repartition("lang", "digest").sortWithinPartitions("lang", "digest", F.col("text").isNull())
    return met.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def sparse_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(counts, groups): lang, source, term, n, total of the kept terms; and of every (lang, source)
    den (N + 2 V), of its lang lang_den, v and the number of its sources and counts."""
    # dealt by term once: the sums by source and the totals of a term need no other exchange
    summed = term_counts(collapse(docs)).repartition("lang", "term").groupBy("lang", "term", "source") \
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = summed.withColumns({"total": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term),
                                "first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = materialise(whole.where((F.col("in_docs") >= min_documents) | F.col("term").isNull())
                       .select("lang", "source", "term", "n", "total", "first"), "divergence-counts")
    counts = kept.where("term is not null")
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("nonzero"))
    by_lang = counts.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_size"))
    every = kept.where("term is null").select("lang", "source")
    shape = every.join(by_group, ["lang", "source"], "left").groupBy("lang").agg(
        F.count("*").alias("sources"), F.coalesce(F.sum("nonzero"), F.lit(0)).alias("nonzero"))
    v = F.coalesce("v", F.lit(0))
    groups_ = every.join(by_group.drop("nonzero"), ["lang", "source"], "left").join(by_lang, "lang", "left").join(shape, "lang") \
        .select("lang", "source", v.alias("v"), (F.coalesce("size", F.lit(0)) + 2 * v).alias("den"),
                (F.coalesce("lang_size", F.lit(0)) + 2 * v).alias("lang_den"), "sources", "nonzero")
    return counts, materialise(groups_, "divergence-groups")


def share(count: Column | str, den: Column | str) -> Column:
    """1 + floor(10^9 (count + 2) / den), exact; null if den is 0."""
    c, d = (F.col(x) if isinstance(x, str) else x for x in (count, den))
    whole = (c + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(18,0)")
    return F.when(d > 0, F.lit(1) + F.call_function("div", whole, d.cast("decimal(20,0)")))


def divergence(p, q):
    """floor((p - q)^2 / (p + q)) of arrays of whole numbers."""
    return (p - q) ** 2 // (p + q)


# ---- pairs -------------------------------------------------------------------------------------

def pair_sums(p: np.ndarray, at: np.ndarray, term: np.ndarray, zero: np.ndarray, v: int) -> np.ndarray:
    """Sums of f for every pair of sources, of the terms given and, with ``v`` terms in all, of f0.

    ``at``, ``term``, ``p``: position of the source, number of the term and p of every count, sorted by
    term; ``zero``: p of an absent term by source. Without counts the result is v f0.
    """
    size = len(zero)
    f0 = divergence(zero[:, None], zero[None, :])
    out = v * f0
    if not len(p):
        return out
    # terms of one source: its different values, each against every other source's absent value
    own, n = np.unique(at << 32 | p, return_counts=True)
    for lo in range(0, len(own), 4096):
        rows, values = own[lo:lo + 4096] >> 32, own[lo:lo + 4096] & 0xFFFFFFFF
        gain = n[lo:lo + 4096, None] * (divergence(values[:, None], zero[None, :]) - f0[rows])
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        sums = np.add.reduceat(gain, starts)
        out[rows[starts]] += sums
        out[:, rows[starts]] += sums.T
    # terms of both: all terms held by k sources at once, two of their places at a time
    start = np.flatnonzero(np.diff(term, prepend=term[0] - 1))
    held = np.diff(np.append(start, len(term)))
    both = np.zeros_like(out)
    for k in np.unique(held[held > 1]).tolist():
        first = start[held == k]
        for i, j in itertools.combinations(range(k), 2):
            a, b, x, y = at[first + i], at[first + j], p[first + i], p[first + j]
            more = divergence(x, y) - divergence(x, zero[b]) - divergence(zero[a], y) + f0[a, b]
            np.add.at(both, (a, b), more)
    out += both + both.T
    return out


def pairs(counts: DataFrame, groups_: DataFrame, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """lang, source, item (another source of the lang), value: f of both summed over all kept terms."""
    many = F.ceil(F.col("sources") / tile).cast("int")
    block = F.pmod(F.xxhash64("source"), many).cast("int").alias("block")
    # a bucket never has fewer counts than its tile has pairs, so that what is emitted is bounded by what is read
    width = F.greatest(F.lit(bucket), F.pow(F.least("sources", F.lit(tile)), F.lit(2)))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("nonzero") / width)).cast("int")
    known = groups_.select("lang", "source", "v", "den", many.alias("blocks"), block, buckets.alias("buckets"),
                           share(F.lit(0), "den").alias("zero"))
    tiles = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiled = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    values = counts.join(known, ["lang", "source"]).select(
        "lang", "source", "block", "term", share("n", "den").alias("p"),
        F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), tiles) \
        .select("lang", "source", "term", "p", "bucket", *tiled)
    members = known.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))) \
        .select("lang", "source", "block", "v", "zero", "bucket", tiles).select("lang", "source", "block", "v", "zero", "bucket", *tiled)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows == 0:
            return schema.empty_table()
        # a tile of two blocks: its pairs are those across the blocks, of one block all within it
        lang, low, high, bucket_ = (right[c][0].as_py() for c in ("lang", "low", "high", "bucket"))
        right = right.sort_by("source")
        names = right["source"].combine_chunks()
        blocks = right["block"].to_numpy()
        v = right["v"][0].as_py()
        zero = right["zero"].fill_null(1).to_numpy()
        coded = left["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(coded, kind="stable")
        at = pc.index_in(left["source"].combine_chunks(), names).to_numpy().astype(np.int64)
        sums = pair_sums(left["p"].to_numpy()[order], at[order], coded[order], zero, v if bucket_ == 0 else 0)
        a, b = np.triu_indices(len(zero), 1)
        if low != high:
            across = blocks[a] != blocks[b]
            a, b = a[across], b[across]
        return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)),
                                     pa.array(sums[a, b], pa.int64())], schema=schema)

    key = ["lang", "low", "high", "bucket"]
    found = values.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(run, "lang string, source string, item string, value long")
    once = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return once.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def top_terms(counts: DataFrame, groups_: DataFrame) -> DataFrame:
    """lang, source, item (a term used more than in its lang), value: f against the lang."""
    known = groups_.select("lang", "source", "den", "lang_den")
    valued = counts.join(known, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "den").alias("p"), share("total", "lang_den").alias("q"))
    gap = F.col("p") - F.col("q")
    return valued.where("p > q").select("lang", "source", "item", F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))


def audit(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; see the module."""
    counts, groups_ = sparse_counts(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
              for part, frame in (("pair", pairs(counts, groups_)), ("term", top_terms(counts, groups_)))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
