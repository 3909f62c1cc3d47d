"""Filter interaction audit: what each filter removes, in every order in which they can be applied.

Each document gets one bit a filter. Counts by part and failing set, of all documents, good ones and
toxic ones, are all that leaves the corpus: 2^k cells a part. They form a tensor with one axis of
length 2 (pass, fail) a filter. Every figure of a step is a contraction of that tensor with a vector
an axis that selects pass (1, 0), fail (0, 1) or all (1, 1): kept selects pass on the filters applied
so far, removed also fail on the step's own, and so on. One ``einsum`` does all orders and steps of
many parts.

The texts are read once. What is shuffled is a row of fixed size a document: a join of its id to the
labels, and a join of (digest of its text, id) to the smallest id of each text, so a group of copies
is no key of any join. The counts are summed in the tasks before they are shuffled by part, so neither
is a large source.

Defined results: a null text is empty, a null source the part ''; a null id is never smaller or larger
than another, so its text is no copy and has no label; rows that repeat an id are documents of their
own, and none of them is a copy of another with that id; of several label rows of an id, one that says
1 is enough; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadro.llm.common import groups
from cuadro.session import materialise

FILTERS = "ABCDE"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
UPPER, MARKS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
BLANK = re.compile(rb"[ \t\n\x0b\f\r]")
PIECE = 1 << 20
#: Parts contracted at once; an intermediate holds about 230 kB of each.
PARTS = 64


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about 1 MB of it, cut at blanks."""
    at = 0
    while at < len(raw):
        blank = BLANK.search(raw, at + PIECE)
        end = blank.start() if blank else len(raw)
        yield raw[at:end].split()
        at = end


def failing(text: str | None) -> tuple[int, bytes]:
    """Bits of the failed filters A to D (A highest of five, E unset) and a digest of the text."""
    raw = (text or "").encode()
    n, distinct = 0, set()
    for some in words(raw):
        n += len(some)
        distinct.update(some)
    short, repetitive = n < 50, 100 * len(distinct) < 65 * n
    shouting = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 5 * len(text or "")
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return short << 4 | repetitive << 3 | shouting << 2 | marked << 1, hashlib.blake2b(raw, digest_size=16).digest()


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits (filters A to D), digest for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("bits", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for rows in groups(batches):
            found = [failing(r[-1]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=schema)

    fields = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                         F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
                         docs["text"].cast("string").alias("text"))
    return fields.mapInArrow(run, "doc_id long, part string, bits int, digest binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell (failing set as bits, A highest), n, good, toxic: counts of documents."""
    rows = materialise(measured(docs), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] == 1).alias("good"),
                          (labels["toxic"] == 1).alias("toxic")) \
        .where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    judged = rows.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return judged.groupBy("part", (F.col("bits") + copy.cast("int")).alias("cell")).agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def selectors(k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of k filters; and what each figure selects: figure, order, step, axis, pass or fail."""
    orders = list(itertools.permutations(range(k)))
    chosen = np.empty((4, len(orders), k, k, 2), np.int64)
    for o, order in enumerate(orders):
        for s, own in enumerate(order):
            before = order[:s]
            chosen[0, o, s] = [PASS if f in before or f == own else ALL for f in range(k)]            # kept
            chosen[1, o, s] = [FAIL if f == own else PASS if f in before else ALL for f in range(k)]  # removed
            chosen[2, o, s] = [FAIL if f == own else ALL for f in range(k)]                           # failing at all
            chosen[3, o, s] = [FAIL if f == own else PASS for f in range(k)]                          # failing alone
    return orders, chosen


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Counts selected from a tensor (parts, 2, 2, ...): (parts, orders * steps)."""
    k = tensor.ndim - 1
    axes = "abcdefgh"[:k]
    terms = ",".join([f"p{axes}", *(f"r{x}" for x in axes)])
    rows = chosen.reshape(-1, k, 2)
    return np.einsum(f"{terms}->pr", tensor, *(rows[:, i] for i in range(k)), optimize="greedy")


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                    *((c, pa.int64()) for c in COLUMNS)])


def figures(parts: list[str], counts: np.ndarray, names: str) -> pa.RecordBatch:
    """Result rows of some parts; ``counts``: (n, good, toxic) by part and cell."""
    k = len(names)
    orders, chosen = selectors(k)
    everyone, good, toxic = counts.reshape(3, len(parts), *[2] * k)
    kept, removed, fails, alone = (contract(everyone, c) for c in chosen)
    own = np.array(orders).ravel()
    shapley = np.stack([removed[:, own == f].sum(axis=1) for f in range(k)], axis=1)[:, own]
    values = (kept, removed, fails - removed, alone, contract(good, chosen[1]), contract(toxic, chosen[1]), shapley)
    named = ["".join(names[f] for f in order) for order in orders for _ in order]
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), len(named)))),
         pa.array(named * len(parts), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * len(parts))),
         *(pa.array(np.ascontiguousarray(v).ravel(), pa.int64()) for v in values)], schema=RESULT)


def interactions(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row a part, order and step from ``cells`` of the filters ``names``."""
    size = 1 << len(names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS).to_pylist()
                counts = np.zeros((3, len(some), size), np.int64)
                for i, row in enumerate(some):
                    for c in row["cells"]:
                        counts[:, i, c["cell"]] = c["n"], c["good"], c["toxic"]
                yield figures([r["part"] for r in some], counts, names)

    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of ``COLUMNS`` for the filters A to E."""
    return interactions(cells(docs, labels))
