"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens: words (runs outside space and \\x09-\\x0D, A-Z lower-cased) and one end token a text. The
counts of all training tokens are gathered by Spark. The ``vocabulary`` most frequent words, the
end and one class for all other words are the model's events; inside the class a word has its
smoothed share of the class.

Model: the two words before predict the next, h = c1 * r[w1] + c2 * r[w2] and
s(w) = h . q[w] + b[w], started at the unigram distribution. Every task trains a copy on all
training tokens of its partition by noise-contrastive estimation (noise words shared by a
minibatch, so gradients are matrix products); the copies are averaged, weighted by their tokens,
in Spark. Because the score is a sum over the two context words, the normaliser of every context
pair is one matrix product, exp(A + b) . exp(B)^T, and each token's log-probability is exactly
normalised.

Counts of frequent words travel with the tasks: at most ``frequent`` words (whole bands of a
histogram of counts). Every other word is joined to its count, summed by document beforehand.

Defined results: a null text counts as empty (the end token only); rows are kept one for one;
with no training text all probabilities are 1 (scores 0); a null id is a training row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadro.llm.common import groups, words_of
from cuadro.session import materialise

END = b" "                       # no word holds a blank
OTHER = 0                        # event of all words outside the vocabulary
HELD_WORDS = 300_000             # words a task counts before it hands the counts on


class Model:
    """Parameters r (context vectors, the last row for the start of a text), q, b and c."""

    def __init__(self, unigram: np.ndarray, dims: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.events, self.dims = len(unigram), dims
        self.unigram = unigram / unigram.sum()
        self.r = rng.normal(0, 0.1, (self.events + 1, dims)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (self.events, dims)).astype(np.float32)
        self.b = np.log(self.unigram).astype(np.float32)
        self.c = np.ones((2, dims), np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)])

    def load(self, v: np.ndarray) -> "Model":
        at = 0
        for name in ("r", "q", "b", "c"):
            shape = getattr(self, name).shape
            n = int(np.prod(shape))
            setattr(self, name, v[at:at + n].reshape(shape).astype(np.float32))
            at += n
        return self

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float, noise: int,
              seed: int) -> int:
        """One pass of Adagrad over (word before, word two before, word); returns the tokens seen."""
        rng = np.random.default_rng(seed)
        cdf = np.cumsum(self.unigram)
        log_noise = (np.log(self.unigram) + np.log(noise)).astype(np.float32)
        squares = {n: np.full(getattr(self, n).shape, 1e-3, np.float32) for n in ("r", "q", "b", "c")}
        seen = 0

        def scatter(at: np.ndarray, grad: np.ndarray, rows: int) -> np.ndarray:
            flat = (at[:, None] * self.dims + np.arange(self.dims)).ravel()
            return np.bincount(flat, grad.ravel(), rows * self.dims).reshape(rows, self.dims).astype(np.float32)

        for one, two, word in batches:
            seen += len(word)
            r1, r2, qw = self.r[one], self.r[two], self.q[word]
            h = r1 * self.c[0] + r2 * self.c[1]
            drawn = np.minimum(np.searchsorted(cdf, rng.random(noise)), self.events - 1)
            qn = self.q[drawn]
            true = (h * qw).sum(1) + self.b[word] - log_noise[word]
            false = h @ qn.T + (self.b[drawn] - log_noise[drawn])
            g_true = 1 / (1 + np.exp(np.clip(true, -30, 30)))                 # 1 - sigma
            g_false = -1 / (1 + np.exp(-np.clip(false, -30, 30)))             # - sigma
            gh = g_true[:, None] * qw + g_false @ qn
            grads = {"q": scatter(word, g_true[:, None] * h, self.events),
                     "r": scatter(one, gh * self.c[0], self.events + 1) + scatter(two, gh * self.c[1], self.events + 1),
                     "b": np.bincount(word, g_true, self.events).astype(np.float32),
                     "c": np.stack([(gh * r1).sum(0), (gh * r2).sum(0)])}
            np.add.at(grads["q"], drawn, g_false.T @ h)
            np.add.at(grads["b"], drawn, g_false.sum(0))
            for name, g in grads.items():
                g /= len(word)
                squares[name] += g * g
                getattr(self, name).__iadd__(rate * g / np.sqrt(squares[name]))
        return seen

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A[w1, w] with the bias, B[w2, w], and log Z[w1, w2], in natural logarithms."""
        a = (self.r * self.c[0]) @ self.q.T + self.b
        b = (self.r * self.c[1]) @ self.q.T
        high_a, high_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.exp(a - high_a) @ np.exp(b - high_b).T
        return a, b, np.log(z) + high_a + high_b.T


def contexts(ids: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word two before, word) of all texts; ``start`` stands before a text."""
    word = np.concatenate(ids)
    begin = np.cumsum([0] + [len(i) for i in ids[:-1]])
    one, two = np.roll(word, 1), np.roll(word, 2)
    one[begin] = start
    two[begin] = start
    second = (begin + 1)[np.array([len(i) for i in ids]) > 1]
    two[second] = start
    return one, two, word


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the one text column; counts are summed in the tasks first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def emit(held: Counter):
        items = list(held.items())
        for at in range(0, len(items), 20_000):
            part = items[at:at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()),
                                              pa.array([n for _, n in part], pa.int64())], schema=schema)

    def run(batches):
        held: Counter = Counter()
        for rows in groups(batches):
            for (text,) in rows:
                held.update(words_of(text))
            held[END] += len(rows)
            if len(held) > HELD_WORDS:
                yield from emit(held)
                held = Counter()
        yield from emit(held)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The end token, then the most frequent words: whole bands of counts, ``most`` words at most."""
    band = F.floor(F.log2(F.col("n")) * 8)
    sizes = sorted(((r.band, r["count"]) for r in counts.groupBy(band.alias("band")).count().collect()), reverse=True)
    total, lowest = 0, None                              # at most 8 * 64 bands
    for b, size in sizes:
        total += size
        if total > most:
            break
        lowest = b
    if lowest is None:
        found = counts.where(F.col("word") == F.lit(END)).collect()
    else:
        found = counts.where((band >= lowest) | (F.col("word") == F.lit(END))).collect()
    words = sorted(((bytes(r.word), r.n) for r in found), key=lambda x: (-x[1], x[0]))
    return [x for x in words if x[0] == END] + [x for x in words if x[0] != END]


class Scorer:
    """What the tasks need: frequent words with counts, totals and the model's parameters."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int, vocabulary: int, dims: int):
        self.words = [w for w, _ in words]
        self.counts = np.array([n for _, n in words], np.float64)
        self.total, self.distinct = total, distinct
        self.events = min(len(words), vocabulary - 1) + 1                # and OTHER
        inside = self.counts[:self.events - 1]
        self.rest = total - inside.sum() + distinct - len(inside) + 1    # smoothed mass of OTHER, the unseen included
        unigram = np.concatenate([[max(total - inside.sum(), 1)], inside])
        self.model = Model(unigram, dims)

    def event_of(self) -> dict[bytes, int]:
        return {w: i + 1 for i, w in enumerate(self.words[:self.events - 1])}


def train(texts: DataFrame, scorer: Scorer, rate: float = 0.2, noise: int = 32, batch: int = 1024) -> np.ndarray:
    """Train a copy of the model in every task on all its texts and average the copies."""
    schema = pa.schema([("at", pa.int32()), ("x", pa.float64()), ("n", pa.int64())])
    shared = texts.sparkSession.sparkContext.broadcast(
        (scorer.words[:scorer.events - 1], scorer.model.unigram, scorer.model.dims, scorer.model.vector()))

    def run(parts):
        words, unigram, dims, vector = shared.value
        event = {w: i + 1 for i, w in enumerate(words)}
        get = event.get
        model = Model(unigram, dims).load(vector)
        start = model.events

        def minibatches():
            held, size = [], 0
            for rows in groups(parts):
                for (text,) in rows:
                    held.append(np.array([get(w, OTHER) for w in [*words_of(text), END]], np.int64))
                    size += len(held[-1])
                    if size >= batch:
                        one, two, word = contexts(held, start)
                        for at in range(0, size, batch):
                            yield one[at:at + batch], two[at:at + batch], word[at:at + batch]
                        held, size = [], 0
            if held:
                yield contexts(held, start)

        seen = model.train(minibatches(), rate, noise, TaskContext.get().partitionId())
        if seen:
            v = model.vector().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v), pa.array(np.full(len(v), seen, np.int64))],
                schema=schema)

    copies = texts.mapInArrow(run, "at int, x double, n long")
    mean = copies.groupBy("at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).collect()
    out = scorer.model.vector().astype(np.float64)                       # one row for each parameter
    for r in mean:
        out[r.at] = r.x
    return out


_READY: dict[str, tuple] = {}    # of the scorer that this worker used last


def _ready(key: str, holder) -> tuple:
    if key not in _READY:
        words, counts, total, distinct, events, rest, unigram, dims, vector = holder.value
        index = {w: i for i, w in enumerate(words)}
        base = np.log10((counts + 1) / (total + distinct + 1))
        inside = np.where(np.arange(len(words)) < events - 1, 0.0, np.log10((counts + 1) / rest))
        _READY.clear()
        _READY[key] = index, base, inside, events, Model(unigram, dims).load(vector).tables()
    return _READY[key]


def score(docs: DataFrame, training: DataFrame, vocabulary: int = 2048, dims: int = 16,
          frequent: int = 200_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` has one column, the text.
    """
    counts = materialise(count_words(training), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = frequent_words(counts, frequent)
    if not total:
        n = F.when(F.col("text").isNull(), F.array()).otherwise(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))
        return docs.select("doc_id", (F.size(n) + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
                           F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    scorer = Scorer(words, total, distinct, vocabulary, dims)
    vector = train(training, scorer)
    holder = docs.sparkSession.sparkContext.broadcast(
        (scorer.words, scorer.counts, total, distinct, scorer.events, scorer.rest, scorer.model.unigram, dims, vector))
    key = uuid.uuid4().hex
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()),
                        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        index, base, inside, events, (a, b, log_z) = _ready(key, holder)
        get = index.get
        row = TaskContext.get().partitionId() << 33
        for rows in groups(batches):
            places, rare = [], []
            for doc_id, text in rows:
                words = [*words_of(text), END]
                at = np.array([get(w, -1) for w in words], np.int64)
                places.append(at)
                unknown = np.flatnonzero(at < 0).tolist()
                rare.append(Counter([words[i] for i in unknown]))
            ids = [np.where((p >= 0) & (p < events - 1), p + 1, OTHER) for p in places]
            one, two, word = contexts(ids, events)
            logp = (a[one, word] + b[two, word] - log_z[one, two]).astype(np.float64) / np.log(10)
            begin = np.cumsum([0] + [len(p) for p in places[:-1]])
            flat = np.concatenate(places)
            known = flat >= 0
            safe = np.where(known, flat, 0)
            logp += np.where(known, inside[safe], 0.0)
            cols = {
                "doc_id": [d for d, _ in rows], "n_tokens": [len(p) for p in places],
                "n_known": np.add.reduceat(known.astype(np.int64), begin),
                "base": np.add.reduceat(np.where(known, base[safe], 0.0), begin), "score": np.add.reduceat(logp, begin)}
            keys = np.arange(row, row + len(rows))
            row += len(rows)
            zeros = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(cols["doc_id"], pa.int64()),
                 pa.array([b" %d" % k for k in keys.tolist()], pa.binary()), pa.array(zeros, pa.int64()),
                 pa.array(cols["n_tokens"], pa.int64()), pa.array(cols["n_known"]), pa.array(cols["base"]),
                 pa.array(cols["score"])], schema=schema)
            n = sum(map(len, rare))
            none = pa.nulls(n, pa.int64())
            nothing = pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(keys, [len(r) for r in rare])), none,
                 pa.array([w for r in rare for w in r], pa.binary()), pa.array([t for r in rare for t in r.values()], pa.int64()),
                 none, none, nothing, nothing], schema=schema)

    parts = docs.mapInArrow(run, "row long, doc_id long, word binary, tf long, n_tokens long, n_known long, "
                                 "base double, score double")
    # A row of a document carries a key that is no word, so these rows spread over the partitions and match nothing.
    joined = parts.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    in_base = F.col("tf") * F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    in_rest = F.col("tf") * F.log10((F.col("n") + 1) / F.lit(float(scorer.rest)))
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce(F.col("n_known"), F.when(F.col("n") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", in_base)).alias("base_score"), F.sum(F.coalesce("score", in_rest)).alias("score")) \
        .select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
