"""Exact k-nearest-neighbour search (squared L2), for one question or a batch of them.

Flat exact search compares every question with every document; what matters at scale is
that those pairs are never materialised as rows or shuffled. The distance work runs inside
an Arrow-batched ``mapInPandas`` over the corpus: each task scores its documents against
the question matrix with BLAS and keeps only the best k per question (ties broken by
document id), so a task emits at most k rows per question. A final
``row_number() <= k`` window (planned with a partial WindowGroupLimit) merges the per-task
candidates.

Two plans:

* the question matrix is small enough (checked: rows × dims × 8 bytes ≤ ``broadcast_bytes``):
  it is broadcast once and the corpus is scanned in place, no corpus shuffle;
* otherwise questions and documents are packed into blocks by the tasks that read them and
  written to the shared folder; every block of questions meets every block of documents
  (``cartesian``, which reads the files again and shuffles nothing), two blocks in memory at a time;
  of vectors that are mostly 0, only the other values and their places travel.

In both, the corpus is cut into no more parts than there are task slots, so that the candidates
(k per question and part) grow with the questions, not with questions × documents.

Exactness: documents are picked by scores from one single-precision matrix product. Those that its
rounding leaves in doubt, by a rigorous bound, are measured as ``Σ(c−q)²`` in double precision, and only
these distances decide.

``group_col`` restricts matches to equal groups (a question only searches its own store).
"""

from __future__ import annotations

import itertools
import math
import pickle
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_BYTES, scratch_path, spread_for_cpu

if TYPE_CHECKING:                  # loaded where they are used: the scoring tasks need neither
    import pandas as pd
    import pyarrow as pa

BLOCK_BYTES = 16 << 20             # vectors (as float64) per block of documents in the blocked plan
QUESTION_BYTES = 32 << 20          # the same of questions: documents are read once for each block of questions
TILE_BYTES = 16 << 20              # temporaries of one scoring step
TILE_ROWS = 1024                   # questions and documents of one scoring step: its scores stay in the cache
_U = np.finfo(np.float64).eps / 2  # unit roundoff

_OUT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()),
                     T.StructField("dist", T.DoubleType()), T.StructField("_g", T.StringType())])


def _few_copies(ids: np.ndarray, C: np.ndarray, k: int) -> np.ndarray:
    """Rows that can matter: of equal vectors only the k smallest ids (ties go to the smaller id)."""
    if len(ids) <= k or C.shape[1] == 0:
        return np.arange(len(ids))
    raw = np.ascontiguousarray(C + C.dtype.type(0)).view(np.dtype((np.void, C.shape[1] * C.itemsize))).ravel()
    group = np.unique(raw, return_inverse=True)[1]
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], group[order])
    return order[np.arange(len(order)) - first < k]


def _halved(C: np.ndarray, kind: type) -> tuple[np.ndarray, float]:
    """(rows (c, −|c|²/2) in the given precision, the largest |c|)."""
    c2 = np.einsum("nd,nd->n", C, C, dtype=np.float64, casting="safe")
    rows = np.empty((len(C), C.shape[1] + 1), kind)
    rows[:, :-1] = C
    rows[:, -1] = c2 * -0.5
    return rows, math.sqrt(c2.max())


class TopK:
    """Running exact top-k per question over corpus blocks.

    A document at distance δ has score ``c·q − |c|²/2 = (|q|² − δ)/2``. All scores come from one matrix
    product, in single precision where the values allow it; only documents whose score is not lower, by more
    than its rounding can explain, than that of the question's k-th best so far are measured exactly. A tile's
    first questions have no k-th best yet: theirs is the k-th largest of the best scores of groups of documents.

    Documents and questions are cut into tiles, so that no temporary exceeds ``TILE_BYTES``
    whatever the number of questions, the width, or the number of equal vectors.
    """

    def __init__(self, q_ids: np.ndarray, Q: np.ndarray, k: int):
        Q = _floats(Q)
        self.q_ids, self.k = q_ids, k
        self.live = np.isfinite(Q).all(1)
        with np.errstate(over="ignore", invalid="ignore"):
            self.q2 = np.einsum("nd,nd->n", Q, Q, dtype=np.float64, casting="safe")
            self.A = np.concatenate([Q, np.ones((len(Q), 1), Q.dtype)], axis=1).astype(np.float32, copy=False)
        self.Q = self.A[:, :-1] if Q.dtype == np.float32 else Q
        self.most = float(np.abs(Q[self.live]).max(initial=0.0))
        self.D = np.full((len(q_ids), k), np.inf)
        self.I = np.full((len(q_ids), k), np.iinfo(np.int64).max)
        self.space: dict[np.dtype, np.ndarray] = {}

    def add(self, c_ids: np.ndarray, C: np.ndarray) -> None:
        if len(self.q_ids) == 0 or len(c_ids) == 0:
            return
        C = _floats(C)
        d = C.shape[1]
        if d != self.Q.shape[1]:
            raise ValueError(f"documents of {d} dimensions, questions of {self.Q.shape[1]}")
        live = np.isfinite(C).all(1)
        if not live.all():
            c_ids, C = c_ids[live], C[live]
        rows = max(1, TILE_BYTES // (8 * (d + 1)))
        q_step = min(len(self.q_ids), TILE_ROWS, rows)
        c_step = min(max(TILE_ROWS, TILE_ROWS * TILE_ROWS // q_step), rows)
        for s in range(0, len(c_ids), c_step):
            ids, Cc = c_ids[s:s + c_step], C[s:s + c_step]
            keep = _few_copies(ids, Cc, self.k)
            ids, Cc = ids[keep], Cc[keep]
            most = max(self.most, float(np.abs(Cc).max(initial=0.0)))
            kind = np.float32 if most <= 1e15 and d < 500_000 else np.float64 if most <= 1e150 else None
            scored = _halved(Cc, kind) if kind else None
            for t in range(0, len(self.q_ids), q_step):
                self._add_tile(ids, Cc, scored, slice(t, min(t + q_step, len(self.q_ids))))

    def _add_tile(self, ids: np.ndarray, Cc: np.ndarray, scored: tuple[np.ndarray, float] | None, part: slice) -> None:
        if scored is None:                                               # squares would overflow: everything is measured
            q = np.flatnonzero(self.live[part])
            at = np.repeat(q, len(ids)) * len(ids) + np.tile(np.arange(len(ids)), len(q))
        else:
            B, c_most = scored
            A = self.A[part] if B.dtype == np.float32 else np.concatenate([self.Q[part], np.ones((part.stop - part.start, 1))], axis=1)
            S = np.matmul(A, B.T, out=self._room(B.dtype, len(A), len(B)))             # (q, m)
            at = np.flatnonzero(np.greater_equal(S, self._least(S, c_most, part)[:, None], out=self._room(np.dtype(bool), *S.shape)))
        step = max(1, TILE_BYTES // (32 * max(1, Cc.shape[1])))
        for s in range(0, len(at), step):
            q, c = np.divmod(at[s:s + step], len(ids))
            self._measure(q + part.start, ids[c], Cc[c])

    def _room(self, kind: np.dtype, rows: int, columns: int) -> np.ndarray:
        """Space for a tile's scores, taken once: new pages would cost as much as the comparisons."""
        if kind not in self.space or self.space[kind].size < rows * columns:
            self.space[kind] = np.empty(rows * columns, kind)
        return self.space[kind][:rows * columns].reshape(rows, columns)

    def _least(self, S: np.ndarray, c_most: float, part: slice) -> np.ndarray:
        """The score under which a document of the tile cannot be among a question's k nearest."""
        k, kind, n = self.k, S.dtype.type, self.A.shape[1]
        q2, kth = self.q2[part], self.D[part, k - 1]
        with np.errstate(over="ignore", invalid="ignore"):
            # rounding of n products summed in any order, and of the factors: γ_n ≤ 1.1·n·u as n·u < 0.05
            eps = 1.1 * (n + 8) * float(np.finfo(kind).eps) / 2 * (c_most * np.sqrt(q2) + c_most ** 2 / 2) + 4 * n * float(np.finfo(kind).tiny)
            exact = 8 * (n + 8) * _U                                     # of the double forms, relative
            least = (q2 - kth) / 2 - eps - exact * (q2 + kth)
            groups = min(S.shape[1], 16 * k)
            if groups >= k and np.isinf(kth[self.live[part]]).any():
                best = S[:, :S.shape[1] // groups * groups].reshape(len(S), groups, -1).max(axis=2)
                seed = np.partition(best, groups - k, axis=1)[:, groups - k].astype(np.float64)
                least = np.maximum(least, seed - 2 * eps - exact * (q2 + c_most ** 2))
            least = np.nextafter(least.astype(kind), kind(-np.inf))
        return np.where(self.live[part], least, kind(np.inf))

    def _measure(self, q: np.ndarray, ids: np.ndarray, C: np.ndarray) -> None:
        """Σ(c−q)² of pairs, sorted by question, and the k smallest (dist, id) of each question kept."""
        diff = C.astype(np.float64)
        diff -= self.Q[q]
        with np.errstate(over="ignore"):
            dist = np.einsum("nd,nd->n", diff, diff)
        near = dist <= np.minimum(self.D[q, self.k - 1], np.finfo(np.float64).max)
        q, ids, dist = q[near], ids[near], dist[near]
        if len(q) == 0:
            return
        asked, number = np.unique(q, return_inverse=True)
        number = np.concatenate([np.repeat(np.arange(len(asked)), self.k), number])
        D, I = np.concatenate([self.D[asked].ravel(), dist]), np.concatenate([self.I[asked].ravel(), ids])
        order = np.lexsort((I, D, number))
        number = number[order]
        kept = order[np.arange(len(order)) - np.searchsorted(number, np.arange(len(asked)))[number] < self.k]
        self.D[asked], self.I[asked] = D[kept].reshape(-1, self.k), I[kept].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question ids, document ids, distances)."""
        found = np.isfinite(self.D).ravel()
        return (np.repeat(self.q_ids, self.k)[found].astype(np.int64), self.I.ravel()[found].astype(np.int64), self.D.ravel()[found])

    def rows(self, group: str = "") -> pd.DataFrame:
        import pandas as pd
        q, c, dist = self.found()
        return pd.DataFrame({"query_id": q, "doc_id": c, "dist": dist, "_g": np.full(len(q), str(group), dtype=object)})


def _floats(M: np.ndarray) -> np.ndarray:
    return M if M.dtype == np.float32 else M.astype(np.float64, copy=False)


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return _floats(np.stack(series.to_numpy()))


def _finish(cands: DataFrame, k: int, group_col: str | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("dist", "doc_id")
    out = (cands.withColumn("rank", F.row_number().over(w).cast("bigint"))
           .where(F.col("rank") <= k))
    cols = ["query_id", "rank", "doc_id", "dist"]
    if group_col:
        return out.select(*cols, F.col("_g").alias("group"))
    return out.select(*cols)


def broadcastable(n_rows: int, dim: int, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a question matrix of this size takes the broadcast plan."""
    return n_rows * max(dim, 1) * 8 <= broadcast_bytes


def knn(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str = "doc_id",
        corpus_vec: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding",
        group_col: str | None = None, broadcast_bytes: int = BROADCAST_BYTES,
        corpus_block_bytes: int = BLOCK_BYTES,
        query_stats: tuple[int, int] | None = None) -> DataFrame:
    """k nearest corpus rows for every query row: (query_id, rank, doc_id, dist[, group]).

    With ``group_col`` the output also carries the group (as text), since document ids
    only need to be unique inside a group. ``query_stats`` = (question rows, vector size)
    when the caller already knows them (saves one pass over the questions).
    """
    gsel = [F.col(group_col).cast("string").alias("_g")] if group_col else [F.lit("").alias("_g")]
    qdf = (queries.where(F.col(query_vec).isNotNull())
           .select(F.col(query_id).cast("long").alias("qid"), F.col(query_vec).alias("qv"), *gsel))
    cdf = (corpus.where(F.col(corpus_vec).isNotNull())
           .select(F.col(corpus_id).cast("long").alias("cid"), F.col(corpus_vec).alias("cv"), *gsel))
    if query_stats is None:
        stats = qdf.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qv")).alias("d")).first()
        query_stats = (stats["n"], stats["d"] or 0)
    n_q, dim = query_stats
    if n_q == 0:
        return _finish(corpus.sparkSession.createDataFrame([], _OUT), k, group_col)
    if broadcastable(n_q, dim, broadcast_bytes):
        return _finish(_broadcast_plan(cdf, qdf, k), k, group_col)
    rows = lambda size: max(1, size // (8 * max(dim, 1)))
    return _finish(_blocked_plan(cdf, qdf, k, rows(min(broadcast_bytes, QUESTION_BYTES)), rows(corpus_block_bytes)), k, group_col)


def _broadcast_plan(cdf: DataFrame, qdf: DataFrame, k: int) -> DataFrame:
    spark = cdf.sparkSession
    # each task gives k rows per question: no more tasks than run at a time
    cdf = spread_for_cpu(cdf).coalesce(spark.sparkContext.defaultParallelism)
    pq = qdf.toPandas()          # bounded: size checked by the caller
    groups = {}
    for g, sub in pq.groupby("_g"):
        groups[g] = (sub["qid"].to_numpy(np.int64), _matrix(sub["qv"]))
    bc = spark.sparkContext.broadcast(groups)

    def score(batches):
        qs = bc.value
        acc = {}
        for pdf in batches:
            for g, sub in pdf.groupby("_g"):
                if g not in qs:
                    continue
                if g not in acc:
                    acc[g] = TopK(qs[g][0], qs[g][1], k)
                acc[g].add(sub["cid"].to_numpy(np.int64), _matrix(sub["cv"]))
        for g, t in acc.items():
            yield t.rows(g)

    return cdf.mapInPandas(score, _OUT)


#: A row of the file is one block and a row group: files are split between any two blocks.
_BLOCK_FILE = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false", "compression": "zstd"}


def _thin(M: np.ndarray) -> tuple:
    """A matrix as it travels: its values that are not 0 with their places, if that is shorter."""
    at = np.flatnonzero(M)
    if len(at) * (4 + M.itemsize) >= M.nbytes or M.size >= 1 << 32:
        return M.shape, None, M
    return M.shape, at.astype(np.uint32), M.ravel()[at]


def _full(shape: tuple, at: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    if at is None:
        return values
    M = np.zeros(shape, values.dtype)
    M.ravel()[at] = values
    return M


def _by_group(batch: pa.RecordBatch) -> list[tuple[str, np.ndarray, tuple]]:
    """(group, ids, matrix as it travels) of an Arrow batch (id, vector, group)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    out = []
    for g in pc.unique(batch.column(2)).drop_null().to_pylist():
        part = batch.filter(pc.equal(batch.column(2), g))
        ids, vectors = pc.fill_null(part.column(0), np.iinfo(np.int64).min).to_numpy(), part.column(1)
        sizes = pc.unique(pc.list_value_length(vectors)).to_pylist()
        if len(sizes) != 1:
            raise ValueError(f"all vectors of a group need the same size, not {sorted(sizes)}")
        values = vectors.flatten()
        if not pa.types.is_floating(values.type):
            values = values.cast(pa.float64())
        out.append((g, ids, _thin(_floats(values.to_numpy(zero_copy_only=False)).reshape(len(ids), sizes[0]))))
    return out


def _blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
    """(id, vector, group) rows packed into blocks of at most so many rows, written to the shared folder:
    (key, block), a block being the pickled list of pieces (group, ids, matrix) of at most ``TILE_ROWS`` rows."""
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, n, size, held = TaskContext.get().partitionId(), 0, 0, []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{n}"]), pa.array([pickle.dumps(held, protocol=5)], pa.binary())], ["key", "block"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, min(rows - size, TILE_ROWS))
                at, size = at + piece.num_rows, size + piece.num_rows
                held += _by_group(piece)
                if size == rows:
                    yield block()
                    n, size, held = n + 1, 0, []
        if size:
            yield block()
        pa.default_memory_pool().release_unused()          # the worker stays for later tasks

    path = scratch_path(df.sparkSession, name)
    spread_for_cpu(df).mapInArrow(pack, "key string, block binary").write.options(**_BLOCK_FILE).parquet(path)
    return df.sparkSession.read.schema("key string, block binary").parquet(path)


def _blocked_plan(cdf: DataFrame, qdf: DataFrame, k: int, q_rows: int, c_rows: int) -> DataFrame:
    """Every block of questions against every block of documents."""
    spark = cdf.sparkSession
    questions = _blocks(qdf, q_rows, "knn-questions").rdd
    # a part of the questions meets a part of the documents in a task, which gives k rows per question
    parts = 2 * math.ceil(math.sqrt(spark.sparkContext.defaultParallelism))
    documents = _blocks(cdf, c_rows, "knn-documents").coalesce(parts).rdd

    def asked(block):
        pieces = {}
        for g, ids, M in pickle.loads(block):
            pieces.setdefault(g, []).append((ids, _full(*M)))
        return {g: TopK(np.concatenate([ids for ids, _ in own]), np.concatenate([Q for _, Q in own]), k) for g, own in pieces.items()}

    def score(pairs):
        key, best = None, {}
        for q, c in pairs:
            if q["key"] != key:                  # the documents of the part come once for each block of questions
                yield from found(best)
                key, best = q["key"], asked(q["block"])
            for g, ids, M in pickle.loads(c["block"]):
                if g in best:
                    best[g].add(ids, _full(*M))
        yield from found(best)

    def found(best):
        for g, t in best.items():
            yield from zip(*(x.tolist() for x in t.found()), itertools.repeat(str(g)))

    return spark.createDataFrame(questions.cartesian(documents).mapPartitions(score), _OUT, verifySchema=False)


def centroid(df: DataFrame, vec_col: str = "embedding", out: str = "embedding") -> DataFrame:
    """The mean vector of a vector column, as a one-row DataFrame.

    Vectors are exploded to (dimension, value) and averaged per dimension: a partial
    aggregate per task with one row per dimension, so no vector set is gathered anywhere.
    """
    per_dim = (df.select(F.posexplode(vec_col).alias("i", "v"))
               .groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m")))
    return per_dim.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))),
                                   lambda x: x["m"]).alias(out))


# ---- text → vector -------------------------------------------------------------------------

# ---------------------------------------------------------------------------------------
# Fixed values of the built-in text embedding (the reference calls a remote model instead).
EMBED_FEATURES = 512
TOKEN_PATTERN = r"[^\p{L}\p{N}_]+"
# ---------------------------------------------------------------------------------------


class TextEmbedder:
    """Hashed TF-IDF with L2 normalisation.

    A word's place is the last 8 hex digits of its md5 modulo ``features``, which any SQL engine
    can repeat; counting, IDF (ln((N + 1) / (df + 1))) and normalisation are Spark ML's.
    """

    def __init__(self, features: int = EMBED_FEATURES):
        self.features = features
        self.idf = None

    def _terms(self, df: DataFrame, text_col: str) -> DataFrame:
        from pyspark.ml.feature import CountVectorizerModel
        words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TOKEN_PATTERN), lambda w: w != "")
        hashes, place = F.transform(words, lambda w: F.md5(w)), self._place()
        counter = CountVectorizerModel.from_vocabulary(self._names(), "_place", "_tf", minTF=1.0)
        return counter.transform(spread_for_cpu(df).withColumn("_place", F.transform(hashes, place))).drop("_place")

    def _digits(self) -> tuple[int, int] | None:
        """(hex digits of a place, values of the first) if the number of places is a power of two."""
        bits = self.features.bit_length() - 1
        return (-(-bits // 4), 1 << (bits - 1) % 4 + 1) if self.features == 1 << bits > 1 else None

    def _names(self) -> list[str]:
        """What a place is called in the arrays of places."""
        digits = self._digits()
        return [f"{i:0{digits[0]}x}" if digits else str(i) for i in range(self.features)]

    def _place(self):
        """md5 text → the name of its place. Of a power of two the remainder is read off the last digits."""
        digits = self._digits()
        if digits is None:
            return lambda h: F.pmod(F.conv(F.substring(h, 25, 8), 16, 10).cast("long"), F.lit(self.features)).cast("string")
        n, first = digits
        lowered = "".join(f"{i % first:x}" for i in range(16))
        return lambda h: F.concat(F.translate(F.substring(h, 33 - n, 1), "0123456789abcdef", lowered), F.substring(h, 34 - n, n - 1))

    def fit(self, corpus: DataFrame, text_col: str) -> "TextEmbedder":
        """One distributed pass for the document frequencies."""
        return self._fit_terms(self._terms(corpus.select(text_col), text_col))

    def _fit_terms(self, terms: DataFrame) -> "TextEmbedder":
        from pyspark.ml.feature import IDF
        self.idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(terms.select("_tf"))
        return self

    def _finish(self, terms: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.feature import Normalizer
        from pyspark.ml.functions import vector_to_array
        normal = Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0)
        return normal.transform(self.idf.transform(terms)) \
            .withColumn(out, vector_to_array("_vec", "float32")).drop("_tf", "_tfidf", "_vec")

    def transform(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        return self._finish(self._terms(df, text_col), out)


def fit_text_embedder(corpus: DataFrame, text_col: str, num_features: int = EMBED_FEATURES) -> TextEmbedder:
    return TextEmbedder(num_features).fit(corpus, text_col)


def embed_text(model: TextEmbedder, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    """Apply a fitted embedder; the vector becomes ARRAY<FLOAT>."""
    return model.transform(df, text_col, out)


def fit_and_embed(corpus: DataFrame, text_col: str, out: str = "embedding",
                  num_features: int = EMBED_FEATURES):
    """Fit the embedder on ``corpus`` and embed it with a single tokenisation pass.

    The term vectors are persisted (memory and disk) for the IDF fit and the transform;
    call the returned ``release()`` once the embedded corpus has been written.
    Returns (model, embedded corpus, release).
    """
    from pyspark import StorageLevel
    model = TextEmbedder(num_features)
    terms = model._terms(corpus, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    model._fit_terms(terms)
    return model, model._finish(terms, out), terms.unpersist
