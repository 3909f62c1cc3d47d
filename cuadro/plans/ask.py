"""Batch question answering up to the filled prompt.

For a table of questions: blank questions are dropped, questions on an unknown store, and those
whose vector does not fit the documents', get an error record, the rest retrieve their k nearest documents of their own store, and each gets
the stuffed context, the filled prompt, the source snippets and the chart intent. The
answer itself comes from a language model outside this engine, so ``answer`` stays NULL
except for the fixed error answer.

One job per batch: the store check is an aggregate joined to the questions, retrieval is
``search.knn`` grouped by store, and everything per question is bounded by k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intent import chart_intent
from ..functions.text import fill, pack_text, snippet, strip_outer, unpack_texts
from .chart import chart_file_name, role_errors
from .chart_batch import ChartBatch
from ..session import BROADCAST_BYTES, checkpoint_dir, materialise, small
from ..operators.qa import ASK_K, CHART_NOTE, CONTEXT_SEPARATOR, ERROR_ANSWER, ERROR_QUESTION, ERROR_STORE, SEARCH_K, build_prompt, sources_column
from ..operators.search import embed_text, knn
from ..sources.store import StoreNotFound, available_stores, load_store

PRUNED_STORES = 1000      # up to so many asked stores are named in the scan's partition filter


def search_similar(spark: SparkSession, base: str, store: str, text: str, model, k: int = SEARCH_K) -> DataFrame:
    """The k documents of one store nearest to a text: (rank, doc_id, content, metadata, dist).

    Reads that store's partition only. An unknown store gives an empty result.
    """
    try:
        docs = load_store(spark, base, store)
    except StoreNotFound:
        return spark.createDataFrame([], "rank long, doc_id long, content string, metadata variant, dist double")
    question = embed_text(model, spark.createDataFrame([(0, text)], "query_id long, text string"), "text")
    hits = knn(docs, question, k)
    found = docs.select("doc_id", F.col("page_content").alias("content"), "metadata")
    # the hits are k rows
    return found.join(F.broadcast(hits), "doc_id").select("rank", "doc_id", "content", "metadata", "dist").orderBy("rank")


def ask_batch(questions: DataFrame, corpus: DataFrame, k: int = ASK_K,
              question_id: str = "question_id", question: str = "question",
              store_col: str = "store_name", vec_col: str = "embedding",
              metadata: Column | None = None, model_name: str | None = None,
              broadcast_bytes: int | None = None, stores: DataFrame | None = None,
              schema: T.StructType | None = None, charts: ChartBatch | None = None) -> DataFrame:
    """Answer records for every non-blank question.

    ``questions``: question_id, question, store_name, embedding (the question vector).
    ``corpus``: doc_id, page_content, store_name, embedding (+ columns used by ``metadata``).
    ``stores``: the complete stores (``list_stores``); without it they are counted from the corpus.
    ``schema``: of the table the charts would be drawn from; it decides ``chart_generated``.
    ``charts``: the charts of these questions (``chart_batch``). Output: question_id, question,
    store_name, answer, context, prompt, sources, n_sources, chart_type, chart_filename,
    chart_generated, error, model_used, timestamp (ISO text); with ``charts`` also chart_key, chart (its
    columns, labels, bars or slices, trend), chart_error, and chart_note, the line that is added to the
    model's answer.
    """
    checkpoint_dir(questions.sparkSession)      # make sure one is set (tests: a local folder)
    # classifying a long question takes a task far longer than reading it: spread over the slots
    spread = questions.repartition(questions.sparkSession.sparkContext.defaultParallelism)
    qs = spread.where(F.length(strip_outer(F.col(question))) > 0).withColumn("_kind", chart_intent(F.col(question))) \
        .withColumn("_dim", F.size(vec_col))
    # one row per store: small; broadcast, since questions of one store would meet in one task
    complete = available_stores(corpus) if stores is None else stores
    known_stores = complete.select(F.col("store_name").alias("_known"))
    # the flagged batch is read by several actions (size check, question matrix, final
    # join): write it once to the shared checkpoint folder instead of recomputing the store
    # check over the corpus each time; this also cuts its lineage
    flagged = qs.join(F.broadcast(known_stores), qs[store_col] == known_stores["_known"], "left").checkpoint(eager=True)
    # a question whose vector does not fit the documents' fails alone
    first = corpus.where(F.col(vec_col).isNotNull()).select(F.size(vec_col).alias("d")).first()
    fits = F.lit(True) if first is None else F.coalesce(F.col("_dim") == first["d"], F.lit(False))
    known = flagged.where(F.col("_known").isNotNull() & fits)
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    asked = [r[0] for r in known.select("_known").distinct().limit(PRUNED_STORES + 1).collect()]
    if len(asked) <= PRUNED_STORES:
        corpus = corpus.where(F.col("store_name").isin(asked))     # prunes the store's partitions
    docs = corpus.where(F.col(vec_col).isNotNull())
    kw = {} if broadcast_bytes is None else {"broadcast_bytes": broadcast_bytes}
    hits = knn(docs, known, k, corpus_id="doc_id", corpus_vec=vec_col, query_id=question_id,
               query_vec=vec_col, group_col=store_col, query_stats=(stats["n"], stats["d"] or 0), **kw)
    # read twice below: written once. They are k rows per question; when the questions were small
    # enough to broadcast, so are their hits, and the corpus is probed in place instead of being shuffled
    hits = materialise(hits, "hits")
    if stats["n"] * k * 64 <= (broadcast_bytes or BROADCAST_BYTES):
        hits = F.broadcast(hits)
    hit_ids = hits.select(F.col("doc_id").alias("_hit"), F.col("group").alias("_of")).distinct()
    if metadata is not None:
        meta = metadata
    elif "metadata" in corpus.columns:
        meta = F.col("metadata")                 # the stored document's own metadata
    else:
        meta = F.struct(F.col("doc_id"), F.col("store_name"))
    # texts are fetched from the corpus without its vector column, so the vectors are not
    # read (or recomputed) a second time; only documents with a vector can be hits anyway. Other
    # documents are left out before anything is shuffled (where the ids of the hits can be broadcast; if
    # not, that filter would be a shuffle of its own), and texts travel compressed, each to many questions
    texts = corpus.select("doc_id", F.col("store_name").cast("string").alias("group"), "page_content", meta.alias("_meta"))
    if small(hit_ids, limit=broadcast_bytes or BROADCAST_BYTES):
        texts = texts.join(F.broadcast(hit_ids), (F.col("doc_id") == F.col("_hit")) & (F.col("group") == F.col("_of")), "left_semi")
    packed = texts.select("doc_id", "group", pack_text("page_content").alias("_packed"), snippet("page_content").alias("_short"), "_meta")
    hit_docs = packed.join(hits, ["doc_id", "group"])
    # texts, sources and their count in a single aggregate over <= k rows per question
    per_q = hit_docs.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "_packed"))), lambda x: x["_packed"]).alias("_texts"),
        sources_column("rank", "_short", F.col("_meta")).alias("sources"),
        F.count(F.lit(1)).alias("n_sources"))
    out = flagged.drop(vec_col).join(per_q, flagged[question_id] == per_q["query_id"], "left") \
        .withColumn("context", unpack_texts("_texts", CONTEXT_SEPARATOR))
    is_known = F.col("_known").isNotNull() & fits
    lost = F.col("_known").isNull()
    kind = F.col("_kind")
    drawable = is_known & kind.isNotNull()
    drawn = []
    if charts is not None:
        out = charts.answers(out, question, kind)
        drawable = is_known & F.col("chart").isNotNull()
        note = F.concat(F.lit(CHART_NOTE), chart_file_name(F.col(question), kind))
        drawn = [F.when(is_known, F.col("chart_key")).alias("chart_key"), F.when(is_known, F.col("chart")).alias("chart"),
                 F.when(is_known, F.col("chart_error")).alias("chart_error"), F.when(drawable, note).alias("chart_note")]
    elif schema is not None:
        drawable = drawable & ~F.coalesce(kind.isin(list(role_errors(schema))), F.lit(False))
    return out.select(
        F.col(question_id), F.col(question), F.col(store_col).alias("store_name"),
        F.when(lost, F.lit(ERROR_ANSWER)).when(~is_known, F.lit(ERROR_QUESTION)).alias("answer"),
        F.col("context"),
        F.when(is_known, build_prompt(F.col("context"), F.col(question))).alias("prompt"),
        F.coalesce(F.col("sources"), F.array().cast(per_q.schema["sources"].dataType)).alias("sources"),
        F.coalesce(F.col("n_sources"), F.lit(0)).alias("n_sources"),
        kind.alias("chart_type"),
        chart_file_name(F.col(question), kind).alias("chart_filename"),
        drawable.alias("chart_generated"),
        F.when(lost, fill(ERROR_STORE, store=F.col(store_col)))
        .when(~is_known, F.concat(F.lit("the question's vector does not fit the documents': "), F.coalesce(F.col("_dim").cast("string"), F.lit("none"))))
        .alias("error"),
        F.lit(model_name).cast("string").alias("model_used"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), *drawn)
