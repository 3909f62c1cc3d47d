"""Ingest job: CSV → typed table → row sentences and chunks → vectors → store.

One batch job. Boundaries: the profile action for typing, the row-index actions (count and
boundaries), one shuffle to gather chunks, the IDF fit, and the partitioned write, which
also cuts the lineage: later questions read the store, not the CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import CHUNK_ROWS, DOC_TYPE_SUMMARY, RowFields, corpus_docs
from ..operators.search import embed_text, fit_and_embed
from ..sources.csv import ORDER_KEY, load_csv
from ..session import scratch_path
from ..sources.store import default_store_base, read_store, write_store

# What a document's metadata hold besides its type.
SUMMARY_META = ["total_rows", "columns"]
CHUNK_META = ["chunk_id", "start_row", "end_row", "num_rows"]


def index_table(df: DataFrame, store_name: str, order_by: list[str], fields: RowFields | None = None,
                n: int = CHUNK_ROWS, date_col: str | None = "Date",
                stat_columns: list[str] | None = None, hidden: list[str] | None = None,
                embedder=None):
    """Corpus documents of a table with vectors, ready for ``write_store``.

    Returns (documents, embedder, release): call ``release()`` after the documents are
    written (it frees the term vectors kept for the embedder fit).
    """
    docs = corpus_docs(df, order_by, fields, n, date_col=date_col, stat_columns=stat_columns,
                       hidden=hidden)
    metadata = F.when(F.col("doc_type") == DOC_TYPE_SUMMARY, F.to_variant_object(F.struct(F.col("doc_type").alias("type"), *SUMMARY_META))) \
        .otherwise(F.to_variant_object(F.struct(F.col("doc_type").alias("type"), *CHUNK_META)))
    prepared = docs.select("doc_id", "page_content", metadata.alias("metadata"),
                           F.lit(store_name).alias("store_name"))
    if embedder is not None:
        return embed_text(embedder, prepared, "page_content"), embedder, (lambda: None)
    model, embedded, release = fit_and_embed(prepared, "page_content")
    return embedded, model, release


def ingest_csv(spark: SparkSession, path: str | list[str], store_name: str, base: str | None = None,
               fields: RowFields | None = None, n: int = CHUNK_ROWS, date_col: str | None = "Date",
               stat_columns: list[str] | None = None) -> DataFrame:
    """Load, chunk, embed and store a CSV; returns the stored documents (read back).

    The typed table is written once as Parquet under the shared checkpoint folder: the row
    index, the summary aggregates and the chunking then read pruned columns instead of
    re-parsing the CSV text on every pass, and a lost executor recomputes from that copy.
    """
    base = base or default_store_base(spark)
    typed_path = scratch_path(spark, "typed")
    load_csv(spark, path).write.parquet(typed_path)
    table = spark.read.parquet(typed_path)
    docs, _, release = index_table(table, store_name, ORDER_KEY, fields, n, date_col=date_col,
                                   stat_columns=stat_columns, hidden=ORDER_KEY)
    write_store(docs, base)
    release()
    return read_store(spark, base, store_name)
