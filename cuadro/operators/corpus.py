"""Rows → sentences → fixed-size chunks → the document corpus of a table.

The chunk of a row is ``floor(row_idx / n)``, where ``row_idx`` is the dense position from
``with_row_index``; a group holds at most n rows, so ``collect_list`` inside it is bounded.
The corpus is one summary document followed by the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named, quoted
from ..functions.text import fill, money_text, number_text, rstrip_chars
from .profile import TIMESTAMP_TEXT, dataset_summary
from .rowindex import with_row_index

# ---------------------------------------------------------------------------------------
# Chunk size, header and the sentence labels of a row, in sentence order.
CHUNK_ROWS = 50
CHUNK_HEADER = "CHUNK DE DATOS (filas {start} a {end}):"
ROW_PREFIX = "Orden {id}: "
ROW_LABELS = {
    "date": "Fecha",
    "product": "Producto",
    "price": "Precio",
    "quantity": "Cantidad",
    "total": "Total",
    "purchase_type": "Tipo",
    "payment": "Pago",
    "manager": "Manager",
    "city": "Ciudad",
}
DOC_TYPE_SUMMARY = "dataset_summary"
DOC_TYPE_CHUNK = "data_chunk"
# ---------------------------------------------------------------------------------------


@dataclass
class RowFields:
    """Which table column feeds each part of a row sentence (None: part absent).

    The defaults are the column names of the sales files the sentences were made for.
    ``total`` is used only when price and quantity are not both present (then the total is
    their product).
    """
    id: str | None = "Order ID"
    date: str | None = "Date"
    product: str | None = "Product"
    price: str | None = "Price"
    quantity: str | None = "Quantity"
    total: str | None = None
    purchase_type: str | None = "Purchase Type"
    payment: str | None = "Payment Method"
    manager: str | None = "Manager"
    city: str | None = "City"

    def present(self, df: DataFrame) -> "RowFields":
        cols = set(df.columns)
        kept = {k: (v if v in cols else None) for k, v in self.__dict__.items()}
        return RowFields(**kept)


def _value_text(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(named(c), TIMESTAMP_TEXT)
    return named(c).cast("string")


def _part(label: str, value: Column, prefix: str = "") -> Column:
    # NULL value → NULL part, which concat_ws skips
    return F.concat(F.lit(f"{label}: {prefix}"), value, F.lit(", "))


def row_sentence(df: DataFrame, fields: RowFields, row_idx_col: str = "row_idx") -> Column:
    """'Orden <id>: Fecha: …, Producto: …, Precio: $…, Cantidad: …, Total: $…, Tipo: …, …'."""
    f = fields.present(df)
    ident = named(f.id).cast("string") if f.id else None
    if row_idx_col in df.columns:
        ident = F.coalesce(ident, F.col(row_idx_col).cast("string")) if ident is not None \
            else F.col(row_idx_col).cast("string")
    parts = [fill(ROW_PREFIX, id=ident)]
    if f.date:
        parts.append(_part(ROW_LABELS["date"], _value_text(df, f.date)))
    if f.product:
        parts.append(_part(ROW_LABELS["product"], _value_text(df, f.product)))
    if f.price and f.quantity:
        p, q = named(f.price), named(f.quantity)
        total = money_text(p.cast("double") * q.cast("double"))
        parts.append(F.concat(F.lit(f"{ROW_LABELS['price']}: $"), number_text(p, df.schema[f.price].dataType),
                              F.lit(f", {ROW_LABELS['quantity']}: "), number_text(q, df.schema[f.quantity].dataType),
                              F.lit(f", {ROW_LABELS['total']}: $"), total, F.lit(", ")))
    elif f.total:
        parts.append(_part(ROW_LABELS["total"], money_text(named(f.total)), "$"))
    for key in ("purchase_type", "payment", "manager", "city"):
        c = getattr(f, key)
        if c:
            parts.append(_part(ROW_LABELS[key], _value_text(df, c)))
    return rstrip_chars(F.concat_ws("", *parts), ", ")


def render_rows(df: DataFrame, fields: RowFields, row_idx_col: str = "row_idx",
                keep: list[str] | None = None) -> DataFrame:
    cols = list(keep or [])
    if row_idx_col in df.columns and row_idx_col not in cols:
        cols.append(row_idx_col)
    return df.select(*map(quoted, cols), row_sentence(df, fields, row_idx_col).alias("line"))


def chunk_lines(lines: DataFrame, n: int = CHUNK_ROWS, row_idx_col: str = "row_idx",
                line_col: str = "line") -> DataFrame:
    """Group consecutive positions into chunks of n rows; the last chunk may be shorter.

    Columns: chunk_id, start_row, end_row, num_rows, page_content.
    """
    chunk = F.floor(F.col(row_idx_col) / n).cast("bigint")
    g = lines.groupBy(chunk.alias("chunk_id")).agg(
        F.min(row_idx_col).alias("start_row"),
        F.max(row_idx_col).alias("end_row"),
        F.count(F.lit(1)).alias("num_rows"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(row_idx_col, line_col))),
                                 lambda x: x[line_col]), "\n").alias("_body"))
    header = fill(CHUNK_HEADER, start=F.col("start_row"), end=F.col("end_row"))
    return g.select("chunk_id", "start_row", "end_row", "num_rows",
                    F.concat(header, F.lit("\n"), F.col("_body")).alias("page_content"))


def chunk_table(df: DataFrame, order_by: list[str], fields: RowFields | None = None,
                n: int = CHUNK_ROWS) -> DataFrame:
    """Row index → row sentences → chunks, for a whole table."""
    fields = fields or RowFields()
    indexed = with_row_index(df, order_by)
    return chunk_lines(render_rows(indexed, fields), n)


def corpus_docs(df: DataFrame, order_by: list[str], fields: RowFields | None = None,
                n: int = CHUNK_ROWS, date_col: str | None = "Date",
                stat_columns: list[str] | None = None, hidden: list[str] | None = None) -> DataFrame:
    """Summary document (doc_id 0) followed by the data chunks (doc_id = chunk_id + 1).

    Columns: doc_id, doc_type, chunk_id, start_row, end_row, num_rows, total_rows, columns,
    page_content. ``hidden`` columns (e.g. a file-position key) order the rows but are not
    part of the summary.
    """
    chunks = chunk_table(df, order_by, fields, n)
    data = df.drop(*(hidden or []))
    cols = F.array(*[F.lit(c) for c in data.columns])
    summary = dataset_summary(data, date_col=date_col, stat_columns=stat_columns, with_rows=True)
    head = summary.select(
        F.lit(0).cast("bigint").alias("doc_id"), F.lit(DOC_TYPE_SUMMARY).alias("doc_type"),
        F.lit(None).cast("bigint").alias("chunk_id"), F.lit(None).cast("bigint").alias("start_row"),
        F.lit(None).cast("bigint").alias("end_row"), F.lit(None).cast("bigint").alias("num_rows"),
        F.col("total_rows").cast("bigint").alias("total_rows"), cols.alias("columns"),
        F.col("summary").alias("page_content"))
    body = chunks.select(
        (F.col("chunk_id") + 1).alias("doc_id"), F.lit(DOC_TYPE_CHUNK).alias("doc_type"),
        "chunk_id", "start_row", "end_row", "num_rows",
        F.lit(None).cast("bigint").alias("total_rows"),
        F.lit(None).cast("array<string>").alias("columns"), "page_content")
    return head.unionByName(body)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Documents per type (the ingest log line: n chunks + 1 summary)."""
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_docs"))
