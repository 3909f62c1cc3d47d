"""Data profile: counts, period, numeric statistics, top values, summary text, preview.

Each statistic family is one aggregate over the table (all columns at once) followed by an
``unpivot``/``stack`` of a single wide row, never a loop of per-column jobs. Top values are counted by
hash; the ranks that can still win are kept by a partial WindowGroupLimit before the shuffle, so a
high-cardinality column sends a few rows per task to the window, and only winners' texts are fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import numeric_columns, string_columns
from ..functions.text import fill, money_text
from ..functions.names import named, quoted
from ..session import materialise
from .charts import no_nan
from .exact import grouped_sums, is_floating

# ---------------------------------------------------------------------------------------
# Summary text lines, statistics columns and sizes of the reference.
SUMMARY_TITLE = "RESUMEN DEL DATASET DE VENTAS:"
SUMMARY_TOTAL = "Total de registros: {n}"
SUMMARY_PERIOD = "Período: {start} a {end}"
SUMMARY_COLUMNS = "Columnas disponibles: {cols}"
SUMMARY_NUMERIC_HEADER = "\nESTADÍSTICAS NUMÉRICAS:"
SUMMARY_NUMERIC_LINE = "{col}: Min={min}, Max={max}, Promedio={mean}, Total={total}"
SUMMARY_CATEGORY_HEADER = "\nCATEGORÍAS PRINCIPALES:"
SUMMARY_CATEGORY_ITEM = "{value} ({n})"
DEFAULT_STAT_COLUMNS = ["Price", "Quantity"]
DEFAULT_DATE_COLUMN = "Date"
TOP_VALUES = 5
PREVIEW_ROWS = 10
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"
# ---------------------------------------------------------------------------------------

#: Bytes of a text that travel with its count; a text within them need not be fetched.
HEAD_BYTES = 32


def _text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, TIMESTAMP_TEXT)
    return c.cast("string")


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, number of columns, and every column's name and type (from the schema)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_cols"),
        F.lit(", ".join(df.columns)).alias("columns"),
        F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)).alias("types"))


def preview(df: DataFrame, order_by: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """First n rows in the declared order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*map(quoted, order_by)).limit(n)


def period(df: DataFrame, date_col: str) -> DataFrame:
    return df.agg(F.min(named(date_col)).alias("period_start"), F.max(named(date_col)).alias("period_end"))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, min, max, mean, total of numeric columns, a row each: one scan, one aggregate by column. NaN is missing.

    Whole numbers and DECIMAL are summed as decimals, DOUBLE order-free (``operators.exact``).
    """
    scale = max((df.schema[c].dataType.scale for c in columns if isinstance(df.schema[c].dataType, T.DecimalType)), default=0)
    wide = f"decimal({20 + scale},{scale})" if scale <= 8 else f"decimal(38,{scale})"
    entries = []
    for c in columns:
        real = is_floating(df.schema[c].dataType)
        value = no_nan(c)
        entries.append(F.struct(F.lit(c).alias("column"), value.cast("double").alias("low"),
                                (value.cast("double") if real else F.lit(None).cast("double")).alias("real"),
                                (F.lit(None).cast(wide) if real else value.cast(wide)).alias("whole")))
    rows = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    sums = grouped_sums(rows, ["column"], {"r": "real", "w": "whole"}, None, {"min": "low"}, {"max": "low"}, counts=True)
    n = F.col("r_n") + F.col("w_n")
    total = F.coalesce(F.col("r"), F.col("w").cast("double"))
    return sums.select("column", "min", "max", F.try_divide(total, n).alias("mean"), F.coalesce(total, F.lit(0.0)).alias("total"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: min, max, mean and total of the unrounded values."""
    cols = columns or numeric_columns(df.schema)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, min double, max double, mean double, total double")
    # a table without rows has a row a column too
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    found = every.join(F.broadcast(column_statistics(df, cols)), "column", "left")
    return found.select("column", "min", "max", "mean", F.coalesce("total", F.lit(0.0)).alias("total"))


def _hashed(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, value and the value's two 64-bit hashes, for every non-NULL text."""
    longf = df.select(*[named(c).cast("string").alias(c) for c in cols]).unpivot(
        ids=[], values=[named(c) for c in cols], variableColumnName="column", valueColumnName="value")
    return longf.where(F.col("value").isNotNull()).select("column", "value", F.xxhash64("value").alias("h1"),
                                                          F.xxhash64(F.lit(1), "value").alias("h2"))


def top_candidates(df: DataFrame, columns: list[str], n: int = TOP_VALUES) -> DataFrame:
    """column, h1, h2, head, whole, n: the values that can be among the n most frequent.

    Texts are counted under 128 bits of hashes and the first ``HEAD_BYTES`` bytes, so what is shuffled does
    not grow with the length of texts. Rank by count and head, ties included, is decided by a partial
    group limit in every task.
    """
    heads = _hashed(df, columns).select("column", "h1", "h2", F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES).alias("head"),
                                        (F.octet_length("value") <= HEAD_BYTES).alias("whole"))
    freq = heads.groupBy("column", "h1", "h2", "head", "whole").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("column").orderBy(F.desc("n"), "head")
    return freq.withColumn("_r", F.rank().over(near)).where(F.col("_r") <= n).drop("_r")


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = TOP_VALUES) -> DataFrame:
    """The n most frequent non-NULL values of every text column: (column, value, n, rank). Ties rank
    by the value itself.

    The candidates are found first, without their texts, and written. Values that fit into a head are
    complete then; only if there are longer ones, their texts are fetched by a second scan, joined to the
    few candidates by hash and reduced to one text a candidate in every task.
    """
    cols = columns or string_columns(df.schema)
    found = materialise(top_candidates(df, cols, n), "top-values")
    values = found.where("whole").select("column", F.col("head").cast("string").alias("value"), "n")
    cut = found.where("not whole").select("column", "h1", "h2", "n")
    if not cut.isEmpty():
        texts = _hashed(df, cols).join(cut, ["column", "h1", "h2"]).groupBy("column", "h1", "h2", "n").agg(F.min("value").alias("value"))
        values = values.unionByName(texts.select("column", "value", "n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return values.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def dataset_summary(df: DataFrame, date_col: str | None = DEFAULT_DATE_COLUMN,
                    stat_columns: list[str] | None = None, n_top: int = TOP_VALUES,
                    with_rows: bool = False) -> DataFrame:
    """The summary document as one text row (column ``summary``; with ``with_rows`` also
    ``total_rows``, counted by the same aggregate).

    Lines: title, total rows, period (when ``date_col`` exists), column list, numeric
    statistics for ``stat_columns`` (default: Price and Quantity when present), and the top
    values of every text column. Numbers are rendered with two decimals.
    """
    schema = df.schema
    nums = numeric_columns(schema)
    texts = string_columns(schema)
    stats = [c for c in (stat_columns if stat_columns is not None else DEFAULT_STAT_COLUMNS)
             if c in nums]
    has_date = date_col is not None and date_col in df.columns

    aggs = [F.count(F.lit(1)).alias("__rows")]
    if has_date:
        dt = schema[date_col].dataType
        aggs += [_text(F.min(named(date_col)), dt).alias("__p0"), _text(F.max(named(date_col)), dt).alias("__p1")]
    wide = df.agg(*aggs)

    lines: list[Column] = [F.lit(SUMMARY_TITLE), fill(SUMMARY_TOTAL, n=F.col("__rows"))]
    if has_date:
        lines.append(fill(SUMMARY_PERIOD, start=F.col("__p0"), end=F.col("__p1")))
    lines.append(F.lit(SUMMARY_COLUMNS.format(cols=", ".join(df.columns))))
    if nums:
        lines.append(F.lit(SUMMARY_NUMERIC_HEADER))
        if stats:
            # one small map (a row a column), inlined as a scalar subquery
            rows = numeric_summary(df, stats)
            known = rows.select(F.map_from_entries(F.collect_list(F.struct("column", F.struct("min", "max", "mean", "total"))))).scalar()
            for c in stats:
                of = F.element_at(known, F.lit(c))
                texts_of = {k: money_text(of.getField(k)) for k in ("min", "max", "mean", "total")}
                lines.append(fill(SUMMARY_NUMERIC_LINE, col=F.lit(c), **texts_of))
    if texts:
        lines.append(F.lit(SUMMARY_CATEGORY_HEADER))
        tv = top_values(df, texts, n_top)
        per_col = tv.groupBy("column").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct(
                "rank", fill(SUMMARY_CATEGORY_ITEM, value=F.col("value"), n=F.col("n")).alias("t")))),
            lambda x: x["t"]), ", ").alias("items"))
        # one small map (at most n_top items per text column), inlined as a scalar subquery
        items = per_col.select(F.map_from_entries(F.collect_list(F.struct("column", "items")))).scalar()
        for c in texts:
            # a column without any value still gets its (empty) line
            lines.append(F.concat(F.lit(f"{c}: "), F.coalesce(F.element_at(items, F.lit(c)), F.lit(""))))
    # only present parts are listed, so no empty line needs filtering
    out = [F.concat_ws("\n", *lines).alias("summary")]
    if with_rows:
        out.append(F.col("__rows").alias("total_rows"))
    return wide.select(*out)
