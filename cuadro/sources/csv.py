"""CSV scan: header row, comma, RFC-4180 quotes, every column read as text.

Types are decided afterwards by ``operators.clean`` from one profile action over the data
(or skipped entirely when a schema is passed). Each row also gets its file position as a
sortable key of three columns, ``FILE_ORDER``: the file's path, the byte offset of its split
and the row's increasing id inside its task. Ordering by it gives file order. A row with more fields than the header stops the load; a shorter one is filled
with NULLs. Files with line breaks inside quotes are found beforehand and read whole.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named
from ..operators.clean import cascade_dates, clean_table, profile_table
from ..operators.rowindex import FILE_ORDER

# ---------------------------------------------------------------------------------------
# The text tokens a pandas CSV read treats as missing (its defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DEFAULT_RAW_DIR = "data/raw"
DEFAULT_CSV_NAME = "Sales-Data-Analysis.csv"
STORE_CSV_PATTERN = "{base}/{name}-Data-Analysis.csv"
# ---------------------------------------------------------------------------------------

ORDER_KEY = FILE_ORDER
_RAW = "_raw_record"


def _literal_path(uri: str) -> str:
    """A file's URI as a reader's path: decoded, and with no character that a reader takes as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))


def files_by_quotes(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """(files in which some line holds an odd number of quotes, all other files with any line).

    A record goes on behind a line break only if its first line leaves a quote open, so the second kind can
    be split at any line. One aggregate by file; what reaches the driver is the list of files, which
    Spark's own listing holds there already.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(quotes % 2).alias("odd")).collect()
    names = sorted((r["file"], r["odd"] == 1) for r in found)
    return [_literal_path(f) for f, odd in names if odd], [_literal_path(f) for f, odd in names if not odd]


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
             na_tokens: list[str] | None = NA_TOKENS, multi_line: bool | None = None,
             mode: str = "PERMISSIVE", with_order: bool = True) -> DataFrame:
    """Read CSV files as text columns (or with ``schema``), missing-value tokens → NULL.

    ``multi_line``: whether quoted line breaks may occur. By default one pass over the quotes finds the
    files that need it; those are read whole, one task a file, all others in splits. True or
    False saves that pass. In the default mode a record with too many fields raises when it is read; the
    other modes of Spark's reader (``FAILFAST``, ``DROPMALFORMED``) are passed on.
    """
    if multi_line is None:
        whole, split = files_by_quotes(spark, path)
        if whole and split:
            first = min(whole[0], split[0])
            schema = schema or _header(spark, first, first in whole)
            parts = [scan_csv(spark, files, schema, na_tokens, multi, mode, with_order) for files, multi in ((whole, True), (split, False))]
            return parts[0].unionByName(parts[1])
        multi_line = bool(whole)
    reader = (spark.read.option("header", True).option("escape", '"')
              .option("multiLine", multi_line).option("mode", mode))
    if schema is None:
        schema = _header(spark, path, multi_line)
    checked = mode.upper() == "PERMISSIVE"
    if checked:
        reader = reader.option("columnNameOfCorruptRecord", _RAW)
        wide = T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])
        raw = reader.schema(wide).csv(path)
        # a record that Spark calls malformed is too long if it has a comma too many outside quotes
        bare = F.regexp_replace(F.col(_RAW), r'"([^"]|"")*"', "")
        extra = F.col(_RAW).isNotNull() & (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(schema))
        # the message holds every field, so that all are read: of a pruned record Spark sees no length
        error = F.concat(F.lit("more fields than the header: "), F.substring(_RAW, 1, 200), F.lit("; read as "),
                         F.substring(F.concat_ws("|", *[named(f.name).cast("string") for f in schema.fields]), 1, 200))
        raw = raw.where(F.when(extra, F.raise_error(error).cast("boolean")).otherwise(F.lit(True)))
    else:
        raw = reader.schema(schema).csv(path)
    cols = []
    for f in schema.fields:
        c = named(f.name)
        if na_tokens and isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(na_tokens), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(f.name))
    if with_order:
        cols += [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                 F.monotonically_increasing_id().alias("_pos")]
    return raw.select(*cols)


def _header(spark: SparkSession, path: str | list[str], multi_line: bool) -> T.StructType:
    """The header's names, every column as text."""
    reader = spark.read.option("header", True).option("escape", '"').option("inferSchema", False)
    if not multi_line:
        return reader.csv(path).schema
    # a header may go over several lines: those of a file's beginning until no quote is open
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select("value")
    n = 1
    while (head := [r["value"] for r in lines.take(n)]) and "".join(head).count('"') % 2 and len(head) == n:
        n += 1
    return reader.csv(spark.sparkContext.parallelize(["\n".join(head)], 1)).schema


def load_csv(spark: SparkSession, path: str | list[str], null_label: str | None = None,
             min_ratio: float | None = None, with_order: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Scan + full cleaning (strip, day-first dates by name, numeric coercion).

    ``with_order`` keeps the file-position key (``ORDER_KEY``) for row positions and chunks;
    without it those columns are not read.
    """
    raw = scan_csv(spark, path, with_order=with_order, multi_line=multi_line)
    data = raw.drop(*ORDER_KEY) if with_order else raw
    prof = profile_table(data, min_ratio=min_ratio)
    return clean_table(raw, null_label=null_label, profile=prof)


def load_csv_for_charts(spark: SparkSession, path: str | list[str], date_column: str = "Date",
                        with_order: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Scan for the chart path: text kept as is (no strip), a column becomes numeric only when
    every value is a number, and ``date_column`` is typed by the format cascade."""
    raw = scan_csv(spark, path, with_order=with_order, multi_line=multi_line)
    prof = profile_table(raw.drop(*ORDER_KEY) if with_order else raw, date_formats=[], min_ratio=1.0,
                         strip=False)
    typed = clean_table(raw, profile=prof, strip=False)
    return cascade_dates(typed, date_column)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def resolve_source(spark: SparkSession, df: DataFrame | None = None, path: str | None = None,
                   store_name: str | None = None, raw_dir: str = DEFAULT_RAW_DIR) -> DataFrame | None:
    """Table for a chart: the given table, else the given CSV, else the CSV named after the
    store (``<store without "_data">-Data-Analysis.csv``), else the default file, else None."""
    if df is not None:
        return df
    if path is not None:
        return load_csv_for_charts(spark, path)
    candidates = []
    if store_name:
        candidates.append(STORE_CSV_PATTERN.format(base=raw_dir, name=store_name.replace("_data", "")))
    candidates.append(f"{raw_dir}/{DEFAULT_CSV_NAME}")
    for c in candidates:
        if _exists(spark, c):
            return load_csv_for_charts(spark, c)
    return None
