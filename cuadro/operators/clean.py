"""Cleaning and typing of a table read as text.

``clean_table`` runs one profile action (a single aggregate with a few counters per column), a
second one over the columns that may hold dates, and then applies one projection:

1. strip outer white space of every text column (inner runs are kept);
2. optionally label missing text (``null_label='nan'`` reproduces a pandas ``astype(str)``);
3. date columns chosen by *name*, parsed day-first, all-or-nothing per column: the first
   format that parses every non-NULL value wins, otherwise the column stays text;
4. text columns whose every row is True or False become BOOLEAN;
5. text columns where at least one value is a plain number become numeric (BIGINT when all
   values are integers, else DOUBLE); values that do not parse become NULL.

Dates are typed by shape: the profile also groups by the layout of each date column's texts (every
digit as 9, every letter as a). Layouts that no format reads count as one, so there are few. Only
formats that fit every layout found are tried, on the values, in the second action.

Cost: one extra scan for the profile, and one of the date columns if they hold texts that look like
dates; pass ``schema`` to ``scan_csv`` and skip this step when the types are known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named
from ..functions.text import guarded_double, guarded_long, strip_outer

# ---------------------------------------------------------------------------------------
# Column names treated as dates (besides any name containing "date"), and
# the formats tried. ISO text is read as ISO (year first), never with day and month swapped.
DATE_COLUMN_NAMES = ["Date", "date", "fecha", "Date_Time"]
DAYFIRST_FORMATS = [
    "d-M-yyyy", "d/M/yyyy", "d.M.yyyy",
    "d-M-yyyy H:m:s", "d/M/yyyy H:m:s", "d-M-yyyy H:m", "d/M/yyyy H:m",
    "yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:m:s[.SSSSSS]", "yyyy-M-d'T'H:m:s[.SSSSSS]",
    "d-M-yy", "d/M/yy", "d.M.yy", "d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "d/M/yyyy h:m:s a", "d/M/yyyy h:m a", "d-M-yyyy h:m:s a", "d-M-yyyy h:m a",
    "yyyy-M-d'T'H:m:s[.SSSSSS]XXX", "yyyy-M-d H:m:s[.SSSSSS]XXX", "yyyy-M-d'T'H:m:s[.SSSSSS]XX", "yyyy-M-d H:m:s[.SSSSSS]XX",
]
# Month first, tried for a column only after no day-first format fits all of it.
MONTHFIRST_FORMATS = ["M-d-yyyy", "M/d/yyyy", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M-d-yy", "M/d/yy",
                      "M/d/yyyy h:m:s a", "M/d/yyyy h:m a"]
# Cascade for the plotting loader: day-month-year, then month-day-year, then the other
# layouts, each for the whole column; last a per-row mix preferring day first.
CASCADE_FORMATS = ["d-M-yyyy", "M-d-yyyy"]
INFERRED_FORMATS = ["yyyy-M-d", "yyyy-M-d H:m:s[.SSSSSS]", "yyyy-M-d'T'H:m:s[.SSSSSS]",
                    "yyyy/M/d", "M/d/yyyy", "d.M.yyyy"]
# ---------------------------------------------------------------------------------------


# What a part of a datetime pattern accepts: as text, and as the text's layout.
_PARTS = [("yyyy", r"\d{4}", "9{4}"), ("yy", r"\d{2}", "9{2}"), ("MMMM", "[A-Za-z]{3,9}", "a{3,9}"), ("MMM", "[A-Za-z]{3}", "a{3}"),
          ("[.SSSSSS]", r"(\.\d{1,6})?", r"(\.9{1,6})?"), ("XXX", r"(Z|[+-]\d\d:\d\d)", "(a|[+-]99:99)"),
          ("XX", r"(Z|[+-]\d{4})", "(a|[+-]9{4})"), ("a", "([AaPp][Mm])", "a{2}"), *((x, r"\d{1,2}", "9{1,2}") for x in "dMHhms")]
_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: No format reads a longer text.
LONGEST_DATE = 40


def _format_pattern(fmt: str, layout: bool) -> str:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "'":
            j = fmt.index("'", i + 1)
            text = fmt[i + 1:j]
            out.append("a" * len(text) if layout else re.escape(text))
            i = j + 1
            continue
        part = next((p for p in _PARTS if fmt.startswith(p[0], i)), None)
        out.append(re.escape(fmt[i]) if part is None else part[2 if layout else 1])
        i += 1 if part is None else len(part[0])
    return "".join(out)


def format_shape(fmt: str) -> str:
    """Anchored regex of the texts a datetime pattern accepts.

    Parsing is only attempted on text of the right shape: a failed parse costs as much as a
    successful one.
    """
    return "^" + _format_pattern(fmt, False) + "$"


def date_layout(c: Column, formats: list[str]) -> Column:
    """The layout of a text that some format may read, '' for all other texts, NULL for NULL."""
    layout = F.when(F.length(c) <= LONGEST_DATE, F.translate(c, _DIGITS + _LETTERS, "9" * 10 + "a" * 52))
    known = "^(" + "|".join(dict.fromkeys(_format_pattern(f, True) for f in formats)) + ")$"
    return F.when(c.isNull(), None).when(layout.rlike(known), layout).otherwise("")


def formats_that_fit(formats: list[str], layouts: set[str]) -> list[str]:
    """Formats that may read every layout, in their order."""
    return [f for f in formats if layouts and all(re.fullmatch(_format_pattern(f, True), x) for x in layouts)]


def formats_that_occur(formats: list[str], layouts: set[str]) -> list[str]:
    """Formats that may read some layout, in their order."""
    return [f for f in formats if any(re.fullmatch(_format_pattern(f, True), x) for x in layouts)]


def found_layouts(df: DataFrame, texts: dict[str, Column], formats: list[str]) -> dict[str, set[str]]:
    """The layouts in each text column, by name: one aggregate."""
    if not texts:
        return {}
    row = df.agg(*[F.collect_set(date_layout(c, formats)).alias(f"s{i}") for i, c in enumerate(texts.values())]).first()
    return {name: set(row[f"s{i}"]) for i, name in enumerate(texts)}


def whole_formats(df: DataFrame, texts: dict[str, Column], tried: dict[str, list[str]]) -> dict[str, str]:
    """The first of the tried formats that reads every value of a column, by column: one aggregate over
    the columns that have any to try."""
    tried = {c: fmts for c, fmts in tried.items() if fmts}
    if not tried:
        return {}
    aggs = [F.count(texts[c]).alias(f"n{i}") for i, c in enumerate(tried)]
    aggs += [F.count(parse_timestamp(texts[c], f)).alias(f"t{i}_{j}") for i, c in enumerate(tried) for j, f in enumerate(tried[c])]
    row = df.agg(*aggs).first()
    fits = {c: [f for j, f in enumerate(fmts) if row[f"t{i}_{j}"] == row[f"n{i}"] > 0] for i, (c, fmts) in enumerate(tried.items())}
    return {c: f[0] for c, f in fits.items() if f}


def parse_timestamp(c: Column, fmt: str) -> Column:
    """Text → TIMESTAMP_NTZ with one format; NULL when it does not parse.

    Names of months and of halves of the day are read in any case. Two-digit years from 69 on
    belong to the last century. A text with an offset becomes its time in UTC.
    """
    text = c
    if "MMM" in fmt:
        text = F.initcap(F.lower(c))
    elif fmt.endswith("a"):
        text = F.upper(c)
    ts = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    if "yy" in fmt and "yyyy" not in fmt:
        ts = F.when(F.year(ts) >= 2069, ts - F.expr("interval 100 years")).otherwise(ts)
    return F.when(c.rlike(format_shape(fmt)), ts)


def parse_timestamp_any(c: Column, formats: list[str]) -> Column:
    """Per-row: the first format that parses."""
    return F.coalesce(*[parse_timestamp(c, f) for f in formats])


def is_date_name(name: str) -> bool:
    return name in DATE_COLUMN_NAMES or "date" in name.lower()


@dataclass
class Profile:
    rows: int
    nonnull: dict = field(default_factory=dict)
    date_format: dict = field(default_factory=dict)   # column -> chosen format
    numeric: dict = field(default_factory=dict)       # column -> 'bigint' | 'double'
    boolean: set = field(default_factory=set)         # every row is True or False


# The spellings of truth values that a pandas CSV read accepts.
TRUE_TEXT, FALSE_TEXT = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


def profile_table(df: DataFrame, date_formats: list[str] = DAYFIRST_FORMATS + MONTHFIRST_FORMATS,
                  min_ratio: float | None = None, strip: bool = True) -> Profile:
    """The counters that drive ``clean_table``: one aggregate over the table, and one over its date columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    dated = {}
    for i, c in enumerate(texts):
        raw = named(c)
        aggs.append(F.count(raw).alias(f"n{i}"))                  # stripping never makes NULL
        aggs.append(F.count(guarded_double(raw)).alias(f"d{i}"))  # the guards strip themselves
        aggs.append(F.count(guarded_long(raw)).alias(f"l{i}"))
        aggs.append(F.count(F.when(raw.isin(TRUE_TEXT + FALSE_TEXT), 1)).alias(f"b{i}"))
        if is_date_name(c) and date_formats:
            dated[c] = strip_outer(raw) if strip else raw
            aggs.append(F.collect_set(date_layout(dated[c], date_formats)).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    tried = {c: formats_that_fit(date_formats, set(row[f"s{i}"])) for i, c in enumerate(texts) if c in dated}
    prof = Profile(rows=row["__rows"], date_format=whole_formats(df, dated, tried))
    for i, c in enumerate(texts):
        n = row[f"n{i}"]
        prof.nonnull[c] = n
        if c in prof.date_format:
            continue
        if n > 0 and row[f"b{i}"] == prof.rows:
            prof.boolean.add(c)
            continue
        d, lg = row[f"d{i}"], row[f"l{i}"]
        need = 1 if min_ratio is None else max(1, int(min_ratio * n + 0.999999))
        if n > 0 and d >= need:
            prof.numeric[c] = "bigint" if lg == n else "double"
    return prof


def clean_table(df: DataFrame, null_label: str | None = None, min_ratio: float | None = None,
                profile: Profile | None = None, strip: bool = True) -> DataFrame:
    """Strip, type dates and numbers (see module doc). Column order and names are kept."""
    prof = profile or profile_table(df, min_ratio=min_ratio, strip=strip)
    out = []
    for f in df.schema.fields:
        c = named(f.name)
        if not isinstance(f.dataType, T.StringType):
            out.append(c.alias(f.name))
            continue
        s = strip_outer(c) if strip else c
        if f.name in prof.date_format:
            out.append(parse_timestamp(s, prof.date_format[f.name]).alias(f.name))
        elif f.name in prof.boolean:
            out.append(c.isin(TRUE_TEXT).alias(f.name))
        elif f.name in prof.numeric:
            conv = guarded_long(s) if prof.numeric[f.name] == "bigint" else guarded_double(s)
            out.append(conv.alias(f.name))
        elif null_label is not None:
            out.append(F.coalesce(s, F.lit(null_label)).alias(f.name))
        else:
            out.append(s.alias(f.name))
    return df.select(*out)


def cascade_dates(df: DataFrame, column: str = "Date") -> DataFrame:
    """Date typing of the plotting loader: whole-column formats in order, then per-row mix.

    No stripping and no numeric coercion. Two profile actions when ``column`` is text: its layouts,
    then the formats that fit them. A value that no format reads raises, naming one such value.
    """
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    c = named(column)
    rest = [f for f in INFERRED_FORMATS + DAYFIRST_FORMATS + MONTHFIRST_FORMATS if f not in CASCADE_FORMATS]
    whole = CASCADE_FORMATS + list(dict.fromkeys(rest))
    layouts = found_layouts(df, {column: c}, whole)[column]
    if not layouts:
        return df.withColumn(column, F.lit(None).cast("timestamp_ntz"))
    fits = whole_formats(df, {column: c}, {column: formats_that_fit(whole, layouts)})
    if fits:
        return df.withColumn(column, parse_timestamp(c, fits[column]))
    occurring = formats_that_occur(DAYFIRST_FORMATS + MONTHFIRST_FORMATS, layouts)
    mixed = parse_timestamp_any(c, occurring) if occurring else F.lit(None).cast("timestamp_ntz")
    bad = df.agg(F.min(F.when(mixed.isNull(), c)).alias("bad")).first()["bad"]
    if bad is not None:
        raise ValueError(f"column {column}: {bad!r} is not a date in any known format")
    return df.withColumn(column, mixed)


def column_date_formats(df: DataFrame, candidates: list[str]) -> dict[str, str | None]:
    """Which candidates hold dates, in their order: temporal columns (format None), and text
    columns that one format reads in full (two aggregates for all text candidates)."""
    temporal = (T.TimestampType, T.TimestampNTZType, T.DateType)
    texts = {c: strip_outer(named(c)) for c in candidates if isinstance(df.schema[c].dataType, T.StringType)}
    fmts = list(dict.fromkeys(DAYFIRST_FORMATS + MONTHFIRST_FORMATS + INFERRED_FORMATS))
    layouts = found_layouts(df, texts, fmts)
    found = whole_formats(df, texts, {c: formats_that_fit(fmts, layouts[c]) for c in texts})
    return {c: found.get(c) for c in candidates if c in found or isinstance(df.schema[c].dataType, temporal)}


def parse_dates_like(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Make ``column`` temporal if it is text: one format for the whole column."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    fmt = fmt or column_date_formats(df, [column]).get(column)
    if fmt is None:
        raise ValueError(f"column {column} has no single date format")
    return df.withColumn(column, parse_timestamp(strip_outer(named(column)), fmt))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: non-NULL values and how many of them are plain numbers.

    A column with ``n_numeric = 0`` is one that numeric coercion leaves alone.
    """
    texts = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(texts):
        aggs += [F.count(named(c)).alias(f"n{i}"), F.count(guarded_double(named(c))).alias(f"d{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"), F.col(f"d{i}").alias("n_numeric"))
            for i, c in enumerate(texts)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def row_total(df: DataFrame, price: str = "Price", quantity: str = "Quantity",
              name: str = "total") -> DataFrame:
    """price × quantity as DOUBLE, rounded to the cent after the product; NULL if either is missing."""
    if price not in df.columns or quantity not in df.columns:
        return df
    return df.withColumn(name, F.round(named(price).cast("double") * named(quantity).cast("double"), 2))
