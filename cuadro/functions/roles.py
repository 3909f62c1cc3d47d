"""Column roles: which columns a chart question means, decided from the schema alone.

Every resolver looks at names and types only (plus the question text), so the choice is made
on the driver before any data is touched. Matching is plain substring matching on lower-cased
names, first hit in schema order wins; known hazards (``count`` inside ``country``, ``sex``
inside ``Sussex``, ``time`` inside ``sentiment``) are kept on purpose because they define the
behaviour.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# Name hints, in the order they are tested.
BAR_TARGET_HINTS = ["gender", "sex", "género", "sexo", "hombre", "mujer", "male", "female"]
BAR_VALUE_HINTS = ["count", "quantity", "amount", "total", "cantidad"]
BAR_COUNT_MODE_HINTS = ["gender", "sex", "género", "sexo", "type", "category", "categoría"]
LINE_DATE_HINTS = ["date", "fecha", "time", "tiempo"]
LINE_VALUE_HINTS = ["price", "sales", "amount", "total", "precio", "ventas", "cantidad"]
PIE_TARGET_HINTS = ["gender", "sex", "género", "sexo", "type", "tipo", "category", "categoría"]
SCATTER_X_HINTS = ["price", "precio", "cost", "costo"]
SCATTER_Y_HINTS = ["quantity", "cantidad", "amount", "total"]
# ---------------------------------------------------------------------------------------


class RoleError(ValueError):
    """No column fits the role (the chart cannot be drawn for this table)."""


def string_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def temporal_columns(schema: T.StructType) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]


def has_hint(name: str, hints: list[str], whole_words: bool = False) -> bool:
    """Whether a column name carries one of the hints: as a substring (the reference's rule,
    so 'count' is found in 'country'), or, with ``whole_words``, as a word of the name."""
    low = name.lower()
    if not whole_words:
        return any(h in low for h in hints)
    words = set(re.split(r"[\W_]+", low))
    return any(h in words for h in hints)


def _first_with_hint(columns: list[str], hints: list[str], whole_words: bool = False) -> str | None:
    for c in columns:
        if has_hint(c, hints, whole_words):
            return c
    return None


def with_synonyms(question: str, synonyms: dict[str, str] | None) -> str:
    """The question plus the column words its terms stand for (optional, off by default:
    the reference matches column names literally, so 'ciudad' never names 'City')."""
    q = (question or "").lower()
    if not synonyms:
        return q
    extra = [v.lower() for k, v in synonyms.items() if k.lower() in q]
    return " ".join([q] + extra)


def _first_named_or_hinted(columns: list[str], question: str, hints: list[str],
                           whole_words: bool = False) -> str | None:
    q = (question or "").lower()
    for c in columns:
        if c.lower() in q or has_hint(c, hints, whole_words):
            return c
    return None


@dataclass
class BarRoles:
    target: str
    value: str | None
    mode: str  # 'count' or 'sum' ('sum' falls back to counts when the grand total is not > 0)


def resolve_bar(schema: T.StructType, question: str, synonyms: dict[str, str] | None = None,
                whole_words: bool = False) -> BarRoles:
    cats = string_columns(schema)
    nums = numeric_columns(schema)
    target = _first_named_or_hinted(cats, with_synonyms(question, synonyms), BAR_TARGET_HINTS, whole_words)
    if target is None and cats:
        target = cats[0]
    if target is None:
        raise RoleError(f"no categorical column for a bar chart; columns: {schema.names}")
    value = _first_with_hint(nums, BAR_VALUE_HINTS, whole_words) or (nums[0] if nums else None)
    if has_hint(target, BAR_COUNT_MODE_HINTS, whole_words) or value is None:
        mode = "count"
    else:
        mode = "sum"
    return BarRoles(target, value, mode)


@dataclass
class LineRoles:
    date: str | None          # None: series by row position
    value: str
    date_candidates: list[str] = field(default_factory=list)


def line_date_candidates(schema: T.StructType) -> list[str]:
    """Columns whose name hints a date and whose type can hold one (temporal or text).

    Numeric columns are never date candidates (a number named ``update_count`` is not a
    date); text candidates still have to parse, see ``operators.clean.column_date_formats``.
    """
    out = []
    for f in schema.fields:
        low = f.name.lower()
        if not any(h in low for h in LINE_DATE_HINTS):
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)):
            out.append(f.name)
    return out


def resolve_line(schema: T.StructType, parseable: list[str] | None = None) -> LineRoles:
    """``parseable``: the date candidates known to parse (default: the temporal ones)."""
    nums = numeric_columns(schema)
    cands = line_date_candidates(schema)
    if parseable is None:
        temporal = set(temporal_columns(schema))
        parseable = [c for c in cands if c in temporal]
    dates = [c for c in cands if c in set(parseable)]
    if not nums:
        raise RoleError(f"no numeric column for a line chart; columns: {schema.names}")
    if dates:
        value = _first_with_hint(nums, LINE_VALUE_HINTS) or nums[0]
        return LineRoles(dates[0], value, cands)
    return LineRoles(None, nums[0], cands)


def resolve_pie(schema: T.StructType, question: str, synonyms: dict[str, str] | None = None,
                whole_words: bool = False) -> str:
    cats = string_columns(schema)
    target = _first_named_or_hinted(cats, with_synonyms(question, synonyms), PIE_TARGET_HINTS, whole_words)
    if target is None and cats:
        target = cats[0]
    if target is None:
        raise RoleError(f"no categorical column for a pie chart; columns: {schema.names}")
    return target


@dataclass
class ScatterRoles:
    x: str
    y: str
    warning: str | None = None


def resolve_scatter(schema: T.StructType, whole_words: bool = False) -> ScatterRoles:
    nums = numeric_columns(schema)
    if len(nums) < 2:
        raise RoleError(f"a scatter plot needs two numeric columns; numeric: {nums}")
    x = _first_with_hint(nums, SCATTER_X_HINTS, whole_words) or nums[0]
    y = _first_with_hint(nums, SCATTER_Y_HINTS, whole_words) or nums[1]
    warning = f"x and y resolve to the same column {x}" if x == y else None
    return ScatterRoles(x, y, warning)
