"""Chart intent of a question: bar, line, pie, scatter or none.

Rule: lower-case the question. If it contains none of the explicit keywords, one of the gate
patterns must match, else there is no chart. Then the first chart type (in the order bar,
line, pie, scatter) with a matching pattern wins. An explicit question without a typed match
is a bar chart; anything else has no chart.

The same rule is offered twice: as a Spark column expression (``chart_intent``), so a question
log of any size is classified in one projection, and as a plain Python function
(``detect_chart_intent``) for resolving a single question on the driver before planning.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# These keyword and pattern lists must equal the reference behaviour exactly,
# in this order (search semantics, applied to the lower-cased question).
EXPLICIT_KEYWORDS = ["gráfico", "grafico", "chart", "plot", "visualiza", "muestra", "dibuja"]
GATE_PATTERNS = [
    r"ventas.*por.*ciudad",
    r"productos.*más.*vendidos",
    r"top.*\d+",
    r"ranking",
    r"distribución.*por",
    r"comparar.*ventas",
]
CHART_PATTERNS = {
    "bar": [
        r"gráfico de barras?",
        r"barras?",
        r"comparar.*por",
        r"distribución.*por",
        r"ventas.*por.*ciudad",
        r"ventas.*por.*producto",
        r"por.*manager",
        r"ranking",
        r"top.*\d+",
    ],
    "line": [
        r"gráfico de líneas?",
        r"líneas?",
        r"tendencia",
        r"evolución",
        r"a lo largo del tiempo",
        r"por.*fecha",
        r"por.*mes",
        r"histórico",
    ],
    "pie": [
        r"gráfico de pastel",
        r"gráfico circular",
        r"pie",
        r"proporción",
        r"porcentaje.*de",
        r"distribución.*total",
    ],
    "scatter": [
        r"dispersión",
        r"scatter",
        r"correlación",
        r"relación.*entre",
        r"precio.*vs.*cantidad",
        r"vs\.",
        r"contra",
    ],
}
CHART_ORDER = ["bar", "line", "pie", "scatter"]
# ---------------------------------------------------------------------------------------

# Java regex flags so that Spark matches like Python's ``re``: Unicode classes for ``\d`` and
# ``\w``, and ``.`` excluding only ``\n``.
_JAVA_FLAGS = "(?Ud)"


def _any_pattern(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def chart_intent(question: Column | str) -> Column:
    """Column expression: 'bar' | 'line' | 'pie' | 'scatter' | NULL."""
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    explicit = reduce(lambda a, b: a | b, [q.contains(k) for k in EXPLICIT_KEYWORDS])
    gate = q.rlike(_JAVA_FLAGS + _any_pattern(GATE_PATTERNS))
    typed = None
    for kind in CHART_ORDER:
        cond = q.rlike(_JAVA_FLAGS + _any_pattern(CHART_PATTERNS[kind]))
        typed = F.when(cond, F.lit(kind)) if typed is None else typed.when(cond, F.lit(kind))
    typed = typed.when(explicit, F.lit("bar"))
    return F.when(q.isNull() | ~(explicit | gate), F.lit(None).cast("string")).otherwise(typed)


_PY_GATE = re.compile(_any_pattern(GATE_PATTERNS))
_PY_TYPED = [(k, re.compile(_any_pattern(CHART_PATTERNS[k]))) for k in CHART_ORDER]


def detect_chart_intent(question: str | None) -> str | None:
    """Driver-side form of :func:`chart_intent` for one question string."""
    if question is None:
        return None
    q = question.lower()
    explicit = any(k in q for k in EXPLICIT_KEYWORDS)
    if not explicit and not _PY_GATE.search(q):
        return None
    for kind, rx in _PY_TYPED:
        if rx.search(q):
            return kind
    return "bar" if explicit else None


def requested_top_n(question: str | None, default: int) -> int:
    """N of a 'top N' question (first number after 'top'), else ``default``."""
    if question:
        m = re.search(r"top\D*(\d+)", question.lower())
        if m:
            return int(m.group(1))
    return default
