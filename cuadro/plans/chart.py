"""Question → chart: intent, column roles, one aggregate plan, and a chart record.

The choice of chart and columns needs only the question and the schema, so it happens on
the driver; the data work is a single DataFrame plan handed back to the caller. Drawing is
out of scope: the plotted series *is* the result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intent import chart_intent, detect_chart_intent
from ..functions.roles import (RoleError, line_date_candidates, resolve_bar, resolve_line,
                               resolve_pie, resolve_scatter)
from ..functions.text import basename
from ..operators import charts
from ..operators.clean import column_date_formats, parse_dates_like
from ..operators.rowindex import FILE_ORDER
from ..sources.csv import DEFAULT_RAW_DIR, resolve_source

# ---------------------------------------------------------------------------------------
# Chart labels and file-name stems.
TITLE_BY = "Distribución por {col}"
YLABEL_COUNT = "Cantidad"
YLABEL_TOTAL = "Total {col}"
TITLE_LINE = "Evolución de {col} en el Tiempo"
TITLE_INDEX = "Evolución de {col}"
XLABEL_INDEX = "Índice"
TITLE_SCATTER = "Relación entre {x} y {y}"
FILE_STEMS = {"bar": "bar_chart", "line": "line_chart", "pie": "pie_chart", "scatter": "scatter_plot"}
# ---------------------------------------------------------------------------------------


@dataclass
class ChartSpec:
    chart_type: str | None
    question: str
    columns: dict = field(default_factory=dict)
    title: str | None = None
    xlabel: str | None = None
    ylabel: str | None = None
    mode: str | None = None
    error: str | None = None
    warning: str | None = None
    guarded: DataFrame | None = field(default=None, repr=False)

    @property
    def chart_id(self) -> str:
        return hashlib.md5(self.question.encode("utf-8")).hexdigest()[:12]

    @property
    def file_name(self) -> str | None:
        if not self.chart_type:
            return None
        return f"{FILE_STEMS[self.chart_type]}_{self.chart_id}.png"

    def label(self) -> str | None:
        """The value axis' label as drawn. For sums it follows the zero guard, which reads the data."""
        if self.guarded is not None:
            first = self.guarded.select("counted").first()
            if first is not None and first["counted"]:
                return YLABEL_COUNT
        return self.ylabel


def bar_plan(df: DataFrame, question: str, n: int = charts.BAR_LIMIT,
             synonyms: dict[str, str] | None = None, whole_words: bool = False) -> tuple[ChartSpec, DataFrame]:
    roles = resolve_bar(df.schema, question, synonyms, whole_words)
    spec = ChartSpec("bar", question, {"x": roles.target, "y": roles.value},
                     title=TITLE_BY.format(col=roles.target), xlabel=roles.target, mode=roles.mode)
    if roles.mode == "count":
        spec.ylabel = YLABEL_COUNT
        return spec, charts.bar_counts(df, roles.target, n)
    # the zero guard may still switch to counts at run time; ``spec.label()`` follows the data
    spec.ylabel = YLABEL_TOTAL.format(col=roles.value)
    spec.guarded = charts.bar_sums_labelled(df, roles.target, roles.value, n)
    return spec, spec.guarded.drop("counted")


def line_plan(df: DataFrame, question: str, order_by: list[str] | None = None
              ) -> tuple[ChartSpec, DataFrame]:
    """``df`` may carry the file position of its rows; a series by position then follows it."""
    data = visible(df)
    formats = column_date_formats(data, line_date_candidates(data.schema))   # one action, for text candidates only
    roles = resolve_line(data.schema, list(formats))
    if roles.date is not None:
        dated = parse_dates_like(data, roles.date, formats[roles.date])
        spec = ChartSpec("line", question, {"x": roles.date, "y": roles.value},
                         title=TITLE_LINE.format(col=roles.value), xlabel=roles.date,
                         ylabel=roles.value, mode="series")
        return spec, charts.time_series(dated, roles.date, roles.value)
    keys = order_by or (FILE_ORDER if set(FILE_ORDER) <= set(df.columns) else [data.columns[0]])
    spec = ChartSpec("line", question, {"x": "row_idx", "y": roles.value},
                     title=TITLE_INDEX.format(col=roles.value), xlabel=XLABEL_INDEX,
                     ylabel=roles.value, mode="index")
    return spec, charts.series_by_index(df, roles.value, keys)


def visible(df: DataFrame) -> DataFrame:
    """The table without the columns that only order its rows."""
    return df.drop(*FILE_ORDER) if set(FILE_ORDER) <= set(df.columns) else df


def pie_plan(df: DataFrame, question: str, n: int = charts.PIE_SLICES,
             synonyms: dict[str, str] | None = None, whole_words: bool = False) -> tuple[ChartSpec, DataFrame]:
    target = resolve_pie(df.schema, question, synonyms, whole_words)
    spec = ChartSpec("pie", question, {"x": target}, title=TITLE_BY.format(col=target),
                     mode="shares")
    return spec, charts.pie_shares(df, target, n)


def scatter_plan(df: DataFrame, question: str, whole_words: bool = False) -> tuple[ChartSpec, DataFrame]:
    roles = resolve_scatter(df.schema, whole_words)
    spec = ChartSpec("scatter", question, {"x": roles.x, "y": roles.y},
                     title=TITLE_SCATTER.format(x=roles.x, y=roles.y), xlabel=roles.x,
                     ylabel=roles.y, mode="points", warning=roles.warning)
    return spec, charts.scatter_points(df, roles.x, roles.y)


_PLANS = {"bar": bar_plan, "line": line_plan, "pie": pie_plan, "scatter": scatter_plan}


NO_SOURCE = "no table, file or store file to draw from"


def answer_chart(df: DataFrame | None, question: str, order_by: list[str] | None = None,
                 synonyms: dict[str, str] | None = None, whole_words: bool = False,
                 path: str | None = None, store_name: str | None = None, raw_dir: str = DEFAULT_RAW_DIR,
                 spark: SparkSession | None = None) -> tuple[ChartSpec | None, DataFrame | None]:
    """Dispatch one question. No chart intent → (None, None). A table without suitable
    columns → (spec with ``error``, None), the quiet failure of the reference made explicit.

    Without a table the source is the CSV at ``path``, else the file named after the store,
    else the default file (``resolve_source``). ``synonyms`` (question word → column name) and
    ``whole_words`` are optional; by default names match literally.
    """
    kind = detect_chart_intent(question)
    if kind is None:
        return None, None
    if df is None:
        df = resolve_source(spark or SparkSession.getActiveSession(), None, path, store_name, raw_dir)
        if df is None:
            return ChartSpec(kind, question, error=NO_SOURCE), None
    try:
        if kind == "line":
            return line_plan(df, question, order_by)
        if kind in ("bar", "pie"):
            return _PLANS[kind](visible(df), question, synonyms=synonyms, whole_words=whole_words)
        return _PLANS[kind](visible(df), question, whole_words=whole_words)
    except RoleError as e:
        return ChartSpec(kind, question, error=str(e)), None


def chart_trend(df: DataFrame, spec: ChartSpec) -> DataFrame | None:
    """Least-squares trend line for a scatter spec (slope, intercept, n)."""
    if spec is None or spec.chart_type != "scatter" or spec.error:
        return None
    return charts.linear_trend(df, spec.columns["x"], spec.columns["y"])


def chart_file_name(question: Column, kind: Column | None = None) -> Column:
    """``<stem>_<md5(question)[:12]>.png`` when the question asks for a chart (of ``kind``, if that is known),
    else NULL."""
    kind = chart_intent(question) if kind is None else kind
    stem = F.create_map(*[x for k, v in FILE_STEMS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(kind.isNotNull(), F.concat(F.element_at(stem, kind), F.lit("_"),
                                             F.substring(F.md5(question), 1, 12), F.lit(".png")))


def role_errors(schema: T.StructType) -> dict[str, str]:
    """The chart types a table cannot be drawn as, and why."""
    tries = {"bar": lambda: resolve_bar(schema, ""), "line": lambda: resolve_line(schema),
             "pie": lambda: resolve_pie(schema, ""), "scatter": lambda: resolve_scatter(schema)}
    out = {}
    for kind, attempt in tries.items():
        try:
            attempt()
        except RoleError as e:
            out[kind] = str(e)
    return out


def chart_records(questions: DataFrame, question_col: str = "question",
                  path_prefix: Column | str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Chart record per question of a question table, in one projection.

    Columns added: chart_type, chart_generated, chart_id, chart_filename, error, timestamp (ISO
    text, one per run) (and chart_path when a prefix is given). With the table's ``schema`` a
    chart that it cannot give is a failure: not generated, no file, and ``error`` says why. The id is ``md5(question)`` instead of a clock reading, so two
    questions asked within a second no longer overwrite each other's file.
    """
    q, kind = F.col(question_col), F.col("chart_type")
    asked = questions.withColumn("chart_type", chart_intent(q))           # classified once a row
    error = F.lit(None).cast("string")
    for k, why in (role_errors(schema) if schema is not None else {}).items():
        error = F.when(kind == k, F.lit(why)).otherwise(error)
    out = asked.withColumns({
        "chart_generated": kind.isNotNull() & error.isNull(),
        "chart_id": F.substring(F.md5(q), 1, 12),
        "chart_filename": F.when(error.isNull(), chart_file_name(q, kind)),
        "error": error,
        "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    })
    if path_prefix is not None:
        prefix = F.lit(path_prefix) if isinstance(path_prefix, str) else path_prefix
        out = out.withColumn("chart_path", F.concat(prefix, F.lit("/"), F.col("chart_filename")))
        out = out.withColumn("chart_filename", basename(F.col("chart_path")))
    return out


# ---- many questions over one table ---------------------------------------------------------

def _first_named_or_hinted(q: Column, columns: list[str], hints: list[str]) -> Column | None:
    """First column (schema order) whose lower name is in the question or carries a hint."""
    expr = None
    for c in columns:
        low = c.lower()
        cond = F.lit(True) if any(h in low for h in hints) else q.contains(low)
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr.otherwise(F.lit(columns[0])) if expr is not None else None


def chart_specs(questions: DataFrame, df: DataFrame, question_col: str = "question", kind: Column | None = None) -> DataFrame:
    """Chart type and resolved columns of every question, as one projection.

    Adds chart_type, x, y, mode; ``kind`` is the chart type where the caller knows it. Roles depend only on the schema (and, for text date columns,
    one parse check), so they are CASE expressions over the question text.
    """
    from ..functions.roles import (BAR_COUNT_MODE_HINTS, BAR_TARGET_HINTS, PIE_TARGET_HINTS,
                                   numeric_columns, string_columns)
    df = visible(df)
    schema = df.schema
    asked = questions.withColumns({"chart_type": chart_intent(F.col(question_col)) if kind is None else kind,
                                   "_lower": F.lower(F.col(question_col))})          # once a row
    q, kind = F.col("_lower"), F.col("chart_type")
    cats, nums = string_columns(schema), numeric_columns(schema)
    null = F.lit(None).cast("string")
    bar_x = _first_named_or_hinted(q, cats, BAR_TARGET_HINTS) if cats else null
    pie_x = _first_named_or_hinted(q, cats, PIE_TARGET_HINTS) if cats else null
    try:
        bar_value = resolve_bar(schema, "").value
    except RoleError:
        bar_value = None
    count_targets = [c for c in cats if any(h in c.lower() for h in BAR_COUNT_MODE_HINTS)]
    bar_mode = F.when(bar_x.isin(count_targets) | F.lit(bar_value is None), F.lit("count")) \
        .otherwise(F.lit("sum")) if cats else null
    try:
        line = resolve_line(schema, list(column_date_formats(df, line_date_candidates(schema))))
        line_x, line_y = (line.date or "row_idx"), line.value
        line_mode = "series" if line.date else "index"
    except RoleError:
        line_x = line_y = line_mode = None
    try:
        sc = resolve_scatter(schema)
        sc_x, sc_y = sc.x, sc.y
    except RoleError:
        sc_x = sc_y = None

    def lit(v):
        return F.lit(v) if v is not None else null

    def pick(bar, line_, pie, scatter):
        return (F.when(kind == "bar", bar).when(kind == "line", line_)
                .when(kind == "pie", pie).when(kind == "scatter", scatter))

    return asked.withColumns({
        "x": pick(bar_x, lit(line_x), pie_x, lit(sc_x)),
        "y": pick(F.when(bar_mode == "sum", lit(bar_value)), lit(line_y), null, lit(sc_y)),
        "mode": pick(bar_mode, lit(line_mode), F.lit("shares"), F.lit("points")),
    }).drop("_lower")
