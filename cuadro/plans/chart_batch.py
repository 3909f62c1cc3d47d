"""The charts of a batch of questions over one table, from one scan of the table.

The different charts that the questions ask for are few: their number is bounded by the schema. Each row
of the table is exploded into one (chart, key, value) entry a chart, with only the columns that some
chart needs; one aggregate by chart and key gives all bars, slices, time points and the trend. It is
written to the shared folder once. Totals, zero guards and ranks are taken by chart from those groups;
the best are found by a partial group limit in every task, so a column with many different values sends
few rows to the ranking.

A chart's bars or slices (10 at most) travel with each question's answer. The points of a time series
are as many as the table has times: they stay rows of ``marks``, under the chart's key. The points of a
scatter chart are the table's own two columns (``charts.scatter_points``); its trend is in ``charts``. A
series by position, which a table without dates gets, is numbered by ``charts.series_by_index``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named
from ..operators import charts as ops
from ..operators.clean import parse_dates_like
from ..operators.exact import grouped_sums
from ..session import materialise
from .chart import (TITLE_BY, TITLE_INDEX, TITLE_LINE, TITLE_SCATTER, XLABEL_INDEX, YLABEL_COUNT, YLABEL_TOTAL, chart_specs,
                    role_errors, visible)

BARS = "array<struct<ord:bigint,label:string,value:double,pct:double,is_other:boolean>>"


@dataclass
class ChartBatch:
    """``charts``: a row a chart; ``marks``: a row a bar, slice or time point; ``table``: what they are drawn from."""
    table: DataFrame
    charts: DataFrame
    marks: DataFrame

    def answers(self, questions: DataFrame, question_col: str = "question", kind: Column | None = None) -> DataFrame:
        """``questions`` with chart_type, chart_key, chart (the row of ``charts``) and chart_error; a
        question that asks for none has nulls. ``kind``: the chart type where it is known."""
        asked = with_keys(questions, self.table, question_col, kind)
        error = F.lit(None).cast("string")
        for kind, why in role_errors(visible(self.table).schema).items():
            error = F.when(F.col("chart_type") == kind, F.lit(why)).otherwise(error)
        fields = [c for c in self.charts.columns if c != "chart_key"]
        drawn = self.charts.select(F.col("chart_key").alias("_key"), F.struct(*fields).alias("chart"))
        # bounded by the schema: a row for each pair of chart type and column, with at most 10 bars
        return asked.join(F.broadcast(drawn), F.col("chart_key") == F.col("_key"), "left") \
            .drop("_key", "x", "y", "mode").withColumn("chart_error", error)


def with_keys(questions: DataFrame, df: DataFrame, question_col: str = "question", kind: Column | None = None) -> DataFrame:
    """``chart_specs`` of the questions and ``chart_key``, null where no chart is drawn."""
    specs = chart_specs(questions, df, question_col, kind)
    key = F.concat_ws("/", "chart_type", "mode", "x", "y")
    return specs.withColumn("chart_key", F.when(F.col("x").isNotNull(), key))


def _entries(df: DataFrame, specs: list) -> tuple[DataFrame, dict[str, str]]:
    """One row a table row and chart: chart_key, label, at, v0, v1 … (values by column), sx, sy. And the
    value columns by name."""
    values = {y: f"v{j}" for j, y in enumerate(dict.fromkeys(s["y"] for s in specs if s["mode"] in ("sum", "series")))}
    entries = []
    for s in specs:
        label = named(s["x"]).cast("string") if s["chart_type"] in ("bar", "pie") else F.lit(None).cast("string")
        at = named(s["x"]).cast("timestamp_ntz") if s["mode"] == "series" else F.lit(None).cast("timestamp_ntz")
        held = [named(y) if s["mode"] in ("sum", "series") and s["y"] == y else F.lit(None).cast(df.schema[y].dataType) for y in values]
        pair = [named(s[c]).cast("double") if s["mode"] == "points" else F.lit(None).cast("double") for c in ("x", "y")]
        entry = F.struct(F.lit(s["chart_key"]).alias("chart_key"), label.alias("label"), at.alias("at"),
                         *[h.alias(v) for h, v in zip(held, values.values())], pair[0].alias("sx"), pair[1].alias("sy"))
        key = label if s["chart_type"] in ("bar", "pie") else at if s["mode"] == "series" else F.lit(True)
        entries.append(F.when(key.isNotNull(), entry))                       # a missing key is no group
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
    return rows, values


def chart_batch(questions: DataFrame, df: DataFrame, question_col: str = "question", order_by: list[str] | None = None) -> ChartBatch:
    """All charts that ``questions`` ask of ``df``. Only their specs reach the driver, at most two for
    each text column and two more."""
    data = visible(df)
    # classifying a long question takes a task far longer than reading it: spread over the slots
    texts = questions.select(question_col).repartition(questions.sparkSession.sparkContext.defaultParallelism)
    asked = with_keys(texts, df, question_col).where(F.col("chart_key").isNotNull()) \
        .select("chart_key", "chart_type", "x", "y", "mode").distinct()
    specs = sorted(asked.collect(), key=lambda s: s["chart_key"])
    for x in {s["x"] for s in specs if s["mode"] == "series"}:
        data = parse_dates_like(data, x)
    drawn = [s for s in specs if s["mode"] != "index"]
    marks = _no_marks(questions)
    facts = None
    if drawn:
        groups = materialise(_groups(data, drawn), "chart-groups")
        bars, facts = _ranked(groups, drawn)
        marks = bars.unionByName(_times(groups, drawn))
    for s in specs:
        if s["mode"] == "index":                                             # a chart of at most one column
            rows = ops.series_by_index(df, s["y"], order_by or _file_order(df))
            marks = marks.unionByName(rows.select(
                F.lit(s["chart_key"]).alias("chart_key"), F.col("row_idx").cast("bigint").alias("ord"), F.lit(None).cast("string").alias("label"),
                F.lit(None).cast("timestamp_ntz").alias("at"), named(s["y"]).cast("double").alias("value"),
                F.lit(None).cast("double").alias("pct"), F.lit(False).alias("is_other")))
    return ChartBatch(df, _charts(questions.sparkSession, specs, marks, facts), marks)


def _file_order(df: DataFrame) -> list[str]:
    from ..operators.rowindex import FILE_ORDER
    return FILE_ORDER if set(FILE_ORDER) <= set(df.columns) else [df.columns[0]]


def _groups(data: DataFrame, specs: list) -> DataFrame:
    """chart_key, label, at, value, n, slope, intercept, pairs: one aggregate over one scan of the table."""
    rows, values = _entries(data, specs)
    trend = {"slope": F.regr_slope("sy", "sx"), "intercept": F.regr_intercept("sy", "sx"), "pairs": F.regr_count("sy", "sx")}
    sums = {f"t{v}": v for v in values.values()}
    grouped = grouped_sums(rows, ["chart_key", "label", "at"], sums, rows="n", others=trend)
    value = F.lit(None).cast("double")
    for s in specs:
        if s["mode"] in ("sum", "series"):
            total = F.coalesce(F.col(f"t{values[s['y']]}").cast("double"), F.lit(0.0))
            value = F.when(F.col("chart_key") == s["chart_key"], total).otherwise(value)
    return grouped.select("chart_key", "label", "at", value.alias("value"), "n", "slope", "intercept", F.col("pairs").cast("bigint").alias("pairs"))


def _of(specs: list, *modes: str) -> Column:
    return F.col("chart_key").isin([s["chart_key"] for s in specs if s["mode"] in modes])


def _ranked(groups: DataFrame, specs: list) -> tuple[DataFrame, DataFrame]:
    """(marks of bars and pies, facts by chart: whether counts replace sums, trend)."""
    facts = grouped_sums(groups, ["chart_key"], {"grand": "value", "rows": "n"},
                         others={"slope": F.max("slope"), "intercept": F.max("intercept"), "pairs": F.max("pairs")}).select(
        "chart_key", (_of(specs, "sum") & ~F.coalesce(F.col("grand") > 0, F.lit(False))).alias("counted"),
        F.col("rows").cast("bigint").alias("rows"), "slope", "intercept", "pairs")
    # one row a chart, and there are at most two charts a text column and two more
    known = groups.where(_of(specs, "sum", "count", "shares")).join(F.broadcast(facts.select("chart_key", "counted", "rows")), "chart_key")
    summed = _of(specs, "sum") & ~F.col("counted")
    scored = known.select("chart_key", "label", F.when(summed, F.col("value")).otherwise(F.col("n").cast("double")).alias("value"), "n", "rows")
    best = Window.partitionBy("chart_key").orderBy(F.desc("value"), "label")
    top = scored.withColumn("ord", F.row_number().over(best).cast("bigint")).where(F.col("ord") <= max(ops.BAR_LIMIT, ops.PIE_SLICES)) \
        .where(F.when(_of(specs, "shares"), F.col("ord") <= ops.PIE_SLICES).otherwise(F.col("ord") <= ops.BAR_LIMIT))
    share = lambda n: F.round(F.lit(100.0) * n / F.col("rows"), 1)
    slices = _of(specs, "shares")
    shown = top.select("chart_key", "ord", "label", F.lit(None).cast("timestamp_ntz").alias("at"), "value",
                       F.when(slices, share(F.col("n"))).alias("pct"), F.lit(False).alias("is_other"))
    left = top.where(slices).groupBy("chart_key").agg((F.max("rows") - F.sum("n")).cast("bigint").alias("rest"), F.max("rows").alias("rows"))
    others = left.where("rest > 0").select(
        "chart_key", F.lit(ops.PIE_SLICES + 1).cast("bigint").alias("ord"), F.lit(ops.PIE_OTHER_LABEL).alias("label"),
        F.lit(None).cast("timestamp_ntz").alias("at"), F.col("rest").cast("double").alias("value"), share(F.col("rest")).alias("pct"),
        F.lit(True).alias("is_other"))
    return shown.unionByName(others), facts


def _times(groups: DataFrame, specs: list) -> DataFrame:
    """Marks of time series; ``at`` is their order."""
    return groups.where(_of(specs, "series")).select(
        "chart_key", F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("label"), "at", "value",
        F.lit(None).cast("double").alias("pct"), F.lit(False).alias("is_other"))


MARKS = "chart_key string, ord bigint, label string, at timestamp_ntz, value double, pct double, is_other boolean"


def _no_marks(questions: DataFrame) -> DataFrame:
    return questions.sparkSession.createDataFrame([], MARKS)


def _labels(s) -> tuple[str, str | None, str | None]:
    """(title, x label, y label) of a chart, as drawn without the zero guard."""
    if s["chart_type"] == "bar":
        return TITLE_BY.format(col=s["x"]), s["x"], YLABEL_COUNT if s["mode"] == "count" else YLABEL_TOTAL.format(col=s["y"])
    if s["chart_type"] == "pie":
        return TITLE_BY.format(col=s["x"]), None, None
    if s["mode"] == "index":
        return TITLE_INDEX.format(col=s["y"]), XLABEL_INDEX, s["y"]
    if s["mode"] == "series":
        return TITLE_LINE.format(col=s["y"]), s["x"], s["y"]
    return TITLE_SCATTER.format(x=s["x"], y=s["y"]), s["x"], s["y"]


CHARTS = "chart_key string, x string, y string, mode string, title string, xlabel string, ylabel string, warning string"


def _charts(spark, specs: list, marks: DataFrame, facts: DataFrame | None) -> DataFrame:
    """A row a chart: columns, labels, bars or slices, trend and how many pairs it is fitted to."""
    rows = []
    for s in specs:
        same = s["mode"] == "points" and s["x"] == s["y"]
        rows.append((s["chart_key"], s["x"], s["y"], s["mode"], *_labels(s),
                     f"x and y resolve to the same column {s['x']}" if same else None))
    known = spark.createDataFrame(rows, CHARTS)
    bounded = [s["chart_key"] for s in specs if s["chart_type"] in ("bar", "pie")]
    bars = marks.where(F.col("chart_key").isin(bounded)).groupBy("chart_key").agg(
        F.sort_array(F.collect_list(F.struct("ord", "label", "value", "pct", "is_other"))).alias("bars"))
    out = known.join(bars, "chart_key", "left")
    if facts is None:
        nothing = {"counted": "boolean", "slope": "double", "intercept": "double", "pairs": "bigint"}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    else:
        out = out.join(facts.drop("rows"), "chart_key", "left")
    ylabel = F.when(F.coalesce("counted", F.lit(False)), F.lit(YLABEL_COUNT)).otherwise(F.col("ylabel"))
    points = F.col("mode") == "points"
    return out.select("chart_key", "x", "y", "mode", "title", "xlabel", ylabel.alias("ylabel"), "warning",
                      F.coalesce("bars", F.array().cast(BARS)).alias("bars"), "slope", "intercept", F.when(points, F.col("pairs")).alias("pairs"))
