"""Registered queries: one Spark callable and (where SQL can say it) one DuckDB oracle each.

Every query reads the driver tables under ``sf_dir`` (or data Spark derives from them) in
full. Column names and types are aligned with the oracle SQL so results can be compared
row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import charts
from .plans.chart import answer_chart
from .session import read_table

Query = Callable[[SparkSession, str], DataFrame]

# Questions used by the chart queries (taken from the reference's own examples).
Q_BAR_PRODUCT = "Muestra un gráfico de ventas por producto"
Q_BAR_TYPES = "Haz un gráfico de barras por tipo de evento"
Q_PIE = "Gráfico circular por p_name"
Q_LINE = "Muestra la evolución de las ventas por mes"
Q_SCATTER = "muestra precio vs. cantidad"


def _chart(question: str, table: str, prep=None, order_by=None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, table)
        if prep is not None:
            df = prep(df)
        spec, data = answer_chart(df, question, order_by=order_by)
        if spec is None or data is None:
            raise ValueError(f"no chart for {question!r}: {spec}")
        return data
    return run


def q_pie_top8(spark, sf_dir):
    return _chart(Q_PIE, "part")(spark, sf_dir)


def q_line_by_index(spark, sf_dir):
    return charts.series_by_index(read_table(spark, sf_dir, "customer"), "c_acctbal", ["c_custkey"])


def q_scatter_trend(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    spec, _ = answer_chart(li, Q_SCATTER)
    t = charts.linear_trend(li, spec.columns["x"], spec.columns["y"])
    return t.select(F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


def q_scatter_fitted(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return charts.trend_values(li, "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber"], digits=4)


def q_histogram(spark, sf_dir):
    return charts.histogram(read_table(spark, sf_dir, "lineitem"), "l_quantity", 10)


def _fractions(li: DataFrame) -> DataFrame:
    """Values far below a cent: their sums must not be taken for zero."""
    return li.select("l_returnflag", (F.col("l_discount") * F.col("l_tax") / 100000).alias("l_amount"))


def _missing(ev: DataFrame) -> DataFrame:
    """Events without a name for one kind, without any value for another and with some missing elsewhere."""
    value = F.when((F.col("event_type") == "click") | (F.col("user_id") % 3 == 0), None).otherwise(F.col("value"))
    return ev.select("event_id", F.expr("nullif(event_type, 'error')").alias("kind"), value.alias("amount"),
                     F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("price"))


def q_scatter_missing(spark, sf_dir):
    """A trend over the rows that have both numbers; the others count for neither."""
    t = charts.linear_trend(_missing(read_table(spark, sf_dir, "events")), "price", "amount")
    return t.select(F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


QUERIES: dict[str, Query] = {
    "bar_missing": _chart("Muestra un gráfico de ventas por kind", "events", prep=_missing),
    "pie_missing": _chart("gráfico circular de kind", "events", prep=_missing),
    "scatter_missing": q_scatter_missing,
    "bar_sum": _chart(Q_BAR_PRODUCT, "lineitem"),
    "bar_sum_fractions": _chart(Q_BAR_PRODUCT, "lineitem", prep=_fractions),
    "bar_count": _chart(Q_BAR_TYPES, "events"),
    "bar_zero_guard": _chart(Q_BAR_PRODUCT, "lineitem",
                             prep=lambda d: d.select("l_returnflag", (F.col("l_tax") * 0).alias("l_tax_zero"))),
    "pie_top8": q_pie_top8,
    "line_series": _chart(Q_LINE, "orders"),
    "line_by_index": q_line_by_index,
    "scatter_points": _chart(Q_SCATTER, "lineitem"),
    "scatter_trend": q_scatter_trend,
    "scatter_fitted": q_scatter_fitted,
    "histogram": q_histogram,
}

def _sql_exact(x: str, bits: int = 60) -> str:
    """The exact sum of DOUBLE values (multiples of 2^-bits), rounded once: added as whole numbers."""
    whole = f"sum(cast(({x}) * pow(2, {bits}) as hugeint))"
    return (f"coalesce((cast({whole} // (1::hugeint << 48) as double) * pow(2, 48) + cast({whole} % (1::hugeint << 48) as double))"
            f" / pow(2, {bits}), 0.0::double)")


ORACLE: dict[str, str] = {
    "bar_sum": f"""
select l_returnflag, {_sql_exact('l_quantity')} as value from lineitem where l_returnflag is not null
group by 1 order by value desc, l_returnflag limit 10""",
    "bar_sum_fractions": f"""
select l_returnflag, {_sql_exact('l_discount * l_tax / 100000', 100)} as value from lineitem where l_returnflag is not null
group by 1 order by value desc, l_returnflag limit 10""",
    "bar_missing": f"""
select nullif(event_type, 'error') as kind, {_sql_exact("case when event_type <> 'click' and user_id % 3 <> 0 then value end")} as value
from events where event_type <> 'error' group by 1 order by value desc, 1 limit 10""",
    "pie_missing": """
with f as (select event_type as k, count(*) as n from events where event_type <> 'error' group by 1)
select row_number() over (order by n desc, k) as ord, k as label, n, round(cast(100.0 as double) * n / (select sum(n) from f), 1) as pct,
  false as is_other from f""",
    "scatter_missing": """
select round(regr_slope(v, p), 8) as slope, round(regr_intercept(v, p), 6) as intercept, cast(regr_count(v, p) as bigint) as n
from (select case when event_type <> 'click' and user_id % 3 <> 0 then value end as v, case when user_id % 5 <> 0 then user_id end as p from events)""",
    "bar_count": """
select event_type, count(*) as value from events where event_type is not null
group by 1 order by value desc, event_type limit 10""",
    "bar_zero_guard": """
select l_returnflag, cast(count(*) as double) as value from lineitem where l_returnflag is not null
group by 1 order by value desc, l_returnflag limit 10""",
    "pie_top8": """
with f as (select p_name k, count(*) n from part where p_name is not null group by 1),
     r as (select k, n, row_number() over (order by n desc, k) rk from f),
     head as (select cast(rk as bigint) ord, k label, cast(n as bigint) n, false is_other from r where rk <= 8),
     rest as (select cast(9 as bigint) ord, 'Otros' label,
                     cast((select sum(n) from f) - (select coalesce(sum(n), 0) from head) as bigint) n, true is_other),
     u as (select * from head union all select * from rest where n > 0)
select ord, label, n, round(cast(100.0 as double) * n / (select sum(n) from f), 1) pct, is_other from u""",
    "line_series": f"""
select o_orderdate, {_sql_exact('o_totalprice')} as value
from orders where o_orderdate is not null group by 1 order by 1""",
    "line_by_index": """
select cast(row_number() over (order by c_custkey) - 1 as bigint) row_idx, c_acctbal from customer""",
    "scatter_points": "select l_extendedprice, l_quantity from lineitem",
    "scatter_trend": """
select round(regr_slope(l_quantity, l_extendedprice), 8) slope,
       round(regr_intercept(l_quantity, l_extendedprice), 6) intercept,
       cast(regr_count(l_quantity, l_extendedprice) as bigint) n from lineitem""",
    "scatter_fitted": """
with f as (select regr_slope(l_quantity, l_extendedprice) a, regr_intercept(l_quantity, l_extendedprice) b from lineitem)
select l_orderkey, l_linenumber, round(a * l_extendedprice + b, 4) y_fit from lineitem, f""",
    "histogram": """
with r as (select cast(min(l_quantity) as double) mn, cast(max(l_quantity) as double) mx from lineitem),
     w as (select mn, (mx - mn) / cast(10.0 as double) width from r),
     b as (select cast(least(case when width > 0 then floor((cast(l_quantity as double) - mn) / width) else 0 end, 9) as integer) bin
           from lineitem, w where l_quantity is not null)
select bin, mn + bin * width bin_start, mn + (bin + 1) * width bin_end, count(*) n
from b, w group by bin, mn, width order by bin""",
}


# ---------------------------------------------------------------------------------------
# Profile, cleaning, corpus, insights
# ---------------------------------------------------------------------------------------
from .functions.intent import requested_top_n  # noqa: E402
from .functions.text import snippet, store_name  # noqa: E402
from .operators import clean, corpus, insights, profile  # noqa: E402
from .operators.rowindex import with_row_index  # noqa: E402
from .plans.chart import chart_records  # noqa: E402

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                  "o_orderpriority"]
EVENTS_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EVENT_FIELDS = corpus.RowFields(id="event_id", date="ts", product="event_type", price=None,
                                quantity=None, total="value", purchase_type=None, payment=None,
                                manager=None, city=None)
Q_TOP_N = "Haz un gráfico de barras de los top 5 productos"


def q_summary_numeric(spark, sf_dir):
    return profile.numeric_summary(read_table(spark, sf_dir, "lineitem"))


def q_summary_period(spark, sf_dir):
    return profile.period(read_table(spark, sf_dir, "orders"), "o_orderdate")


def q_summary_top5(spark, sf_dir):
    return profile.top_values(read_table(spark, sf_dir, "orders"))


def q_dataset_summary_text(spark, sf_dir):
    return profile.dataset_summary(read_table(spark, sf_dir, "orders"), date_col="o_orderdate",
                                   stat_columns=["o_totalprice"])


def q_dataset_info(spark, sf_dir):
    return profile.dataset_info(read_table(spark, sf_dir, "lineitem"))


def q_preview_head(spark, sf_dir):
    return profile.preview(read_table(spark, sf_dir, "events"), ["event_id"])


def q_profile_columns(spark, sf_dir):
    return clean.numeric_profile(read_table(spark, sf_dir, "documents"))


def q_clean_strip(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    padded = c.select("c_custkey", F.concat(F.lit("\t "), "c_mktsegment", F.lit("  x  ")).alias("c_mktsegment"))
    return clean.clean_table(padded)


def q_clean_null_label(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    holed = ev.select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return charts.bar_counts(clean.clean_table(holed, null_label="nan"), "event_type", None)


def q_clean_date_dayfirst(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    txt = o.select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("order_date"))
    return clean.clean_table(txt)


def q_clean_date_cascade(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    s = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd-MM-yyyy")) \
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return clean.cascade_dates(o.select("o_orderkey", s.alias("order_date")), "order_date")


def q_clean_numeric(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    digits = F.regexp_replace("source", "src", "")
    mixed = F.when(F.col("lang") == "en", F.col("source")).otherwise(digits)
    return clean.clean_table(d.select("doc_id", "source", digits.alias("source_num"), mixed.alias("source_mixed")))


def q_derive_total(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return clean.row_total(li, "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "total")


def q_derive_total_fractions(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    return clean.row_total(li, "p", "l_discount").select("l_orderkey", "l_linenumber", "total")


def q_row_index(spark, sf_dir):
    return with_row_index(read_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"],
                          rows_per_bucket=2000)


def q_render_rows(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return corpus.render_rows(ev, EVENT_FIELDS, keep=["event_id"])


def q_render_sales_rows(spark, sf_dir):
    """The price and quantity part of a sentence, over prices from tiny to large."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1000 + 0.5).alias("Price"), F.col("l_linenumber").alias("Quantity"),
        F.col("l_returnflag").alias("Product"))
    fields = corpus.RowFields(id="l_orderkey", date=None)
    return corpus.render_rows(li, fields, keep=["l_orderkey", "l_linenumber"])


def q_chunk_rows(spark, sf_dir):
    return corpus.chunk_table(read_table(spark, sf_dir, "events"), ["event_id"], EVENT_FIELDS)


def _events_corpus(spark, sf_dir):
    return corpus.corpus_docs(read_table(spark, sf_dir, "events"), ["event_id"], EVENT_FIELDS,
                              date_col="ts", stat_columns=["value"])


def q_corpus_docs(spark, sf_dir):
    # flat output: the column list as text
    return _events_corpus(spark, sf_dir).withColumn("columns", F.array_join("columns", ", "))


def q_corpus_counts(spark, sf_dir):
    return corpus.corpus_counts(_events_corpus(spark, sf_dir))


def _li_part(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")


def q_top_products(spark, sf_dir):
    return insights.top_products(*_li_part(spark, sf_dir))


def q_top_n(spark, sf_dir):
    return insights.top_products(*_li_part(spark, sf_dir), n=requested_top_n(Q_TOP_N, 10))


def q_best_seller(spark, sf_dir):
    return insights.best_seller(*_li_part(spark, sf_dir))


def q_monthly_trend(spark, sf_dir):
    return insights.monthly_trend(read_table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


def q_avg_by_category(spark, sf_dir):
    return insights.avg_by_category(read_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


def q_avg_fractions(spark, sf_dir):
    """Means of values far below a cent."""
    return insights.avg_by_category(_fractions(read_table(spark, sf_dir, "lineitem")), "l_returnflag", "l_amount")


def q_overall_avg(spark, sf_dir):
    return insights.overall_avg(read_table(spark, sf_dir, "lineitem"), "l_extendedprice")


def q_compare_regions(spark, sf_dir):
    return insights.compare_regions(*[read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")])


def q_source_snippet(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", snippet("text").alias("snippet"))


def q_store_name(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", store_name("url").alias("store_name"))


#: Question templates; {} is filled with a value of the given tables. The last one asks for nothing.
QUESTION_TEMPLATES = [
    "Muestra un gráfico de barras por {}", "Haz un gráfico circular de {}", "¿Cuál es la tendencia? Muestra {} por mes",
    "Dibuja la relación entre {} y cantidad", "Quiero un chart de {}", "top 5 {}", "ventas de {} por ciudad",
    "¿Cuántos {} hay?", "Comparar {} por manager", "gráfico de {} vs. precio",
]


def _questions(spark, sf_dir):
    """Every turn of every conversation asks a template filled with its role and position; every part
    asks one about its name. conv_id -1 marks the parts; every eleventh question is blank."""
    c = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat_ws(" ", "role", "text").alias("word"))
    p = read_table(spark, sf_dir, "part").select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("p_partkey").alias("turn"),
                                                 F.col("p_name").alias("word"))
    rows = c.unionByName(p)
    n = len(QUESTION_TEMPLATES)
    text = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TEMPLATES]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(n)) + 1).cast("int"))
    filled = F.replace(text, F.lit("{}"), F.col("word"))
    return rows.select("conv_id", "turn", F.when(F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(11)) == 0, F.lit("  "))
                       .otherwise(filled).alias("question"))


def q_chart_intent(spark, sf_dir):
    from .functions.intent import chart_intent
    return _questions(spark, sf_dir).select("conv_id", "turn", chart_intent("question").alias("chart_type"))


def q_chart_record(spark, sf_dir):
    """Drawn from ``region``, which has one number: scatter charts fail."""
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return chart_records(_questions(spark, sf_dir), path_prefix="out/charts", schema=region.schema).drop("question", "timestamp")


QUERIES.update({
    "summary_numeric": q_summary_numeric,
    "summary_period": q_summary_period,
    "summary_top5": q_summary_top5,
    "dataset_summary_text": q_dataset_summary_text,
    "dataset_info": q_dataset_info,
    "preview_head": q_preview_head,
    "profile_columns": q_profile_columns,
    "clean_strip": q_clean_strip,
    "clean_null_label": q_clean_null_label,
    "clean_date_dayfirst": q_clean_date_dayfirst,
    "clean_date_cascade": q_clean_date_cascade,
    "clean_numeric": q_clean_numeric,
    "derive_total": q_derive_total,
    "derive_total_fractions": q_derive_total_fractions,
    "render_sales_rows": q_render_sales_rows,
    "row_index": q_row_index,
    "render_rows": q_render_rows,
    "chunk_rows": q_chunk_rows,
    "corpus_docs": q_corpus_docs,
    "corpus_counts": q_corpus_counts,
    "top_products": q_top_products,
    "top_n": q_top_n,
    "best_seller": q_best_seller,
    "monthly_trend": q_monthly_trend,
    "avg_by_category": q_avg_by_category,
    "avg_fractions": q_avg_fractions,
    "overall_avg": q_overall_avg,
    "compare_regions": q_compare_regions,
    "source_snippet": q_source_snippet,
    "store_name": q_store_name,
    "chart_intent": q_chart_intent,
    "chart_record": q_chart_record,
})


# ---- oracle SQL builders ---------------------------------------------------------------

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_numeric_summary(table: str, cols: list[str]) -> str:
    parts = [f"""select {_sql_str(c)} as "column", cast(min({c}) as double) as min, cast(max({c}) as double) as max,
  {_sql_exact(c)} / count({c}) as mean, {_sql_exact(c)} as total from {table}""" for c in cols]
    return "\nunion all\n".join(parts)


def _sql_top_values(table: str, cols: list[str], n: int = 5) -> str:
    longf = " union all ".join(f"select {_sql_str(c)} as \"column\", cast({c} as varchar) as value from {table}" for c in cols)
    return f"""select "column", value, n, rank from (
  select "column", value, n, cast(row_number() over (partition by "column" order by n desc, value) as bigint) rank
  from (select "column", value, count(*) n from ({longf}) where value is not null group by 1, 2)) where rank <= {n}"""


def _sql_summary(table: str, columns: list[str], date_col: str | None, stats: list[str],
                 texts: list[str], has_numeric: bool, date_text: bool = False) -> str:
    nl = "chr(10)"
    aggs = ["count(*) as n"]
    if date_text:
        aggs += [f"min({date_col}) as p0", f"max({date_col}) as p1"]
    elif date_col:
        aggs += [f"strftime(min({date_col}), '%Y-%m-%d %H:%M:%S') as p0",
                 f"strftime(max({date_col}), '%Y-%m-%d %H:%M:%S') as p1"]
    for i, c in enumerate(stats):
        aggs += [f"cast(cast(min({c}) as double) as decimal(38,2)) as mn{i}",
                 f"cast(cast(max({c}) as double) as decimal(38,2)) as mx{i}",
                 f"cast(round(avg({c}), 2) as decimal(38,2)) as me{i}",
                 f"cast(round(cast(sum({c}) as double), 2) as decimal(38,2)) as sm{i}"]
    lines = [_sql_str("RESUMEN DEL DATASET DE VENTAS:"), "'Total de registros: ' || cast(n as varchar)"]
    if date_col:
        lines.append("'Período: ' || p0 || ' a ' || p1")
    lines.append(_sql_str("Columnas disponibles: " + ", ".join(columns)))
    if has_numeric:
        lines.append(f"{nl} || 'ESTADÍSTICAS NUMÉRICAS:'")
        for i, c in enumerate(stats):
            lines.append(f"'{c}: Min=' || cast(mn{i} as varchar) || ', Max=' || cast(mx{i} as varchar) || "
                         f"', Promedio=' || cast(me{i} as varchar) || ', Total=' || cast(sm{i} as varchar)")
    with_items = ""
    if texts:
        lines.append(f"{nl} || 'CATEGORÍAS PRINCIPALES:'")
        for c in texts:
            lines.append(f"'{c}: ' || coalesce((select items from items where \"column\" = {_sql_str(c)}), '')")
        with_items = f""", tv as ({_sql_top_values(table, texts)}),
items as (select "column", string_agg(value || ' (' || cast(n as varchar) || ')', ', ' order by rank) items from tv group by 1)"""
    body = f" || {nl} || ".join(lines)
    return f"with s as (select {', '.join(aggs)} from {table}){with_items}\nselect {body} as summary from s"


def _sql_event_line() -> str:
    return ("regexp_replace('Orden ' || cast(event_id as varchar) || ': ' || 'Fecha: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ', ' "
            "|| 'Producto: ' || event_type || ', ' || 'Total: $' || cast(cast(value as decimal(38,2)) as varchar) || ', ', '[, ]+$', '')")


def _sql_chunks() -> str:
    return f"""with l as (select cast(row_number() over (order by event_id) - 1 as bigint) i, {_sql_event_line()} line from events)
select cast(floor(i / 50) as bigint) chunk_id, min(i) start_row, max(i) end_row, count(*) num_rows,
  'CHUNK DE DATOS (filas ' || cast(min(i) as varchar) || ' a ' || cast(max(i) as varchar) || '):' || chr(10)
  || string_agg(line, chr(10) order by i) page_content
from l group by 1"""


def _sql_intent(q: str) -> str:
    """The intent rule, written out."""
    explicit = f"regexp_matches({q}, 'gráfico|grafico|chart|plot|visualiza|muestra|dibuja')"
    gate = (f"regexp_matches({q}, 'ventas.*por.*ciudad|productos.*más.*vendidos|top.*[0-9]+|ranking|distribución.*por"
            f"|comparar.*ventas')")
    bar = "barra|comparar.*por|distribución.*por|ventas.*por.*ciudad|ventas.*por.*producto|por.*manager|ranking|top.*[0-9]+"
    line = "línea|tendencia|evolución|a lo largo del tiempo|por.*fecha|por.*mes|histórico"
    pie = "gráfico de pastel|gráfico circular|pie|proporción|porcentaje.*de|distribución.*total"
    scatter = "dispersión|scatter|correlación|relación.*entre|precio.*vs.*cantidad|vs[.]|contra"
    return (f"case when not ({explicit} or {gate}) then null when regexp_matches({q}, '{bar}') then 'bar' "
            f"when regexp_matches({q}, '{line}') then 'line' when regexp_matches({q}, '{pie}') then 'pie' "
            f"when regexp_matches({q}, '{scatter}') then 'scatter' when {explicit} then 'bar' end")


_EVENTS_SUMMARY = _sql_summary("events", EVENTS_COLUMNS, "ts", ["value"], ["event_type", "props"], True)
_QUESTIONS = """(select conv_id, turn, text, lower(text) q from (
  select conv_id, turn, case when ((conv_id * 7 + turn) % 11 + 11) % 11 = 0 then '  ' else replace(
    ['Muestra un gráfico de barras por {}', 'Haz un gráfico circular de {}', '¿Cuál es la tendencia? Muestra {} por mes',
     'Dibuja la relación entre {} y cantidad', 'Quiero un chart de {}', 'top 5 {}', 'ventas de {} por ciudad',
     '¿Cuántos {} hay?', 'Comparar {} por manager', 'gráfico de {} vs. precio'][((conv_id + turn) % 10 + 10) % 10 + 1], '{}', word) end as text
  from (select conv_id, turn, role || ' ' || text word from conversations
        union all select cast(-1 as bigint), p_partkey, p_name from part)))"""

ORACLE.update({
    "summary_numeric": _sql_numeric_summary("lineitem", LINEITEM_NUMERIC),
    "summary_period": "select min(o_orderdate) period_start, max(o_orderdate) period_end from orders",
    "summary_top5": _sql_top_values("orders", ["o_orderstatus", "o_orderpriority"]),
    "dataset_summary_text": _sql_summary("orders", ORDERS_COLUMNS, "o_orderdate", ["o_totalprice"],
                                         ["o_orderstatus", "o_orderpriority"], True),
    "dataset_info": "select count(*) n_rows, cast(11 as integer) n_cols, "
                    "'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
                    "l_tax, l_returnflag, l_linestatus, l_shipdate' as columns, "
                    "(select string_agg(column_name || ' ' || case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' "
                    "when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' when 'DATE' then 'date' when 'TIMESTAMP' then 'timestamp_ntz' end, "
                    "', ' order by column_index) from duckdb_columns() where table_name = 'lineitem') as types from lineitem",
    "preview_head": "select * from events order by event_id limit 10",
    "profile_columns": "\nunion all\n".join(
        f"select '{c}' as \"column\", count({c}) n_values, count(case when regexp_matches("
        f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then 1 end) n_numeric from documents"
        for c in ["text", "lang", "source"]),
    "clean_strip": "select c_custkey, regexp_replace(chr(9) || ' ' || c_mktsegment || '  x  ', '^\\s+|\\s+$', '', 'g') c_mktsegment from customer",
    "clean_null_label": "select coalesce(nullif(event_type, 'error'), 'nan') event_type, count(*) value from events group by 1",
    "clean_date_dayfirst": "select o_orderkey, try_strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y') order_date from orders",
    "clean_date_cascade": """select o_orderkey, coalesce(try_strptime(s, '%d-%m-%Y'), try_strptime(s, '%Y/%m/%d')) order_date
from (select o_orderkey, case when o_orderstatus = 'F' then strftime(o_orderdate, '%d-%m-%Y') else strftime(o_orderdate, '%Y/%m/%d') end s from orders)""",
    "clean_numeric": """select doc_id, source, cast(regexp_replace(source, 'src', '') as bigint) source_num,
  case when lang = 'en' then null else cast(regexp_replace(source, 'src', '') as double) end source_mixed from documents""",
    "derive_total": "select l_orderkey, l_linenumber, round(cast(l_extendedprice as double) * cast(l_quantity as double), 2) total from lineitem",
    "derive_total_fractions": "select l_orderkey, l_linenumber, cast(round(cast(cast(l_extendedprice / 1000 * l_discount as varchar) as decimal(38,18)), 2) as double) total from lineitem",
    "render_sales_rows": """select l_orderkey, l_linenumber, 'Orden ' || l_orderkey || ': Producto: ' || l_returnflag || ', Precio: $'
  || cast(l_extendedprice * 1000 + 0.5 as varchar) || ', Cantidad: ' || l_linenumber
  || ', Total: $' || printf('%.2f', (l_extendedprice * 1000 + 0.5) * l_linenumber) line from lineitem""",
    "row_index": "select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) row_idx from orders",
    "render_rows": f"select event_id, {_sql_event_line()} line from events",
    "chunk_rows": _sql_chunks(),
    "corpus_docs": f"""with ev_summary as ({_EVENTS_SUMMARY}), ch as ({_sql_chunks()})
select cast(0 as bigint) doc_id, 'dataset_summary' doc_type, cast(null as bigint) chunk_id, cast(null as bigint) start_row,
  cast(null as bigint) end_row, cast(null as bigint) num_rows, (select count(*) from events) total_rows,
  {_sql_str(', '.join(EVENTS_COLUMNS))} as columns, summary page_content from ev_summary
union all
select chunk_id + 1, 'data_chunk', chunk_id, start_row, end_row, num_rows, cast(null as bigint), cast(null as varchar), page_content from ch""",
    "corpus_counts": "select 'dataset_summary' doc_type, cast(1 as bigint) n_docs union all "
                     "select 'data_chunk', count(distinct floor(i / 50)) from "
                     "(select row_number() over (order by event_id) - 1 i from events)",
    "top_products": f"""select p_name, {_sql_exact('l_quantity')} as value from lineitem join part on l_partkey = p_partkey
where p_name is not null group by 1 order by value desc, p_name limit 10""",
    "top_n": f"""select p_name, {_sql_exact('l_quantity')} as value from lineitem join part on l_partkey = p_partkey
where p_name is not null group by 1 order by value desc, p_name limit 5""",
    "best_seller": f"""select p_name, {_sql_exact('l_quantity')} as value from lineitem join part on l_partkey = p_partkey
where p_name is not null group by 1 order by value desc, p_name limit 1""",
    "monthly_trend": f"""select cast(date_trunc('month', o_orderdate) as timestamp) month_start, {_sql_exact('o_totalprice')} as value
from orders where o_orderdate is not null group by 1 order by 1""",
    "avg_by_category": f"""select l_returnflag, {_sql_exact('l_quantity')} / count(l_quantity) avg_value, count(l_quantity) n
from lineitem where l_returnflag is not null group by 1 order by 1""",
    "avg_fractions": f"""select l_returnflag, {_sql_exact('l_discount * l_tax / 100000', 100)} / count(*) avg_value, count(*) n
from lineitem where l_returnflag is not null group by 1 order by 1""",
    "overall_avg": f"select {_sql_exact('l_extendedprice')} / count(l_extendedprice) avg_value, count(l_extendedprice) n from lineitem",
    "compare_regions": f"""select r_name, {_sql_exact('o_totalprice')} as value from orders
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by 1 order by value desc, r_name""",
    "source_snippet": "select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end snippet from documents",
    "store_name": "select page_id, 'streamlit_' || substring(md5(url), 1, 8) store_name from pages",
    "chart_intent": f"select conv_id, turn, {_sql_intent('q')} chart_type from {_QUESTIONS}",
    "chart_record": f"""select conv_id, turn, chart_type, chart_type is not null and chart_type <> 'scatter' chart_generated,
  substring(md5(text), 1, 12) chart_id,
  case when chart_type <> 'scatter' then (case chart_type when 'bar' then 'bar_chart' when 'line' then 'line_chart'
    else 'pie_chart' end) || '_' || substring(md5(text), 1, 12) || '.png' end chart_filename, 'out/charts/' || chart_filename chart_path,
  case when chart_type = 'scatter' then 'a scatter plot needs two numeric columns; numeric: [''r_regionkey'']' end error
from (select conv_id, turn, text, {_sql_intent('q')} chart_type from {_QUESTIONS})""",
})


# ---------------------------------------------------------------------------------------
# Vector search, retrieval context, store, batch questions
# ---------------------------------------------------------------------------------------
from .operators import qa, search  # noqa: E402
from .plans.ask import ask_batch, search_similar  # noqa: E402
from .plans.chart_batch import chart_batch  # noqa: E402
from .session import materialise, scratch_path, small  # noqa: E402
from .sources import store as store_mod  # noqa: E402



def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def q_retrieve_batch(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    hits = search.knn(e, e, qa.ASK_K, corpus_id="vec_id", query_id="vec_id")
    return hits.select("query_id", "rank", F.col("doc_id").alias("vec_id"), F.round("dist", 5).alias("dist"))


def q_search_similar(spark, sf_dir):
    """The 5 vectors nearest to the corpus centroid (the most typical documents)."""
    e = _vectors(spark, sf_dir)
    q = search.centroid(e).select(F.lit(0).cast("bigint").alias("query_id"), "embedding")
    hits = search.knn(e, q, qa.SEARCH_K, corpus_id="vec_id")
    return (hits.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
            .select("rank", F.col("doc_id").alias("vec_id"), "label", F.round("dist", 5).alias("dist")))


def q_stuff_context(spark, sf_dir):
    from pyspark.sql import Window
    c = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.char_length("text").desc(), F.col("turn").asc())
    ranked = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= qa.ASK_K)
    return qa.stuff_context(ranked, ["conv_id"], "rank", "text").select(
        "conv_id", F.md5("context").alias("context_md5"))


def q_build_prompt(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(qa.build_prompt(F.col("text"), F.col("role"))).alias("prompt_md5"))


def _doc_corpus(spark, sf_dir, counted=False):
    """``counted``: only whether there is a text, for counts of stores (a join would send whole texts)."""
    d = read_table(spark, sf_dir, "documents")
    if counted:
        d = d.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("")))
    e = read_table(spark, sf_dir, "embeddings")
    # the map is made before the join: Spark moves no filter on documents through a map
    d = d.select("doc_id", F.col("text").alias("page_content"), F.col("source").alias("store_name"),
                 F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return d.join(e, d["doc_id"] == e["vec_id"], "left").select("doc_id", "page_content", "store_name", "metadata", "embedding")


def q_stores_available(spark, sf_dir):
    return store_mod.available_stores(_doc_corpus(spark, sf_dir))


def q_store_roundtrip(spark, sf_dir):
    base = scratch_path(spark, "store")
    store_mod.write_store(_doc_corpus(spark, sf_dir), base)
    back = store_mod.read_store(spark, base)
    return back.select("store_name", "doc_id", F.md5("page_content").alias("content_md5"),
                       F.size("embedding").cast("bigint").alias("n_dims"))


def q_store_read(spark, sf_dir):
    """One store out of all, read through its partition."""
    base = scratch_path(spark, "store")
    store_mod.write_store(_doc_corpus(spark, sf_dir), base)
    one = store_mod.load_store(spark, base, "src0")
    return one.select("store_name", "doc_id", F.md5("page_content").alias("content_md5"), F.variant_get("metadata", "$.lang", "string").alias("lang"))


def q_store_list(spark, sf_dir):
    base = scratch_path(spark, "store")
    store_mod.write_store(_doc_corpus(spark, sf_dir), base)
    return store_mod.list_stores(spark, base)


def _vector_questions(spark, sf_dir):
    """Every stored vector asks a question (a template filled with its document) to its own store;
    some questions are blank, some name a store that does not exist."""
    d = read_table(spark, sf_dir, "documents")
    e = read_table(spark, sf_dir, "embeddings")
    text = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TEMPLATES]), (F.pmod("vec_id", F.lit(10)) + 1).cast("int"))
    question = F.replace(text, F.lit("{}"), F.col("text"))
    ids = e.select(F.col("vec_id").alias("_vec")).distinct()
    if small(ids):      # texts of documents without a vector are left out before the join
        d = d.join(F.broadcast(ids), F.col("doc_id") == F.col("_vec"), "left_semi")
    return e.join(d, e["vec_id"] == d["doc_id"]).select(
        F.col("vec_id").alias("question_id"),
        F.when(F.pmod("vec_id", F.lit(11)) == 0, F.lit(" \t")).otherwise(question).alias("question"),
        F.when(F.pmod("vec_id", F.lit(7)) == 3, F.concat(F.lit("old_"), "source")).otherwise(F.col("source")).alias("store_name"),
        "embedding")


def q_ask_batch(spark, sf_dir):
    questions = materialise(_vector_questions(spark, sf_dir), "questions")     # read by the charts and the answers
    res = ask_batch(questions, _doc_corpus(spark, sf_dir), stores=store_mod.available_stores(_doc_corpus(spark, sf_dir, counted=True)),
                    charts=chart_batch(questions, read_table(spark, sf_dir, "lineitem")))
    return res.select(
        "question_id", "store_name", F.col("n_sources").cast("bigint").alias("n_sources"),
        F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"),
        F.md5(F.array_join(F.transform("sources", lambda s: s["content"]), "\u0001")).alias("sources_md5"),
        F.md5(F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["metadata"]["lang"], s["metadata"]["source"])), ","))
        .alias("metadata_md5"),
        "answer", "chart_type", "chart_filename", "chart_generated", "error", "chart_key", F.col("chart")["title"].alias("chart_title"),
        F.array_join(F.transform(F.col("chart")["bars"], lambda b: b["label"]), "|").alias("chart_labels"),
        F.aggregate(F.col("chart")["bars"], F.lit(0.0), lambda a, b: a + b["value"]).alias("chart_total"), "chart_note")


def q_embed_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    model = search.fit_text_embedder(d, "text")
    out = search.embed_text(model, d.select("doc_id", "text"), "text")
    at = F.filter(F.transform("embedding", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return out.select("doc_id", F.size(at).cast("bigint").alias("n_terms"), F.md5(F.array_join(at, ",")).alias("places_md5"),
                      F.round(F.array_max("embedding").cast("double"), 3).alias("largest"))


def _text_store(spark, sf_dir):
    """documents as one store, indexed once and written to the shared folder: (embedder, base folder)."""
    d = read_table(spark, sf_dir, "documents")
    docs = d.select("doc_id", F.col("text").alias("page_content"),
                    F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
                    F.lit("documents").alias("store_name"))
    model, embedded, release = search.fit_and_embed(docs, "page_content")
    base = scratch_path(spark, "stores")
    store_mod.write_store(embedded, base)
    release()
    return model, base


def q_search_text(spark, sf_dir):
    """The 5 documents nearest to the longest text of the benchmark; an unknown store adds nothing."""
    model, base = _text_store(spark, sf_dir)
    items = read_table(spark, sf_dir, "benchmark")
    text = items.orderBy(F.length("text").desc(), "item_id").first()["text"]
    found = search_similar(spark, base, "documents", text, model).unionByName(search_similar(spark, base, "no_store", text, model))
    return found.select("rank", "doc_id", F.md5("content").alias("content_md5"), F.variant_get("metadata", "$.lang", "string").alias("lang"),
                        F.round("dist", 3).alias("dist"))


def q_ask_text_batch(spark, sf_dir):
    """Every conversation turn asked against the documents store, vectors from hashed TF-IDF."""
    model, base = _text_store(spark, sf_dir)
    turns = read_table(spark, sf_dir, "conversations")
    # one id per (conversation, turn): the turn in the low 32 bits
    qs = turns.select((F.col("conv_id") * F.lit(1 << 32) + F.col("turn")).alias("question_id"),
                      F.col("text").alias("question"), F.lit("documents").alias("store_name"))
    res = ask_batch(search.embed_text(model, qs, "question"), store_mod.read_store(spark, base),
                    stores=store_mod.list_stores(spark, base))
    return res.select("question_id", "store_name", F.col("n_sources").cast("bigint").alias("n_sources"),
                      F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"),
                      F.md5(F.array_join(F.transform("sources", lambda s: s["content"]), "\u0001")).alias("sources_md5"),
                      "chart_type", "error")


QUERIES.update({
    "retrieve_batch": q_retrieve_batch,
    "search_similar": q_search_similar,
    "stuff_context": q_stuff_context,
    "build_prompt": q_build_prompt,
    "stores_available": q_stores_available,
    "store_roundtrip": q_store_roundtrip,
    "store_read": q_store_read,
    "store_list": q_store_list,
    "search_text": q_search_text,
    "ask_batch": q_ask_batch,
    "embed_text": q_embed_text,
    "ask_text_batch": q_ask_text_batch,
})


def _sql_dist(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda s: (s[1]::double - s[2]::double) * (s[1]::double - s[2]::double)))")


def _sql_prompt(context: str, question: str) -> str:
    """The answer prompt, written out."""
    head = _sql_str("""Eres un analista de datos experto que ayuda a responder preguntas sobre datasets tabulares.

CONTEXTO DE DATOS:
""")
    mid = _sql_str("""

INSTRUCCIONES:
1. Analiza cuidadosamente los datos proporcionados en el contexto
2. Responde la pregunta basándote ÚNICAMENTE en la información disponible
3. Si los datos contienen información relevante, proporciona una respuesta clara y específica
4. Incluye números, fechas y detalles específicos cuando sea posible
5. Si la información no está disponible en los datos, indica claramente que no puedes responder
6. Cita las columnas o filas relevantes cuando sea apropiado

PREGUNTA: """)
    return f"({head} || {context} || {mid} || {question} || chr(10) || chr(10) || 'RESPUESTA:')"


def _sql_snippet(t: str) -> str:
    return f"(case when length({t}) > 200 then substring({t}, 1, 200) || '...' else {t} end)"


def _sql_vectors(name: str, id_col: str, text: str, table: str) -> str:
    """Term counts of a text column by place: (id, j, tf)."""
    return f"""{name}_t as (select {id_col} id, unnest(list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) w from {table}),
  {name}_f as (select id, cast('0x' || substring(md5(w), 25, 8) as bigint) % 512 j, count(*) tf from {name}_t group by all)"""


def _sql_scaled(name: str) -> str:
    """Normalised TF-IDF: (id, j, x), with idf(j) from ``idf``."""
    return f"""{name}_x as (select id, j, tf * idf x from {name}_f join idf using (j) where idf > 0),
  {name} as (select id, j, x / sqrt(sum(x * x) over (partition by id)) x from {name}_x)"""


_DOC_VECTORS = f"""{_sql_vectors('d', 'doc_id', 'text', 'documents')},
  idf as (select j, ln(((select count(*) from documents) + 1) / (count(*) + 1.0)) idf from d_f group by j),
  {_sql_scaled('d')}"""

ORACLE["embed_text"] = f"""with {_DOC_VECTORS}
select doc_id, cast(coalesce(n, 0) as bigint) n_terms, md5(coalesce(places, '')) places_md5, round(coalesce(largest, 0.0), 3) largest
from documents left join (select id, count(*) n, string_agg(cast(j as varchar), ',' order by j) places, max(x) largest from d group by id)
  on id = doc_id"""


_FLAGS = f"""select x, label, count(*) n, {_sql_exact('v')} as value from (
  select 'l_returnflag' x, l_returnflag label, l_quantity v from lineitem union all select 'l_linestatus', l_linestatus, l_quantity from lineitem)
  where label is not null group by x, label"""

ORACLE.update({
    "search_text": f"""with {_DOC_VECTORS},
  one as (select 0 item, text from benchmark order by length(text) desc, item_id limit 1),
  {_sql_vectors('q', 'item', 'text', 'one')}, {_sql_scaled('q')},
  dot as (select d.id doc_id, sum(d.x * q.x) s from d join q using (j) group by 1),
  r as (select doc_id, text, lang, 2 - 2 * coalesce(s, 0) dist, row_number() over (order by round(2 - 2 * coalesce(s, 0), 6), doc_id) rk
        from documents left join dot using (doc_id))
select rk rank, doc_id, md5(text) content_md5, lang, round(dist, 3) dist from r where rk <= 5""",
    "retrieve_batch": f"""
with d as (select q.vec_id query_id, e.vec_id, {_sql_dist('e.embedding', 'q.embedding')} dist from embeddings q, embeddings e),
     r as (select query_id, vec_id, dist, row_number() over (partition by query_id order by dist, vec_id) rk from d)
select query_id, cast(rk as bigint) rank, vec_id, round(dist, 5) dist from r where rk <= 3""",
    "search_similar": f"""
with dims as (select i, avg(cast(embedding[i] as double)) m from embeddings, range(1, 1 + (select max(len(embedding)) from embeddings)) t(i) group by i),
     q as (select list(m order by i) embedding from dims),
     d as (select e.vec_id, e.label, {_sql_dist('e.embedding', 'q.embedding')} dist from embeddings e, q),
     r as (select vec_id, label, dist, row_number() over (order by dist, vec_id) rk from d)
select cast(rk as bigint) rank, vec_id, label, round(dist, 5) dist from r where rk <= 5""",
    "stuff_context": """
with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by length(text) desc, turn) rk from conversations)
select conv_id, md5(string_agg(text, chr(10) || chr(10) order by rk)) context_md5 from r where rk <= 3 group by 1""",
    "build_prompt": f"select conv_id, turn, md5({_sql_prompt('text', 'role')}) prompt_md5 from conversations",
    "stores_available": """
select d.source store_name, count(d.text) n_docs, count(e.embedding) n_vecs
from documents d left join embeddings e on d.doc_id = e.vec_id group by 1 having count(d.text) > 0 and count(e.embedding) > 0""",
    "store_roundtrip": """
select d.source store_name, d.doc_id, md5(d.text) content_md5, len(e.embedding) n_dims
from documents d left join embeddings e on d.doc_id = e.vec_id""",
    "store_read": "select source store_name, doc_id, md5(text) content_md5, lang from documents where source = 'src0'",
    "store_list": """
select d.source store_name, count(d.text) n_docs, count(e.embedding) n_vecs
from documents d left join embeddings e on d.doc_id = e.vec_id group by 1 having count(d.text) > 0 and count(e.embedding) > 0""",
    "ask_batch": f"""
with corpus as (select d.doc_id, d.text page_content, d.source store_name, d.lang, e.embedding
                from documents d join embeddings e on d.doc_id = e.vec_id),
     q0 as (select e.vec_id question_id, case when e.vec_id % 11 = 0 then ' ' || chr(9) else replace(
              ['Muestra un gráfico de barras por {{}}', 'Haz un gráfico circular de {{}}', '¿Cuál es la tendencia? Muestra {{}} por mes',
               'Dibuja la relación entre {{}} y cantidad', 'Quiero un chart de {{}}', 'top 5 {{}}', 'ventas de {{}} por ciudad',
               '¿Cuántos {{}} hay?', 'Comparar {{}} por manager', 'gráfico de {{}} vs. precio'][e.vec_id % 10 + 1],
              '{{}}', d.text) end question,
              case when e.vec_id % 7 = 3 then 'old_' || d.source else d.source end store_name, e.embedding
           from embeddings e join documents d on d.doc_id = e.vec_id),
     q as (select * from q0 where length(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) > 0),
     dist as (select q.question_id, c.doc_id, c.page_content, c.lang || '/' || c.store_name meta, {_sql_dist('c.embedding', 'q.embedding')} dist
              from q join corpus c on q.store_name = c.store_name),
     r as (select *, row_number() over (partition by question_id order by dist, doc_id) rk from dist),
     agg as (select question_id, count(*) n_sources,
                    string_agg(page_content, chr(10) || chr(10) order by rk) context,
                    md5(string_agg({_sql_snippet('page_content')}, chr(1) order by rk)) sources_md5,
                    md5(string_agg(meta, ',' order by rk)) metadata_md5
             from r where rk <= 3 group by 1),
     flags as ({_FLAGS}),
     k as (select *, {_sql_intent('lower(question)')} chart_type, question_id % 7 = 3 lost from q)
select k.question_id, k.store_name, cast(coalesce(agg.n_sources, 0) as bigint) n_sources, md5(agg.context) context_md5,
       md5({_sql_prompt('agg.context', 'k.question')}) prompt_md5, coalesce(agg.sources_md5, md5('')) sources_md5,
       coalesce(agg.metadata_md5, md5('')) metadata_md5,
       case when lost then 'Error: No se pudo cargar el dataset especificado.' end answer, chart_type,
       chart_filename, not lost and chart_type is not null chart_generated,
       case when lost then 'Vector store ' || chr(39) || store_name || chr(39) || ' no encontrado' end error,
       case when not lost then c.chart_key end chart_key, case when not lost then c.title end chart_title,
       case when not lost and chart_type is not null then coalesce(array_to_string(c.labels, '|'), '') end chart_labels,
       case when not lost and chart_type is not null then coalesce(c.total, 0.0::double) end chart_total,
       case when not lost then chr(10) || chr(10) || '📊 Gráfico generado: ' || chart_filename end chart_note
from (select *, case chart_type when 'bar' then 'bar_chart' when 'line' then 'line_chart' when 'pie' then 'pie_chart'
         when 'scatter' then 'scatter_plot' end || '_' || substring(md5(question), 1, 12) || '.png' chart_filename,
        case when chart_type in ('bar', 'pie') then case when contains(lower(question), 'l_returnflag') then 'l_returnflag'
          when contains(lower(question), 'l_linestatus') then 'l_linestatus' else 'l_returnflag' end end x from k) k
left join agg on k.question_id = agg.question_id
left join (
  select 'bar' kind, x, 'bar/sum/' || x || '/l_quantity' chart_key, 'Distribución por ' || x title, list(label order by value desc, label) labels, sum(value) total
  from flags group by x
  union all select 'pie', x, 'pie/shares/' || x, 'Distribución por ' || x, list(label order by n desc, label), cast(sum(n) as double) from flags group by x
  union all select 'line', null, 'line/series/l_shipdate/l_extendedprice', 'Evolución de l_extendedprice en el Tiempo', [], 0
  union all select 'scatter', null, 'scatter/points/l_extendedprice/l_quantity', 'Relación entre l_extendedprice y l_quantity', [], 0) c
  on c.kind = chart_type and c.x is not distinct from k.x""",
})


# ---------------------------------------------------------------------------------------
# CSV source, ingest, dispatch
# ---------------------------------------------------------------------------------------
from .plans.ingest import ingest_csv  # noqa: E402
from .sources import csv as csv_src  # noqa: E402

Q_PIE_PAYMENTS = "GRÁFICO CIRCULAR de pagos"


def _orders_csv(spark, sf_dir, date_fmt: str, date_name: str) -> str:
    """orders written by Spark as CSV text (padded labels, dates as text) into scratch."""
    o = read_table(spark, sf_dir, "orders")
    path = scratch_path(spark, "csv")
    (o.orderBy("o_orderkey")
     .select("o_orderkey", "o_custkey",
             F.concat(F.lit(" "), "o_orderstatus", F.lit("\t")).alias("o_orderstatus"),
             "o_totalprice", F.date_format("o_orderdate", date_fmt).alias(date_name), "o_orderpriority")
     .write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def q_scan_csv(spark, sf_dir):
    path = _orders_csv(spark, sf_dir, "dd-MM-yyyy", "o_orderdate")
    return csv_src.load_csv(spark, path, with_order=False)


def q_scan_csv_dates(spark, sf_dir):
    path = _orders_csv(spark, sf_dir, "MM-dd-yyyy", "Date")
    return csv_src.load_csv_for_charts(spark, path, with_order=False)


def q_scan_csv_typed(spark, sf_dir):
    """Truth values, month-first and two-digit-year dates, and file order, read back from text."""
    o = read_table(spark, sf_dir, "orders")
    path = scratch_path(spark, "csv")
    (o.orderBy(F.col("o_totalprice").desc(), "o_orderkey")
     .select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "True").otherwise("False").alias("even"),
             F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date"), F.date_format("o_orderdate", "dd/MM/yy").alias("short_date"),
             F.date_format("o_orderdate", "d MMM yyyy").alias("long_date"))
     .write.option("header", True).csv(path))
    table = csv_src.load_csv(spark, path)
    return with_row_index(table, csv_src.ORDER_KEY).drop(*csv_src.ORDER_KEY)


def q_scan_csv_line_breaks(spark, sf_dir):
    """Texts with line breaks and quotes, under names with dots, in files some of which have none."""
    c = read_table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "csv")
    texts = c.select(F.col("conv_id").alias("conv.id"), F.col("turn").alias("turn no."), "role",
                     F.concat(F.lit('"'), F.element_at(F.split("role", ""), 1), F.lit('", said:\n'), "text", F.lit('\n"')).alias("a.text"))
    flat = texts.withColumn("a.text", F.translate("`a.text`", '\n"', "  "))
    for name, rows in (("broken", texts.where("`turn no.` % 2 = 0")), ("flat", flat.where("`turn no.` % 2 = 1"))):
        rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/{name}")
    loaded = csv_src.load_csv(spark, [f"{path}/broken", f"{path}/flat"], with_order=False)
    return loaded.toDF("conv_id", "turn", "role", "text")


def _store_csv(spark, sf_dir, table: DataFrame) -> str:
    """A raw folder that holds ``table`` as the file of the store ``sales_data``."""
    raw = scratch_path(spark, "raw")
    table.write.option("header", True).csv(f"{raw}/sales-Data-Analysis.csv")
    return raw


def q_resolve_source(spark, sf_dir):
    """A question on a store without a table: its CSV file is found, loaded and drawn."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    spec, data = answer_chart(None, "Haz un gráfico de ventas", store_name="sales_data", raw_dir=_store_csv(spark, sf_dir, o), spark=spark)
    return data.withColumn("label", F.lit(spec.label()))


def q_line_by_file_order(spark, sf_dir):
    """A series by position follows the order of the file, not of its first column."""
    c = read_table(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").select("c_custkey", "c_mktsegment")
    _, data = answer_chart(None, "Muestra la tendencia", store_name="sales_data", raw_dir=_store_csv(spark, sf_dir, c), spark=spark)
    return data


def q_column_roles(spark, sf_dir):
    """The columns each kind of question gets from a loaded CSV, and how many questions ask for them."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.col("o_orderstatus").alias("type"),
                                                   "o_orderpriority")
    table = csv_src.resolve_source(spark, store_name="sales_data", raw_dir=_store_csv(spark, sf_dir, o))
    return chart_specs(_questions(spark, sf_dir), table).groupBy("chart_type", "x", "y", "mode").agg(F.count(F.lit(1)).alias("n"))


def q_ingest_job(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    path = scratch_path(spark, "csv")
    ev.orderBy("event_id").write.option("header", True).option("escape", '"').csv(path)
    stored = ingest_csv(spark, path, "events_data", base=scratch_path(spark, "stores"),
                        fields=EVENT_FIELDS, date_col="ts", stat_columns=["value"])
    held = {k: F.variant_get("metadata", f"$.{k}", t) for k, t in (
        ("type", "string"), ("chunk_id", "bigint"), ("start_row", "bigint"), ("end_row", "bigint"), ("num_rows", "bigint"), ("total_rows", "bigint"),
        ("columns", "array<string>"))}
    return stored.select("doc_id", held.pop("type").alias("doc_type"), F.md5("page_content").alias("content_md5"),
                         *[c.alias(k) for k, c in held.items() if k != "columns"], F.array_join(held["columns"], ", ").alias("columns"), F.schema_of_variant("metadata").alias("meta_schema"),
                         F.size("embedding").cast("bigint").alias("n_dims"))


def q_chart_dispatch(spark, sf_dir):
    return _chart(Q_PIE_PAYMENTS, "orders")(spark, sf_dir)


QUERIES.update({
    "scan_csv": q_scan_csv,
    "scan_csv_dates": q_scan_csv_dates,
    "scan_csv_typed": q_scan_csv_typed,
    "scan_csv_line_breaks": q_scan_csv_line_breaks,
    "resolve_source": q_resolve_source,
    "line_by_file_order": q_line_by_file_order,
    "column_roles": q_column_roles,
    "ingest_job": q_ingest_job,
    "chart_dispatch": q_chart_dispatch,
})

ORACLE.update({
    "scan_csv": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders",
    "scan_csv_dates": """select o_orderkey, o_custkey, ' ' || o_orderstatus || chr(9) o_orderstatus, o_totalprice,
  o_orderdate "Date", o_orderpriority from orders""",
    "scan_csv_typed": """
select o_orderkey, o_orderkey % 2 = 0 even, cast(date_trunc('day', o_orderdate) as timestamp) us_date, cast(date_trunc('day', o_orderdate) as timestamp) short_date,
  cast(date_trunc('day', o_orderdate) as timestamp) long_date,
  row_number() over (order by o_totalprice desc, o_orderkey) - 1 row_idx from orders""",
    "scan_csv_line_breaks": """
select conv_id, turn, role, regexp_replace(case when turn % 2 = 1 then translate(t, chr(10) || '"', '  ') else t end, '^\\s+|\\s+$', '', 'g') as text
from (select *, '"' || substring(role, 1, 1) || '", said:' || chr(10) || text || chr(10) || '"' as t from conversations)""",
    "resolve_source": f"""
select o_orderstatus, {_sql_exact('o_totalprice')} as value, 'Total o_totalprice' label
from orders where o_orderstatus is not null group by 1 order by value desc, 1 limit 10""",
    "line_by_file_order": "select row_number() over (order by c_acctbal desc, c_custkey) - 1 row_idx, c_custkey from customer",
    "column_roles": f"""
select chart_type, case chart_type when 'bar' then 'o_orderdate' when 'pie' then 'type' when 'line' then 'o_orderdate' when 'scatter' then 'o_totalprice' end x,
  case chart_type when 'bar' then 'o_totalprice' when 'line' then 'o_totalprice' when 'scatter' then 'o_totalprice' end y,
  case chart_type when 'bar' then 'sum' when 'pie' then 'shares' when 'line' then 'series' when 'scatter' then 'points' end "mode", count(*) n
from (select {_sql_intent('q')} chart_type from {_QUESTIONS}) group by all""",
    "chart_dispatch": """
with f as (select o_orderstatus k, count(*) n from orders where o_orderstatus is not null group by 1),
     r as (select k, n, row_number() over (order by n desc, k) rk from f),
     head as (select cast(rk as bigint) ord, k label, cast(n as bigint) n, false is_other from r where rk <= 8),
     rest as (select cast(9 as bigint) ord, 'Otros' label,
                     cast((select sum(n) from f) - (select coalesce(sum(n), 0) from head) as bigint) n, true is_other),
     u as (select * from head union all select * from rest where n > 0)
select ord, label, n, round(cast(100.0 as double) * n / (select sum(n) from f), 1) pct, is_other from u""",
})


# ---------------------------------------------------------------------------------------
# Chart specs for a question log
# ---------------------------------------------------------------------------------------
from .plans.chart import chart_specs  # noqa: E402


def q_chart_specs(spark, sf_dir):
    """Chart type and columns for every user turn, against the lineitem schema."""
    return chart_specs(_questions(spark, sf_dir), read_table(spark, sf_dir, "lineitem")).drop("question")


def _sql_chart_specs() -> str:
    """Of lineitem's two text columns the one that the question names, else the first."""
    x = "(case when contains(q, 'l_returnflag') then 'l_returnflag' when contains(q, 'l_linestatus') then 'l_linestatus' else 'l_returnflag' end)"
    return f"""select conv_id, turn, chart_type,
  case chart_type when 'bar' then {x} when 'line' then 'l_shipdate' when 'pie' then {x} when 'scatter' then 'l_extendedprice' end x,
  case chart_type when 'bar' then 'l_quantity' when 'line' then 'l_extendedprice' when 'scatter' then 'l_quantity' end y,
  case chart_type when 'bar' then 'sum' when 'line' then 'series' when 'pie' then 'shares' when 'scatter' then 'points' end "mode"
from (select conv_id, turn, q, {_sql_intent('q')} chart_type from {_QUESTIONS})"""


QUERIES["chart_specs"] = q_chart_specs
ORACLE["chart_specs"] = _sql_chart_specs()


_CSV_EVENTS = """(select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') ts, user_id, event_type, value,
  props from events)"""
_CSV_SUMMARY = _sql_summary(_CSV_EVENTS, EVENTS_COLUMNS, "ts", ["value"], ["ts", "event_type", "props"], True, date_text=True)
_CSV_LINE = _sql_event_line().replace("strftime(ts, '%Y-%m-%d %H:%M:%S')", "ts")

ORACLE["ingest_job"] = f"""
with su as ({_CSV_SUMMARY}),
  l as (select cast(row_number() over (order by event_id) - 1 as bigint) i, {_CSV_LINE} line from {_CSV_EVENTS}),
  ch as (select cast(floor(i / 50) as bigint) c, min(i) a, max(i) b, count(*) n, 'CHUNK DE DATOS (filas ' || min(i) || ' a ' || max(i) || '):' || chr(10)
           || string_agg(line, chr(10) order by i) t from l group by 1)
select cast(0 as bigint) doc_id, 'dataset_summary' doc_type, md5(summary) content_md5, cast(null as bigint) chunk_id, cast(null as bigint) start_row,
  cast(null as bigint) end_row, cast(null as bigint) num_rows, (select count(*) from events) total_rows, {_sql_str(', '.join(EVENTS_COLUMNS))} as columns,
  'OBJECT<columns: ARRAY<STRING>, total_rows: BIGINT, type: STRING>' as meta_schema, cast(512 as bigint) n_dims from su
union all
select c + 1, 'data_chunk', md5(t), c, a, b, n, null, null,
  'OBJECT<chunk_id: BIGINT, end_row: BIGINT, num_rows: BIGINT, start_row: BIGINT, type: STRING>', 512 from ch"""

ORACLE["ask_text_batch"] = f"""with {_DOC_VECTORS},
  turns as (select conv_id * 4294967296 + turn qid, text from conversations where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
  {_sql_vectors('q', 'qid', 'text', 'turns')}, {_sql_scaled('q')},
  dot as (select q.id qid, d.id doc_id, sum(d.x * q.x) s from d join q using (j) group by all),
  r as (select qid, doc_id, row_number() over (partition by qid order by round(2 - 2 * s, 6), doc_id) rk from dot),
  agg as (select qid, count(*) n, string_agg(text, chr(10) || chr(10) order by rk) context,
                 md5(string_agg({_sql_snippet('text')}, chr(1) order by rk)) sources_md5
          from r join documents using (doc_id) where rk <= 3 group by 1)
select qid question_id, 'documents' store_name, n n_sources, md5(context) context_md5,
       md5({_sql_prompt('context', 'turns.text')}) prompt_md5, sources_md5,
       {_sql_intent('lower(turns.text)')} chart_type, cast(null as varchar) error
from turns join agg using (qid)"""


# ---------------------------------------------------------------------------------------
# The charts of a batch of questions, drawn from one scan
# ---------------------------------------------------------------------------------------

def _column_questions(spark, sf_dir, columns: list[str]):
    """Every turn fills a template with its role, a column's name and its text."""
    c = read_table(spark, sf_dir, "conversations")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))
    word = F.concat_ws(" ", "role", pick(columns, F.col("conv_id")), "text")
    return c.select("conv_id", "turn", F.replace(pick(QUESTION_TEMPLATES, F.col("conv_id") + F.col("turn")), F.lit("{}"), word).alias("question"))


def q_ask_charts(spark, sf_dir):
    """Each question with the bars or slices, labels and trend of its chart of ``part``."""
    questions = _column_questions(spark, sf_dir, ["p_type", "p_brand", "p_name", "ventas"])
    answers = chart_batch(questions, read_table(spark, sf_dir, "part")).answers(questions)
    chart = F.col("chart")
    return answers.select("conv_id", "turn", "chart_type", "chart_key", *[chart[c].alias(c) for c in ("title", "xlabel", "ylabel", "pairs")],
                          F.round(chart["slope"], 8).alias("slope"), F.round(chart["intercept"], 6).alias("intercept"), "chart_error",
                          F.explode_outer(chart["bars"]).alias("bar")).select("*", "bar.*").drop("bar")


def q_chart_marks(spark, sf_dir):
    """All bars, slices and time points that a batch of questions asks of ``lineitem``."""
    questions = _column_questions(spark, sf_dir, ["l_linestatus", "l_returnflag"])
    return chart_batch(questions, read_table(spark, sf_dir, "lineitem")).marks


QUERIES.update({"ask_charts": q_ask_charts, "chart_marks": q_chart_marks})


def _sql_column_questions(columns: list[str]) -> str:
    return f"""(select conv_id, turn, text, lower(text) q from (select conv_id, turn, replace(
  ['Muestra un gráfico de barras por {{}}', 'Haz un gráfico circular de {{}}', '¿Cuál es la tendencia? Muestra {{}} por mes',
   'Dibuja la relación entre {{}} y cantidad', 'Quiero un chart de {{}}', 'top 5 {{}}', 'ventas de {{}} por ciudad',
   '¿Cuántos {{}} hay?', 'Comparar {{}} por manager', 'gráfico de {{}} vs. precio'][((conv_id + turn) % 10 + 10) % 10 + 1], '{{}}',
  role || ' ' || {columns}[(conv_id % {len(columns)} + {len(columns)}) % {len(columns)} + 1] || ' ' || text) as text from conversations))"""


ORACLE["ask_charts"] = f"""
with k as (select conv_id, turn, q, {_sql_intent('q')} as chart_type from {_sql_column_questions(['p_type', 'p_brand', 'p_name', 'ventas'])}),
kx as (select *, case chart_type
    when 'bar' then case when contains(q, 'p_name') then 'p_name' when contains(q, 'p_brand') then 'p_brand' when contains(q, 'p_type') then 'p_type' else 'p_name' end
    when 'pie' then case when contains(q, 'p_name') then 'p_name' when contains(q, 'p_brand') then 'p_brand' else 'p_type' end
    when 'line' then 'row_idx' when 'scatter' then 'p_retailprice' end as x from k),
long as (select 'p_name' as x, p_name as label, p_partkey as v from part union all select 'p_brand', p_brand, p_partkey from part
         union all select 'p_type', p_type, null from part),
g as (select x, label, count(*) as n, case when x = 'p_type' then cast(count(*) as double) else cast(coalesce(sum(v), 0) as double) end as value
      from long where label is not null group by x, label),
r as (select *, row_number() over (partition by x order by value desc, label) as bar, row_number() over (partition by x order by n desc, label) as slice,
      sum(n) over (partition by x) as rows from g),
marks as (select 'bar' as kind, x, bar as ord, label, value, null::double as pct, false as is_other from r where bar <= 10
          union all select 'pie', x, slice, label, cast(n as double), round(100.0::double * n / rows, 1), false from r where slice <= 8
          union all select 'pie', x, 9, 'Otros', cast(sum(n) as double), round(100.0::double * sum(n) / any_value(rows), 1), true from r where slice > 8 group by x),
fit as (select round(regr_slope(p_size, p_retailprice), 8) as slope, round(regr_intercept(p_size, p_retailprice), 6) as intercept,
        cast(regr_count(p_size, p_retailprice) as bigint) as pairs from part)
select conv_id, turn, chart_type,
  case chart_type when 'bar' then case when kx.x = 'p_type' then 'bar/count/p_type' else 'bar/sum/' || kx.x || '/p_partkey' end when 'pie' then 'pie/shares/' || kx.x
    when 'line' then 'line/index/row_idx/p_partkey' when 'scatter' then 'scatter/points/p_retailprice/p_size' end as chart_key,
  case when chart_type in ('bar', 'pie') then 'Distribución por ' || kx.x when chart_type = 'line' then 'Evolución de p_partkey'
    when chart_type = 'scatter' then 'Relación entre p_retailprice y p_size' end as title,
  case chart_type when 'bar' then kx.x when 'line' then 'Índice' when 'scatter' then 'p_retailprice' end as xlabel,
  case chart_type when 'bar' then case when kx.x = 'p_type' then 'Cantidad' else 'Total p_partkey' end when 'line' then 'p_partkey' when 'scatter' then 'p_size' end as ylabel,
  pairs, slope, intercept, null::varchar as chart_error, cast(ord as bigint) as ord, label, value, pct, is_other
from kx left join marks m on m.kind = chart_type and m.x = kx.x left join fit on chart_type = 'scatter'"""

ORACLE["chart_marks"] = f"""
with kinds as (select distinct {_sql_intent('q')} as kind, case when contains(q, 'l_returnflag') then 'l_returnflag' else 'l_linestatus' end as x
               from {_sql_column_questions(['l_linestatus', 'l_returnflag'])}),
flags as ({_FLAGS}),
r as (select *, row_number() over (partition by x order by value desc, label) as bar, row_number() over (partition by x order by n desc, label) as slice,
      sum(n) over (partition by x) as rows from flags)
select 'bar/sum/' || x || '/l_quantity' as chart_key, bar as ord, label, null::timestamp as at, value, null::double as pct, false as is_other
from r semi join (select x from kinds where kind = 'bar') using (x) where bar <= 10
union all select 'pie/shares/' || x, slice, label, null, cast(n as double), round(100.0::double * n / rows, 1), false
from r semi join (select x from kinds where kind = 'pie') using (x) where slice <= 8
union all select 'line/series/l_shipdate/l_extendedprice', null, null, l_shipdate, {_sql_exact('l_extendedprice')}, null, false
from lineitem where l_shipdate is not null and exists (select 1 from kinds where kind = 'line') group by l_shipdate"""
