"""The charts of a question batch from one scan, against the chart of each question."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cuadro.operators import charts as ops
from cuadro.plans import chart_batch as B
from cuadro.plans.ask import ask_batch
from cuadro.plans.chart import answer_chart, chart_specs

SCHEMA = "`Sale Date` timestamp_ntz, Product string, Color string, `unit.price` double, Quantity long"


def sales(spark, n=400):
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(days=i % 9) if i % 13 else None, f"product {i * i % 23}" if i % 7 else None, ["red", "blue", None][i % 3],
             i * 0.1 if i % 5 else None, (i % 4) if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


QUESTIONS = ["Muestra un gráfico de barras por product", "gráfico de barras por color", "Haz un gráfico circular de product",
             "gráfico circular de color", "Muestra la evolución por mes", "muestra precio vs. cantidad", "hola", "grafico de barras por product"]


def asked(spark, texts=QUESTIONS):
    return spark.createDataFrame(list(enumerate(texts)), "i int, question string")


def test_each_answer_is_its_single_chart(spark):
    df = sales(spark)
    batch = B.chart_batch(asked(spark), df)
    answers = {r["i"]: r for r in batch.answers(asked(spark)).collect()}
    marks = batch.marks.collect()
    for i, q in enumerate(QUESTIONS):
        spec, data = answer_chart(df, q)
        r = answers[i]
        if spec is None:
            assert r["chart"] is None and r["chart_key"] is None
            continue
        chart = r["chart"]
        assert (r["chart_type"], chart["title"], chart["xlabel"], chart["mode"]) == (spec.chart_type, spec.title, spec.xlabel, spec.mode)
        assert chart["ylabel"] == spec.label()
        own = [m for m in marks if m["chart_key"] == r["chart_key"]]
        if spec.chart_type == "bar":
            assert [(b["label"], b["value"]) for b in chart["bars"]] == [tuple(x) for x in data.collect()]
        elif spec.chart_type == "pie":
            want = [(x["ord"], x["label"], float(x["n"]), x["pct"], x["is_other"]) for x in data.orderBy("ord").collect()]
            assert [tuple(b) for b in chart["bars"]] == want
        elif spec.chart_type == "line":
            assert chart["bars"] == [] and sorted((m["at"], m["value"]) for m in own) == [tuple(x) for x in data.collect()]
        else:
            fit = ops.linear_trend(df, spec.columns["x"], spec.columns["y"]).first()
            assert (chart["slope"], chart["intercept"], chart["pairs"]) == (pytest.approx(fit["slope"]), pytest.approx(fit["intercept"]), fit["n"])


def test_the_table_is_scanned_once(spark, tmp_dir):
    path = f"{tmp_dir}/sales"
    sales(spark).write.parquet(path)
    df = spark.read.parquet(path)
    specs = [r for r in B.with_keys(asked(spark), df).where("chart_key is not null")
             .select("chart_key", "chart_type", "x", "y", "mode").distinct().collect()]
    assert len(specs) == 6
    plan = B._groups(df, specs)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == 1 and "Python" not in plan
    batch = B.chart_batch(asked(spark), df)
    for frame in (batch.marks, batch.charts):
        assert path not in frame._jdf.queryExecution().executedPlan().toString()


def test_zero_guard_and_labels(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", None), (None, 0.0)], "kind_of string, amount double")
    chart = B.chart_batch(asked(spark, ["gráfico de barras"]), df).charts.first()
    assert [(b["label"], b["value"]) for b in chart["bars"]] == [("a", 2.0), ("b", 1.0)] and chart["ylabel"] == "Cantidad"


def test_more_groups_than_bars_and_slices(spark):
    df = spark.createDataFrame([(f"k{i:02}", float(i)) for i in range(1, 30)], "name string, amount double")
    found = {c["chart_key"]: c["bars"] for c in B.chart_batch(asked(spark, ["gráfico de barras", "gráfico circular"]), df).charts.collect()}
    assert [b["label"] for b in found["bar/sum/name/amount"]] == [f"k{i}" for i in range(29, 19, -1)]
    pie = found["pie/shares/name"]
    assert len(pie) == 9 and pie[-1]["label"] == "Otros" and pie[-1]["value"] == 21.0 and pie[-1]["is_other"] and pie[0]["pct"] == 3.4


def test_series_by_position_and_errors(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "n long, name string")
    batch = B.chart_batch(asked(spark, ["Muestra la tendencia", "muestra precio vs. cantidad"]), df)
    assert [(m["ord"], m["value"]) for m in batch.marks.orderBy("ord").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]
    line, scatter = batch.answers(asked(spark, ["Muestra la tendencia", "muestra precio vs. cantidad"])).orderBy("i").collect()
    assert line["chart"]["mode"] == "index" and line["chart_error"] is None
    assert scatter["chart"] is None and "two numeric columns" in scatter["chart_error"]


def test_no_charts_asked(spark):
    batch = B.chart_batch(asked(spark, ["hola"]), sales(spark, 5))
    assert batch.marks.count() == 0 and batch.charts.count() == 0 and batch.answers(asked(spark, ["hola"])).first()["chart"] is None
    empty = B.chart_batch(asked(spark, ["gráfico de barras", "gráfico circular"]), sales(spark, 0))
    assert [c["bars"] for c in empty.charts.collect()] == [[], []]


def test_text_dates_are_read(spark):
    df = spark.createDataFrame([("03/02/2024", 1.0), ("03/02/2024", 2.5), ("04/02/2024", 4.0)], "fecha string, ventas double")
    rows = B.chart_batch(asked(spark, ["Muestra la evolución por mes"]), df).marks.orderBy("at").collect()
    assert [(r["at"].day, r["at"].month, r["value"]) for r in rows] == [(3, 2, 3.5), (4, 2, 4.0)]


def test_ask_batch_carries_the_chart(spark):
    corpus = spark.createDataFrame([(i, f"doc {i}", "docs", [float(i), 1.0]) for i in range(5)],
                                   "doc_id long, page_content string, store_name string, embedding array<float>")
    qs = spark.createDataFrame([(1, QUESTIONS[0], "docs", [1.0, 1.0]), (2, "hola", "docs", [0.0, 1.0]), (3, QUESTIONS[0], "nope", [1.0, 0.0])],
                               "question_id long, question string, store_name string, embedding array<float>")
    rows = {r["question_id"]: r for r in ask_batch(qs, corpus, charts=B.chart_batch(qs, sales(spark))).collect()}
    assert rows[1]["chart_generated"] and len(rows[1]["chart"]["bars"]) == 10
    assert rows[1]["chart_note"] == "\n\n📊 Gráfico generado: " + rows[1]["chart_filename"]
    assert rows[2]["chart"] is None and not rows[2]["chart_generated"] and rows[2]["chart_note"] is None
    assert rows[3]["chart"] is None and rows[3]["chart_note"] is None and rows[3]["error"]


def test_many_questions_share_a_chart_without_a_shuffle_of_them(spark):
    df = sales(spark)
    many = spark.range(1000).select(F.col("id").cast("int").alias("i"), F.lit(QUESTIONS[0]).alias("question"))
    answers = B.chart_batch(many, df).answers(many)
    assert "BroadcastHashJoin" in answers._jdf.queryExecution().executedPlan().toString()
    assert answers.where(F.size(F.col("chart.bars")) == 10).count() == 1000
    assert chart_specs(many, df).select("x").distinct().count() == 1
