"""Chart aggregates on hand-made tables: ties, NULL keys, remainder label, zero guard, fits."""

import pytest

from pyspark.sql import functions as F

from cuadro.operators import charts
from cuadro.plans.chart import answer_chart, chart_trend


def test_ties_null_keys_and_empty_groups(spark):
    df = spark.createDataFrame(
        [("b", 1.0), ("a", 1.0), ("c", None), ("c", None), (None, 5.0), ("d", 2.0)], "k string, v double")
    counts = [tuple(r) for r in charts.bar_counts(df, "k").collect()]
    assert counts == [("c", 2), ("a", 1), ("b", 1), ("d", 1)]          # ties by key; NULL key dropped
    sums = [(r[0], float(r[1])) for r in charts.bar_sums(df, "k", "v").collect()]
    assert sums == [("d", 2.0), ("a", 1.0), ("b", 1.0), ("c", 0.0)]    # all-NULL group sums to 0


def test_zero_guard(spark):
    zero = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.0)], "k string, v double")
    assert [(r[0], float(r[1])) for r in charts.bar_sums(zero, "k", "v").collect()] == [("a", 2.0), ("b", 1.0)]
    neg = spark.createDataFrame([("a", -5.0), ("b", 1.0), ("b", 1.0)], "k string, v double")
    assert [(r[0], float(r[1])) for r in charts.bar_sums(neg, "k", "v").collect()] == [("b", 2.0), ("a", 1.0)]


def test_pie_remainder_and_real_otros(spark):
    keys = ["Otros"] * 10 + [f"k{i}" for i in range(12) for _ in range(12 - i)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    rows = [r.asDict() for r in charts.pie_shares(df, "k").orderBy("ord").collect()]
    assert len(rows) == 9 and rows[-1]["is_other"] and rows[-1]["label"] == "Otros"
    assert sum(r["n"] for r in rows) == len(keys)                       # shares cover all non-NULL rows
    real = [r for r in rows if r["label"] == "Otros" and not r["is_other"]]
    assert real and real[0]["n"] == 10                                   # a real 'Otros' stays separate
    assert abs(sum(r["pct"] for r in rows) - 100.0) < 0.5
    few = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r["label"] for r in charts.pie_shares(few, "k").orderBy("ord").collect()] == ["a", "b"]


def test_trend_pairwise_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 7.0), (4.0, 8.0)], "x double, y double")
    r = charts.linear_trend(df, "x", "y").first()
    assert r["n"] == 3 and r["slope"] == pytest.approx(2.0) and r["intercept"] == pytest.approx(0.0)
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert charts.linear_trend(const, "x", "y").first()["slope"] is None
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert charts.linear_trend(one, "x", "y").first()["slope"] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "v double")
    rows = charts.histogram(df, "v", 10).collect()
    assert sum(r["n"] for r in rows) == 5 and rows[-1]["bin"] == 9        # max lands in the last bin
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in charts.histogram(flat, "v").collect()] == [(0, 2)]


def test_dispatch_and_errors(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 4.5)], "product string, price double, quantity double")
    spec, data = answer_chart(df, "¿Qué producto se vende más?")
    assert spec is None and data is None
    spec, data = answer_chart(df, "muestra precio vs. cantidad")
    assert spec.chart_type == "scatter" and (spec.columns["x"], spec.columns["y"]) == ("price", "quantity")
    assert chart_trend(df, spec).first()["n"] == 2
    spec, data = answer_chart(df.select("price"), "Haz un gráfico de barras")
    assert spec.error and data is None
    spec, data = answer_chart(df, "Muestra la evolución por mes", order_by=["product"])
    assert spec.mode == "index" and [r["row_idx"] for r in data.collect()] == [0, 1]
    assert spec.file_name.startswith("line_chart_") and spec.file_name.endswith(".png")


def test_chart_labels(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0)], "product string, tipo string, price double, quantity double")
    spec, _ = answer_chart(df, "Haz un gráfico de barras")
    assert (spec.title, spec.xlabel, spec.ylabel) == ("Distribución por product", "product", "Total quantity")
    spec, _ = answer_chart(df, "GRÁFICO CIRCULAR de pagos")
    assert spec.title == "Distribución por tipo"
    spec, _ = answer_chart(df, "muestra precio vs. cantidad")
    assert spec.title == "Relación entre price y quantity"
    ts = spark.createDataFrame([("2022-11-07", 1.0)], "fecha string, ventas double")
    spec, data = answer_chart(ts, "Muestra la tendencia de ventas por mes")
    assert spec.title == "Evolución de ventas en el Tiempo" and spec.xlabel == "fecha"
    assert data.first()["fecha"].year == 2022


def test_sums_of_64_bit_ids_do_not_overflow(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([("a", big), ("a", big), ("b", 1)], "k string, id long")
    rows = [(r[0], int(r[1])) for r in charts.bar_sums(df, "k", "id").collect()]
    assert rows == [("a", 2 * big), ("b", 1)]


def test_batch_specs_agree_with_single_dispatch(spark):
    from cuadro.plans.chart import chart_specs
    from cuadro.plans.chart_batch import chart_batch
    from tests.test_intent import TRUTH
    import datetime as dt
    df = spark.createDataFrame(
        [(1, dt.datetime(2019, 3, 17), "Lamp", 8.25, 41.5, "Phone", "Voucher", "Ada", "Bergen")],
        "`Order ID` long, Date timestamp_ntz, Product string, Price double, Quantity double, "
        "`Purchase Type` string, `Payment Method` string, Manager string, City string")
    qs = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(TRUTH)] + [(99, "gráfico por manager")],
                               "i int, question string")
    rows = {r["i"]: r for r in chart_specs(qs, df).collect()}
    for i, r in rows.items():
        spec, _ = answer_chart(df, r["question"])
        if spec is None:
            assert r["chart_type"] is None
            continue
        assert r["chart_type"] == spec.chart_type
        if spec.chart_type == "line":
            assert (r["x"], r["y"], r["mode"]) == (spec.columns["x"], spec.columns["y"], spec.mode)
        elif spec.chart_type == "pie":
            assert r["x"] == spec.columns["x"]
        else:
            assert (r["x"], r["y"] if spec.mode != "count" else None) == \
                (spec.columns["x"], spec.columns["y"] if spec.mode != "count" else None)
    drawn = {(r["chart_key"].split("/")[0], r["x"], r["y"], r["mode"]) for r in chart_batch(qs, df).charts.collect()}
    assert drawn == {(r["chart_type"], r["x"], r["y"], r["mode"]) for r in rows.values() if r["chart_type"]}


def test_nan_is_missing(spark):
    from cuadro.operators import insights, profile
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 3.0)], "k string, v double")
    assert [(r[0], float(r[1])) for r in charts.bar_sums(df, "k", "v").collect()] == [("b", 3.0), ("a", 1.0)]
    s = profile.numeric_summary(df, ["v"]).first()
    assert (s["min"], s["max"], s["mean"]) == (1.0, 3.0, 2.0)
    assert insights.overall_avg(df, "v").first()["n"] == 2
    assert sum(r["n"] for r in charts.histogram(df, "v").collect()) == 2


def test_pie_ties_keep_key_order_for_numbers(spark):
    df = spark.createDataFrame([(k,) for k in [9, 10, 11]], "k int")
    assert [r["label"] for r in charts.pie_shares(df, "k").orderBy("ord").collect()] == ["9", "10", "11"]


def test_chart_records_with_path(spark):
    from cuadro.plans.chart import chart_records
    qs = spark.createDataFrame([("Haz un gráfico de barras",), ("hola",)], "question string")
    rows = {r["question"]: r for r in chart_records(qs, path_prefix="/charts").collect()}
    r = rows["Haz un gráfico de barras"]
    assert r["chart_generated"] and r["chart_path"] == "/charts/" + r["chart_filename"]
    assert r["chart_filename"] == f"bar_chart_{r['chart_id']}.png"
    assert rows["hola"]["chart_type"] is None and rows["hola"]["chart_filename"] is None


def test_sums_are_not_rounded_first(spark):
    rows = [("a", 0.004), ("a", 0.004), ("b", 0.003)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = [(r.k, round(r.value, 9), r.counted) for r in charts.bar_sums_labelled(df, "k", "v").collect()]
    assert got == [("a", 0.008, False), ("b", 0.003, False)]
    big = spark.createDataFrame([("a", 1e40), ("b", float("inf")), ("c", float("nan")), ("c", 1.0)], "k string, v double")
    assert [(r.k, r.value) for r in charts.bar_sums(big, "k", "v").collect()] == [("b", float("inf")), ("a", 1e40), ("c", 1.0)]
    from cuadro.operators import insights, profile
    assert abs(insights.overall_avg(df, "v").first().avg_value - 0.011 / 3) < 1e-12
    assert abs(profile.numeric_summary(df, ["v"]).first().total - 0.011) < 1e-12


def test_label_follows_the_zero_guard(spark):
    from cuadro.plans.chart import answer_chart
    zero = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.0)], "k string, v double")
    spec, data = answer_chart(zero, "gráfico de barras")
    assert spec.label() == "Cantidad" and [tuple(r) for r in data.collect()] == [("a", 2.0), ("b", 1.0)]
    spec, _ = answer_chart(zero.withColumn("v", F.col("v") + 0.001), "gráfico de barras")
    assert spec.label() == "Total v"


def test_one_scan_for_bars_and_shares(spark):
    from cuadro.session import read_table
    from tests.conftest import SF_SMALL
    from tools.plans import final_lines
    li = read_table(spark, SF_SMALL, "lineitem")
    for df in (charts.bar_sums(li, "l_returnflag", "l_quantity"), charts.pie_shares(li, "l_returnflag")):
        df.collect()
        final = "\n".join(final_lines(df._jdf.queryExecution().executedPlan().toString()))
        assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_hidden_columns_and_file_order(spark, tmp_dir):
    import os
    from cuadro.plans.chart import answer_chart
    folder = os.path.join(tmp_dir, "raw")
    os.makedirs(folder)
    with open(os.path.join(folder, "shop-Data-Analysis.csv"), "w") as f:
        f.write("name,amount\nz,3\na,1\nm,2\n")
    spec, data = answer_chart(None, "muestra la tendencia", store_name="shop_data", raw_dir=folder, spark=spark)
    assert [(r.row_idx, r.amount) for r in data.orderBy("row_idx").collect()] == [(0, 3), (1, 1), (2, 2)]
    spec, data = answer_chart(None, "dispersión, muestra", store_name="shop_data", raw_dir=folder, spark=spark)
    assert data is None and "two numeric" in spec.error           # the position of a row is no number to draw
    spec, data = answer_chart(None, "muestra barras", store_name="none_data", raw_dir=os.path.join(tmp_dir, "nowhere"), spark=spark)
    assert data is None and spec.error
