"""CSV files with line breaks inside quotes, and names with dots."""

import os

import pytest
from pyspark.sql import functions as F

from cuadro.operators import charts, corpus, insights, profile
from cuadro.operators.rowindex import with_row_index
from cuadro.plans.chart import answer_chart
from cuadro.sources import csv as src


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_quoted_line_break_stays_in_its_field(spark, tmp_dir):
    path = put(tmp_dir, "a.csv", 'id,text,price\n1,"first\nsecond",5.5\n2,plain,6.5\n3,"a ""quoted""\n\nword, and more",7.0\n')
    df = src.load_csv(spark, path, with_order=False)
    assert rows(df) == [(1, "first\nsecond", 5.5), (2, "plain", 6.5), (3, 'a "quoted"\n\nword, and more', 7.0)]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double"]
    charted = src.load_csv_for_charts(spark, path, with_order=False)
    assert rows(charted) == rows(df)


def test_only_files_with_an_open_quote_are_read_whole(spark, tmp_dir):
    put(tmp_dir, "open [1] {x}.csv", 'a,b\n1,"x\ny"\n')
    put(tmp_dir, "plain 100%.csv", 'a,b\n2,"x ""y"" z"\n3,w\n')
    whole, split = src.files_by_quotes(spark, tmp_dir)
    assert len(whole) == 1 and "open" in whole[0] and len(split) == 1 and "plain" in split[0]
    df = src.scan_csv(spark, tmp_dir, with_order=False)
    assert rows(df) == [("1", "x\ny"), ("2", 'x "y" z'), ("3", "w")]


def test_file_order_over_both_kinds_of_files(spark, tmp_dir):
    for i in range(4):
        body = "".join(f'{10 * i + j},"t\n{j}"\n' if i % 2 else f"{10 * i + j},t{j}\n" for j in range(5))
        put(tmp_dir, f"part{i}.csv", "n,text\n" + body)
    df = with_row_index(src.load_csv(spark, tmp_dir), src.ORDER_KEY)
    assert [r["n"] for r in df.orderBy("row_idx").collect()] == [10 * i + j for i in range(4) for j in range(5)]


def test_line_break_in_the_header(spark, tmp_dir):
    path = put(tmp_dir, "h.csv", '"unit\nprice",b\n1,x\n')
    df = src.load_csv(spark, path, with_order=False)
    assert df.columns == ["unit\nprice", "b"] and rows(df) == [(1, "x")]


def test_a_longer_row_still_stops_the_load(spark, tmp_dir):
    path = put(tmp_dir, "long.csv", 'a,b\n1,"x\ny"\n2,"p\nq",3\n')
    with pytest.raises(Exception, match="more fields than the header"):
        src.scan_csv(spark, path, with_order=False).collect()


def test_choice_can_be_given(spark, tmp_dir):
    path = put(tmp_dir, "p.csv", "a,b\n1,x\n")
    assert rows(src.load_csv(spark, path, with_order=False, multi_line=False)) == rows(src.load_csv(spark, path, with_order=False, multi_line=True))


def test_empty_and_header_only_files(spark, tmp_dir):
    put(tmp_dir, "a.csv", "a,b\n")
    put(tmp_dir, "b.csv", "")
    assert src.load_csv(spark, tmp_dir, with_order=False).count() == 0


def test_names_with_dots(spark, tmp_dir):
    path = put(tmp_dir, "dots.csv", 'order.id,sale.date,product.name,unit.price,no. of items\n'
               '1,05-03-2024,lamp,2.5,3\n2,06-03-2024,chair,4.0,1\n3,06-03-2024,lamp,1.5,2\n')
    df = src.load_csv(spark, path)
    assert [t for _, t in df.drop(*src.ORDER_KEY).dtypes] == ["bigint", "timestamp_ntz", "string", "double", "bigint"]
    spec, data = answer_chart(df, "gráfico de barras por product.name")
    assert spec.columns["x"] == "product.name" and [r[0] for r in data.collect()] == ["lamp", "chair"]
    spec, data = answer_chart(df, "Muestra la evolución por mes")
    assert [r["value"] for r in data.collect()] == [2.5, 5.5] and spec.columns["x"] == "sale.date"
    assert charts.linear_trend(df, "unit.price", "no. of items").first()["n"] == 3
    assert charts.histogram(df, "unit.price").agg(F.sum("n")).first()[0] == 3
    assert charts.series_by_index(df, "unit.price", src.ORDER_KEY).count() == 3
    shown = df.drop(*src.ORDER_KEY)
    assert {r["column"] for r in profile.numeric_summary(shown).collect()} == {"order.id", "unit.price", "no. of items"}
    assert "unit.price: Min=1.50" in profile.dataset_summary(shown, date_col="sale.date", stat_columns=["unit.price"]).first()[0]
    assert profile.top_values(shown).where("rank = 1").first()["value"] == "lamp"
    assert insights.avg_by_category(shown, "product.name", "unit.price").collect()[1]["avg_value"] == 2.0
    fields = corpus.RowFields(id="order.id", date="sale.date", product="product.name", price="unit.price", quantity="no. of items")
    chunk = corpus.chunk_table(df, src.ORDER_KEY, fields).first()["page_content"]
    assert "Orden 1: Fecha: 2024-03-05 00:00:00, Producto: lamp, Precio: $2.5, Cantidad: 3, Total: $7.50" in chunk
