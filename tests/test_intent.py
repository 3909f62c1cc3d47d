"""Chart intent truth table (questions from the reference's demos, UI and README)."""

import pytest

from cuadro.functions.intent import chart_intent, detect_chart_intent, requested_top_n

TRUTH = [
    ("Muestra un gráfico de ventas por ciudad", "bar"),
    ("¿Cuáles son los productos más vendidos? Haz un gráfico", "bar"),
    ("Gráfico de líneas de ventas en el tiempo", "line"),
    ("Distribución porcentual por producto", "bar"),
    ("Relación entre precio y cantidad", None),
    ("Genera un gráfico para conocer cuántos hombres y mujeres han sido arrestados", "bar"),
    ("Muestra la distribución de ventas por región", "bar"),
    ("¿Cuál es la tendencia de ventas en los últimos meses?", None),
    ("Genera un gráfico de barras para las categorías de productos", "bar"),
    ("Muestra la tendencia de ventas por mes", "line"),
    ("Analiza la distribución por género", "bar"),
    ("Crea un histograma de los precios", None),
    ("Compara las ventas entre regiones", None),
    ("¿Cuáles son los productos más vendidos?", None),
    ("Muestra la evolución de las ventas por mes", "line"),
    ("¿Cuál es el promedio de ventas por categoría?", None),
    ("Haz un gráfico de barras de los top 5 productos", "bar"),
    ("¿Cuál es el promedio de ventas?", None),
    ("¿Qué producto se vende más?", None),
    ("Muestra la evolución por mes", "line"),
    ("Haz un gráfico de barras", "bar"),
    ("GRÁFICO CIRCULAR de pagos", "pie"),
    ("muestra precio vs. cantidad", "scatter"),
    ("comparar ventas por año", "bar"),
    ("comparar ventas", None),
]


@pytest.mark.parametrize("question,expected", TRUTH)
def test_driver_side(question, expected):
    assert detect_chart_intent(question) == expected


def test_column_form_matches_truth_table(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(TRUTH)] + [(99, None)], "id int, q string")
    got = {r["id"]: r["t"] for r in df.select("id", chart_intent("q").alias("t")).collect()}
    for i, (_, expected) in enumerate(TRUTH):
        assert got[i] == expected, TRUTH[i]
    assert got[99] is None


def test_top_n():
    assert requested_top_n("Haz un gráfico de barras de los top 5 productos", 10) == 5
    assert requested_top_n("ranking de productos", 10) == 10
