"""Row sentences, chunks and the corpus on a small sales table (formats written out by hand)."""

import datetime as dt

from cuadro.operators import corpus, profile

ROWS = [
    (71, dt.datetime(2019, 3, 17), "Lamp", 8.25, 41.5, "Phone", "Voucher", "Ada Quill", "Bergen"),
    (72, dt.datetime(2019, 3, 17), "Desk", 120.0, 3.0, "Phone", "Voucher", "Ada Quill", "Bergen"),
    (73, dt.datetime(2019, 3, 18), "Lamp", 7.5, 10.2, "Counter", "Coins", "Bo Reed", "Turku"),
]
SCHEMA = ("`Order ID` long, Date timestamp_ntz, Product string, Price double, Quantity double, "
          "`Purchase Type` string, `Payment Method` string, Manager string, City string")


def test_row_sentence_format(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    lines = [r["line"] for r in corpus.render_rows(df, corpus.RowFields(), keep=["Order ID"]).orderBy("Order ID").collect()]
    assert lines[0] == ("Orden 71: Fecha: 2019-03-17 00:00:00, Producto: Lamp, Precio: $8.25, Cantidad: 41.5, "
                        "Total: $342.38, Tipo: Phone, Pago: Voucher, Manager: Ada Quill, Ciudad: Bergen")
    assert lines[2].startswith("Orden 73: Fecha: 2019-03-18 00:00:00, Producto: Lamp, Precio: $7.5, Cantidad: 10.2, Total: $76.50")


def test_chunks_partition_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    chunks = corpus.chunk_table(df, ["Order ID"], n=2).orderBy("chunk_id").collect()
    assert [(c["chunk_id"], c["start_row"], c["end_row"], c["num_rows"]) for c in chunks] == [(0, 0, 1, 2), (1, 2, 2, 1)]
    assert chunks[0]["page_content"].split("\n")[0] == "CHUNK DE DATOS (filas 0 a 1):"
    assert chunks[0]["page_content"].split("\n")[2].startswith("Orden 72:")
    assert sum(c["num_rows"] for c in chunks) == len(ROWS)


def test_corpus_and_summary(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    docs = corpus.corpus_docs(df, ["Order ID"], n=2).orderBy("doc_id").collect()
    assert [d["doc_type"] for d in docs] == ["dataset_summary", "data_chunk", "data_chunk"]
    summary = docs[0]["page_content"]
    assert summary == "\n".join([
        "RESUMEN DEL DATASET DE VENTAS:",
        "Total de registros: 3",
        "Período: 2019-03-17 00:00:00 a 2019-03-18 00:00:00",
        "Columnas disponibles: Order ID, Date, Product, Price, Quantity, Purchase Type, Payment Method, Manager, City",
        "",
        "ESTADÍSTICAS NUMÉRICAS:",
        "Price: Min=7.50, Max=120.00, Promedio=45.25, Total=135.75",
        "Quantity: Min=3.00, Max=41.50, Promedio=18.23, Total=54.70",
        "",
        "CATEGORÍAS PRINCIPALES:",
        "Product: Lamp (2), Desk (1)",
        "Purchase Type: Phone (2), Counter (1)",
        "Payment Method: Voucher (2), Coins (1)",
        "Manager: Ada Quill (2), Bo Reed (1)",
        "City: Bergen (2), Turku (1)",
    ])
    assert docs[0]["total_rows"] == 3 and docs[0]["columns"][0] == "Order ID"


def test_top_values_and_numeric_summary(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    tv = profile.top_values(df, ["City"], 1).collect()
    assert [(r["value"], r["n"], r["rank"]) for r in tv] == [("Bergen", 2, 1)]
    ns = {r["column"]: r for r in profile.numeric_summary(df, ["Price"]).collect()}
    assert ns["Price"]["mean"] == 45.25 and ns["Price"]["total"] == 135.75


def test_numbers_are_written_as_python_writes_them(spark):
    from cuadro.functions.text import number_text
    values = [12345678.9, 0.0001, 1e-05, 3.0, 0.5, 1e16, 123456789012345680.0, -2.5e-7, 0.0, 1e22, -1e100, float("inf"), 100000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(number_text("v", df.schema["v"].dataType)).collect()]
    assert got == [str(v) for v in values]
