"""Batch questions: unknown store, blank question, k sources, prompt, snippets."""

from pyspark.sql import functions as F

from cuadro.operators.qa import ERROR_ANSWER, PROMPT_TEMPLATE, build_prompt
from cuadro.plans.ask import ask_batch


def _corpus(spark):
    docs = [(i, ("x" * 250 if i == 0 else f"doc {i}"), "s1", [float(i), 0.0]) for i in range(6)]
    docs += [(10, "other", "s2", [0.0, 0.0]), (11, "no vector", "s3", None)]
    return spark.createDataFrame(docs, "doc_id long, page_content string, store_name string, embedding array<float>")


def test_ask_batch_records(spark):
    qs = spark.createDataFrame([
        (1, "Muestra un gráfico de ventas por ciudad", "s1", [0.2, 0.0]),
        (2, "  ", "s1", [0.0, 0.0]),
        (3, "¿Qué producto se vende más?", "missing", [0.0, 0.0]),
        (4, "hola", "s3", [0.0, 0.0]),
    ], "question_id long, question string, store_name string, embedding array<float>")
    res = {r["question_id"]: r for r in ask_batch(qs, _corpus(spark)).collect()}
    assert set(res) == {1, 3, 4}                       # blank question dropped
    r1 = res[1]
    assert r1["n_sources"] == 3 and r1["error"] is None and r1["answer"] is None
    assert r1["context"].split("\n\n") == ["x" * 250, "doc 1", "doc 2"]
    assert r1["sources"][0]["content"] == "x" * 200 + "..."
    assert r1["chart_type"] == "bar"
    assert r1["prompt"] == PROMPT_TEMPLATE.format(context=r1["context"], question=r1["question"])
    r3 = res[3]
    assert r3["answer"] == ERROR_ANSWER and r3["error"] == "Vector store 'missing' no encontrado"
    assert r3["sources"] == [] and r3["n_sources"] == 0 and r3["prompt"] is None
    assert res[4]["error"] is not None                 # a store without vectors is not available


def test_build_prompt_column(spark):
    df = spark.createDataFrame([("ctx", "q?")], "c string, q string")
    assert df.select(build_prompt(F.col("c"), F.col("q"))).first()[0] == PROMPT_TEMPLATE.format(context="ctx", question="q?")


def test_sources_carry_stored_metadata_and_chart_file(spark):
    docs = spark.createDataFrame([(i, f"doc {i}", {"type": "data_chunk", "chunk_id": str(i)}, "s", [float(i)])
                                  for i in range(4)],
                                 "doc_id long, page_content string, metadata map<string,string>, store_name string, "
                                 "embedding array<float>")
    qs = spark.createDataFrame([(1, "Haz un gráfico de barras", "s", [0.0])],
                               "question_id long, question string, store_name string, embedding array<float>")
    r = ask_batch(qs, docs).first()
    assert r["sources"][0]["metadata"]["chunk_id"] == "0"
    assert r["chart_filename"].startswith("bar_chart_") and r["chart_filename"].endswith(".png")


def test_a_vector_that_does_not_fit_fails_alone(spark):
    from cuadro.operators.qa import ERROR_QUESTION
    corpus = spark.createDataFrame([(i, f"doc {i}", "docs", [float(i), 1.0]) for i in range(4)],
                                   "doc_id long, page_content string, store_name string, embedding array<float>")
    qs = spark.createDataFrame([(1, "hola", "docs", [1.0, 1.0]), (2, "hola", "docs", [1.0, 1.0, 1.0]), (3, "hola", "docs", None), (4, "hola", "x", [1.0])],
                               "question_id long, question string, store_name string, embedding array<float>")
    rows = {r["question_id"]: r for r in ask_batch(qs, corpus).collect()}
    assert rows[1]["n_sources"] == 3 and rows[1]["error"] is None and rows[1]["answer"] is None
    for bad, what in ((2, "3"), (3, "none")):
        assert rows[bad]["answer"] == ERROR_QUESTION and rows[bad]["error"].endswith(what)
        assert rows[bad]["n_sources"] == 0 and rows[bad]["prompt"] is None and not rows[bad]["chart_generated"]
    assert "no encontrado" in rows[4]["error"]


def test_packed_texts_come_back_as_they_were(spark):
    from cuadro.functions.text import pack_text, unpack_texts
    texts = ["añ 🙂\n\n", "", None, "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    packed = df.withColumn("p", pack_text("t")).agg(F.sort_array(F.collect_list(F.struct("i", "p")))["p"].alias("ps"))
    assert packed.select(unpack_texts("ps", "\n\n")).first()[0] == "\n\n".join(t for t in texts if t is not None)
    assert spark.sql("select cast(null as array<binary>) ps").select(unpack_texts("ps", "-")).first()[0] is None


def test_only_texts_of_hits_are_joined(spark, tmp_dir):
    """The filter by hits stands below the join of documents and vectors, which sent every text before."""
    from cuadro import catalog
    spark.createDataFrame([(i, f"text {i}", "es", "s1", 6) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    qs = spark.createDataFrame([(1, "hola", "s1", [0.1, 1.0])], "question_id long, question string, store_name string, embedding array<float>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        res = ask_batch(qs, catalog._doc_corpus(spark, tmp_dir))
        plan = res._jdf.queryExecution().optimizedPlan().toString()
        assert res.first()["context"] == "text 0\n\ntext 1\n\ntext 2"
        asked = catalog._vector_questions(spark, tmp_dir)
        assert asked.count() == 20 and "LeftSemi" in asked._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < plan.index("Join LeftOuter, (doc_id") < plan.index("Join LeftSemi")
