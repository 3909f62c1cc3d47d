"""Store overwrite semantics and the streaming question loop."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cuadro.operators import search
from cuadro.sources import store
from cuadro.streaming.questions import classify_stream, question_stream, start_answering


def _docs(spark, name, n, offset=0.0):
    rows = [(i, f"{name} doc {i}", {"type": "data_chunk"}, [float(i) + offset, 1.0], name) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, page_content string, metadata map<string,string>, embedding array<float>, store_name string")


def test_store_overwrite_is_per_store(spark, tmp_dir):
    base = os.path.join(tmp_dir, "stores")
    store.write_store(_docs(spark, "a", 3).unionByName(_docs(spark, "b", 2)), base)
    store.write_store(_docs(spark, "a", 1), base)             # replaces store 'a' only
    got = {r["store_name"]: r["n_docs"] for r in store.available_stores(store.read_store(spark, base)).collect()}
    assert got == {"a": 1, "b": 2}
    with pytest.raises(store.StoreNotFound):
        store.load_store(spark, base, "zzz")
    assert store.load_store(spark, base, "a").count() == 1
    one = store.read_store(spark, base, "b")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(store_name" in one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _state(spark, base):
    docs = sorted(tuple(r) for r in store.read_store(spark, base).select("store_name", "doc_id", "page_content").collect())
    return docs, sorted(tuple(r) for r in store.list_stores(spark, base).collect())


def test_a_write_that_fails_half_way_leaves_the_old_store(spark, tmp_dir, monkeypatch):
    base = os.path.join(tmp_dir, "stores")
    store.write_store(_docs(spark, "a", 3).unionByName(_docs(spark, "b", 2)), base)
    before = _state(spark, base)
    failing = F.when(F.col("doc_id") == 150, F.raise_error(F.lit("disk full")).cast("string")).otherwise(F.col("page_content"))
    bad = _docs(spark, "a", 200).repartition(8).withColumn("page_content", failing)
    with pytest.raises(Exception, match="disk full"):
        store.write_store(bad, base)
    assert _state(spark, base) == before
    for step in ("_commit", "_switch"):
        def stop(*_):
            raise OSError("driver lost")
        with monkeypatch.context() as m:
            m.setattr(store, step, stop)
            with pytest.raises(OSError):
                store.write_store(_docs(spark, "a", 9), base)
        assert _state(spark, base) == before
    store.write_store(_docs(spark, "a", 9), base)
    assert _state(spark, base)[1] == [("a", 9, 9), ("b", 2, 2)]


def test_a_reader_keeps_its_version(spark, tmp_dir):
    base = os.path.join(tmp_dir, "stores")
    store.write_store(_docs(spark, "a", 3).unionByName(_docs(spark, "b", 2)), base)
    old, old_all, old_list = store.load_store(spark, base, "a"), store.read_store(spark, base), store.list_stores(spark, base)
    store.write_store(_docs(spark, "a", 7).unionByName(_docs(spark, "c", 1)), base)
    assert old.count() == 3 and old_all.count() == 5 and old_list.count() == 2
    assert store.load_store(spark, base, "a").count() == 7 and store.read_store(spark, base).count() == 10


def test_two_writers_lose_nothing(spark, tmp_dir, monkeypatch):
    base = os.path.join(tmp_dir, "stores")
    store.write_store(_docs(spark, "a", 1), base)
    switch, met = store._switch, []

    def other_first(*args):
        if not met:
            met.append(True)
            store.write_store(_docs(spark, "b", 2), base)          # takes the number in between
        return switch(*args)
    monkeypatch.setattr(store, "_switch", other_first)
    store.write_store(_docs(spark, "c", 3), base)
    assert _state(spark, base)[1] == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]


def test_vacuum_deletes_only_what_no_kept_manifest_names(spark, tmp_dir):
    base = os.path.join(tmp_dir, "stores")
    store.write_store(_docs(spark, "a", 1).unionByName(_docs(spark, "b", 1)), base)
    for n in (2, 3, 4):
        store.write_store(_docs(spark, "a", n), base)
    before = _state(spark, base)
    assert store.vacuum(spark, base, keep=1) == 2                  # the first version still holds store b
    assert _state(spark, base) == before and store.vacuum(spark, base, keep=1) == 0


def test_empty_base_names_and_null_store(spark, tmp_dir):
    base = os.path.join(tmp_dir, "stores")
    assert _state(spark, base) == ([], [])
    with pytest.raises(store.StoreNotFound):
        store.load_store(spark, base, "a")
    odd = _docs(spark, "0012", 1).unionByName(_docs(spark, "2024-01-01", 1)).unionByName(_docs(spark, "a b/c=d", 1)).unionByName(_docs(spark, None, 1))
    store.write_store(odd, base)
    assert {r[0] for r in store.read_store(spark, base).select("store_name").collect()} == {"0012", "2024-01-01", "a b/c=d", None}
    assert store.load_store(spark, base, "a b/c=d").count() == 1


def test_metadata_keep_their_types(spark, tmp_dir):
    base = os.path.join(tmp_dir, "stores")
    docs = spark.createDataFrame([(1, "t", (7, ["x", "y.z"], None), [1.0], "s")], "doc_id long, page_content string, "
                                 "metadata struct<start_row: bigint, columns: array<string>, gone: string>, embedding array<float>, store_name string")
    store.write_store(docs, base)
    got = store.load_store(spark, base, "s").select(F.variant_get("metadata", "$.start_row", "bigint"), F.variant_get("metadata", "$.columns", "array<string>"),
                                                    F.schema_of_variant("metadata")).first()
    assert (got[0], got[1]) == (7, ["x", "y.z"]) and "start_row: BIGINT" in got[2] and "columns: ARRAY<STRING>" in got[2]


def test_streaming_answers(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "q1.json"), "w") as f:
        for q in [{"question_id": 1, "question": "Muestra un gráfico de ventas por ciudad", "store_name": "docs"},
                  {"question_id": 2, "question": " ", "store_name": "docs"},
                  {"question_id": 3, "question": "hola", "store_name": "nope"}]:
            f.write(json.dumps(q) + "\n")
    corpus = spark.createDataFrame([(i, f"venta ciudad {i}", "docs") for i in range(10)],
                                   "doc_id long, page_content string, store_name string")
    model = search.fit_text_embedder(corpus, "page_content", num_features=32)
    corpus_v = search.embed_text(model, corpus, "page_content")
    qs = question_stream(spark, inbox)
    out = os.path.join(tmp_dir, "answers")
    q = start_answering(qs, corpus_v, lambda b: search.embed_text(model, b, "question"), out,
                        checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    res = {r["question_id"]: r for r in spark.read.parquet(out).collect()}
    assert set(res) == {1, 3}
    assert res[1]["n_sources"] == 3 and res[1]["chart_type"] == "bar"
    assert res[3]["error"] == "Vector store 'nope' no encontrado"
    mem = classify_stream(question_stream(spark, inbox)).writeStream.format("memory").queryName("intents") \
        .trigger(availableNow=True).start()
    mem.awaitTermination(120)
    assert {r["question_id"]: r["chart_type"] for r in spark.table("intents").collect()} == {1: "bar", 3: None}


def test_streaming_two_batches(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox2")
    os.makedirs(inbox)
    for i in range(2):
        with open(os.path.join(inbox, f"q{i}.json"), "w") as f:
            f.write(json.dumps({"question_id": i, "question": f"ventas {i}", "store_name": "docs"}) + "\n")
    corpus = spark.createDataFrame([(i, f"venta {i}", "docs") for i in range(5)],
                                   "doc_id long, page_content string, store_name string")
    model = search.fit_text_embedder(corpus, "page_content", num_features=16)
    corpus_v = search.embed_text(model, corpus, "page_content")
    out = os.path.join(tmp_dir, "answers2")
    q = start_answering(question_stream(spark, inbox, max_files_per_trigger=1), corpus_v,
                        lambda b: search.embed_text(model, b, "question"), out,
                        checkpoint=os.path.join(tmp_dir, "ckpt2"))
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    assert res.count() == 2 and res.select("batch_id").distinct().count() == 2
