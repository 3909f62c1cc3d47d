"""The pipeline, stage by stage, against what each operator's brute-force version does."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from cuadro.llm import bpe, decontam, pii
from cuadro.llm.queries import BPE_RANKS
from tests.conftest import SF_SMALL
from tests.llm.test_decontam import full_score
from tests.llm.test_simhash import brute_fp, brute_groups


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "123 456", "en", "s", 7), (9003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    out = {"documents": docs}
    for name, stage in C.STAGES:
        docs = stage(spark, docs.withColumn("score", F.lit(1)), SF_SMALL)
        out[name] = docs = docs.cache()
    return out


def test_language_rejects_only_texts_without_language(stages):
    before, after = texts(stages["documents"]), texts(stages["language"])
    assert before.keys() - after.keys() == {9001, 9002, 9003}
    assert stages["language"].columns == list(C.COLUMNS)


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages["language"]), texts(stages["near_duplicates"])
    fps = {i: brute_fp(t, 4) for i, t in before.items()}
    group = brute_groups(set(fps.values()), 4)
    low = {}
    for i, f in fps.items():
        low[group[f]] = min(low.get(group[f], i), i)
    assert sorted(after) == sorted(low.values())


def test_contaminated_documents_go(spark, stages):
    before, after = texts(stages["near_duplicates"]), texts(stages["decontaminate"])
    items = [w for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect() if (w := decontam.words(r.text))]
    want = set()
    for i, t in before.items():
        w = decontam.words(t)
        for q in items:
            if len(set(q) & set(w)) > 0.5 * len(set(q)) and full_score(w, q) >= 2 * len(q) - 3 * (len(q) // 5):
                want.add(i)
    assert before.keys() - after.keys() == want and want


def test_masked_and_encoded(stages):
    before, after = texts(stages["decontaminate"]), texts(stages["mask_pii"])
    assert before.keys() == after.keys()
    assert all(after[i] == pii.masked(t, pii.spans_of(t)) for i, t in before.items())
    assert all(r.n_chars == len(r.text) for r in stages["mask_pii"].collect())
    got = {r.doc_id: bytes(r.content).decode() for r in bpe.decode(stages["encode"], BPE_RANKS).collect()}
    assert got == after


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0


def test_repeated_rows_and_rows_without_id(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    rows = [(1, "one two three four five", "en", "s", 1)] * 2 + [(None, "some other words in here", "en", "s", 1)] * 2
    got = C.near_duplicates(spark, spark.createDataFrame(rows, schema), SF_SMALL)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "None", "None"]


def test_run(spark):
    out = C.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "ids", "offsets"] and 0 < out.count() < 200
