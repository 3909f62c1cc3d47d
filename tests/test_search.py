"""Exact kNN against a brute-force numpy answer, for both plans and with ties and groups."""

import numpy as np

from cuadro.operators import search
from cuadro.session import read_table
from tests.conftest import SF_SMALL


def _brute(corpus, queries, k, groups_c=None, groups_q=None):
    out = {}
    for qi, qv in queries.items():
        cand = []
        for ci, cv in corpus.items():
            if groups_c is not None and groups_c[ci] != groups_q[qi]:
                continue
            d = float(((np.asarray(cv, float) - np.asarray(qv, float)) ** 2).sum())
            cand.append((d, ci))
        out[qi] = [c for _, c in sorted(cand)[:k]]
    return out


def _got(df):
    res = {}
    for r in df.orderBy("query_id", "rank").collect():
        res.setdefault(r["query_id"], []).append(r["doc_id"])
    return res


def test_broadcast_and_blocked_plans_equal_brute_force(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    pdf = e.toPandas()
    vecs = dict(zip(pdf["vec_id"], pdf["embedding"]))
    queries = {i: vecs[i] for i in list(vecs)[:40]}
    expected = _brute(vecs, queries, 4)
    qdf = e.where(e["vec_id"].isin(list(queries)))
    a = search.knn(e, qdf, 4, corpus_id="vec_id", query_id="vec_id")
    assert _got(a) == expected
    b = search.knn(e, qdf, 4, corpus_id="vec_id", query_id="vec_id", broadcast_bytes=1024, corpus_block_bytes=2000)
    assert _got(b) == expected


def test_ties_are_broken_by_id_and_groups_respected(spark):
    rows = [(i, [1.0, 0.0], "a") for i in range(20)] + [(100 + i, [0.0, 0.0], "b") for i in range(5)]
    c = spark.createDataFrame(rows, "doc_id long, embedding array<float>, g string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b")], "query_id long, embedding array<float>, g string")
    got = _got(search.knn(c, q, 3, group_col="g"))
    assert got == {1: [0, 1, 2], 2: [100, 101, 102]}
    got_b = _got(search.knn(c, q, 3, group_col="g", broadcast_bytes=1, corpus_block_bytes=64))
    assert got_b == got


def test_topk_kernel_near_ties():
    rng = np.random.default_rng(3)
    C = rng.normal(size=(300, 8))
    C[50:80] = C[10]                       # many exact duplicates at the candidate border
    Q = np.vstack([C[10], rng.normal(size=(4, 8))])
    t = search.TopK(np.arange(len(Q)), Q, 12)
    ids = np.arange(300)
    t.add(ids, C)
    rows = t.rows()
    for qi in range(len(Q)):
        d = ((C - Q[qi]) ** 2).sum(1)
        order = np.lexsort((ids, d))[:12]
        assert list(rows[rows.query_id == qi].sort_values(["dist", "doc_id"]).doc_id) == list(order)


def test_text_embedder(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    model = search.fit_text_embedder(d, "text", num_features=64)
    out = search.embed_text(model, d, "text").select("embedding").first()[0]
    assert len(out) == 64 and abs(sum(x * x for x in out) - 1.0) < 1e-4


def test_empty_question_set_gives_empty_result(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    none = e.where(e["vec_id"] < 0)
    out = search.knn(e, none, 5, corpus_id="vec_id", query_id="vec_id")
    assert out.count() == 0 and out.columns == ["query_id", "rank", "doc_id", "dist"]


def test_equal_vectors_stay_within_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(4)
    C = np.repeat(rng.normal(size=(1, 64)), 5000, axis=0)
    Q = np.vstack([C[:1], rng.normal(size=(399, 64))])
    ids = rng.permutation(5000)
    tracemalloc.start()
    t = search.TopK(np.arange(400), Q, 5)
    t.add(ids, C)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert all(list(g.sort_values(["dist", "doc_id"]).doc_id) == [0, 1, 2, 3, 4] for _, g in t.rows().groupby("query_id"))


def test_places_are_the_remainder_of_the_hash(spark):
    import hashlib
    words = ["venta", "ciudad", "Ñandú", "x9", "precio"]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    for features in (2, 8, 16, 32, 100, 512, 4096):
        model = search.TextEmbedder(features)
        counts = model._terms(df, "t").first()["_tf"]
        want = {}
        for w in words:
            at = int(hashlib.md5(w.lower().encode()).hexdigest()[-8:], 16) % features
            want[at] = want.get(at, 0) + 1
        assert dict(zip(counts.indices.tolist(), counts.values.tolist())) == want


def test_blocked_plan_finds_every_pair_and_shuffles_candidates_only(spark):
    """Blocks once met by keys of two types, so that pairs were lost as soon as there were several shuffle partitions."""
    rng = np.random.default_rng(7)
    docs = [(i, rng.normal(size=4).tolist(), f"s{i % 2}") for i in range(200)]
    asked = [(1000 + i, rng.normal(size=4).tolist(), f"s{i % 2}") for i in range(60)]
    c = spark.createDataFrame(docs, "doc_id long, embedding array<float>, store string").repartition(9)
    q = spark.createDataFrame(asked, "query_id long, embedding array<float>, store string").repartition(3)
    expected = _brute({r["doc_id"]: r["embedding"] for r in c.collect()}, {r["query_id"]: r["embedding"] for r in q.collect()}, 3,
                      {d: s for d, _, s in docs}, {i: s for i, _, s in asked})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grouped = search.knn(c, q, 3, group_col="store", broadcast_bytes=320, corpus_block_bytes=640)
        assert _got(grouped) == expected
        alone = search.knn(c, q, 3, broadcast_bytes=320, corpus_block_bytes=640)
        assert _got(alone) == _got(search.knn(c, q, 3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert grouped._jdf.queryExecution().logical().toString().count("CoGroup") == 0
    assert grouped._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1


def test_candidates_grow_with_the_questions_only(spark):
    c = spark.range(4000).selectExpr("id as doc_id", "array(cast(id as float)) as embedding").repartition(200)
    q = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "query_id long, embedding array<float>")
    found = search._broadcast_plan(c.selectExpr("doc_id as cid", "embedding as cv", "'' as _g"), q.selectExpr("query_id as qid", "embedding as qv", "'' as _g"), 3)
    assert found.count() <= 20 * 3 * spark.sparkContext.defaultParallelism


def test_few_documents_are_measured(monkeypatch):
    """Each question once kept 8 candidates more than k of every tile, picked by a partition of all its scores."""
    rng = np.random.default_rng(11)
    C, Q = rng.normal(size=(20_000, 16)).astype(np.float32), rng.normal(size=(50, 16)).astype(np.float32)
    measured, measure = [], search.TopK._measure
    monkeypatch.setattr(search.TopK, "_measure", lambda self, q, ids, c: (measured.append(len(q)), measure(self, q, ids, c)))
    t = search.TopK(np.arange(50), Q, 3)
    for s in range(0, len(C), 1500):
        t.add(np.arange(s, min(s + 1500, len(C))), C[s:s + 1500])
    assert sum(measured) < 0.01 * 50 * len(C)
    D = ((C.astype(float)[None] - Q.astype(float)[:, None]) ** 2).sum(2)
    assert t.I.tolist() == [np.lexsort((np.arange(len(C)), row))[:3].tolist() for row in D]


def test_rounding_of_the_scores_never_decides():
    rng = np.random.default_rng(12)
    near = 1000 + rng.normal(size=(3000, 8)) * 1e-5            # closer to each other than single precision can tell
    for C in (near, near * 1e160, near * 1e-30, np.vstack([near, [[np.nan] * 8, [np.inf] * 8]])):
        Q = np.vstack([C[:40] * (1 + 1e-9), [[np.nan] * 8]])
        t = search.TopK(np.arange(41), Q, 4)
        for s in range(0, len(C), 700):
            t.add(np.arange(s, min(s + 700, len(C))), C[s:s + 700])
        with np.errstate(all="ignore"):
            D = ((C[None] - Q[:40, None]) ** 2).sum(2)
        D[~np.isfinite(D)] = np.inf
        want = np.array([np.lexsort((np.arange(len(C)), row))[:4] for row in D])
        got = np.take_along_axis(D, np.where(t.I[:40] < len(C), t.I[:40], 0), 1)
        best = np.take_along_axis(D, want, 1)
        ok = np.isfinite(best)
        assert np.allclose(got[ok], best[ok], rtol=1e-12, atol=0) and not np.isfinite(t.D[:40][~ok]).any()
        assert not np.isfinite(t.D[40]).any()


def test_blocks_carry_what_is_not_zero(spark):
    """A block once held every 0 of its vectors, and no more rows than one batch."""
    import pickle
    rows = [(i, [float(j == i % 64) * (i + 1) for j in range(64)], "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame([*rows, (900, [1.0, 2.0], "short"), (901, [1.0], None)], "id long, v array<float>, g string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        blocks = [pickle.loads(r["block"]) for r in search._blocks(df.repartition(4, "id").coalesce(4), 1000, "knn-test").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(blocks) <= 4
    assert sum(len(pickle.dumps(b)) for b in blocks) < 300 * 64 * 4 / 2
    back = {(int(i), g): v.tolist() for b in blocks for g, ids, M in b for i, v in zip(ids, search._full(*M))}
    assert back == {(i, g): v for i, v, g in [*rows, (900, [1.0, 2.0], "short")]}
