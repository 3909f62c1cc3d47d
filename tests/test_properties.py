"""Properties: results do not depend on partitioning; chunks partition the rows; shares
cover all rows; top-k distances never decrease; both intent forms agree."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuadro.functions.intent import chart_intent, detect_chart_intent
from cuadro.operators import charts, corpus, profile, search
from cuadro.session import read_table
from tests.conftest import SF_SMALL

EVENT_FIELDS = corpus.RowFields(id="event_id", date="ts", product="event_type", price=None, quantity=None,
                                total="value", purchase_type=None, payment=None, manager=None, city=None)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results_do_not_depend_on_partitioning(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    ev = read_table(spark, SF_SMALL, "events")
    part = read_table(spark, SF_SMALL, "part")
    base = None
    for n in (1, 4, 17):
        got = (_rows(charts.bar_sums(li.repartition(n), "l_returnflag", "l_quantity")),
               _rows(charts.pie_shares(part.repartition(n), "p_name")),
               _rows(profile.top_values(ev.repartition(n), ["event_type"])),
               _rows(corpus.chunk_table(ev.repartition(n), ["event_id"], EVENT_FIELDS)))
        base = base or got
        assert got == base


def test_chunks_cover_rows_and_shares_cover_rows(spark):
    ev = read_table(spark, SF_SMALL, "events")
    chunks = corpus.chunk_table(ev, ["event_id"], EVENT_FIELDS, n=50).collect()
    assert sum(c["num_rows"] for c in chunks) == ev.count()
    assert all(c["end_row"] - c["start_row"] + 1 == c["num_rows"] for c in chunks)
    part = read_table(spark, SF_SMALL, "part")
    pie = charts.pie_shares(part, "p_type").collect()
    assert sum(r["n"] for r in pie) == part.where(F.col("p_type").isNotNull()).count()


def test_topk_distances_never_decrease(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    rows = search.knn(e, e, 5, corpus_id="vec_id", query_id="vec_id").orderBy("query_id", "rank").collect()
    prev = {}
    for r in rows:
        assert r["dist"] >= prev.get(r["query_id"], -1.0)
        prev[r["query_id"]] = r["dist"]


WORDS = ["gráfico", "grafico", "muestra", "barras", "líneas", "por", "ciudad", "ventas", "producto", "mes",
         "fecha", "top", "5", "ranking", "distribución", "total", "porcentaje", "de", "pie", "vs.", "contra",
         "relación", "entre", "precio", "cantidad", "comparar", "más", "vendidos", "productos", "tendencia",
         "evolución", "histórico", "GRÁFICO", "Circular", "dispersión", "manager", "\n", "x"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=0, max_size=8).map(" ".join), min_size=200, max_size=200))
def test_intent_forms_agree(spark, questions):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string")
    got = {r["i"]: r["t"] for r in df.select("i", chart_intent("q").alias("t")).collect()}
    for i, q in enumerate(questions):
        assert got[i] == detect_chart_intent(q), q


def test_top_values_shuffle_no_long_texts(spark):
    import re
    from cuadro.operators import profile
    long = "y" * 5000
    rows = [(f"{long}{i % 4}", "short" if i % 3 else None, f"{long[:i % 60]}z") for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c string").repartition(5)
    got = {(r["column"], r["rank"]): (r["value"], r["n"]) for r in profile.top_values(df, n=3).collect()}
    for j, c in enumerate("abc"):
        counts = {}
        for r in rows:
            if r[j] is not None:
                counts[r[j]] = counts.get(r[j], 0) + 1
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [got[c, i + 1] for i in range(len(want))] == want

    def shuffled(text_length):
        wide = spark.range(2000).select(F.concat(F.repeat(F.lit("q"), text_length), F.col("id").cast("string")).alias("t")).repartition(4)
        plan = profile.top_candidates(wide, ["t"])
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        return [re.sub(r"#\d+", "", m) for m in re.findall(r"Exchange hashpartitioning\(([^)]*)", text)]
    keys = shuffled(40)
    assert keys == shuffled(4000) and any("h1" in k and "head" in k for k in keys) and not any("value" in k for k in keys)


def test_top_values_ties_behind_a_common_head(spark):
    from cuadro.operators import profile
    head = "https://example.org/a/very/long/common/path/"
    df = spark.createDataFrame([(f"{head}{i:03}",) for i in range(100)] + [("zz",), ("zz",)], "u string").repartition(4)
    assert [(r["value"], r["n"]) for r in profile.top_values(df, n=4).orderBy("rank").collect()] == \
        [("zz", 2)] + [(f"{head}{i:03}", 1) for i in range(3)]
    assert profile.top_values(spark.createDataFrame([], "u string")).count() == 0
