"""Plan shape: pruning, pushdown, partial aggregation, bounded top-k, no Python UDF, no pair
explosion."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = {k: v for k, v in E.queries().items() if k not in E.LLM_QUERIES}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key,cols", [
    ("bar_sum", {"l_returnflag", "l_quantity"}),
    ("bar_count", {"event_type"}),
    ("line_series", {"o_orderdate", "o_totalprice"}),
    ("scatter_points", {"l_extendedprice", "l_quantity"}),
    ("histogram", {"l_quantity"}),
])
def test_chart_scans_read_only_needed_columns(spark, key, cols):
    df = Q[key](spark, SF_SMALL)
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schemas = [ln.split("ReadSchema:")[1].strip() for ln in text.splitlines() if "ReadSchema:" in ln]
    assert schemas
    for s in schemas:
        fields = {f.split(":")[0] for f in s[len("struct<"):-1].split(",")}
        assert fields <= cols, (s, cols)


def test_filters_pushed_and_partial_aggregation(spark):
    df = Q["bar_sum"](spark, SF_SMALL)
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "IsNotNull(l_returnflag)" in text
    assert "partial_sum" in text and "TakeOrderedAndProject" in text


@pytest.mark.parametrize("key", sorted(k for k in Q if k not in {"embed_text", "ask_text_batch", "ingest_job",
                                                               "retrieve_batch", "search_similar", "ask_batch",
                                                               "scan_csv", "scan_csv_dates", "store_roundtrip"}))
def test_no_python_in_relational_plans(spark, key):
    plan = _plan(Q[key](spark, SF_SMALL))
    assert "EvalPython" not in plan and "PythonUDF" not in plan
    assert "CartesianProduct" not in plan


def test_search_plan_has_no_pair_join(spark):
    plan = _plan(Q["retrieve_batch"](spark, SF_SMALL))
    assert "MapInPandas" in plan or "FlatMapCoGroupsInPandas" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_values_use_group_limit(spark):
    plan = _plan(Q["summary_top5"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_fact_table_is_aggregated_before_the_join(spark):
    opt = _optimized(Q["top_products"](spark, SF_SMALL))
    join_at = opt.find("Join Inner")
    agg_below = opt.find("Aggregate [l_partkey", join_at)
    assert join_at >= 0 and agg_below > join_at
