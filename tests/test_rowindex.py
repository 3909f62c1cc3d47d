"""Row index: dense, exact and independent of partitioning; no global window."""

from pyspark.sql import functions as F

from cuadro.operators.rowindex import with_row_index
from cuadro.session import read_table
from tests.conftest import SF_SMALL


def _check(df, keys, expected_order):
    got = [r[keys[0]] for r in df.orderBy("row_idx").collect()]
    assert got == expected_order
    idx = sorted(r["row_idx"] for r in df.collect())
    assert idx == list(range(len(expected_order)))


def test_numeric_key_many_buckets(spark):
    o = read_table(spark, SF_SMALL, "orders").select("o_orderkey")
    expected = sorted(r[0] for r in o.collect())
    for parts in (1, 4, 17):
        _check(with_row_index(o.repartition(parts), ["o_orderkey"], rows_per_bucket=100), ["o_orderkey"], expected)


def test_timestamp_and_composite_key(spark):
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "ts")
    expected = [r[0] for r in ev.orderBy("ts", "event_id").collect()]
    out = with_row_index(ev, ["ts", "event_id"], rows_per_bucket=50)
    assert [r["event_id"] for r in out.orderBy("row_idx").collect()] == expected


def test_string_key(spark):
    c = read_table(spark, SF_SMALL, "customer").select("c_name")
    expected = sorted(r[0] for r in c.collect())
    _check(with_row_index(c, ["c_name"], rows_per_bucket=20), ["c_name"], expected)


def test_the_unpartitioned_window_sees_counts_only(spark, monkeypatch):
    from cuadro.operators import rowindex
    plans, write = [], rowindex.materialise
    monkeypatch.setattr(rowindex, "materialise", lambda d, n: plans.append(d._jdf.queryExecution().sparkPlan().toString()) or write(d, n))
    o = read_table(spark, SF_SMALL, "orders").select("o_orderkey")
    with_row_index(o, ["o_orderkey"], rows_per_bucket=100)
    windows = [ln for plan in plans for ln in plan.splitlines() if "Window [" in ln]
    counts = [ln for ln in windows if "sum(__n" in ln]             # the running offset over bucket counts
    assert len(counts) == 1 and len(windows) >= 3
    assert all("[__bucket" in ln for ln in windows if ln not in counts)      # keys are ranked inside buckets


def test_nan_and_infinite_keys(spark):
    values = [float("nan"), float("inf"), float("-inf"), None, 0.0, -1.5] + [float(i) for i in range(1, 60)]
    df = spark.createDataFrame([(v,) for v in values], "k double").repartition(5)
    out = [r["k"] for r in with_row_index(df, ["k"], rows_per_bucket=7).orderBy("row_idx").collect()]
    assert out[:3] == [None, float("-inf"), -1.5] and out[-2] == float("inf") and out[-1] != out[-1]
    idx = [r["row_idx"] for r in with_row_index(df, ["k"], rows_per_bucket=7).orderBy("row_idx").collect()]
    assert idx == list(range(len(values)))


def test_null_keys_come_first_across_buckets(spark):
    rows = [(None, i) for i in range(5)] + [(float(i % 37), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k double, id int")
    out = with_row_index(df, ["k", "id"], rows_per_bucket=16).orderBy("row_idx").collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0.0, r[1]))
    assert [(r["k"], r["id"]) for r in out] == expected
    assert [r["row_idx"] for r in out] == list(range(len(rows)))


def test_composite_key_with_a_hot_leading_value(spark):
    # a third of the rows share one leading value: they must still spread over buckets
    rows = [(0, i) for i in range(300)] + [(v, i) for v in range(1, 601) for i in range(1)]
    df = spark.createDataFrame(rows, "lead int, id int")
    out = with_row_index(df, ["lead", "id"], rows_per_bucket=50)
    got = [(r["lead"], r["id"]) for r in out.orderBy("row_idx").collect()]
    assert got == sorted(rows)
    spread = out.groupBy().agg(F.max("row_idx")).first()[0]
    assert spread == len(rows) - 1


def test_only_keys_are_written(spark, monkeypatch):
    from cuadro.operators import rowindex
    written = []
    write = rowindex.materialise
    monkeypatch.setattr(rowindex, "materialise", lambda d, n: written.append(d.columns) or write(d, n))
    wide = spark.range(500).select((F.col("id") * 7919 % 500).alias("k.key"), F.repeat(F.lit("x"), 1000).alias("text"), "id")
    out = rowindex.with_row_index(wide, ["k.key"], rows_per_bucket=100)
    assert all("text" not in c and "id" not in c for c in written) and len(written) == 2
    assert [r[0] for r in out.orderBy("row_idx").select("`k.key`").collect()] == list(range(500))
    assert out.columns == ["k.key", "text", "id", "row_idx"] and out.agg(F.sum(F.length("text"))).first()[0] == 500_000


def test_repeated_and_missing_keys(spark):
    from cuadro.operators.rowindex import with_row_index
    rows = [(None, "a", 1.0), (None, "b", 2.0), (1.5, "c", 3.0), (1.5, "c", 4.0), (float("nan"), "d", 5.0), (float("-inf"), "e", 6.0)]
    df = spark.createDataFrame(rows, "k double, t string, v double").repartition(3)
    repeated = with_row_index(df, ["k", "t"]).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in repeated] == list(range(6)) and sorted(r["v"] for r in repeated) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert [r["t"] for r in repeated] == ["a", "b", "e", "c", "c", "d"]
    single = with_row_index(df.where("v <> 4"), ["k", "t"]).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["t"]) for r in single] == [(0, "a"), (1, "b"), (2, "e"), (3, "c"), (4, "d")]
