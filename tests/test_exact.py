"""Order-free sums against exact fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cuadro.operators import charts, exact, insights, profile

rng = random.Random(12)


def value(kind):
    return {0: lambda: round(rng.uniform(-1e5, 1e5), 2), 1: lambda: rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 12),
            2: lambda: rng.choice([1e16, 1.0, -1e16, 3.5, 0.0]), 3: lambda: rng.uniform(-1, 1) * 2.0 ** rng.randrange(-1074, -1000),
            4: lambda: rng.uniform(-1, 1) * 10.0 ** rng.randrange(280, 300)}[kind]()


def rows(n=3000):
    out = []
    for _ in range(n):
        g = rng.randrange(40)
        out.append((g, None if rng.random() < .05 else value(g % 5), rng.randrange(-2**62, 2**62)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return rows()


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_same_bits_for_any_partitioning(spark, data, partitions):
    df = spark.createDataFrame(data, "g int, v double, w long").repartition(partitions)
    got = {r["g"]: r for r in exact.grouped_sums(df, ["g"], {"s": "v", "t": "w"}, "n", {"lo": "v"}, {"hi": "v"}, counts=True).collect()}
    for g in {r[0] for r in data}:
        own = [r for r in data if r[0] == g]
        there = [r[1] for r in own if r[1] is not None]
        assert got[g]["s"] == float(sum(map(Fraction, there)))
        assert (got[g]["t"], got[g]["n"], got[g]["s_n"]) == (sum(r[2] for r in own), len(own), len(there))
        assert (got[g]["lo"], got[g]["hi"]) == (min(there), max(there))


def test_charts_and_insights_do_not_depend_on_partitions(spark, data):
    df = spark.createDataFrame([(str(g), v, w) for g, v, w in data if g % 5 < 2], "k string, v double, w long")

    def all_of(n):
        part = df.repartition(n)
        return [charts.bar_sums(part, "k", "v").collect(), insights.avg_by_category(part, "k", "v").collect(),
                profile.numeric_summary(part, ["v"]).collect(), insights.overall_avg(part, "v").collect()]
    first = all_of(1)
    assert all_of(7) == first and all_of(50) == first


def test_missing_zero_and_infinite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, inf), (1, 1.0), (2, inf), (2, -inf), (3, nan), (3, None), (4, nan), (4, 2.0), (5, 0.0), (5, -0.0),
                                (6, 1e308), (6, 1e308)], "g int, v double")
    got = {r["g"]: (r["s"], r["s_n"], r["n"]) for r in exact.grouped_sums(df, ["g"], {"s": "v"}, "n", counts=True).collect()}
    assert got[1] == (inf, 2, 2) and got[2][0] != got[2][0] and got[3] == (None, 0, 2) and got[4] == (2.0, 1, 2)
    assert got[5] == (0.0, 2, 2) and got[6][0] == inf


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert exact.grouped_sums(df, [], {"s": "v"}, "n", counts=True).collect()[0].asDict() == {"s": None, "s_n": 0, "n": 0}
    assert exact.grouped_sums(df, ["g"], {"s": "v"}).count() == 0


def test_regrouped_parts_lose_nothing(spark, data):
    df = spark.createDataFrame(data, "g int, v double, w long")
    parts = exact.partial_sums(df, ["g"], {"s": "v"}).withColumn("half", F.col("g") % 2)
    got = {r["half"]: r["s"] for r in exact.whole_sums(exact.regrouped(parts, ["half"], {"s": "v"}), ["half"], {"s": "v"}).collect()}
    for half in (0, 1):
        assert got[half] == float(sum(Fraction(v) for g, v, _ in data if g % 2 == half and v is not None))


def test_partial_aggregation_and_no_python(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = exact.grouped_sums(df, ["g"], {"s": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Arrow" not in plan
