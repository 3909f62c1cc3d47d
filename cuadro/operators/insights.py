"""Insights the reference only advertises (best sellers, top N, monthly trend, averages by
category, histogram, region comparison, overall average) computed exactly on Spark.

Joins aggregate the large side on the join key *before* joining, so the fact table is
reduced to a few rows per key (order-free sums still in parts, map-side combine) and the join
and the second aggregate run over keys, not over facts. Join strategy is left to AQE, which
broadcasts a side only when its measured size is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import named, quoted
from .exact import grouped_sums, partial_sums, regrouped, whole_sums

TOP_PRODUCTS = 10


def _top(df: DataFrame, key: str, n: int | None) -> DataFrame:
    out = df.orderBy(F.col("value").desc(), named(key).asc())
    return out.limit(n) if n else out


def product_totals(lineitem: DataFrame, part: DataFrame, value: str = "l_quantity") -> DataFrame:
    """Total of ``value`` per product name (lineitem pre-aggregated per part key)."""
    per_part = partial_sums(lineitem.where(F.col("l_partkey").isNotNull()), ["l_partkey"], {"value": value})
    parts = per_part.join(part.select("p_partkey", "p_name"), per_part["l_partkey"] == part["p_partkey"]) \
        .where(F.col("p_name").isNotNull())
    return _double(whole_sums(regrouped(parts, ["p_name"], {"value": value}), ["p_name"], {"value": value}))


def _double(df: DataFrame, name: str = "value") -> DataFrame:
    """Totals as DOUBLE; an all-missing group totals 0."""
    return df.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))


def top_products(lineitem: DataFrame, part: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    return _top(product_totals(lineitem, part), "p_name", n)


def best_seller(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The single best-selling product (ties: name ascending)."""
    return _top(product_totals(lineitem, part), "p_name", 1)


def monthly_trend(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Calendar-month totals, ascending."""
    month = F.date_trunc("month", named(date_col)).cast("timestamp_ntz")
    dated = df.where(named(date_col).isNotNull()).select(month.alias("month_start"), quoted(value_col))
    return _double(grouped_sums(dated, ["month_start"], {"value": value_col})).orderBy("month_start")


def avg_by_category(df: DataFrame, key: str, value: str, digits: int | None = None) -> DataFrame:
    """Mean of ``value`` per non-NULL key; ``digits`` rounds the mean for display."""
    return _means(df.where(named(key).isNotNull()), [key], value, digits).orderBy(named(key))


def overall_avg(df: DataFrame, value: str, digits: int | None = None) -> DataFrame:
    return _means(df, [], value, digits)


def _means(df: DataFrame, keys: list[str], value: str, digits: int | None) -> DataFrame:
    """keys, avg_value (order-free total / number of values, NULL without any), n (that number)."""
    sums = grouped_sums(df, keys, {"total": value}, counts=True)
    return sums.select(*map(quoted, keys), _shown(F.try_divide(F.col("total").cast("double"), F.col("total_n")), digits).alias("avg_value"),
                       F.col("total_n").alias("n"))


def _shown(c, digits: int | None):
    return c if digits is None else F.round(c, digits)


def compare_regions(orders: DataFrame, customer: DataFrame, nation: DataFrame,
                    region: DataFrame) -> DataFrame:
    """Order totals per region over orders ⋈ customer ⋈ nation ⋈ region.

    Orders are first summed per customer, customers per nation; only 25 nations and 5
    regions meet the last two joins.
    """
    sums = {"value": "o_totalprice"}
    per_cust = partial_sums(orders.where(F.col("o_custkey").isNotNull()), ["o_custkey"], sums)
    per_nation = regrouped(per_cust.join(customer.select("c_custkey", "c_nationkey"),
                                         per_cust["o_custkey"] == customer["c_custkey"]), ["c_nationkey"], sums)
    geo = nation.select("n_nationkey", "n_regionkey").join(
        region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    named_parts = regrouped(per_nation.join(geo, per_nation["c_nationkey"] == geo["n_nationkey"]), ["r_name"], sums)
    return _double(whole_sums(named_parts, ["r_name"], sums)).orderBy(F.col("value").desc(), F.col("r_name").asc())
