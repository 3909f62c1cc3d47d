"""Chart aggregates: ranked bars, shares with a remainder, time series, trend, histogram.

Every operator is one declarative plan: a partial/final hash aggregate on the key, and a
``TakeOrderedAndProject`` for the top-k, so no task ever holds more than one partition's
groups plus k rows. Grand totals that steer a result (zero guard, shares) are scalar
subqueries over the same grouped aggregate, so the table is scanned once and its exchange is
reused; nothing is collected by this code.

Sums add the unrounded values by ``operators.exact``: the same bits for any order and partitioning.
NaN is missing, infinities stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named, quoted
from .exact import grouped_sums
from .rowindex import with_row_index

# ---------------------------------------------------------------------------------------
# Sizes of the reference charts and the remainder label of a pie chart.
BAR_LIMIT = 10
PIE_SLICES = 8
PIE_OTHER_LABEL = "Otros"
HISTOGRAM_BINS = 10
# ---------------------------------------------------------------------------------------


def no_nan(c: Column | str) -> Column:
    """NaN → NULL (missing), as the reference's statistics skip NaN; other values unchanged."""
    col = named(c) if isinstance(c, str) else c
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def present(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not missing: NULL groups are dropped."""
    return df.where(named(key).isNotNull())


def _ranked(df: DataFrame, key: str, value: str, n: int | None) -> DataFrame:
    out = df.orderBy(F.col(value).desc(), named(key).asc())
    return out.limit(n) if n else out


def bar_counts(df: DataFrame, key: str, n: int | None = BAR_LIMIT) -> DataFrame:
    """Frequency of each non-NULL key, most frequent first (ties: key ascending)."""
    g = present(df, key).groupBy(named(key)).agg(F.count(F.lit(1)).alias("value"))
    return _ranked(g, key, "value", n)


def bar_sums(df: DataFrame, key: str, value: str, n: int | None = BAR_LIMIT,
             zero_guard: bool = True) -> DataFrame:
    """Group sums, largest first: (key, value). With ``zero_guard`` the counts are used instead
    whenever the grand total of the group sums (over all groups, before the limit) is not > 0."""
    return bar_sums_labelled(df, key, value, n, zero_guard).select(quoted(key), "value")


def bar_sums_labelled(df: DataFrame, key: str, value: str, n: int | None = BAR_LIMIT,
                      zero_guard: bool = True) -> DataFrame:
    """``bar_sums`` with ``counted``: whether the guard put counts in place of the sums.

    The grand total is a subquery over the grouped aggregate itself (same columns, so Spark
    reuses its exchange); the table is read once.
    """
    g = grouped_sums(present(df, key), [key], {"_sum": value}, rows="_n").select(
        named(key), F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("_s"), "_n")
    counted = F.lit(False)
    if zero_guard:
        # both columns, as below: Spark reuses an exchange only if both plans read them alike
        grand = grouped_sums(g, [], {"s": "_s", "n": "_n"}).select(F.struct("s", "n")).scalar()
        counted = ~F.coalesce(grand.getField("s") > 0, F.lit(False))
    out = g.select(named(key), F.when(~counted, F.col("_s")).otherwise(F.col("_n").cast("double")).alias("value"),
                   counted.alias("counted"))
    return _ranked(out, key, "value", n)


def pie_shares(df: DataFrame, key: str, n: int = PIE_SLICES,
               other_label: str = PIE_OTHER_LABEL) -> DataFrame:
    """Top ``n`` frequencies plus one remainder row, with percent shares (1 decimal).

    Columns: ord, label, n, pct, is_other. A real category that happens to be called like
    the remainder label stays a separate row (``is_other`` tells them apart).

    Plan: one frequency aggregate → TakeOrderedAndProject(n) → a single-row aggregate of
    those n rows → ``explode`` into the n slices plus the remainder. The total is a scalar
    subquery over the same aggregate (its exchange is reused), so the table is read once and
    a key with millions of distinct values never meets an unpartitioned window.
    """
    freq = present(df, key).groupBy(named(key)).agg(F.count(F.lit(1)).alias("n"))
    total = freq.select(F.sum("n")).scalar()
    top = freq.orderBy(F.col("n").desc(), named(key).asc()).limit(n)
    one = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"),
                                                        named(key).alias("k")))).alias("items"),
                  F.coalesce(F.sum("n"), F.lit(0)).alias("top_n"))
    slices = F.transform("items", lambda x, i: F.struct(
        (i + 1).cast("bigint").alias("ord"), x["k"].cast("string").alias("label"),
        (-x["neg"]).cast("bigint").alias("n"),
        F.lit(False).alias("is_other")))
    rest_n = (total - F.col("top_n")).cast("bigint")
    rest = F.when(rest_n > 0, F.array(F.struct(F.lit(n + 1).cast("bigint").alias("ord"), F.lit(other_label).alias("label"),
                                               rest_n.alias("n"), F.lit(True).alias("is_other"))))
    rows = one.select(F.explode(F.concat(slices, F.coalesce(rest, F.array().cast(slices_type())))).alias("r"))
    return rows.select("r.ord", "r.label", "r.n",
                       F.round(F.lit(100.0) * F.col("r.n") / total, 1).alias("pct"), "r.is_other")


def slices_type() -> str:
    return "array<struct<ord:bigint,label:string,n:bigint,is_other:boolean>>"


def time_series(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Sum of the value per exact timestamp, ascending (no calendar bucketing)."""
    return grouped_sums(present(df, date_col), [date_col], {"value": value_col}).select(
        named(date_col), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")).orderBy(named(date_col))


def series_by_index(df: DataFrame, value_col: str, order_by: list[str]) -> DataFrame:
    """(row_idx, value) when a table has no usable date column."""
    return with_row_index(df.select(*map(quoted, dict.fromkeys(order_by + [value_col]))), order_by) \
        .select("row_idx", quoted(value_col))


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(*map(quoted, dict.fromkeys([x, y])))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line y = slope*x + intercept over the rows where both are present.

    NULL when fewer than two such rows exist or x is constant.
    """
    return df.agg(F.regr_slope(named(y), named(x)).alias("slope"),
                  F.regr_intercept(named(y), named(x)).alias("intercept"),
                  F.regr_count(named(y), named(x)).cast("bigint").alias("n"))


def trend_values(df: DataFrame, x: str, y: str, keep: list[str],
                 digits: int | None = None) -> DataFrame:
    """The fitted line evaluated at each row's x (fit inlined as a scalar subquery)."""
    fit = linear_trend(df, x, y).select(F.struct("slope", "intercept").alias("f")).scalar()
    fitted = fit.getField("slope") * named(x) + fit.getField("intercept")
    if digits is not None:
        fitted = F.round(fitted, digits)
    return df.select(*map(quoted, keep), fitted.alias("y_fit"))


def histogram(df: DataFrame, c: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram over [min, max]; the maximum falls into the last bin."""
    v = no_nan(named(c).cast("double"))
    rng = df.select(F.struct(F.min(v).alias("mn"), F.max(v).alias("mx")).alias("r")).scalar()
    mn, mx = rng.getField("mn"), rng.getField("mx")
    width = (mx - mn) / F.lit(float(bins))
    raw = F.when(width > 0, F.floor((v - mn) / width)).otherwise(F.lit(0))
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        (mn + F.col("bin") * width).alias("bin_start"),
        (mn + (F.col("bin") + 1) * width).alias("bin_end"),
        "n").orderBy("bin")
