"""Tables behind the monitoring charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.quantiles import exact_quantiles
from cohortwise.operators.relational import melt_numeric, null_out_sentinels, pivot_long_to_wide
from cohortwise.plans.stability import cut_columns, index_term, percent_positions, quantile_buckets
from cohortwise.plans.universe import default_rate


def mean_by_cohort(df: DataFrame, variables: Sequence[str], cohort: str, special_values: Mapping | None = None) -> DataFrame:
    long = melt_numeric(null_out_sentinels(df, special_values or {}), variables, keep=[cohort])
    return long.groupBy(cohort, "variable").agg(F.avg("value").alias("mean"))


def control_limits(table: DataFrame, metric: str, keys: Sequence[str] = ("variable",), below: float = 5, above: float = 5) -> DataFrame:
    """``table`` with lower and upper = mean -/+ a multiple of the deviation of the metric.

    ``table`` is already aggregated: one row per key and cohort.
    """
    whole = Window.partitionBy(*keys)
    mean, std = F.avg(metric).over(whole), F.stddev_samp(metric).over(whole)
    return table.select("*", (mean - below * std).alias("lower"), (mean + above * std).alias("upper"))


def median_by_cohort(df: DataFrame, variables: Sequence[str], cohort: str, special_values: Mapping | None = None) -> DataFrame:
    """cohort, variable, q_25, median, q_75."""
    long = melt_numeric(null_out_sentinels(df, special_values or {}), variables, keep=[cohort])
    names, points, by = ("q_25", "median", "q_75"), ["0.25", "0.5", "0.75"], [cohort, "variable"]
    quartiles = exact_quantiles(long, "value", points, by=by)
    slots = [F.max(F.when(F.col("position") == i, F.col("value"))).alias(name) for i, name in enumerate(names, 1)]
    return quartiles.groupBy(*by).agg(*slots)


def category_frequency_by_cohort(df: DataFrame, variables: Sequence[str], cohort: str) -> DataFrame:
    """cohort, variable, category, freq."""
    return _melt_categories(df, variables, [cohort]).groupBy(cohort, "variable", "category").agg(F.count("*").alias("freq"))


def category_pivot(frequencies: DataFrame, cohort: str, categories: Sequence[str]) -> DataFrame:
    """The same with one column per listed category, and ``freq_other`` for all that are not listed."""
    sums = [F.sum(F.when(F.col("category") == c, F.col("freq"))).alias(f"freq_{c}") for c in categories]
    unlisted = ~F.coalesce(F.col("category").isin(list(categories)), F.lit(False))
    other = F.coalesce(F.sum(F.when(unlisted, F.col("freq"))), F.lit(0)).alias("freq_other")
    return frequencies.groupBy(cohort, "variable").agg(*sums, other)


def _melt_categories(df: DataFrame, variables: Sequence[str], keep: Sequence[str]) -> DataFrame:
    wide = df.select(*keep, *[F.col(name).cast("string").alias(name) for name in variables])
    return wide.unpivot(list(keep), list(variables), "variable", "category")


def default_rate_by_quantile(
    df: DataFrame, variables: Sequence[str], target: str, n: int, special_values: Mapping | None = None
) -> DataFrame:
    """variable, bucket, total, bads, goods, tm and the upper cut of the bucket."""
    long = melt_numeric(null_out_sentinels(df, special_values or {}), variables, keep=[target])
    found, bucketed = quantile_buckets(long, n, [target])
    cuts = cut_columns(found, n)
    rates = default_rate(bucketed, ["variable", "bucket"], target, 4, weight="_n")
    ordered = cuts.select("variable", F.array_compact(F.array(*[f"cut_{i}" for i in range(1, n)])).alias("_cuts"))
    upper = F.coalesce(F.get("_cuts", F.col("bucket")), F.lit(float("inf")))
    return rates.join(F.broadcast(ordered), "variable", "left").withColumn("upper_cut", upper).drop("_cuts")


def default_rate_by_category(df: DataFrame, variables: Sequence[str], target: str) -> DataFrame:
    """variable, category, total, bads, goods, tm."""
    return default_rate(_melt_categories(df, variables, [target]), ["variable", "category"], target, 4)


def information_value_by_percentile(
    df: DataFrame, variables: Sequence[str], target: str, n: int, special_values: Mapping | None = None
) -> DataFrame:
    """variable, percentile, iv: information value of the split of a variable at each percentile."""
    long = melt_numeric(null_out_sentinels(df, special_values or {}), variables, keep=[target])
    _, bucketed = quantile_buckets(long, n, [target], unique=False)
    bad = F.col(target) * F.col("_n")
    counts = bucketed.groupBy("variable", "bucket").agg(F.sum(F.col("_n") - bad).alias("goods"), F.sum(bad).alias("bads"))
    # Bucket b holds the values that reached b cuts, so the part left of cut i is bucket < i.
    sides = []
    for i, position in enumerate(percent_positions(n), 1):
        left = F.col("bucket") < i
        sides.append(
            F.struct(
                F.lit(position).cast("double").alias("percentile"),
                F.sum(F.when(left, F.col("goods"))).alias("goods_left"),
                F.sum(F.when(left, F.col("bads"))).alias("bads_left"),
                F.sum("goods").alias("goods"),
                F.sum("bads").alias("bads"),
            )
        )
    split = counts.groupBy("variable").agg(F.array(*sides).alias("_s")).select("variable", F.inline("_s"))
    good_left = F.try_divide(F.col("goods_left"), F.col("goods"))
    bad_left = F.try_divide(F.col("bads_left"), F.col("bads"))
    iv = index_term(good_left, bad_left) + index_term(1 - good_left, 1 - bad_left)
    return split.select("variable", "percentile", iv.alias("iv"))


def information_value_wide(table: DataFrame, variables: Sequence[str]) -> DataFrame:
    """percentile and one information value column per variable."""
    return pivot_long_to_wide(table, ["percentile"], "variable", variables, "iv")
