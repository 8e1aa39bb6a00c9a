"""Size, periods, distributions and default rates of a scored population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.scalars import safe_ratio, yyyymm_year
from cohortwise.operators.relational import share_of_total


def table_dimension(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def cohort_range(df: DataFrame, cohort: str) -> DataFrame:
    return df.agg(F.min(cohort).cast("int").alias("min_cohort"), F.max(cohort).cast("int").alias("max_cohort"))


def period_distribution(df: DataFrame, cohort: str) -> DataFrame:
    """Rows of each year of a yyyymm cohort with their share, to 4 decimals."""
    counts = df.groupBy(yyyymm_year(F.col(cohort)).alias("year")).agg(F.count("*").alias("count"))
    return share_of_total(counts).withColumn("proportion", F.round("proportion", 4))


def default_rate(
    df: DataFrame, keys: Sequence[str], target: str, digits: int, counted: str | None = None, weight: str | None = None
) -> DataFrame:
    """Per group: total, bads, goods and tm = bads / total.

    Rows are counted where ``counted`` (the last key unless given) is known; a row stands for ``weight``
    rows if that column is given.
    """
    known, bad = F.col(counted or keys[-1]), F.col(target)
    total = F.count(known) if weight is None else F.coalesce(F.sum(F.when(known.isNotNull(), F.col(weight))), F.lit(0))
    bads = F.sum(bad if weight is None else bad * F.col(weight))
    grouped = df.groupBy(*keys).agg(total.alias("total"), bads.cast("bigint").alias("bads"))
    return grouped.select(
        "*",
        (F.col("total") - F.col("bads")).alias("goods"),
        F.round(safe_ratio(F.col("bads"), F.col("total")), digits).alias("tm"),
    )


def default_rate_by_year(df: DataFrame, cohort: str, target: str) -> DataFrame:
    return default_rate(df.withColumn("year", yyyymm_year(F.col(cohort))), ["year"], target, 4)


def default_rate_by_cohort(df: DataFrame, cohort: str, target: str) -> DataFrame:
    return default_rate(df, [cohort], target, 4).orderBy(cohort)


def default_rate_by_segment_cohort(df: DataFrame, segment: str, cohort: str, target: str) -> DataFrame:
    """All segments in one aggregate; a segment may have any type."""
    return default_rate(df, [segment, cohort], target, 4).orderBy(segment, cohort)


def default_rate_by_segment_sample(df: DataFrame, segment: str, sample: str, target: str) -> DataFrame:
    return default_rate(df, [sample, segment], target, 5).orderBy(F.asc(segment), F.desc(sample))


def distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each group with their share of the table."""
    return share_of_total(df.groupBy(*keys).agg(F.count("*").alias("count")))


def distribution_report(df: DataFrame, segment: str, sample: str, target: str) -> DataFrame:
    """The five distributions over segment, sample and target from one scan.

    view, the three keys (null where a view does not use them), count, proportion.
    """
    views = {
        "segment": [segment],
        "sample": [sample],
        "segment_sample": [segment, sample],
        "target": [target],
        "sample_target": [sample, target],
    }
    keys = [segment, sample, target]
    label = F.lit(None).cast("string")
    for name, used in views.items():
        bits = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in used)
        label = F.when(F.col("_view") == bits, F.lit(name)).otherwise(label)
    grouped = df.groupingSets([list(used) for used in views.values()], *keys).agg(
        F.count("*").alias("count"), F.grouping_id().alias("_view")
    )
    share = F.col("count") / F.sum("count").over(Window.partitionBy("view"))
    return grouped.select(label.alias("view"), *keys, "count").withColumn("proportion", share)
