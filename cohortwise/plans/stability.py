"""Stability index between two samples and PSI across cohorts.

All variables are handled together: one melt, and two reads of it for cuts and bucket counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.quantiles import bracket_counts, settle_quantiles
from cohortwise.functions.scalars import safe_ratio
from cohortwise.operators.relational import melt_numeric, null_out_sentinels, pivot_long_to_wide

# Limits of the stability index between no, some and significant differences.
STABLE_BELOW = 0.10
SHIFTED_ABOVE = 0.25


def percent_positions(n: int) -> list[str]:
    """1/n .. (n-1)/n to two decimals."""
    return [f"{i / n:.2f}" for i in range(1, n)]


def cut_columns(cuts: DataFrame, n: int, unique: bool = True) -> DataFrame:
    """One row per variable with ``cut_1 ..``; with ``unique`` a repeated cut becomes null."""
    slots = [F.expr(f"max(value) filter (where position = {i}) as cut_{i}") for i in range(1, n)]
    wide = cuts.groupBy("variable").agg(*slots)
    if not unique:
        return wide
    first = ["cut_1"] if n > 1 else []
    rest = [f"case when cut_{i} > cut_{i - 1} then cut_{i} end as cut_{i}" for i in range(2, n)]
    return wide.selectExpr("variable", *first, *rest)


def assign_bucket(long: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
    """``long`` with ``bucket``: how many cuts the value has reached (closed on the left).

    ``cuts`` has one row per variable of the caller's list, so it is small enough to broadcast.
    """
    reached = [f"case when value >= cut_{i} then 1 else 0 end" for i in range(1, n)]
    bucket = " + ".join(reached) or "0"
    kept = [f"`{name}`" for name in long.columns]
    return long.join(F.broadcast(cuts), "variable", "left").selectExpr(*kept, f"{bucket} as bucket")


def quantile_buckets(
    long: DataFrame, n: int, keep: Sequence[str], reference: Column | None = None, unique: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Cuts of a melted table at ``n`` equal parts of the ``reference`` rows, and all rows counted by bucket.

    Cuts: variable, position, value. Counts: variable, ``keep``, bucket and _n, from the same two reads
    that settle the cuts: what lies between two values of a row without a value of its own no cut splits.
    """
    points = percent_positions(n)
    counts = bracket_counts(long, "value", points, ["variable"], keep, reference, few=True)
    cuts = settle_quantiles(counts, points, ["variable"])
    placed = counts.select("variable", *keep, F.coalesce("_x", "_at").alias("value"), "_n")
    return cuts, assign_bucket(placed, cut_columns(cuts, n, unique), n).select("variable", *keep, "bucket", "_n")


def index_term(p: Column, q: Column) -> Column:
    """``(p - q) ln(p / q)``; null when either share is zero or missing."""
    return (p - q) * F.ln(F.try_divide(p, q))


def two_labels(df: DataFrame, column: str) -> tuple:
    """The two values of a label column in order; anything but two is an error."""
    found = [row[0] for row in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(3).collect()]
    if len(found) != 2:
        raise ValueError(f"column {column!r} must hold exactly two labels, not {sorted(map(str, found))}")
    return tuple(sorted(found))


def stability_index(
    df: DataFrame,
    variables: Sequence[str],
    sample: str,
    n: int,
    special_values: Mapping[str, Sequence] | None = None,
    labels: tuple | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Bucket table and cut points of sample X against sample Y.

    ``labels`` is (X, Y), by default the two values found, in order. Cuts are quantiles of X
    without special values. Buckets: variable, bucket, frequency_x, proportion_x, frequency_y,
    proportion_y, ie, for the buckets X has rows in; shares are rounded to 3 decimals first.
    """
    x, y = labels or two_labels(df, sample)
    both = null_out_sentinels(df.filter(F.col(sample).isin(x, y)), special_values or {})
    long = melt_numeric(both, variables, keep=[sample])
    cuts, bucketed = quantile_buckets(long, n, [sample], F.col(sample) == x)
    of = lambda label: F.sum(F.when(F.col(sample) == label, F.col("_n")).otherwise(0))
    counts = bucketed.groupBy("variable", "bucket").agg(of(x).alias("fx"), of(y).alias("fy"))
    whole = Window.partitionBy("variable")
    shares = counts.select(
        "variable", "bucket", "fx", "fy",
        F.round(F.col("fx") / F.sum("fx").over(whole), 3).alias("px"),
        F.round(safe_ratio(F.col("fy"), F.sum("fy").over(whole)), 3).alias("py"),
    ).filter(F.col("fx") > 0)
    has_y = F.col("fy") > 0
    buckets = shares.select(
        "variable", "bucket",
        F.col("fx").alias("frequency_x"), F.col("px").alias("proportion_x"),
        F.when(has_y, F.col("fy")).alias("frequency_y"), F.when(has_y, F.col("py")).alias("proportion_y"),
        F.when(has_y, index_term(F.col("px"), F.col("py"))).alias("ie"),
    )
    return buckets, cuts


def stability_summary(buckets: DataFrame) -> DataFrame:
    """Index of each variable, skipping buckets without one, and its decision band."""
    total = buckets.groupBy("variable").agg(F.sum("ie").alias("ie"))
    band = (
        F.when(F.col("ie") < STABLE_BELOW, "no difference")
        .when(F.col("ie") <= SHIFTED_ABOVE, "some difference")
        .when(F.col("ie") > SHIFTED_ABOVE, "significant difference")
    )
    return total.withColumn("band", band)


def psi_table(
    df: DataFrame,
    variables: Sequence[str],
    cohort: str,
    n: int,
    base=None,
    special_values: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """cohort, variable, bucket, freq, total, proportion (5 decimals) from the base cohort on.

    Cuts come from the base cohort (the smallest one unless given) without special values. Rows
    with a null in any variable are left out; special values are counted in their bucket.
    """
    start = F.lit(base) if base is not None else df.agg(F.min(cohort)).scalar()
    rows = df.filter(F.col(cohort) >= start).select(cohort, *variables).na.drop(how="any")
    special = [
        (F.col("variable") == name) & F.col("value").isin([float(code) for code in codes])
        for name, codes in (special_values or {}).items()
        if name in variables and len(codes)
    ]
    at_base = reduce(Column.__and__, [~s for s in special], F.col(cohort) == start)
    _, bucketed = quantile_buckets(melt_numeric(rows, variables, keep=[cohort]), n, [cohort], at_base)
    counts = bucketed.groupBy(cohort, "variable", "bucket").agg(F.sum("_n").alias("freq"))
    total = F.sum("freq").over(Window.partitionBy(cohort, "variable"))
    return counts.withColumn("total", total).withColumn("proportion", F.round(F.col("freq") / F.col("total"), 5))


def psi_by_cohort(table: DataFrame, cohort: str, base=None) -> DataFrame:
    """PSI of each cohort against the base, from the shares of a ``psi_table``: variable, cohort, psi, skipped.

    A bucket counts if it has a share on both sides, as in the stability index; ``skipped`` is the
    number of buckets that only one side has.
    """
    start = F.lit(base) if base is not None else table.agg(F.min(cohort)).scalar()
    reference = F.max(F.when(F.col(cohort) == start, F.col("proportion"))).over(Window.partitionBy("variable", "bucket"))
    both = (F.col("proportion") > 0) & (F.col("_base") > 0)
    in_base = table.filter((F.col(cohort) == start) & (F.col("proportion") > 0)).groupBy("variable").agg(F.count("*").alias("_buckets"))
    summed = (
        table.withColumn("_base", reference)
        .groupBy("variable", cohort)
        .agg(
            F.sum(index_term(F.col("proportion"), F.col("_base"))).alias("psi"),
            F.count_if(both).alias("_shared"),
            F.count_if(F.col("proportion") > 0).alias("_own"),
        )
    )
    only_one = F.col("_own") + F.coalesce("_buckets", F.lit(0)) - 2 * F.col("_shared")
    return summed.join(in_base, "variable", "left").select("variable", cohort, "psi", only_one.alias("skipped"))


def psi_wide(table: DataFrame, cohort: str, n: int) -> DataFrame:
    """Shares with one column per bucket: variable, cohort, q_0 .."""
    return pivot_long_to_wide(table, ["variable", cohort], "bucket", list(range(n)), "proportion", "q_")
