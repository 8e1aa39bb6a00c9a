"""Weighted mean curves, their correction, and monthly profiles from yearly ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean_curve(
    df: DataFrame,
    weights: Sequence[str],
    values: Sequence[str],
    keys: Sequence[str] = (),
    condition: Column | None = None,
) -> DataFrame:
    """``keys`` and ``curve``: at each point sum(value) / sum(weight), null without weight.

    The values are taken as already multiplied by their weights.
    """
    if condition is not None:
        df = df.filter(condition)
    sums = [F.sum(w).alias(f"_w{i}") for i, w in enumerate(weights)]
    sums += [F.sum(v).alias(f"_v{i}") for i, v in enumerate(values)]
    points = [F.when(F.col(f"_w{i}") > 0, F.col(f"_v{i}") / F.col(f"_w{i}")) for i in range(len(weights))]
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*points).alias("curve"))


# The default bounds are those of the curve's specification.
def monotone_clamped_curve(df: DataFrame, curve: str = "curve", lower: float = -2.0, upper: float = 1.5) -> DataFrame:
    """Replace ``curve`` by a non-falling one inside the bounds; the first point stays as it is.

    A point below the one before it is raised to it (``corrected`` = S), then held at the upper
    (``clamped`` = S) or the lower bound (``clamped`` = I); ``clamped`` tells the last case met.
    A null counts as zero in the comparison. Each point depends on the corrected one before it,
    hence a fold over the array and not a window.
    """
    start = F.struct(
        F.array().cast("array<double>").alias("points"),
        F.lit(None).cast("string").alias("corrected"),
        F.lit(None).cast("string").alias("clamped"),
    )

    def step(done: Column, point: Column) -> Column:
        later = F.size(done["points"]) > 0
        before = F.try_element_at(done["points"], F.lit(-1))
        falls = later & (_or_zero(point) < _or_zero(before))
        raised = F.when(falls, F.greatest(before, point)).otherwise(point)
        high = later & (_or_zero(raised) > upper)
        low = later & (_or_zero(raised) < lower)
        held = F.when(high, upper).when(low, lower).otherwise(raised)
        return F.struct(
            F.concat(done["points"], F.array(held)).alias("points"),
            F.when(falls, "S").otherwise(done["corrected"]).alias("corrected"),
            F.when(high, "S").when(low, "I").otherwise(done["clamped"]).alias("clamped"),
        )

    rest = [name for name in df.columns if name != curve]
    folded = df.select(*rest, F.aggregate(F.col(curve).cast("array<double>"), start, step).alias("_f"))
    return folded.select(*rest, F.col("_f.points").alias(curve), "_f.corrected", "_f.clamped")


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def curve_by_segment(df: DataFrame, segment: str, weights: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The corrected mean curve of every segment in one aggregate: segment, curve and its flags."""
    return monotone_clamped_curve(weighted_mean_curve(df, weights, values, [segment]))


def curve_of(df: DataFrame, label: str, condition: Column, weights: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The corrected mean curve of the rows under a condition, labelled ``segment``."""
    curve = weighted_mean_curve(df, weights, values, condition=condition)
    return monotone_clamped_curve(curve).withColumn("segment", F.lit(label))


def profile_fill(
    df: DataFrame, client: str, period: str, profile: str, first_year: int, last_year: int, order: str | None = None
) -> DataFrame:
    """client, period, profile for every month of the years, from profiles at year end (yyyy12).

    December has the year's own profile if there is one. The other months carry the last profile
    known at the end of the year before, and the first year has its own December throughout.
    Where a client has several rows in a year the one with the largest ``order`` counts. Every
    client of ``df`` gets all its months, null where nothing is known; rows outside the years add
    nothing else.

    One aggregate with a slot per year replaces a client-month grid: a client costs one row in
    the shuffle, whatever the number of its rows.
    """
    years = list(range(first_year, last_year + 1))

    def own(year: int) -> Column:
        here = F.col(period) == year * 100 + 12
        if order is None:
            return F.max(F.when(here, F.col(profile)))
        return F.max_by(F.when(here, F.col(profile)), F.when(here, F.col(order)))

    slots = df.groupBy(client).agg(*[own(year).alias(f"_y{i}") for i, year in enumerate(years)])

    def known(i: int) -> Column:
        return F.coalesce(*[F.col(f"_y{j}") for j in range(i, -1, -1)])

    by_year = F.array(
        *[
            F.struct(F.lit(year).alias("_year"), known(max(i - 1, 0)).alias("_before"), known(i).alias("_own"))
            for i, year in enumerate(years)
        ]
    )
    months = slots.select(client, F.inline(by_year)).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_m"))
    return months.select(
        client,
        (F.col("_year") * 100 + F.col("_m")).alias(period),
        F.when(F.col("_m") == 12, F.col("_own")).otherwise(F.col("_before")).alias(profile),
    )
