"""Least-squares fits and the Chow test for a structural break, from sufficient statistics.

The rows are read once and reduced to counts and covariances; the fit itself works on one short
array per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.scalars import safe_ratio


def _co_moments(y: str, xs: Sequence[str], part: Column | None = None) -> Column:
    """Upper triangle of the centred cross products of (xs, y), row by row, divided by n."""
    cells = []
    names = [*xs, y]
    for i, a in enumerate(names):
        for b in names[i:]:
            left, right = F.col(a).cast("double"), F.col(b).cast("double")
            if part is not None:
                left, right = F.when(part, left), F.when(part, right)
            cells.append(F.covar_pop(left, right))
    return F.array(*cells)


def _residual_share(n: Column, cov: Column, k: int) -> Column:
    """Residual sum of squares of y on ``k`` regressors and an intercept.

    One regressor has a closed form; more are solved for all groups of a batch at once.
    """
    if k == 1:
        xx, xy, yy = (cov[i] for i in range(3))
        explained = F.coalesce(F.try_divide(xy * xy, xx), F.when(xx.isNotNull() & xy.isNotNull(), F.lit(0.0)))
        return F.when(n > 0, F.greatest(F.lit(0.0), n * (yy - explained)))

    @F.pandas_udf("double")
    def rss(count: pd.Series, triangle: pd.Series) -> pd.Series:
        import numpy as np

        size = (k + 1) * (k + 2) // 2
        cells = np.array([c if c is not None else [np.nan] * size for c in triangle], dtype="float64").reshape(-1, size)
        known = (count.to_numpy("float64", na_value=0) > 0) & np.isfinite(cells).all(axis=1)
        full = np.zeros((len(cells), k + 1, k + 1))
        rows, columns = np.triu_indices(k + 1)
        full[:, rows, columns] = full[:, columns, rows] = np.where(known[:, None], cells, 0.0)
        xx, xy = full[:, :k, :k], full[:, :k, k]
        slope = np.linalg.pinv(xx, hermitian=True) @ xy[:, :, None]
        left = full[:, k, k] - (slope[:, :, 0] * xy).sum(axis=1)
        return pd.Series(np.where(known, np.maximum(0.0, count.to_numpy("float64", na_value=0) * left), np.nan)).where(known, None)

    return rss(n.cast("double"), cov)


def f_survival(statistic: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution, from the incomplete beta function.

    The continued fraction of DLMF 8.17.22 is taken as a product of two-by-two matrices, term by term
    for all rows of a batch at once, until no row changes.
    """

    @F.pandas_udf("double")
    def tail(stat: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        import math

        import numpy as np

        f, p, q = (s.to_numpy("float64", na_value=np.nan) for s in (stat, one, two))
        known = ~np.isnan(f) & (p > 0) & (q > 0)
        inside = known & (f > 0) & np.isfinite(f)
        out = np.where(known, np.where(f > 0, 0.0, 1.0), np.nan)
        a, b = q[inside] / 2, p[inside] / 2
        x = q[inside] / (q[inside] + p[inside] * f[inside])
        swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast below this point
        a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        lgamma = np.vectorize(math.lgamma, otypes=["float64"])
        if len(x):
            front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
            # numerators and denominators of the last two convergents of 1 / (1 + d1 / (1 + d2 / ...))
            older, newer = (np.zeros_like(x), np.ones_like(x)), (np.ones_like(x), np.ones_like(x))
            value = np.ones_like(x)
            for term in range(1, 2000):
                m = term // 2
                if term % 2:
                    d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                else:
                    d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                older, newer = newer, tuple(u + d * v for u, v in zip(newer, older))
                scale = np.where(np.abs(newer[1]) > 1e100, 1e-100, 1.0)
                older, newer = tuple(u * scale for u in older), tuple(u * scale for u in newer)
                before, value = value, newer[0] / newer[1]
                if term > 3 and (np.abs(value - before) <= 1e-15 * np.abs(value)).all():
                    break
            share = np.clip(front * value, 0.0, 1.0)
            out[inside] = np.where(swap, 1 - share, share)
        return pd.Series(out).where(known, None)

    return tail(statistic.cast("double"), d1.cast("double"), d2.cast("double"))


def ols_rss(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, n, rss of the fit of y on xs with an intercept; rows with a null are left out."""
    rows = df.na.drop(subset=[y, *xs])
    moments = rows.groupBy(*keys).agg(F.count("*").alias("n"), _co_moments(y, xs).alias("_cov"))
    return moments.select(*keys, "n", _residual_share(F.col("n"), F.col("_cov"), len(xs)).alias("rss"))


def chow_test(df: DataFrame, y: str, xs: Sequence[str], later: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, n_1, n_2, rss, rss_1, rss_2, statistic, p_value for a break marked by ``later``.

    Both halves and the whole come from the same pass; ``later`` is true from the break on.
    """
    k = len(xs) + 1
    rows = df.withColumn("_later", later).filter(F.col("_later").isNotNull()).na.drop(subset=[y, *xs])
    after, before = F.col("_later"), ~F.col("_later")
    moments = rows.groupBy(*keys).agg(
        F.count_if(before).alias("n_1"),
        F.count_if(after).alias("n_2"),
        _co_moments(y, xs).alias("_all"),
        _co_moments(y, xs, before).alias("_before"),
        _co_moments(y, xs, after).alias("_after"),
    )
    fitted = moments.select(
        *keys, "n_1", "n_2",
        _residual_share(F.col("n_1") + F.col("n_2"), F.col("_all"), k - 1).alias("rss"),
        _residual_share(F.col("n_1"), F.col("_before"), k - 1).alias("rss_1"),
        _residual_share(F.col("n_2"), F.col("_after"), k - 1).alias("rss_2"),
    )
    return _tested(fitted, k)


def _tested(fitted: DataFrame, k: int) -> DataFrame:
    """Statistic and p-value from n_1, n_2, rss, rss_1 and rss_2 of fits with ``k`` coefficients."""
    halves = F.col("rss_1") + F.col("rss_2")
    free = F.col("n_1") + F.col("n_2") - 2 * k
    statistic = safe_ratio((F.col("rss") - halves) / k, safe_ratio(halves, free))
    return fitted.withColumn("statistic", statistic).withColumn("p_value", f_survival(F.col("statistic"), F.lit(k), free))


def chow_scan(df: DataFrame, y: str, xs: Sequence[str], later: Column, keys: Sequence[str], level: float = 0.05) -> DataFrame:
    """``chow_test`` of every group with ``breaks``: whether equal coefficients are rejected."""
    tested = chow_test(df, y, xs, later, keys)
    return tested.withColumn("breaks", (F.col("p_value") < level).cast("int"))


def chow_by_date(
    df: DataFrame, y: str, xs: Sequence[str], date: str, keys: Sequence[str] = (), unit: str = "day", least: int | None = None
) -> DataFrame:
    """``chow_test`` for a break at every date of every group, from one read of the rows.

    Returns ``keys``, break_date (the first date after the break, cut to ``unit``: day, week, month, quarter
    or year), n_1, n_2, rss, rss_1, rss_2, statistic, p_value, for the breaks that leave ``least`` rows
    (one more than coefficients, unless given) on both sides. Rows with a null are left out.

    Rows are reduced to counts, means and covariances by group and date, so a group is dealt out by date
    and has at most one row a day after that. Moments around the group's mean are then summed along
    the dates: what is before a break is a running sum, what comes after is the rest.
    """
    k = len(xs) + 1
    names = [*xs, y]
    at = F.date_trunc(unit, F.col(date)).cast("date").alias("break_date")
    means = [F.avg(F.col(name).cast("double")).alias(f"_m{i}") for i, name in enumerate(names)]
    rows = df.na.drop(subset=[y, *xs, date])
    dates = rows.groupBy(*keys, at).agg(F.count("*").alias("_n"), *means, _co_moments(y, xs).alias("_cov"))

    whole = Window.partitionBy(*keys)
    n = F.col("_n")
    dates = dates.withColumns({f"_c{i}": F.sum(n * F.col(f"_m{i}")).over(whole) / F.sum("_n").over(whole) for i in range(k)})
    away = [F.col(f"_m{i}") - F.col(f"_c{i}") for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = {"_n": n} | {f"_s{i}": n * away[i] for i in range(k)}
    sums |= {f"_q{i}_{j}": n * (F.col("_cov")[at] + away[i] * away[j]) for at, (i, j) in enumerate(cells)}
    dates = dates.select(*keys, "break_date", *[c.cast("double").alias(name) for name, c in sums.items()])
    before = whole.orderBy("break_date").rowsBetween(Window.unboundedPreceding, -1)
    totals = dates.select(
        *keys, "break_date",
        *[F.sum(name).over(whole).alias(f"{name}_0") for name in sums],
        *[F.coalesce(F.sum(name).over(before), F.lit(0.0)).alias(f"{name}_1") for name in sums],
    )
    totals = totals.withColumns({f"{name}_2": F.col(f"{name}_0") - F.col(f"{name}_1") for name in sums})
    enough = k + 1 if least is None else max(1, least)
    totals = totals.filter((F.col("_n_1") >= enough) & (F.col("_n_2") >= enough))

    def rss(part: int) -> Column:
        count, first = F.col(f"_n_{part}"), [F.col(f"_s{i}_{part}") / F.col(f"_n_{part}") for i in range(k)]
        cov = F.array(*[F.col(f"_q{i}_{j}_{part}") / count - first[i] * first[j] for i, j in cells])
        return _residual_share(count, cov, k - 1)

    counts = [F.col(f"_n_{part}").cast("bigint").alias(f"n_{part}") for part in (1, 2)]
    fits = [rss(part).alias(name) for part, name in enumerate(("rss", "rss_1", "rss_2"))]
    return _tested(totals.select(*keys, "break_date", *counts, *fits), k)


def largest_break(tested: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of each group of ``chow_by_date`` the row with the largest statistic, the earliest if tied.

    Its p-value is that of a test at this date alone, not of a search over dates.
    """
    names = [name for name in tested.columns if name not in keys]
    order = F.struct("statistic", -F.unix_date("break_date"))
    best = tested.filter("statistic is not null").groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("_best"))
    return best.select(*keys, "_best.*")
