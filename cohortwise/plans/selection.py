"""Which variables to drop: correlated with a stronger one, hardly varying, or unimportant."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.quantiles import exact_quantiles, quantiles_approx, rank_auc
from cohortwise.operators.aggregates import join_strings, pearson_matrix
from cohortwise.operators.relational import (
    melt_numeric,
    null_out_sentinels,
    numeric_columns,
    threshold_rank,
    top_rows,
)
from cohortwise.session import scratch_table, scratch_tables
from cohortwise.sources.readers import persist_stage, settled

# Numbers in a part of a working table; a forest's row takes about 8 bytes for each of them.
PART_NUMBERS = 1 << 24
# Most steps of a fit, most reads with the steps that were halved, and the sums of a read: loss, its falls and curvatures.
LOGISTIC_STEPS = 10
LOGISTIC_READS = 40
LOGISTIC_SUMS = ("loss", "g0", "g1", "h00", "h01", "h11")


def candidates(df: DataFrame, variables: Sequence[str], target: str, black_list: Sequence[str] = ()) -> list[str]:
    """The numeric variables that are neither the target nor black-listed."""
    out = {target, *black_list}
    return [name for name in numeric_columns(df, variables) if name not in out]


def correlated_pairs(df: DataFrame, variables: Sequence[str], limit: float) -> DataFrame:
    """row, column, correlation for pairs whose absolute correlation is above the limit."""
    return threshold_rank(pearson_matrix(df, variables, limit), "correlation", limit)


def pair_members(pairs: DataFrame) -> DataFrame:
    """The variables that appear in a pair."""
    return pairs.select(F.explode(F.array("row", "column")).alias("variable")).distinct()


def univariate_gini(
    df: DataFrame, variables: Sequence[str], target: str, only: DataFrame | None = None, method: str = "rank"
) -> DataFrame:
    """variable, gini, direction (d: bads have the larger values, u: the smaller ones).

    ``only`` is a table of at most ``len(variables)`` names to restrict the work to. The rank
    method is exact and needs no fit; ``logistic`` fits one model per variable, whose curve
    always points the same way; it takes the ranks of the fitted answers.
    """
    if method == "logistic":
        names = [r[0] for r in only.select("variable").collect()] if only is not None else variables
        return _logistic_gini(df, [v for v in variables if v in names], target)
    long = melt_numeric(df, variables, keep=[target])
    if only is not None:
        long = long.join(F.broadcast(only.select("variable")), "variable", "left_semi")
    auc = rank_auc(long, "variable", "value", target)
    return auc.select(
        "variable",
        F.abs(2 * F.col("auc") - 1).alias("gini"),
        F.when(F.col("auc") < 0.5, "u").otherwise("d").alias("direction"),
    )


def _logistic_gini(df: DataFrame, variables: Sequence[str], target: str) -> DataFrame:
    """Fits of all variables from one persisted table, and the rank AUC of what the fitted models answer."""
    if not variables:
        return df.sparkSession.createDataFrame([], "variable string, gini double, direction string")
    kept = [F.col(v).cast("double").alias(v) for v in variables]
    with working_table(df.select(*kept, F.col(target).cast("double").alias("label")).na.drop(subset=["label"])) as table:
        fits = _logistic_fits(table, variables)
        answer = lambda v: 1 / (1 + F.exp(-(F.lit(fits[v][0]) + F.lit(fits[v][1]) * F.col(v))))
        known = [F.when(~F.isnan(v), answer(v)).alias(v) for v in variables]
        auc = settled(rank_auc(melt_numeric(table.select("label", *known), variables, keep=["label"]), "variable", "value", "label"))
    of = F.coalesce("auc", F.when(F.col("positives") > 0, 1.0).otherwise(0.0))  # a single class
    return auc.select("variable", F.abs(2 * of - 1).alias("gini"), F.when(of < 0.5, "u").otherwise("d").alias("direction"))


def _logistic_fits(table: DataFrame, variables: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Intercept and slope of a logistic regression of ``label`` on each variable alone.

    Newton's method on standardised variables: one read of the table is a step of all fits, a task gives a
    few sums for each. A step that makes the loss larger is halved. Without two classes or two values the
    slope is 0.
    """
    own = melt_numeric(table, variables, keep=["label"]).groupBy("variable").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg("label").alias("rate"),
        F.expr("count_if(label not in (0D, 1D) or abs(value) = double('infinity')) as wrong"),
    )
    known = {r["variable"]: r for r in own.collect()}
    if unfit := [v for v in variables if v not in known or known[v]["wrong"]]:
        raise ValueError(f"a fit needs known finite values and labels 0 or 1: {unfit}")
    at = {v: np.array([np.log(r["rate"] / (1 - r["rate"])), 0.0]) if 0 < r["rate"] < 1 else np.zeros(2) for v, r in known.items()}
    best, step, taken = {v: (np.inf, at[v]) for v in variables}, {}, dict.fromkeys(variables, 0)
    left = [v for v in variables if 0 < known[v]["rate"] < 1 and known[v]["std"]]
    for _ in range(LOGISTIC_READS):
        if not left:
            break
        sums = _logistic_sums(table, [(v, known[v]["mean"], known[v]["std"], *map(float, at[v])) for v in left])
        for v in list(left):
            loss, g0, g1, h00, h01, h11 = sums[v]
            if loss > best[v][0] * (1 + 1e-12):
                step[v] = step[v] / 2
            else:
                best[v], taken[v] = (loss, at[v]), taken[v] + 1
                # no steps are left, or all answers are 0 or 1
                if taken[v] > LOGISTIC_STEPS or not h00 * h11 - h01 * h01 > 1e-12 * h00 * h11:
                    left.remove(v)
                    continue
                step[v] = np.linalg.solve([[h00, h01], [h01, h11]], [g0, g1])
            at[v] = best[v][1] + step[v]
            if np.abs(step[v]).max() < 1e-9:
                left.remove(v)
    fits = {}
    for v in variables:
        slope = float(best[v][1][1]) / known[v]["std"] if known[v]["std"] else 0.0
        fits[v] = float(best[v][1][0]) - slope * known[v]["mean"], slope
    return fits


def _logistic_sums(table: DataFrame, fits: Sequence[tuple]) -> dict[str, tuple[float, ...]]:
    """Loss, its falls and curvatures of fits (variable, mean, std, intercept, slope), over the rows that know the variable."""
    names = [fit[0] for fit in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), 6))
        for batch in batches:
            label, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k, ((_, mean, std, a, b), x) in enumerate(zip(fits, columns, strict=True)):
                known = ~np.isnan(x)
                y, z = label[known], (x[known] - mean) / std
                margin = a + b * z
                small = np.exp(-np.abs(margin))
                p = np.where(margin >= 0, 1.0, small) / (1 + small)
                w, miss = p * (1 - p), y - p
                wz = w * z
                total[k] += (np.log1p(small) + np.maximum(margin, 0) - y * margin).sum(), miss.sum(), miss @ z, w.sum(), wz.sum(), wz @ z
        yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, total.T)], ["variable", *LOGISTIC_SUMS])

    schema = ", ".join(["variable string", *(f"{name} double" for name in LOGISTIC_SUMS)])
    parts = table.select("label", *names).mapInArrow(run, schema)
    return {r[0]: tuple(r)[1:] for r in parts.groupBy("variable").agg(*[F.sum(name) for name in LOGISTIC_SUMS]).collect()}


def attach_gini(pairs: DataFrame, gini: DataFrame) -> DataFrame:
    """Pairs with row_gini, column_gini and ``drop``: the weaker one, on a tie the column side.

    The ginis, one per variable, enter as one map value, so that they are computed once although
    both sides of a pair look them up.
    """
    by_name = gini.agg(F.map_from_entries(F.collect_list(F.struct("variable", "gini")))).scalar()
    both = pairs.withColumn("_gini", by_name).select(
        "row", "column", "correlation",
        F.try_element_at("_gini", F.col("row")).alias("row_gini"),
        F.try_element_at("_gini", F.col("column")).alias("column_gini"),
    )
    weaker = F.when(F.col("row_gini") >= F.col("column_gini"), F.col("column")).otherwise(F.col("row"))
    return both.withColumn("drop", weaker)


def correlation_drop_list(pairs: DataFrame, gini: DataFrame) -> DataFrame:
    return attach_gini(pairs, gini).select(F.col("drop").alias("variable")).distinct()


def variability(
    df: DataFrame, variables: Sequence[str], special_values: Mapping | None = None, accuracy: int | None = None
) -> DataFrame:
    """variable, q_0, q_25, median, q_75, q_100, iqr, variability (% of the range), largest first.

    Quantiles are exact; with ``accuracy`` they come from sketches of that accuracy.
    """
    names = ("q_0", "q_25", "median", "q_75", "q_100")
    points = ("0", "0.25", "0.5", "0.75", "1")
    long = melt_numeric(null_out_sentinels(df, special_values or {}), variables)
    if accuracy:
        sketch = quantiles_approx(long, "value", [float(p) for p in points], ["variable"], accuracy)
        wide = sketch.select("variable", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(names)])
    else:
        exact = exact_quantiles(long, "value", points, by=["variable"], few=True)
        slots = [F.max(F.when(F.col("position") == i, F.col("value"))).alias(name) for i, name in enumerate(names, 1)]
        wide = exact.groupBy("variable").agg(*slots)
    wide = wide.withColumn("iqr", F.col("q_75") - F.col("q_25"))
    share = F.when(F.col("iqr") == 0, 0.0).otherwise(100 * F.try_divide(F.col("iqr"), F.col("q_100") - F.col("q_0")))
    return wide.withColumn("variability", share).orderBy(F.desc("variability"))


def low_variability_list(table: DataFrame, limit: float) -> DataFrame:
    return threshold_rank(table, "variability", limit, above=False).select("variable")


def forest_importance(
    df: DataFrame, variables: Sequence[str], target: str, num_trees: int = 20, max_depth: int = 5, seed: int = 0
) -> DataFrame:
    """variable, importance from a random forest over the rows where everything is known."""
    rows = df.select(
        *[F.col(name).cast("double").alias(name) for name in variables], F.col(target).cast("double").alias("label")
    ).na.drop()
    with working_table(rows, num_trees) as table:
        return _fit_forest(table, variables, num_trees, max_depth, seed)


def _fit_forest(table: DataFrame, variables: Sequence[str], num_trees: int, max_depth: int, seed: int) -> DataFrame:
    """Importances from a table of known numbers with its ``label``."""
    data = VectorAssembler(inputCols=list(variables), outputCol="features").transform(table).select("features", "label")
    model = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed).fit(data)
    found = [(name, float(model.featureImportances[i])) for i, name in enumerate(variables)]
    return table.sparkSession.createDataFrame(found, "variable string, importance double").orderBy(F.desc("importance"))


@contextmanager
def working_table(df: DataFrame, extra: int = 0) -> Iterator[DataFrame]:
    """A table that is about to be read several times: dealt out evenly over the cores and persisted.

    A part has at most about ``PART_NUMBERS`` numbers, so that their count grows with the rows and what a task
    reads does not; up to that size there is one for each core. ``extra`` numbers are counted to each row for
    what a fit keeps beside its columns: a forest one for each tree. A forest samples by partition, and the
    layout depends on the counted rows alone. The dealing is by position, not by a key, so equal rows don't
    meet in one task.
    """
    needed = -(-df.count() * (len(df.columns) + extra) // PART_NUMBERS)
    with persist_stage(df.repartition(max(needed, df.sparkSession.sparkContext.defaultParallelism))) as kept:
        yield kept


def low_importance_list(table: DataFrame, k: int, metric: str = "importance") -> DataFrame:
    """The ``k`` least important variables."""
    return top_rows(table, [F.asc(metric), F.desc("variable")], k).select("variable")


def indicator_columns(names: DataFrame, flags: Mapping[str, DataFrame]) -> DataFrame:
    """``names.variable`` with a 1/0 column per list telling whether the list holds it."""
    for flag, listed in flags.items():
        marked = listed.select("variable").distinct().withColumn(flag, F.lit(1))
        names = names.join(marked, "variable", "left").withColumn(flag, F.coalesce(flag, F.lit(0)))
    return names


def selection_matrix(names: DataFrame, correlation: DataFrame, variability: DataFrame, importance: DataFrame) -> DataFrame:
    """variable, the flags correlation, variability and low_importance, and their count."""
    flags = {"correlation": correlation, "variability": variability, "low_importance": importance}
    total = sum((F.col(flag) for flag in flags), F.lit(0))
    return indicator_columns(names, flags).withColumn("count", total)


def selection_matrix_filtered(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flagged variables, most flags first, with the partners they correlate with.

    Partners where the variable is the row side come first; each side is in order of strength.
    """
    as_row = join_strings(pairs, ["row"], "column", "_a", strongest="correlation")
    as_column = join_strings(pairs, ["column"], "row", "_b", strongest="correlation")
    partners = F.nullif(F.concat_ws(" & ", "_a", "_b"), F.lit(""))
    return (
        matrix.filter(F.col("count") >= 1)
        .join(as_row.withColumnRenamed("row", "variable"), "variable", "left")
        .join(as_column.withColumnRenamed("column", "variable"), "variable", "left")
        .select(*matrix.columns, partners.alias("correlation_with"))
        .orderBy(F.desc("count"), "variable")
    )


def select_features(
    df: DataFrame,
    variables: Sequence[str],
    target: str,
    *,
    lim_corr: float,
    lim_variab: float,
    lim_importance: int,
    black_list: Sequence[str] = (),
    special_values: Mapping | None = None,
    num_trees: int = 20,
    max_depth: int = 5,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """The whole selection over one persisted working table.

    pairs (with ginis), gini, variability, importance, matrix, matrix_filtered. What needs the working
    table is written to scratch folders before it is released; they stay until the surrounding
    ``scratch_tables`` block or the process ends, and go at once if the selection fails.
    """
    names = candidates(df, variables, target, black_list)
    spark = df.sparkSession
    with scratch_tables(keep=True), working_table(df.select(*names, target), num_trees) as table:
        pairs = scratch_table(correlated_pairs(table, names, lim_corr), "pairs")
        gini = scratch_table(univariate_gini(table, names, target, only=pair_members(pairs)), "gini")
        spread = scratch_table(variability(table, names, special_values), "variability")
        known = table.withColumn("label", F.col(target).cast("double")).na.drop(subset=[*names, "label"])
        importance = _fit_forest(known, names, num_trees, max_depth, seed)
        matrix = selection_matrix(
            spark.createDataFrame([(name,) for name in names], "variable string"),
            correlation_drop_list(pairs, gini),
            low_variability_list(spread, lim_variab),
            low_importance_list(importance, lim_importance),
        )
        return {
            "pairs": attach_gini(pairs, gini).orderBy(F.desc("correlation")),
            "gini": gini,
            "variability": spread,
            "importance": importance,
            "matrix": matrix,
            "matrix_filtered": selection_matrix_filtered(matrix, pairs),
        }
