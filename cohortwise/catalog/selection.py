"""Queries on feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.catalog.registry import query, table
from cohortwise.plans import selection

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "gross_price", "tax_amount"]
SPECIAL = {"l_quantity": [50.0], "l_discount": [0.0], "l_tax": [0.0]}
LIM_CORR = 0.5
LIM_VARIAB = 45.0
K_LOW = 2


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with three derived amounts that correlate with the price, and the target."""
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
        (price * (1 - F.col("l_discount"))).alias("net_price"),
        (price * (1 + tax)).alias("gross_price"),
        (price * tax).alias("tax_amount"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
    )


MODEL_SQL = """model AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax,
    l_extendedprice * (1 - l_discount) AS net_price, l_extendedprice * (1 + l_tax) AS gross_price,
    l_extendedprice * l_tax AS tax_amount, (l_returnflag = 'R')::INT AS target FROM lineitem)"""


def _pairs_sql(names: list[str] = NAMES) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    parts = (f"SELECT '{a}' AS row, '{b}' AS column, abs(corr({a}, {b})) AS correlation FROM model" for a, b in pairs)
    return f"pairs AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE correlation > {LIM_CORR})"


_LONG = " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value, target FROM model" for v in NAMES)
GINI_SQL = f"""long AS ({_LONG}),
  ranked AS (SELECT variable, target, rank() OVER (PARTITION BY variable ORDER BY value)
             + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0::DOUBLE AS r FROM long),
  auc AS (SELECT variable, (sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0::DOUBLE)
          / (sum(target)::DOUBLE * sum(1 - target)) AS auc FROM ranked GROUP BY variable),
  gini AS (SELECT variable, abs(2 * auc - 1) AS gini, CASE WHEN auc < 0.5 THEN 'u' ELSE 'd' END AS direction FROM auc)"""

DROP_SQL = """both_sides AS (SELECT p.*, a.gini AS row_gini, b.gini AS column_gini,
    CASE WHEN a.gini >= b.gini THEN p.column ELSE p.row END AS drop_name
    FROM pairs p JOIN gini a ON a.variable = p.row JOIN gini b ON b.variable = p.column)"""


def _variability_sql() -> str:
    parts = []
    for name in NAMES:
        rule = f"WHERE {name} <> {SPECIAL[name][0]}" if name in SPECIAL else ""
        parts.append(f"SELECT '{name}' AS variable, {name} AS value FROM model {rule}")
    return f"""five AS (SELECT variable, min(value) AS q_0, quantile_disc(value, 0.25) AS q_25,
        quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS q_75, max(value) AS q_100
        FROM ({' UNION ALL '.join(parts)}) GROUP BY variable),
      spread AS (SELECT *, q_75 - q_25 AS iqr,
        CASE WHEN q_75 = q_25 THEN 0.0 ELSE 100 * (q_75 - q_25) / (q_100 - q_0) END AS variability FROM five)"""


@query("correlated_pairs", "C1", f"WITH {MODEL_SQL}, {_pairs_sql()} SELECT row, \"column\", round(correlation, 8) AS correlation FROM pairs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = selection.correlated_pairs(model_table(spark, sf), NAMES, LIM_CORR)
    return pairs.withColumn("correlation", F.round("correlation", 8))


@query(
    "univariate_gini",
    "C2",
    f"WITH {MODEL_SQL}, {GINI_SQL} SELECT variable, round(gini, 9) AS gini, direction FROM gini",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    gini = selection.univariate_gini(model_table(spark, sf), NAMES, "target")
    return gini.withColumn("gini", F.round("gini", 9))


@query(
    "univariate_gini_logistic",
    "C2",
    " UNION ALL ".join(f"SELECT '{v}' AS variable, true AS agrees" for v in sorted(NAMES)),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A fit of one variable orders rows as the variable does, so its Gini is the rank Gini, up to the fit's score bins."""
    model = model_table(spark, sf)
    fitted = selection.univariate_gini(model, NAMES, "target", method="logistic")
    exact = selection.univariate_gini(model, NAMES, "target").select("variable", F.col("gini").alias("rank_gini"))
    return fitted.join(exact, "variable").select("variable", (F.abs(F.col("gini") - F.col("rank_gini")) <= 1e-3).alias("agrees"))


def _pairs_and_gini(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    model = model_table(spark, sf)
    pairs = selection.correlated_pairs(model, NAMES, LIM_CORR)
    return pairs, selection.univariate_gini(model, NAMES, "target", only=selection.pair_members(pairs))


@query(
    "correlation_ginis",
    "C1 C2 C3",
    f"""WITH {MODEL_SQL}, {_pairs_sql()}, {GINI_SQL}, {DROP_SQL} SELECT row, "column", round(correlation, 8) AS correlation,
        round(row_gini, 9) AS row_gini, round(column_gini, 9) AS column_gini, drop_name AS "drop" FROM both_sides""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    table_ = selection.attach_gini(*_pairs_and_gini(spark, sf))
    rounded = {"correlation": F.round("correlation", 8)}
    return table_.withColumns(rounded | {c: F.round(c, 9) for c in ("row_gini", "column_gini")})


@query(
    "correlation_drop_list",
    "C3",
    f"WITH {MODEL_SQL}, {_pairs_sql()}, {GINI_SQL}, {DROP_SQL} SELECT DISTINCT drop_name AS variable FROM both_sides",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return selection.correlation_drop_list(*_pairs_and_gini(spark, sf))


@query(
    "variability",
    "C4",
    f"""WITH {MODEL_SQL}, {_variability_sql()} SELECT variable, q_0, q_25, median, q_75, q_100, round(iqr, 6) AS iqr,
        round(variability, 6) AS variability FROM spread""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    spread = selection.variability(model_table(spark, sf), NAMES, SPECIAL)
    return spread.withColumns({c: F.round(c, 6) for c in ("iqr", "variability")})


@query(
    "low_variability_list",
    "C5",
    f"WITH {MODEL_SQL}, {_variability_sql()} SELECT variable FROM spread WHERE variability < {LIM_VARIAB}",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return selection.low_variability_list(selection.variability(model_table(spark, sf), NAMES, SPECIAL), LIM_VARIAB)


@query(
    "forest_importance",
    "C6",
    f"""WITH {MODEL_SQL}, long AS (SELECT variable, value FROM (UNPIVOT (SELECT * EXCLUDE (target) FROM model WHERE target IS NOT NULL)
          ON {", ".join(NAMES)} INTO NAME variable VALUE value))
        SELECT variable, count(DISTINCT value) > 1 AS can_split, 1.0::DOUBLE AS total FROM long GROUP BY variable""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All variables and the real target: a variable has an importance if it can be split at all."""
    found = selection.forest_importance(model_table(spark, sf), NAMES, "target", num_trees=20, max_depth=4, seed=12345)
    total = found.agg(F.round(F.sum("importance"), 6)).scalar()
    return found.select("variable", (F.col("importance") > 0).alias("can_split"), total.alias("total"))


#: A target that the discount alone decides; the net price is derived from it, the others are noise.
DRIVEN = [name for name in NAMES if name != "net_price"]
DRIVEN_SQL = f"""{MODEL_SQL}, driven AS (SELECT variable, value, target FROM (UNPIVOT (SELECT * REPLACE ((l_discount > 0.05)::INT AS target) FROM model)
    ON {", ".join(DRIVEN)} INTO NAME variable VALUE value)),
  parted AS (SELECT variable, max(value) FILTER (target = 0) < min(value) FILTER (target = 1) AS decides FROM driven GROUP BY variable)"""


def _driven_forest(spark: SparkSession, sf: str) -> DataFrame:
    driven = model_table(spark, sf).withColumn("target", (F.col("l_discount") > 0.05).cast("int"))
    return selection.forest_importance(driven, DRIVEN, "target", num_trees=20, max_depth=4, seed=12345)


@query("forest_importance_driven", "C6", f"WITH {DRIVEN_SQL} SELECT variable, decides AS carries_most FROM parted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _driven_forest(spark, sf).select("variable", (F.col("importance") > 0.5).alias("carries_most"))


@query("low_importance_list", "C7", f"WITH {DRIVEN_SQL} SELECT variable FROM parted WHERE NOT decides")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All but the variable that decides."""
    return selection.low_importance_list(_driven_forest(spark, sf), len(DRIVEN) - 1)


@query("low_importance_list_by_gini", "C7", f"WITH {MODEL_SQL}, {GINI_SQL} SELECT variable FROM gini ORDER BY gini, variable DESC LIMIT {K_LOW}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The real target, with an importance that SQL can state."""
    return selection.low_importance_list(selection.univariate_gini(model_table(spark, sf), NAMES, "target"), K_LOW, metric="gini")


# The matrix needs an importance that SQL can state as well: here the gini of each variable.
MATRIX_SQL = f"""{MODEL_SQL}, {_pairs_sql()}, {GINI_SQL}, {DROP_SQL}, {_variability_sql()},
  low AS (SELECT variable FROM gini ORDER BY gini, variable DESC LIMIT {K_LOW}),
  matrix AS (SELECT variable, (variable IN (SELECT drop_name FROM both_sides))::INT AS correlation,
      (variable IN (SELECT variable FROM spread WHERE variability < {LIM_VARIAB}))::INT AS variability,
      (variable IN (SELECT variable FROM low))::INT AS low_importance FROM gini)"""


def _matrix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    model = model_table(spark, sf)
    pairs = selection.correlated_pairs(model, NAMES, LIM_CORR)
    gini = selection.univariate_gini(model, NAMES, "target")
    matrix = selection.selection_matrix(
        spark.createDataFrame([(name,) for name in NAMES], "variable string"),
        selection.correlation_drop_list(pairs, gini),
        selection.low_variability_list(selection.variability(model, NAMES, SPECIAL), LIM_VARIAB),
        selection.low_importance_list(gini, K_LOW, metric="gini"),
    )
    return matrix, pairs


@query(
    "selection_matrix",
    "C8",
    f"WITH {MATRIX_SQL} SELECT *, correlation + variability + low_importance AS count FROM matrix",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf)[0]


@query(
    "selection_matrix_filtered",
    "C9",
    f"""WITH {MATRIX_SQL},
        a AS (SELECT row AS variable, string_agg("column", ' & ' ORDER BY correlation DESC, "column") AS t FROM pairs GROUP BY 1),
        b AS (SELECT "column" AS variable, string_agg(row, ' & ' ORDER BY correlation DESC, row) AS t FROM pairs GROUP BY 1)
        SELECT matrix.*, correlation + variability + low_importance AS count,
               nullif(concat_ws(' & ', a.t, b.t), '') AS correlation_with
        FROM matrix LEFT JOIN a USING (variable) LEFT JOIN b USING (variable)
        WHERE correlation + variability + low_importance >= 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return selection.selection_matrix_filtered(*_matrix(spark, sf))


def _report(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    names = selection.candidates(model_table(spark, sf), [*NAMES, "l_linestatus"], "target")
    return selection.select_features(
        model_table(spark, sf), names, "target",
        lim_corr=LIM_CORR, lim_variab=LIM_VARIAB, lim_importance=K_LOW, black_list=["gross_price"],
        special_values=SPECIAL, num_trees=20, max_depth=4, seed=12345,
    )


LISTED = [name for name in NAMES if name != "gross_price"]
REPORT_SQL = f"{MODEL_SQL}, {_pairs_sql(LISTED)}, {GINI_SQL}, {DROP_SQL}, {_variability_sql()}"


@query(
    "select_features",
    "C10 S13",
    f"""WITH {REPORT_SQL}
        SELECT variable, (variable IN (SELECT drop_name FROM both_sides))::INT AS correlation,
               (variable IN (SELECT variable FROM spread WHERE variability < {LIM_VARIAB}))::INT AS variability, {K_LOW}::BIGINT AS low_flags
        FROM gini WHERE variable <> 'gross_price'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The flags that SQL can state, and how many variables the forest flags."""
    matrix = _report(spark, sf)["matrix"]
    return matrix.select("variable", "correlation", "variability", matrix.agg(F.sum("low_importance")).scalar().alias("low_flags"))


@query(
    "select_features_pairs",
    "C10 C1 C3",
    f"""WITH {REPORT_SQL} SELECT row, "column", round(correlation, 8) AS correlation, round(row_gini, 9) AS row_gini,
        round(column_gini, 9) AS column_gini, drop_name AS "drop" FROM both_sides""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _report(spark, sf)["pairs"]
    return pairs.withColumns({"correlation": F.round("correlation", 8)} | {c: F.round(c, 9) for c in ("row_gini", "column_gini")})


@query(
    "select_features_filtered",
    "C10 C9",
    f"""WITH {REPORT_SQL},
        a AS (SELECT row AS variable, string_agg("column", ' & ' ORDER BY correlation DESC, "column") AS t FROM pairs GROUP BY 1),
        b AS (SELECT "column" AS variable, string_agg(row, ' & ' ORDER BY correlation DESC, row) AS t FROM pairs GROUP BY 1),
        flagged AS (SELECT variable, (variable IN (SELECT drop_name FROM both_sides))::INT AS correlation,
               (variable IN (SELECT variable FROM spread WHERE variability < {LIM_VARIAB}))::INT AS variability
               FROM gini WHERE variable <> 'gross_price')
        SELECT flagged.*, nullif(concat_ws(' & ', a.t, b.t), '') AS correlation_with, {K_LOW}::BIGINT AS low_flags, true AS counted
        FROM flagged LEFT JOIN a USING (variable) LEFT JOIN b USING (variable) WHERE correlation + variability >= 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The flagged variables as far as SQL can state them, how many the forest flags, and whether the flags add up."""
    listed = _report(spark, sf)["matrix_filtered"]
    flags = F.col("correlation") + F.col("variability")
    return listed.select(
        "variable", "correlation", "variability", "correlation_with",
        listed.agg(F.sum("low_importance")).scalar().alias("low_flags"),
        (F.col("count") == flags + F.col("low_importance")).alias("counted"),
    ).filter(flags >= 1)
