"""Queries on curves, structural breaks and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.catalog.registry import query, table
from cohortwise.catalog.relational import LINES
from cohortwise.plans import curves, similarity, structural

# Shift of the curve at each line number, so that the mean curve falls and leaves its bounds.
SHAPE = [-3.0, -2.5, 0.5, 0.25, 1.0, 2.0, 1.25]
WEIGHTS = [f"weight_{i}" for i in LINES]
VALUES = [f"value_{i}" for i in LINES]


def _families(spark: SparkSession, sf: str) -> DataFrame:
    columns = []
    for i, shift in zip(LINES, SHAPE):
        here = F.col("l_linenumber") == i
        weight = F.when(here, F.col("l_quantity"))
        columns += [weight.alias(f"weight_{i}"), (weight * (F.col("l_discount") + shift)).alias(f"value_{i}")]
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", *columns)


_SHIFT = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN {s}" for i, s in zip(LINES, SHAPE)) + " END"


def _means_sql(key: str, condition: str = "true") -> str:
    return f"""means AS (SELECT {key} AS k, l_linenumber AS i,
        sum(l_quantity * (l_discount + ({_SHIFT})::DOUBLE)) / sum(l_quantity) AS x
        FROM lineitem WHERE {condition} GROUP BY ALL)"""


_FOLD_SQL = """fold(k, i, x, corrected, clamped) AS (
    SELECT k, i, x, NULL::VARCHAR, NULL::VARCHAR FROM means WHERE i = 1
    UNION ALL
    SELECT m.k, m.i, CASE WHEN greatest(m.x, f.x) > 1.5 THEN 1.5 WHEN greatest(m.x, f.x) < -2 THEN -2 ELSE greatest(m.x, f.x) END,
           CASE WHEN m.x < f.x THEN 'S' ELSE f.corrected END,
           CASE WHEN greatest(m.x, f.x) > 1.5 THEN 'S' WHEN greatest(m.x, f.x) < -2 THEN 'I' ELSE f.clamped END
    FROM fold f JOIN means m ON m.k = f.k AND m.i = f.i + 1),
  last AS (SELECT k, corrected, clamped FROM fold WHERE i = 7)"""


def _points(curve: DataFrame, *keep: str) -> DataFrame:
    rows = curve.select(*keep, F.posexplode("curve").alias("_i", "x"))
    return rows.select(*keep, (F.col("_i") + 1).alias("i"), F.round("x", 8).alias("x"))


@query(
    "weighted_mean_curve",
    "A16",
    f"WITH {_means_sql('l_returnflag')} SELECT k AS l_returnflag, i, round(x, 8) AS x FROM means",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _points(curves.weighted_mean_curve(_families(spark, sf), WEIGHTS, VALUES, ["l_returnflag"]), "l_returnflag")


@query(
    "monotone_clamped_curve",
    "V1",
    f"""WITH RECURSIVE {_means_sql('l_returnflag')}, {_FOLD_SQL}
        SELECT f.k AS l_returnflag, i, round(x, 8) AS x, l.corrected, l.clamped FROM fold f JOIN last l ON l.k = f.k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    curve = curves.curve_by_segment(_families(spark, sf), "l_returnflag", WEIGHTS, VALUES)
    return _points(curve, "l_returnflag", "corrected", "clamped")


@query(
    "curve_by_segment",
    "V2",
    f"""WITH RECURSIVE {_means_sql("'returned_open'", "l_returnflag = 'R' AND l_linestatus = 'O'")}, {_FOLD_SQL}
        SELECT f.k AS segment, i, round(x, 8) AS x, l.corrected, l.clamped FROM fold f JOIN last l ON l.k = f.k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    condition = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    curve = curves.curve_of(_families(spark, sf), "returned_open", condition, WEIGHTS, VALUES)
    return _points(curve, "segment", "corrected", "clamped")


# --- structural break ------------------------------------------------------------------------


def _from_1998() -> Column:
    return F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")


_RSS = "(regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2) / regr_sxx({y}, {x}))"


def _rss_sql(part: str = "true") -> str:
    y, x = f"CASE WHEN {part} THEN l_extendedprice END", f"CASE WHEN {part} THEN l_quantity END"
    return _RSS.format(y=y, x=x)


@query(
    "ols_rss",
    "T1",
    f"SELECT l_returnflag, count(*) AS n, round({_rss_sql()} / count(*), 3) AS rss_per_row FROM lineitem GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fit = structural.ols_rss(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return fit.select("l_returnflag", "n", F.round(F.col("rss") / F.col("n"), 3).alias("rss_per_row"))


_DET = "(vaa * vbb - vab * vab)"


@query(
    "ols_rss_two_regressors",
    "T1",
    f"""WITH m AS (SELECT count(*) AS n, var_pop(l_extendedprice) AS vyy, var_pop(l_quantity) AS vaa, var_pop(l_discount) AS vbb,
          covar_pop(l_quantity, l_discount) AS vab, covar_pop(l_extendedprice, l_quantity) AS vya,
          covar_pop(l_extendedprice, l_discount) AS vyb FROM lineitem)
        SELECT n, round(vyy - ((vya * vbb - vyb * vab) * vya + (vyb * vaa - vya * vab) * vyb) / {_DET}, 3) AS rss_per_row FROM m""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fit = structural.ols_rss(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return fit.select("n", F.round(F.col("rss") / F.col("n"), 3).alias("rss_per_row"))


# With one regressor the F distribution has 2 degrees of freedom above, and a closed upper tail.
_CHOW_SQL = f"""chow AS (SELECT {{keys}} count(*) FILTER (l_shipdate < '1998-01-01') AS n_1,
    count(*) FILTER (l_shipdate >= '1998-01-01') AS n_2, {_rss_sql()} AS rss,
    {_rss_sql("l_shipdate < '1998-01-01'")} AS rss_1, {_rss_sql("l_shipdate >= '1998-01-01'")} AS rss_2
    FROM lineitem {{group}}),
  tested AS (SELECT *, ((rss - rss_1 - rss_2) / 2) / ((rss_1 + rss_2) / (n_1 + n_2 - 4)) AS f, n_1 + n_2 - 4 AS d FROM chow),
  result AS (SELECT *, pow(1 + 2 * f / d, -d / 2.0::DOUBLE) AS p FROM tested)"""


def _rounded(tested: DataFrame, *keep: str) -> DataFrame:
    return tested.select(
        *keep, "n_1", "n_2", F.round("statistic", 4).alias("statistic"), F.round("p_value", 5).alias("p_value")
    )


@query(
    "chow_test",
    "T2",
    f"WITH {_CHOW_SQL.format(keys='', group='')} SELECT n_1, n_2, round(f, 4) AS statistic, round(p, 5) AS p_value FROM result",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(structural.chow_test(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], _from_1998()))


@query(
    "chow_scan",
    "T3",
    f"""WITH {_CHOW_SQL.format(keys='l_returnflag, l_linestatus,', group='GROUP BY l_returnflag, l_linestatus')}
        SELECT l_returnflag, l_linestatus, n_1, n_2, round(f, 4) AS statistic, round(p, 5) AS p_value,
               (p < 0.05)::INT AS breaks FROM result""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    tested = structural.chow_scan(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], _from_1998(), keys)
    return _rounded(tested, *keys, "breaks")


# Every month of every group against a plain loop: all rows once for each month.
_MONTHS_SQL = f"""months AS (SELECT DISTINCT l_returnflag, date_trunc('month', l_shipdate)::DATE AS break_date FROM lineitem WHERE l_shipdate IS NOT NULL),
  chow AS (SELECT l_returnflag, break_date, count(*) FILTER (l_shipdate < break_date) AS n_1, count(*) FILTER (l_shipdate >= break_date) AS n_2,
    {_rss_sql()} AS rss, {_rss_sql("l_shipdate < break_date")} AS rss_1, {_rss_sql("l_shipdate >= break_date")} AS rss_2
    FROM months JOIN lineitem USING (l_returnflag) WHERE l_shipdate IS NOT NULL GROUP BY ALL HAVING n_1 >= 100 AND n_2 >= 100),
  tested AS (SELECT *, ((rss - rss_1 - rss_2) / 2) / ((rss_1 + rss_2) / (n_1 + n_2 - 4)) AS f, n_1 + n_2 - 4 AS d FROM chow),
  result AS (SELECT *, pow(1 + 2 * f / d, -d / 2.0::DOUBLE) AS p FROM tested)"""


def _by_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return structural.chow_by_date(rows, "l_extendedprice", ["l_quantity"], "l_shipdate", ["l_returnflag"], "month", least=100)


@query(
    "chow_by_date",
    "T3",
    f"WITH {_MONTHS_SQL} SELECT l_returnflag, break_date, n_1, n_2, round(f, 4) AS statistic, round(p, 5) AS p_value FROM result",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_by_month(spark, sf), "l_returnflag", "break_date")


@query(
    "chow_largest_break",
    "T3",
    f"""WITH {_MONTHS_SQL} SELECT l_returnflag, break_date, n_1, n_2, round(f, 4) AS statistic, round(p, 5) AS p_value
        FROM result QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY f DESC, break_date) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(structural.largest_break(_by_month(spark, sf), ["l_returnflag"]), "l_returnflag", "break_date")


# --- similarity ------------------------------------------------------------------------------

DIMENSIONS = 64
POOL_SQL = "label IN (1, 2, 3, 4, 5, 6, 7) AND embedding[1] BETWEEN -0.3 AND 0.3"


def _pool() -> Column:
    return F.col("label").isin(1, 2, 3, 4, 5, 6, 7) & F.col("embedding")[0].between(-0.3, 0.3)


def _features() -> list[Column]:
    return [F.col("embedding")[i].cast("double") for i in range(DIMENSIONS)]


DISTANCE_SQL = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    "query_vs_candidates",
    "J5",
    f"""SELECT e.vec_id, e.label, round({DISTANCE_SQL}, 6) AS distance
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label <> 0 AND e.vec_id <> 7""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    near = similarity.query_vs_candidates(
        table(spark, sf, "embeddings"), _features(), "vec_id", F.col("vec_id") == 7, F.col("label") != 0, ["label"]
    )
    return near.filter(~F.col("is_query")).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(
    "top_k_similar",
    "K1",
    f"""WITH near AS (SELECT e.vec_id, e.label, {DISTANCE_SQL} AS distance
          FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 AND e.{POOL_SQL.replace('embedding[1]', 'e.embedding[1]')})
        SELECT (row_number() OVER (ORDER BY distance, vec_id))::INT AS rank, vec_id, label, round(distance, 6) AS distance
        FROM near QUALIFY rank <= 10
        UNION ALL SELECT 0, vec_id, label, 0.0 FROM embeddings WHERE vec_id = 7""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    best = similarity.top_k_similar(
        table(spark, sf, "embeddings"), _features(), "vec_id", "vec_id", 7, _pool(), k=10, extra=["label"]
    )
    return best.withColumn("distance", F.round("distance", 6))


@query(
    "top_k_similar_batch",
    "K1",
    f"""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id, {DISTANCE_SQL} AS distance
          FROM embeddings e JOIN embeddings q ON q.vec_id IN (3, 7, 11, 20) AND e.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank, vec_id,
               round(distance, 6) AS distance FROM near QUALIFY rank <= 10
        UNION ALL SELECT vec_id, 0, vec_id, 0.0 FROM embeddings WHERE vec_id IN (3, 7, 11, 20)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    best = similarity.top_k_similar_batch(
        table(spark, sf, "embeddings"), F.col("embedding"), "vec_id", [3, 7, 11, 20], F.lit(True), k=10
    )
    return best.withColumn("distance", F.round("distance", 6))


@query(
    "top_k_similar_thousand",
    "K1",
    f"""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id, {DISTANCE_SQL} AS distance FROM embeddings e JOIN embeddings q ON q.vec_id BETWEEN 0 AND 999 AND e.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank, vec_id,
               round(distance, 6) AS distance FROM near QUALIFY rank <= 3
        UNION ALL SELECT vec_id, 0, vec_id, 0.0 FROM embeddings WHERE vec_id BETWEEN 0 AND 999""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand queries in one read of the pool."""
    vectors = table(spark, sf, "embeddings")
    best = similarity.top_k_similar_batch(vectors, F.col("embedding"), "vec_id", range(1000), F.lit(True), k=3)
    return best.withColumn("distance", F.round("distance", 6))
