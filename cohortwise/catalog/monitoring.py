"""Queries on the population: distributions, default rates, stability, PSI and chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.catalog.registry import MELT_SQL, SCORE_SQL, SPECIAL, VARIABLES, query, score, share_sql, table
from cohortwise.operators.aggregates import percent_labels
from cohortwise.plans import charts, stability, universe

PARTS = 5
BASE = 199501

# --- universe --------------------------------------------------------------------------------


@query("table_dimension", "U1", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return universe.table_dimension(table(spark, sf, "lineitem"))


@query("cohort_range", "U2", f"WITH {SCORE_SQL} SELECT min(cohort) AS min_cohort, max(cohort) AS max_cohort FROM score")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return universe.cohort_range(score(spark, sf), "cohort")


@query(
    "period_distribution",
    "U3",
    f"""WITH {SCORE_SQL} SELECT (cohort // 100)::INT AS year, count(*) AS count,
        {share_sql('count(*)', '(SELECT count(*) FROM score)', 4)} AS proportion FROM score GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return universe.period_distribution(score(spark, sf), "cohort")


def _rate_sql(keys: str, digits: int, names: str | None = None) -> str:
    return f"""WITH {SCORE_SQL} SELECT {keys}, count(*) AS total, sum(target)::BIGINT AS bads,
        (count(*) - sum(target))::BIGINT AS goods, {share_sql('sum(target)', 'count(*)', digits)} AS tm
        FROM score GROUP BY {names or keys}"""


@query("default_rate_by_year", "U4", _rate_sql("(cohort // 100)::INT AS year", 4, "1"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return universe.default_rate_by_year(score(spark, sf), "cohort", "target")


def _share_sql(keys: str) -> str:
    return f"""WITH {SCORE_SQL} SELECT {keys}, count(*) AS count,
        round(count(*)::DOUBLE / (SELECT count(*) FROM score), 10) AS proportion FROM score GROUP BY {keys}"""


def _distribution(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    return universe.distribution(score(spark, sf), keys).withColumn("proportion", F.round("proportion", 10))


@query("segment_distribution", "U5", _share_sql("segment"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution(spark, sf, "segment")


@query("sample_distribution", "U6", _share_sql("sample"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution(spark, sf, "sample")


@query("segment_sample_distribution", "U7", _share_sql("segment, sample"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution(spark, sf, "segment", "sample").orderBy(F.asc("segment"), F.desc("sample"))


@query("target_distribution", "U8", _share_sql("target"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution(spark, sf, "target").orderBy("target")


@query("sample_target_distribution", "U9", _share_sql("sample, target"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution(spark, sf, "sample", "target").orderBy(F.asc("target"), F.desc("sample"))


@query(
    "distribution_report",
    "U5 U6 U7 U8 U9",
    f"""WITH {SCORE_SQL}, c AS (
          SELECT segment, sample, target, count(*) AS count, grouping(segment, sample, target) AS g
          FROM score GROUP BY GROUPING SETS ((segment), (sample), (segment, sample), (target), (sample, target)))
        SELECT CASE g WHEN 3 THEN 'segment' WHEN 5 THEN 'sample' WHEN 1 THEN 'segment_sample' WHEN 6 THEN 'target'
               ELSE 'sample_target' END AS view, segment, sample, coalesce(target, -1) AS target, count,
               round(count::DOUBLE / (SELECT count(*) FROM score), 10) AS proportion FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = universe.distribution_report(score(spark, sf), "segment", "sample", "target")
    return report.withColumns({"target": F.coalesce("target", F.lit(-1)), "proportion": F.round("proportion", 10)})


@query("default_rate_by_cohort", "U10", _rate_sql("cohort", 4))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return universe.default_rate_by_cohort(score(spark, sf), "cohort", "target")


@query("default_rate_by_segment_cohort", "U11", _rate_sql("segment, cohort", 4))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return universe.default_rate_by_segment_cohort(score(spark, sf), "segment", "cohort", "target")


@query("default_rate_by_segment_sample", "U12", _rate_sql("sample, segment", 5))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return universe.default_rate_by_segment_sample(score(spark, sf), "segment", "sample", "target")


# --- stability -------------------------------------------------------------------------------

STABILITY_SQL = f"""{SCORE_SQL}, {MELT_SQL},
  cuts AS (SELECT variable, list_distinct(quantile_disc(value, [0.2, 0.4, 0.6, 0.8])) AS q
           FROM melt WHERE segment = 'F' GROUP BY variable),
  bucketed AS (SELECT m.variable, segment, len(list_filter(q, lambda c: m.value >= c))::INT AS bucket
               FROM melt m JOIN cuts USING (variable)),
  x AS (SELECT variable, bucket, count(*) AS frequency_x FROM bucketed WHERE segment = 'F' GROUP BY ALL),
  y AS (SELECT variable, bucket, count(*) AS frequency_y FROM bucketed WHERE segment = 'O' GROUP BY ALL),
  px AS (SELECT *, {share_sql('frequency_x', 'sum(frequency_x) OVER (PARTITION BY variable)', 3)} AS proportion_x FROM x),
  py AS (SELECT *, {share_sql('frequency_y', 'sum(frequency_y) OVER (PARTITION BY variable)', 3)} AS proportion_y FROM y),
  ie AS (SELECT *, CASE WHEN proportion_x > 0 AND proportion_y > 0
                   THEN (proportion_x - proportion_y) * ln(proportion_x / proportion_y) END AS ie
         FROM px LEFT JOIN py USING (variable, bucket))"""


def _stability(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return stability.stability_index(score(spark, sf), VARIABLES, "segment", PARTS, SPECIAL, labels=("F", "O"))


def stability_report(spark: SparkSession, sf: str) -> DataFrame:
    return _stability(spark, sf)[0].withColumn("ie", F.round("ie", 9))


query(
    "stability_index",
    "U13",
    f"""WITH {STABILITY_SQL} SELECT variable, bucket, frequency_x, proportion_x, frequency_y, proportion_y,
        round(ie, 9) AS ie FROM ie""",
)(stability_report)


@query(
    "stability_cuts",
    "U13",
    f"""WITH {SCORE_SQL}, {MELT_SQL},
        q AS (SELECT variable, quantile_disc(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM melt WHERE segment = 'F' GROUP BY 1)
        SELECT variable, i::INT AS position, q[i] AS value FROM q, (SELECT unnest([1, 2, 3, 4]) AS i)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _stability(spark, sf)[1]


@query(
    "stability_summary",
    "U14",
    f"""WITH {STABILITY_SQL}, s AS (SELECT variable, sum(ie) AS ie FROM ie GROUP BY variable)
        SELECT variable, round(ie, 9) AS ie, CASE WHEN ie < 0.10 THEN 'no difference'
               WHEN ie <= 0.25 THEN 'some difference' ELSE 'significant difference' END AS band FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stability.stability_summary(_stability(spark, sf)[0]).withColumn("ie", F.round("ie", 9))


PSI_SQL = f"""{SCORE_SQL}, {MELT_SQL},
  whole AS (SELECT cohort, variable, value FROM score UNPIVOT (value FOR variable IN (l_quantity, l_extendedprice, l_discount, l_tax))
            WHERE cohort >= 199501),
  cuts AS (SELECT variable, list_distinct(quantile_disc(value, [0.2, 0.4, 0.6, 0.8])) AS q
           FROM melt WHERE cohort = 199501 GROUP BY variable),
  f AS (SELECT cohort, variable, len(list_filter(q, lambda c: whole.value >= c))::INT AS bucket, count(*) AS freq
        FROM whole JOIN cuts USING (variable) GROUP BY ALL),
  psi AS (SELECT *, (sum(freq) OVER w)::BIGINT AS total, {share_sql('freq', 'sum(freq) OVER w', 5)} AS proportion
          FROM f WINDOW w AS (PARTITION BY cohort, variable))"""


def _psi(spark: SparkSession, sf: str, base: int | None = BASE) -> DataFrame:
    return stability.psi_table(score(spark, sf), VARIABLES, "cohort", PARTS, base, SPECIAL)


@query("psi_table", "U15", f"WITH {PSI_SQL} SELECT * FROM psi")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _psi(spark, sf)


@query("psi_table_default_base", "U15", f"WITH {PSI_SQL} SELECT * FROM psi")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _psi(spark, sf, None)


@query(
    "psi_by_cohort",
    "U16",
    f"""WITH {PSI_SQL} SELECT c.variable, c.cohort, round(sum(CASE WHEN c.proportion > 0 AND b.proportion > 0 THEN
          (c.proportion - b.proportion) * ln(c.proportion / b.proportion) END), 8) AS psi,
          count(*) FILTER (c.proportion > 0) - 2 * count(*) FILTER (c.proportion > 0 AND b.proportion > 0)
            + coalesce(max(k.n), 0) AS skipped
        FROM psi c LEFT JOIN psi b ON b.cohort = 199501 AND b.variable = c.variable AND b.bucket = c.bucket
          LEFT JOIN (SELECT variable, count(*) AS n FROM psi WHERE cohort = 199501 AND proportion > 0 GROUP BY 1) k ON k.variable = c.variable
        GROUP BY c.variable, c.cohort""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stability.psi_by_cohort(_psi(spark, sf), "cohort", BASE).withColumn("psi", F.round("psi", 8))


@query(
    "psi_wide",
    "U17",
    f"WITH {PSI_SQL} SELECT variable, cohort, "
    + ", ".join(f"max(proportion) FILTER (bucket = {i}) AS q_{i}" for i in range(PARTS))
    + " FROM psi GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stability.psi_wide(_psi(spark, sf), "cohort", PARTS)


# --- chart tables ----------------------------------------------------------------------------


@query(
    "mean_by_cohort",
    "G1",
    f"WITH {SCORE_SQL}, {MELT_SQL} SELECT cohort, variable, round(avg(value), 6) AS mean FROM melt GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return charts.mean_by_cohort(score(spark, sf), VARIABLES, "cohort", SPECIAL).withColumn("mean", F.round("mean", 6))


@query(
    "median_by_cohort",
    "G2",
    f"""WITH {SCORE_SQL}, {MELT_SQL} SELECT cohort, variable, quantile_disc(value, 0.25) AS q_25,
        quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS q_75 FROM melt GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return charts.median_by_cohort(score(spark, sf), VARIABLES, "cohort", SPECIAL)


CATEGORY_SQL = f"""{SCORE_SQL}, cats AS (SELECT cohort, target, 'segment' AS variable, segment AS category FROM score
  UNION ALL SELECT cohort, target, 'sample', sample FROM score)"""


@query(
    "category_frequency_by_cohort",
    "G3",
    f"WITH {CATEGORY_SQL} SELECT cohort, variable, category, count(*) AS freq FROM cats GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return charts.category_frequency_by_cohort(score(spark, sf), ["segment", "sample"], "cohort")


@query(
    "category_pivot",
    "G3",
    f"""WITH {CATEGORY_SQL} SELECT cohort, variable, count(*) FILTER (category = 'F') AS "freq_F",
        count(*) FILTER (category = 'O') AS "freq_O", 0::BIGINT AS "freq_other" FROM cats WHERE variable = 'segment' GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    frequencies = charts.category_frequency_by_cohort(score(spark, sf), ["segment"], "cohort")
    return charts.category_pivot(frequencies, "cohort", ["F", "O"])


CUT_ALL_SQL = f"""{SCORE_SQL}, {MELT_SQL},
  cuts AS (SELECT variable, quantile_disc(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM melt GROUP BY variable)"""


@query(
    "default_rate_by_quantile",
    "G4",
    f"""WITH {CUT_ALL_SQL},
        u AS (SELECT variable, list_sort(list_distinct(q)) AS q FROM cuts),
        b AS (SELECT variable, q, len(list_filter(q, lambda c: melt.value >= c))::INT AS bucket, target
              FROM melt JOIN u USING (variable))
        SELECT variable, bucket, count(*) AS total, sum(target)::BIGINT AS bads, (count(*) - sum(target))::BIGINT AS goods,
               {share_sql('sum(target)', 'count(*)', 4)} AS tm,
               coalesce(any_value(q)[bucket + 1], 'inf'::DOUBLE) AS upper_cut
        FROM b GROUP BY variable, bucket""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return charts.default_rate_by_quantile(score(spark, sf), VARIABLES, "target", PARTS, SPECIAL)


@query(
    "default_rate_by_category",
    "G5",
    f"""WITH {CATEGORY_SQL} SELECT variable, category, count(*) AS total, sum(target)::BIGINT AS bads,
        (count(*) - sum(target))::BIGINT AS goods, {share_sql('sum(target)', 'count(*)', 4)} AS tm FROM cats GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return charts.default_rate_by_category(score(spark, sf), ["segment", "sample"], "target")


def _iv_sql(columns: str) -> str:
    return f"""WITH {CUT_ALL_SQL},
        s AS (SELECT variable, i, (q[i] <= value) AS right_side, target FROM melt JOIN cuts USING (variable),
              (SELECT unnest([1, 2, 3, 4]) AS i)),
        g AS (SELECT variable, i, sum(1 - target) FILTER (NOT right_side) AS gl, sum(target) FILTER (NOT right_side) AS bl,
                     sum(1 - target)::DOUBLE AS g, sum(target)::DOUBLE AS b FROM s GROUP BY ALL),
        iv AS (SELECT variable, i * 0.2::DOUBLE AS p, CASE WHEN gl > 0 AND bl > 0 AND gl < g AND bl < b THEN
                 (gl / g - bl / b) * ln((gl / g) / (bl / b)) +
                 (bl / b - gl / g) * ln((1 - gl / g) / (1 - bl / b)) END AS iv FROM g)
        {columns}"""


@query(
    "information_value_by_percentile",
    "G6",
    _iv_sql("SELECT variable, round(p, 2) AS percentile, round(iv, 9) AS iv FROM iv"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    table_ = charts.information_value_by_percentile(score(spark, sf), VARIABLES, "target", PARTS, SPECIAL)
    return table_.withColumn("iv", F.round("iv", 9))


@query(
    "information_value_wide",
    "G6",
    _iv_sql(
        "SELECT round(p, 2) AS percentile, "
        + ", ".join(f"round(max(iv) FILTER (variable = '{v}'), 9) AS {v}" for v in VARIABLES)
        + " FROM iv GROUP BY 1"
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    table_ = charts.information_value_by_percentile(score(spark, sf), VARIABLES, "target", PARTS, SPECIAL)
    wide = charts.information_value_wide(table_, VARIABLES)
    return wide.withColumns({v: F.round(v, 9) for v in VARIABLES})


@query(
    "percent_labels",
    "G7",
    f"""SELECT p_brand, p_type, count(*) AS count, {share_sql('count(*) * 100', '(SELECT count(*) FROM part)', 2)} AS percent
        FROM part GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return percent_labels(table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("count")))
