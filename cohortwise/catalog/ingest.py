"""Queries that read, write and refresh tables.

Text sources are first written by Spark from a given table, so that they grow with it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.catalog.registry import ROW_KEYS, query, table
from cohortwise.functions.scalars import yyyymm
from cohortwise.session import scratch_dir
from cohortwise.sources import readers, writers

PART_SQL = "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part"
PART_FIELDS = [["p_partkey", "int"], ["p_brand", "str"], ["p_type", "str"], ["p_size", "int"], ["p_retailprice", "double"]]


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(*[name for name, _ in PART_FIELDS])


def _as_stored(df: DataFrame) -> DataFrame:
    return df.select(F.col("p_partkey").cast("bigint"), "p_brand", F.col("p_size").cast("int"), "p_retailprice")


@query("read_parquet", "S4", PART_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf}/part.parquet", ["p_partkey", "p_brand", "p_size", "p_retailprice"])


@query("read_csv_typed", "S1 S5", PART_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    _parts(spark, sf).write.csv(path, header=True)
    schema = readers.schema_from_pairs(PART_FIELDS)
    return _as_stored(readers.read_csv_typed(spark, path, schema, ["p_partkey", "p_brand", "p_size", "p_retailprice"]))


@query("read_csv_inferred", "S2", PART_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    _parts(spark, sf).write.csv(path, header=True)
    return _as_stored(readers.read_csv_inferred(spark, path))


@query("read_csv_strings", "S2", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand, p_size::VARCHAR AS p_size FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    _parts(spark, sf).write.csv(path, header=True)
    return readers.read_csv_inferred(spark, path, infer=False).select("p_partkey", "p_brand", "p_size")


@query("read_json", "S3", PART_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "json")
    _parts(spark, sf).write.json(path)
    return _as_stored(readers.read_json(spark, path))


@query("read_json_typed", "S3", PART_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "json")
    _parts(spark, sf).write.json(path)
    return _as_stored(readers.read_json(spark, path, readers.schema_from_pairs(PART_FIELDS)))


@query("read_delimited_tsv", "S8", PART_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "tsv")
    _parts(spark, sf).withColumnRenamed("p_partkey", "damaged.p_partkey").write.csv(path, header=True, sep="\t")
    return _as_stored(readers.read_delimited_tsv(spark, path, "p_partkey"))


@query(
    "rename_from_map",
    "S6",
    "SELECT o_orderkey AS contract_id, o_custkey AS client_id, o_totalprice AS amount FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    names = {"o_orderkey": "contract_id", "o_custkey": "client_id", "o_totalprice": "amount", "o_orderstatus": "status"}
    return readers.rename_from_map(table(spark, sf, "orders"), names, ["contract_id", "client_id", "amount"])


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", yyyymm(F.col("o_orderdate")).alias("cohort"))


ORDERS_SQL = """orders_by_month AS (
  SELECT o_orderkey, o_totalprice, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS cohort FROM orders)"""


@query("write_partitioned", "S9", f"WITH {ORDERS_SQL} SELECT * FROM orders_by_month")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "partitioned")
    writers.write_partitioned(_orders(spark, sf), path, "cohort")
    return spark.read.parquet(path)


@query(
    "write_partitioned_append",
    "S9",
    f"""WITH {ORDERS_SQL} SELECT cohort, count(*) AS n, round(sum(o_totalprice), 2) AS amount
        FROM (SELECT * FROM orders_by_month UNION ALL SELECT * FROM orders_by_month) GROUP BY cohort""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "partitioned")
    writers.write_partitioned(_orders(spark, sf), path, "cohort")
    writers.write_partitioned(_orders(spark, sf), path, "cohort", mode="append")
    return (
        spark.read.parquet(path)
        .groupBy("cohort")
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    )


@query(
    "refresh_partitions",
    "S10",
    f"""WITH {ORDERS_SQL} SELECT o_orderkey, cohort,
          CASE WHEN cohort BETWEEN 199601 AND 199606 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
        FROM orders_by_month""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "refreshed")
    orders = _orders(spark, sf)
    writers.write_partitioned(orders, path, "cohort")
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    months = [199601, 199602, 199603, 199604, 199605, 199606]
    writers.refresh_partitions(changed, path, "cohort", months)
    writers.refresh_partitions(changed, path, "cohort", months)
    return spark.read.parquet(path)


@query(
    "month_range",
    "S11",
    """WITH first AS (SELECT date_trunc('month', min(o_orderdate)) AS d FROM orders),
       months AS (SELECT unnest(generate_series(d, d + INTERVAL 95 MONTH, INTERVAL 1 MONTH)) AS m FROM first)
       SELECT strftime(m, '%Y-%m-%d') AS month, count(o_orderkey) AS n
       FROM months LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    first = orders.agg(F.min("o_orderdate").cast("date").alias("start"))
    months = first.select(F.explode(writers.month_range(F.col("start"), 96)).alias("month"))
    counts = orders.groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"))
    return months.join(counts, "month", "left").select(
        F.col("month").cast("string").alias("month"), F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "backfill_months",
    "S12",
    """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
              round(((o_totalprice * 100)::VARCHAR::DECIMAL(28,10)), 5)::DOUBLE AS scaled
       FROM orders WHERE o_orderdate >= '1995-11-01' AND o_orderdate < '1996-11-01'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "backfilled")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.trunc("o_orderdate", "MM").alias("month"))
    for _run in range(2):
        writers.backfill_months(orders, "1995-11-17", 12, path, "month", "o_totalprice")
    return spark.read.parquet(path).select(
        "o_orderkey", F.col("month").cast("string").alias("month"), F.col("scaled").cast("double").alias("scaled")
    )


@query(
    "preview",
    "S14",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return spark.createDataFrame(readers.preview(orders, 10), orders.schema)


_HALF = 1.96 * math.sqrt(1 - 0.1) / 0.1


@query(
    "count_approx",
    "S15",
    f"""WITH k AS (SELECT count(*) AS kept FROM lineitem WHERE ('0x' || substr(md5({" || '-' || ".join(ROW_KEYS)} || '-7'), 1, 8))::BIGINT
          / 4294967296.0 < 0.1)
        SELECT round(kept / 0.1)::BIGINT AS estimate, floor(greatest(0.0, kept / 0.1 - {_HALF!r} * sqrt(kept)))::BIGINT AS lower,
               ceil(kept / 0.1 + {_HALF!r} * sqrt(kept))::BIGINT AS upper FROM k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return readers.count_approx(table(spark, sf, "lineitem"), 0.1, 7, ROW_KEYS)


@query("is_empty", "S15", "SELECT 'orders' AS name, (SELECT count(*) FROM orders) = 0 AS empty UNION ALL SELECT 'future orders', (SELECT count(*) FROM orders WHERE o_orderdate > '2999-01-01') = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    tables = {"orders": orders, "future orders": orders.filter("o_orderdate > '2999-01-01'")}
    return spark.createDataFrame([(name, readers.is_empty(df)) for name, df in tables.items()], "name string, empty boolean")


@query(
    "persist_stage",
    "S13",
    """SELECT 'amount' AS analysis, o_orderpriority AS key, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
       UNION ALL SELECT 'orders', year(o_orderdate)::VARCHAR, count(*)::DOUBLE FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two analyses of one kept table; their results are settled before it is released."""
    done = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    with readers.persist_stage(done) as stage:
        if readers.is_empty(stage):
            raise ValueError("no finished orders")
        amount = stage.groupBy(F.col("o_orderpriority").alias("key")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
        orders = stage.groupBy(F.year("o_orderdate").cast("string").alias("key")).agg(F.count("*").cast("double").alias("value"))
        named = [df.select(F.lit(name).alias("analysis"), "key", "value") for name, df in (("amount", amount), ("orders", orders))]
        return readers.settled(named[0].unionAll(named[1]))
