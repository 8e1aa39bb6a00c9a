"""Registration of queries and the table roles they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.scalars import yyyymm
from cohortwise.operators.sampling import split_train_test

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    inventory: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, inventory: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under its name, the inventory entries it covers and its SQL."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(inventory, build, sql)
        return build

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ROW_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
# The codes that stand for "missing" in the score table; the price has no rule.
SPECIAL = {"l_quantity": [50.0], "l_discount": [0.0], "l_tax": [0.0]}
SEED = 42
TRAIN = 0.7


def score(spark: SparkSession, sf: str) -> DataFrame:
    """The score table: line items with cohort, target, segment and sample, from one scan."""
    lines = table(spark, sf, "lineitem")
    roles = lines.select(
        yyyymm(F.col("l_shipdate")).alias("cohort"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        F.col("l_linestatus").alias("segment"),
        *ROW_KEYS,
        *VARIABLES,
    )
    return split_train_test(roles, "target", ROW_KEYS, TRAIN, SEED).drop(*ROW_KEYS)


SCORE_SQL = """score AS (
  SELECT (year(l_shipdate) * 100 + month(l_shipdate))::INT AS cohort,
         (l_returnflag = 'R')::INT AS target, l_linestatus AS segment,
         CASE WHEN ('0x' || substr(md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' ||
                    l_linenumber || '-42'), 1, 8))::BIGINT / 4294967296.0 < 0.7
              THEN 'train' ELSE 'test' END AS sample,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""

# The melted score table without its special values.
MELT_SQL = """melt AS (
  SELECT cohort, target, segment, sample, 'l_quantity' AS variable, l_quantity AS value FROM score WHERE l_quantity <> 50
  UNION ALL SELECT cohort, target, segment, sample, 'l_extendedprice', l_extendedprice FROM score
  UNION ALL SELECT cohort, target, segment, sample, 'l_discount', l_discount FROM score WHERE l_discount <> 0
  UNION ALL SELECT cohort, target, segment, sample, 'l_tax', l_tax FROM score WHERE l_tax <> 0)"""


def share_sql(part: str, whole: str, digits: int) -> str:
    """A rounded quotient of counts, half up on its decimal digits as Spark rounds."""
    return f"round((({part})::DOUBLE / ({whole}))::VARCHAR::DECIMAL(28,18), {digits})::DOUBLE"
