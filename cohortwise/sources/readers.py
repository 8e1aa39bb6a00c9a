"""Typed ingestion and small looks at a table."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.functions.scalars import hash_below

# The type names a configured schema may use.
FIELD_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "str": T.StringType(),
    "float": T.FloatType(),
    "decimal": T.DecimalType(30, 10),
}


def schema_from_pairs(pairs: Iterable[Sequence[str]]) -> T.StructType:
    """Schema from ordered ``[name, type name]`` pairs; every field is nullable."""
    return T.StructType([T.StructField(name, FIELD_TYPES[kind], True) for name, kind in pairs])


def read_csv_typed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    """CSV under a known schema, so that no pass is spent on inference."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=header)
    return df.select(*columns) if columns else df


def read_csv_inferred(spark: SparkSession, path: str, sep: str = ",", infer: bool = True) -> DataFrame:
    """CSV with a header; ``infer=False`` leaves every column a string."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=infer)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; without a schema Spark infers one."""
    return spark.read.json(path, schema=schema) if schema else spark.read.json(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_delimited_tsv(spark: SparkSession, path: str, first_column: str) -> DataFrame:
    """Tab-separated text with a header whose first name may carry a byte-order mark."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    return df.withColumnRenamed(df.columns[0], first_column)


def rename_from_map(df: DataFrame, names: Mapping[str, str], fields: Sequence[str]) -> DataFrame:
    """Rename by ``{old: new}`` and keep the working fields, in one projection."""
    return df.withColumnsRenamed(dict(names)).select(*fields)


def from_rows(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([tuple(row) for row in rows], schema)


def preview(df: DataFrame, n: int = 5) -> list[dict]:
    """The first ``n`` rows as dictionaries."""
    return [row.asDict() for row in df.limit(n).collect()]


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def count_approx(df: DataFrame, fraction: float, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Row count estimated from a sample, with a 95 % interval: estimate, lower, upper.

    With integer row ``keys`` the sample is fixed by them and the seed. Worth it for rows that are
    costly to make past the sample; the exact count of a Parquet table is cheaper, for it comes from
    the files' footers.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    half = 1.96 * math.sqrt((1 - fraction)) / fraction
    kept = df.filter(hash_below(fraction, seed, *[F.col(k) for k in keys])) if keys else df.sample(False, fraction, seed)
    return kept.agg(F.count("*").alias("kept")).select(
        F.round(F.col("kept") / fraction).cast("bigint").alias("estimate"),
        F.floor(F.greatest(F.lit(0.0), F.col("kept") / fraction - half * F.sqrt("kept"))).alias("lower"),
        F.ceil(F.col("kept") / fraction + half * F.sqrt("kept")).alias("upper"),
    )


@contextmanager
def persist_stage(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep a working table for several analyses and always release it."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


def settled(small: DataFrame) -> DataFrame:
    """A result of a few rows, computed now and held as local rows, so that its source may be released."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)
