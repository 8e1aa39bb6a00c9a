"""Projection, filter, join, set and reshape helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_columns(df: DataFrame, among: Sequence[str] | None = None) -> list[str]:
    """Names of the numeric columns, in table order or in the order of ``among``."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    numeric = {name for name, kind in df.dtypes if kind.startswith(kinds)}
    return [name for name in (among or df.columns) if name in numeric]


def replace_and_drop(df: DataFrame, new: Mapping[str, Column], drop: Sequence[str]) -> DataFrame:
    """Add derived columns and leave out their sources in one projection."""
    gone = set(drop)
    kept = [F.col(name) for name in df.columns if name not in gone]
    return df.select(*kept, *[column.alias(name) for name, column in new.items()])


def stage_columns(df: DataFrame, *stages: Mapping[str, Column]) -> DataFrame:
    """Add columns stage by stage; a stage may use the names made by the ones before it."""
    for stage in stages:
        df = df.select("*", *[column.alias(name) for name, column in stage.items()])
    return df


def null_out_sentinels(df: DataFrame, special_values: Mapping[str, Sequence]) -> DataFrame:
    """Null in place of each variable's special codes; variables without a rule stay as they are."""
    rules = {
        name: F.when(~F.col(name).isin(list(codes)), F.col(name))
        for name, codes in special_values.items()
        if name in df.columns and len(codes)
    }
    return df.withColumns(rules) if rules else df


def drop_sentinels(df: DataFrame, column: str, codes: Sequence | None) -> DataFrame:
    """Rows whose value is known and not a special code; without codes, all rows."""
    return df.filter(~F.col(column).isin(list(codes))) if codes else df


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns))


def range_filter(
    df: DataFrame, ranges: Mapping[str, tuple], members: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """Inclusive bounds on some columns and membership lists on others."""
    for name, (low, high) in ranges.items():
        df = df.filter(F.col(name).between(low, high))
    for name, allowed in (members or {}).items():
        df = df.filter(F.col(name).isin(list(allowed)))
    return df


def side_of(column: str, threshold) -> Column:
    """before, or after from the threshold on, which must have the column's own type; null if unknown."""
    value = F.lit(threshold)
    return F.when(F.col(column) < value, "before").when(F.col(column) >= value, "after")


def split_at_threshold(df: DataFrame, column: str, threshold) -> tuple[DataFrame, DataFrame]:
    """The rows before the threshold and the rows from it on, as filters that reach the scan.

    To aggregate both sides, group by ``side_of``: that is one scan.
    """
    value = F.lit(threshold)
    return df.filter(F.col(column) < value), df.filter(F.col(column) >= value)


def left_join_chain(fact: DataFrame, key: str, tables: Sequence[DataFrame], required: Sequence[str]) -> DataFrame:
    """Left joins on one key, then only the rows where the joined columns are known.

    Catalyst turns the joins into inner ones because of the final filter.
    """
    for table in tables:
        fact = fact.join(table, key, "left")
    for name in required:
        fact = fact.filter(F.col(name).isNotNull())
    return fact


def lookup_join(df: DataFrame, lookup: DataFrame, on: str, key: str, value: str, name: str) -> DataFrame:
    """Attach ``lookup.value`` as ``name`` where ``df.on`` equals ``lookup.key``."""
    small = lookup.select(F.col(key).alias(on), F.col(value).alias(name))
    return df.join(small, on, "left")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``.

    The copies of a row on the right are removed before the join, so that it meets each left row
    at most once; a left row with very many copies is split by the adaptive skew join.
    """
    return left.subtract(right.distinct())


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """The multiset form: each row of ``right`` removes one copy."""
    return left.exceptAll(right)


def pivot_long_to_wide(
    df: DataFrame, keys: Sequence[str], name: str, values: Sequence, value: str, prefix: str = ""
) -> DataFrame:
    """One column per listed value of ``name``; the list keeps Spark from scanning for it."""
    wide = df.groupBy(*keys).pivot(name, list(values)).agg(F.max(value))
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def unpivot_wide_to_long(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def melt_numeric(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, variable, value as double; unknown values (null or NaN) make no row.

    An inlined array rather than ``unpivot``: two uses of such a table in one plan stay
    recognisably equal, so Spark runs their common part once.
    """
    cells = ", ".join(f"struct('{name}' as variable, cast(`{name}` as double) as value)" for name in variables)
    long = df.selectExpr(*[f"`{name}`" for name in keep], f"inline(array({cells}))")
    return long.filter("value is not null and not isnan(value)")


def explode_array(df: DataFrame, column: str, value: str, position: str = "position") -> DataFrame:
    """One row per element with its place, counted from 1."""
    rest = [name for name in df.columns if name != column]
    return df.select(*rest, F.posexplode(column).alias("_p", value)).select(
        *rest, (F.col("_p") + 1).alias(position), value
    )


def columns_to_vector(df: DataFrame, prefix: str, n: int, name: str) -> DataFrame:
    """``prefix_1 .. prefix_n`` as one array column."""
    family = [f"{prefix}_{i}" for i in range(1, n + 1)]
    rest = [c for c in df.columns if c not in family]
    return df.select(*rest, F.array(*family).alias(name))


def vector_to_columns(df: DataFrame, name: str, prefix: str, n: int) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *[F.col(name)[i - 1].alias(f"{prefix}_{i}") for i in range(1, n + 1)])


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of a total order; each task keeps at most ``n`` rows."""
    return df.orderBy(*order).limit(n)


def threshold_rank(df: DataFrame, metric: str, limit: float, above: bool = True) -> DataFrame:
    """Rows past a limit, strongest first."""
    past = F.col(metric) > limit if above else F.col(metric) < limit
    return df.filter(past).orderBy(F.desc(metric))


def share_of_total(counts: DataFrame, count: str = "count", name: str = "proportion") -> DataFrame:
    """Counts with their share of the grand total.

    The total is a scalar subquery: no window gathers all groups into one task.
    """
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(name, F.try_divide(F.col(count).cast("double"), total.cast("double")))


def share_within(
    counts: DataFrame, keys: Sequence[str], count: str = "count", name: str = "proportion", total: str | None = None
) -> DataFrame:
    """Counts with their share of the total of ``keys``, over rows that are already aggregated.

    ``total`` names a column for the total itself.
    """
    whole = F.sum(count).over(Window.partitionBy(*keys))
    summed = counts.withColumn(total or "_total", whole)
    shared = summed.withColumn(name, F.col(count) / F.col(total or "_total"))
    return shared if total else shared.drop("_total")
