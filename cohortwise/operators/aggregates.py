"""Grouped aggregates and one-pass profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.quantiles import exact_quantiles
from cohortwise.operators.relational import melt_numeric, numeric_columns, share_of_total
from cohortwise.session import scratch_table

PAIR_SCHEMA = "row string, column string, correlation double"
PAIR_ARROW = pa.schema([("row", pa.string()), ("column", pa.string()), ("correlation", pa.float64())])
BLOCK_SCHEMA = "pair int, slot int, n long, sides binary, product binary"
BLOCK_ARROW = pa.schema([("pair", pa.int32()), ("slot", pa.int32()), ("n", pa.int64()), ("sides", pa.binary()), ("product", pa.binary())])
BLOCK_COLUMNS = 128
MERGE_SLOTS = 512


def group_sum_numeric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of every numeric column that is not a key."""
    names = [name for name in numeric_columns(df) if name not in keys]
    return df.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in names])


def group_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(name).alias(name) for name in values])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, count, mean, std, min, max; one row per column."""
    return melt_numeric(df, columns).groupBy("variable").agg(*_moments())


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``describe`` with the quartiles, one row per numeric column."""
    names = list(columns or numeric_columns(df))
    quartiles = (
        exact_quantiles(melt_numeric(df, names), "value", ["0.25", "0.5", "0.75"], by=["variable"], few=True)
        .groupBy("variable")
        .agg(*[F.max(F.when(F.col("position") == i, F.col("value"))).alias(n) for i, n in enumerate(("q_25", "median", "q_75"), 1)])
    )
    return describe(df, names).join(F.broadcast(quartiles), "variable")


def _moments() -> list[Column]:
    return [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count of each column, all in one pass."""
    return df.agg(*[F.count(F.when(F.col(name).isNull(), 1)).alias(name) for name in (columns or df.columns)])


def share_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group counts with their share of all rows."""
    return share_of_total(df.groupBy(*keys).agg(F.count("*").alias("count")))


def percent_labels(counts: DataFrame, count: str = "count") -> DataFrame:
    """A count table with its percentage of the total, to two decimals."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn("percent", F.round(F.try_divide(F.col(count) * 100.0, total.cast("double")), 2))


def distinct_and_spread(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.countDistinct(column).alias("n_distinct"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def pearson_matrix(df: DataFrame, columns: Sequence[str], limit: float | None = None) -> DataFrame:
    """row, column, correlation (absolute) for the pairs above the diagonal.

    ``row`` is the earlier of the two names; rows with a null or NaN in any column are left out,
    and a pair is null when one of its columns is constant or no row is left. With ``limit`` only
    pairs above it are made.

    One scan whatever the number of columns. The matrix is cut into blocks of ``BLOCK_COLUMNS`` columns a
    side; a task keeps the upper blocks of centred products (columns squared, 4 bytes each) and gives a row
    for each. Rows of a block are merged in a tree: first those of every ``MERGE_SLOTS``-th task, then
    the slots. A merge takes its rows one by one, so its memory is one block, however many tasks there
    were. Nothing passes the driver.
    """
    names = list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)]).na.drop()
    blocks = [slice(k, min(k + BLOCK_COLUMNS, len(names))) for k in range(0, len(names), BLOCK_COLUMNS)]
    pairs = [(a, b) for a in range(len(blocks)) for b in range(a, len(blocks))]
    slots = MERGE_SLOTS

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(len(names)), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            own = x.mean(axis=0)
            x -= own
            away, total = own - mean, n + len(x)
            pull = n * len(x) / total
            for a, b in pairs:
                left, right = blocks[a], blocks[b]
                found = x[:, left].T @ x[:, right]
                if n:
                    found += products[a, b]
                    found += pull * np.outer(away[left], away[right])
                products[a, b] = found
            n, mean = total, mean + away * (len(x) / total)
        if not n:
            return
        slot, spread = TaskContext.get().partitionId() % slots, [np.diag(products[a, a]) for a in range(len(blocks))]
        for k, (a, b) in enumerate(pairs):
            sides = np.concatenate([mean[blocks[a]], mean[blocks[b]], spread[a], spread[b]])
            yield _block_rows([(k, slot, n, sides.tobytes(), products.pop((a, b)).tobytes())])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = key[0].as_py()
        merged = _merge_blocks(batches, *[blocks[i] for i in pairs[pair]])
        if merged:
            n, sides, product = merged
            yield _block_rows([(pair, 0, n, sides.tobytes(), product.tobytes())])

    def correlate(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = (blocks[i] for i in pairs[key[0].as_py()])
        p, q = left.stop - left.start, right.stop - right.start
        n, sides, product = _merge_blocks(batches, left, right) or (0, np.zeros(2 * (p + q)), np.zeros((p, q)))
        spread = sides[p + q :]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.abs(product / np.sqrt(np.outer(spread[:p], spread[p:])))
        known = np.isfinite(value)
        keep = np.ones(value.shape, dtype=bool) if limit is None else known & (value > limit)
        if left == right:
            keep &= np.triu(keep, 1)
        i, j = np.nonzero(keep)
        value, known = value[i, j], known[i, j]
        for at in range(0, len(i), 1 << 14):
            part = slice(at, at + (1 << 14))
            columns = [[names[k] for k in i[part] + left.start], [names[k] for k in j[part] + right.start]]
            found = pa.array(value[part], mask=~known[part])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), found], schema=PAIR_ARROW)

    # a part without rows for each block, so that every pair is there even if no task has any
    empty = df.sparkSession.range(len(pairs)).selectExpr("cast(id as int) as pair", "0 as slot", "0L as n", "X'' as sides", "X'' as product")
    by_slot = rows.mapInArrow(moments, BLOCK_SCHEMA).groupBy("pair", "slot").applyInArrow(merge, BLOCK_SCHEMA)
    return by_slot.unionAll(empty).groupBy("pair").applyInArrow(correlate, PAIR_SCHEMA)


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK_ARROW.types, strict=True)], schema=BLOCK_ARROW)


def _merge_blocks(batches: Iterator[pa.RecordBatch], left: slice, right: slice) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Count, means and spreads of both sides, and centred products of all rows together; None without rows."""
    p, q = left.stop - left.start, right.stop - right.start
    n, sides, product = 0, np.zeros(2 * (p + q)), np.zeros((p, q))
    for batch in batches:
        for more, blob, block in zip(*[batch.column(c) for c in ("n", "sides", "product")], strict=True):
            if not (more := more.as_py()):
                continue
            own = np.frombuffer(blob.as_buffer())
            away, total = own[: p + q] - sides[: p + q], n + more
            pull = n * more / total
            product += np.frombuffer(block.as_buffer()).reshape(p, q)
            product += pull * np.outer(away[:p], away[p:])
            sides[p + q :] += own[p + q :] + pull * away * away
            sides[: p + q] += away * (more / total)
            n = total
    return (n, sides, product) if n else None


def join_strings(
    df: DataFrame, keys: Sequence[str], text: str, name: str, separator: str = " & ", strongest: str | None = None
) -> DataFrame:
    """Distinct texts of a key as one string, in text order or first by ``strongest``, descending.

    Meant for short label lists (names of variables, codes): the copies are removed before the
    shuffle, so that a string grows with the number of labels and not with the rows.
    """
    extra = [strongest] if strongest else []
    order = ", ".join([f"`{c}` desc" for c in extra] + [f"`{text}`"])
    return (
        df.select(*keys, text, *extra)
        .distinct()
        .groupBy(*keys)
        .agg(F.expr(f"listagg(`{text}`, '{separator}') within group (order by {order})").alias(name))
    )


def collect_ordered(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, periods: Sequence | None = None
) -> DataFrame:
    """Per key, all its known values as an array, by period and then value; copies are kept.

    Equal values of a period are counted first, so that what is gathered for a key is one entry for
    each distinct value and not each row. With ``periods`` a row of another period is an error.
    """
    rows = df.select(*keys, F.col(order).alias("_p"), value.alias("_x"))
    if periods is not None:
        other = F.raise_error(F.concat(F.lit("period outside the list: "), F.col("_p").cast("string")))
        rows = rows.filter(F.when(F.col("_p").isin(list(periods)), True).otherwise(other.cast("boolean")))
    counts = rows.groupBy(*keys, "_p", "_x").agg(F.count("*").cast("int").alias("_n"))
    known = F.when(F.col("_x").isNotNull(), F.struct("_p", "_x", "_n"))  # lists leave out nulls
    lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(known)).alias("_l"))
    return lists.select(*keys, F.flatten(F.transform("_l", lambda e: F.array_repeat(e["_x"], e["_n"]))).alias(name))


def ordered_rows(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """``collect_ordered`` as rows, for keys of any size: ``keys``, position (from 1), ``order``, ``name``.

    Known values by period and then value, a row for each copy. Values are counted first; the counts are
    dealt into ranges of key, period and value, so that a key with most of the rows fills many ranges.
    Positions are running counts inside a range and totals of the ranges before it.
    """
    counts = df.select(*keys, F.col(order).alias("_p"), value.alias("_x")).filter("_x is not null").groupBy(*keys, "_p", "_x").agg(F.count("*").alias("_n"))
    placed = scratch_table(_in_ranges(counts, [*keys, "_p", "_x"]), "ordered")
    totals = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_upto", F.sum("_n").over(inside))
    same = [F.col(key).eqNullSafe(F.col(f"_k{i}")) for i, key in enumerate(keys)]
    joined = running.join(offsets, reduce(Column.__and__, same, F.col("_range") == F.col("_r")))
    last = F.col("_before") + F.col("_upto")
    positions = F.explode(F.sequence(last - F.col("_n") + 1, last)).alias("position")
    return joined.select(*keys, positions, F.col("_p").alias(order), F.col("_x").alias(name))


def _in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` dealt into ranges, with _range and _at, numbers that rise in the order. Write it before it is used twice."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("_range", F.shiftright("_at", 33))


def weighted_std(
    df: DataFrame,
    keys: Sequence[str],
    weights: Sequence[str],
    values: Sequence[str],
    means: Sequence[str],
    flags: Sequence[str],
    error: bool = False,
) -> DataFrame:
    """Weighted deviation of each point of a curve around its mean, by group.

    ``sqrt(sum(w (v - m)^2) / ((n - 1) sum(w) / n))`` with ``n`` the number of known flags, as
    ``std_1 ..``; with ``error`` also ``error_i = std_i / sqrt(sum(w))``; and the group size.
    """
    columns: list[Column] = []
    errors: list[Column] = []
    for i, (w, v, m, flag) in enumerate(zip(weights, values, means, flags), 1):
        n = F.count(flag)
        spread = F.sum(F.col(w) * F.pow(F.col(v) - F.col(m), F.lit(2)))
        std = F.sqrt(F.try_divide(spread, F.try_divide((n - 1) * F.sum(w), n)))
        columns.append(std.alias(f"std_{i}"))
        errors.append(F.try_divide(std, F.sqrt(F.sum(w))).alias(f"error_{i}"))
    return df.groupBy(*keys).agg(*columns, *(errors if error else []), F.count("*").alias("freq"))
