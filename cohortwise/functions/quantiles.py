"""Exact quantiles and rank statistics without gathering a group in one task.

Quantiles take two reads, whatever the data. The first makes one mergeable summary per group, with a
proven bound on the rank of what it answers, and so a bracket that holds each wanted value. The second
counts rows between the ends of brackets, and by value inside them: ranks are settled on these counts,
and so are counts of buckets between the quantiles found. Counts are shuffled, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

# Rank error of the summary, as a share of a group's rows, is at most 1 / ACCURACY (which is 3 or more).
ACCURACY = 10_000
BRACKET_CELLS = 1024
# Parts that the rows of a group are dealt into where they are shuffled to meet its brackets.
GROUP_PARTS = 64


def bracket_counts(
    df: DataFrame,
    value: str,
    probabilities: Sequence[str],
    by: Sequence[str] = (),
    keep: Sequence[str] = (),
    reference: Column | None = None,
    few: bool = False,
) -> DataFrame:
    """Counts that settle quantiles of the ``reference`` rows (all rows, unless given), in two reads.

    ``by``, ``keep``, _ref (whether reference rows are counted), _code and _cell (which rise with the
    value), _x (the value itself, null outside all brackets), _at (the largest end of a bracket that the
    rows reach, null below all) and _n. No quantile lies above _at and below the other values of a row
    without _x. A row of the summary's answer has a rank within 1 / ``ACCURACY`` of the one asked for, so
    a bracket from three times that below a probability to as much above holds its quantile. Values
    inside brackets are at most 6 / ``ACCURACY`` of a group's rows for each probability.

    ``few``: the groups are no more than the names of the caller's list, so their brackets go to the rows by
    broadcast. Otherwise rows are shuffled, each group in ``GROUP_PARTS`` parts, so that no task gets one whole.
    """
    by, keep, ends = list(by), list(keep), 2 * len(probabilities)
    rows = df.select(*by, *keep, F.col(value).cast("double").alias("_v"), (F.lit(True) if reference is None else F.coalesce(reference, F.lit(False))).alias("_ref"))
    rows = rows.filter("_v is not null and not isnan(_v)")
    margin = 3 / ACCURACY
    asked = [min(1.0, max(0.0, float(p) + side)) for p in probabilities for side in (-margin, margin)]

    # First read: a bracket for each probability, and the places between their ends that some bracket covers.
    found = rows.filter("_ref").groupBy(*by).agg(F.percentile_approx("_v", asked, ACCURACY).alias("_q"))
    sorted_ends = F.array_sort(F.array_distinct("_q"))
    padded = F.concat(sorted_ends, F.array_repeat(F.lit(float("nan")), F.lit(ends) - F.size(sorted_ends)))
    covered = " or ".join(f"(_q[{2 * k}] < _b[i] and _b[i] <= _q[{2 * k + 1}])" for k in range(len(probabilities)))
    brackets = found.withColumn("_b", padded).select(
        *[F.col(name).alias(f"_by{k}") for k, name in enumerate(by)], "_b", F.expr(f"transform(sequence(0, {ends - 1}), i -> {covered})").alias("_w")
    )

    # Second read: _i ends are at or below a value; the place before end _i is covered by a bracket or not.
    # NaN stands for an end that is not there: it is above all values.
    same_group = [F.col(name).eqNullSafe(F.col(f"_by{k}")) for k, name in enumerate(by)]
    if few or not by:
        brackets = F.broadcast(brackets)
    else:
        rows = rows.withColumn("_part", F.monotonically_increasing_id() % GROUP_PARTS)
        brackets = brackets.withColumn("_of_part", F.explode(F.sequence(F.lit(0), F.lit(GROUP_PARTS - 1))))
        same_group.append(F.col("_part") == F.col("_of_part"))
    joined = rows.join(brackets, reduce(Column.__and__, same_group, F.lit(True)), "left")
    joined = joined.withColumn("_b", F.coalesce("_b", F.array_repeat(F.lit(float("nan")), ends)))
    joined = joined.withColumn("_i", F.expr(_reached(0, ends))).withColumn("_at", F.expr("case when _i > 0 then _b[_i - 1] end"))
    inside = f"_i > 0 and _i < {ends} and _v > _at and coalesce(_w[_i], false)"
    place = f"cast(floor((_v - _at) / (_b[_i] - _at) * {BRACKET_CELLS}) as int)"
    return (
        joined.selectExpr(
            *_names(by, *keep, "_ref", "_at"),
            "2 * _i - case when _v = _at then 1 else 0 end as _code",
            f"case when {inside} then least(greatest({place}, 0), {BRACKET_CELLS - 1}) else 0 end as _cell",
            f"case when _v = _at or ({inside}) then _v end as _x",
        )
        .groupBy(*by, *keep, "_ref", "_at", "_code", "_cell", "_x")
        .agg(F.count("*").alias("_n"))
    )


def _reached(low: int, high: int) -> str:
    """SQL of how many of the sorted ends are at or below a value, by binary search."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    return f"case when _v < _b[{middle}] then {_reached(low, middle)} else {_reached(middle + 1, high)} end"


def settle_quantiles(counts: DataFrame, probabilities: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, position (from 1), value: the exact quantiles, from ``bracket_counts``.

    Only cells that hold a wanted rank are looked at by value. Both uses of the counts share one shuffle,
    so no filter or null test may reach below it.
    """
    by = list(by)
    group = f"partition by {', '.join(f'`{name}`' for name in by)}" if by else ""
    holds_rank = F.expr(" or ".join(f"_start < {_rank(p)} and {_rank(p)} <= _start + _r" for p in probabilities))
    of_reference = F.sum(F.expr("case when _ref then _n else 0L end")).alias("_r")
    cells = counts.groupBy(*by, "_code", "_cell").agg(of_reference)
    wanted = cells.selectExpr(
        *_names(by, "_code", "_cell", "_r"),
        f"sum(_r) over ({group}) as _total",
        f"sum(_r) over ({group} order by _code, _cell rows unbounded preceding) - _r as _start",
    ).filter(holds_rank)
    wanted = wanted.select(*[F.col(name).alias(f"_w_{name}") for name in (*by, "_code", "_cell")], "_total", "_start")
    same = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"_w_{name}")) for name in (*by, "_code", "_cell")])
    values = counts.join(wanted, same).groupBy(*by, "_code", "_cell", "_x", "_total", F.col("_start").alias("_from")).agg(of_reference)
    inside = ", ".join(f"`{name}`" for name in (*by, "_code", "_cell"))
    found = values.filter("_r > 0").selectExpr(
        *_names(by, "_x", "_r", "_total"), f"_from + sum(_r) over (partition by {inside} order by _x rows unbounded preceding) - _r as _start"
    )
    places = ", ".join(f"struct({i} as position, {_rank(p)} as rank)" for i, p in enumerate(probabilities, 1))
    known = "case when _x is null then cast(raise_error('a rank outside its bracket') as double) else _x end"
    return (
        found.filter(holds_rank)
        .selectExpr(*_names(by, "_x", "_start", "_r"), f"inline(array({places}))")
        .filter("_start < rank and rank <= _start + _r")
        .selectExpr(*_names(by), "position", f"{known} as value")
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[str], by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """``by``, position (from 1), value: the smallest value whose rank reaches ``p * n``.

    ``probabilities`` are decimal texts such as ``"0.25"``, so that ``p * n`` is exact. Two reads of the
    rows, whatever the data. ``few`` as in ``bracket_counts``.
    """
    return settle_quantiles(bracket_counts(df, value, probabilities, by, few=few), probabilities, by)


def _names(by: Sequence[str], *others: str) -> list[str]:
    return [f"`{name}`" for name in (*by, *others)]


def _rank(probability: str) -> str:
    """The first rank that reaches a probability, in exact decimal arithmetic."""
    exact = f"cast({Decimal(probability):f} as decimal(9,8)) * cast(_total as decimal(20,0))"
    return f"greatest(1L, cast(ceil({exact}) as bigint))"


def quantiles_approx(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """``by`` and an array of approximate quantiles from one mergeable sketch per group."""
    return df.groupBy(*by).agg(F.percentile_approx(value, list(probabilities), accuracy).alias("quantiles"))


def rank_auc(long: DataFrame, by: str, value: str, target: str) -> DataFrame:
    """``by``, positives, negatives, auc: the chance that a bad has a larger value than a good.

    Equal values count one half. The rows are read once and counted per distinct value; the counts are
    dealt into ranges of (``by``, value), which no crowd of values near each other can fill, and run
    through in order. Only a range's totals are ordered per group; no group or cell is gathered.
    """
    counts = (
        long.select(by, F.col(value).cast("double").alias("_v"), F.col(target).cast("bigint").alias("_t"))
        .filter("_v is not null and not isnan(_v)")
        .groupBy(by, "_v")
        .agg(F.expr("count_if(_t = 1) as _pos"), F.expr("count_if(_t = 0) as _neg"))
    )
    kind = long.schema[by].dataType
    schema = StructType([StructField("_by", kind), StructField("_range", IntegerType())])
    for name, of in (("_pos", LongType()), ("_neg", LongType()), ("_wins", DoubleType())):
        schema = schema.add(name, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0))
            ends = runs.run_ends.to_numpy()
            pos, neg = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            done = []
            for key, low, high in zip(runs.values, [0, *ends[:-1]], ends, strict=True):
                if held is None or not held[0].equals(key):
                    if held is not None:
                        done.append(held)
                    held = [key, 0, 0, 0.0]
                p, q = pos[low:high], neg[low:high]
                below = held[2] + np.cumsum(q) - q
                held[3] += float((p * (below + q / 2)).sum())
                held[1] += int(p.sum())
                held[2] += int(q.sum())
            if done:
                yield packed(place, done, batch.schema.field(0).type)
        if held is not None:
            yield packed(place, [held], held[0].type)

    def packed(place: int, rows: list, key: pa.DataType) -> pa.RecordBatch:
        keys, pos, neg, wins = zip(*rows, strict=True)
        columns = [pa.array([k.as_py() for k in keys], key), pa.array([place] * len(rows), pa.int32()), *map(pa.array, (pos, neg, wins))]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    in_order = counts.repartitionByRange(by, "_v").sortWithinPartitions(by, "_v").select(by, "_pos", "_neg")
    before = "sum(_neg) over (partition by _by order by _range rows between unbounded preceding and 1 preceding)"
    return (
        in_order.mapInArrow(run, schema)
        .withColumn("_wins", F.expr(f"_wins + cast(_pos as double) * coalesce({before}, 0L)"))
        .groupBy("_by")
        .agg(F.expr("sum(_pos) as positives"), F.expr("sum(_neg) as negatives"), F.expr("sum(_wins) as _wins"))
        .selectExpr(f"_by as `{by}`", "positives", "negatives", "try_divide(_wins, cast(positives as double) * negatives) as auc")
    )
