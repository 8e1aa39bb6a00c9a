"""Samples and the train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.scalars import hash_below


def sample_simple(df: DataFrame, fraction: float, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Bernoulli sample without replacement; with integer row ``keys`` the same for any partitioning."""
    return df.filter(hash_below(fraction, seed, *[F.col(k) for k in keys])) if keys else df.sample(False, fraction, seed)


def sample_stratified(df: DataFrame, target: str, fraction: float, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """The same fraction of the goods and of the bads; other targets are left out.

    With integer row ``keys`` the sample is the same for any partitioning.
    """
    if not keys:
        return df.sampleBy(target, {0: fraction, 1: fraction}, seed)
    return sample_simple(df.filter(F.col(target).isin(0, 1)), fraction, seed, [*keys, target])


def split_train_test(df: DataFrame, target: str, keys: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """All rows with a ``sample`` column, train or test.

    The side is fixed by integer row keys and the seed, the same for any partitioning, and rows
    that are equal in all columns are kept. A row whose target is neither 0 nor 1 is in test.
    """
    train = F.col(target).isin(0, 1) & hash_below(fraction, seed, *[F.col(k) for k in keys])
    return df.withColumn("sample", F.when(train, "train").otherwise("test"))
