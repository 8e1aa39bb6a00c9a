"""Scalar expressions used by the reports; all of them stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null, not an error, when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio(numerator: Column, denominator: Column, precision: int = 10, scale: int = 5) -> Column:
    """Quotient as a decimal; null on a zero denominator or an overflow."""
    return safe_ratio(numerator, denominator).try_cast(f"decimal({precision},{scale})")


def sentinel_greatest(amount: Column, income: Column, sentinel: float = 99999999) -> Column:
    """Income where the amount is the sentinel, otherwise the larger of the two, one decimal."""
    value = F.when(amount == sentinel, income).otherwise(F.greatest(amount, income))
    return value.try_cast("decimal(20,1)")


def classify_by_sets(code: Column, rules: Mapping[str, Sequence]) -> Column:
    """Name of the set that holds the code, null when none does; the sets must not overlap."""
    seen: set = set()
    label = F.lit(None).cast("string")
    for name, codes in rules.items():
        shared = seen.intersection(codes)
        if shared:
            raise ValueError(f"codes in more than one set: {sorted(shared)}")
        seen.update(codes)
        label = F.when(code.isin(list(codes)), F.lit(name)).otherwise(label)
    return label


def composite_key(entity: Column, branch: Column, contract: Column) -> Column:
    """``00`` + entity + branch padded to four digits + contract; null for a branch above 9999."""
    number = F.trim(branch.cast("string")).try_cast("int")
    padded = F.lpad(number.cast("string"), 4, "0")
    parts = F.concat(F.lit("00"), F.trim(entity.cast("string")), padded, F.trim(contract.cast("string")))
    return F.when(number <= 9999, parts)


def yyyymm(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def yyyymm_year(cohort: Column) -> Column:
    return F.floor(cohort / 100).cast("int")


def parse_mixed_date(text: Column) -> Column:
    """``dd/mm/yyyy`` or ``yyyy-mm-dd`` by the place of the separator; anything else is null."""
    return F.when(F.substring(text, 3, 1) == "/", F.try_to_date(text, "dd/MM/yyyy")).when(
        F.substring(text, 5, 1) == "-", F.try_to_date(text, "yyyy-MM-dd")
    )


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two labels that begin with ``HH:mm:ss``."""

    def seconds(label: Column) -> Column:
        return F.unix_seconds(F.try_to_timestamp(F.substring(label, 1, 8), F.lit("HH:mm:ss")))

    return seconds(end) - seconds(start)


def elapsed_time(start: Column, end: Column) -> Column:
    """The difference as ``H:MM:SS``; a negative one is written as one day less plus the rest."""
    total = elapsed_seconds(start, end)
    rest = F.pmod(total, F.lit(86400))
    clock = F.concat(
        F.floor(rest / 3600).cast("string"),
        F.lit(":"),
        F.lpad(F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(F.pmod(rest, F.lit(60)).cast("string"), 2, "0"),
    )
    return F.when(total < 0, F.concat(F.lit("-1 day, "), clock)).otherwise(clock)


def local_time_label(instant: Column, zone: str = "America/Mexico_City") -> Column:
    """A UTC instant as the local ``HH:mm:ss AM/PM``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz"))
    return F.date_format(local, "HH:mm:ss a")


def strip_suffix(label: Column) -> Column:
    """Drop everything from the first ``"- "`` and the blanks before it."""
    return F.regexp_replace(F.regexp_replace(label, "- .*", ""), r"\s+$", "")


def split_field(text: Column, separator: str, position: int) -> Column:
    """The piece at ``position``, counted from 1."""
    return F.split_part(text, F.lit(separator), F.lit(position))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def label_concat(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def hash_below(fraction: float, seed: int, *keys: Column) -> Column:
    """True for a share ``fraction`` of the rows, fixed by integer keys and a seed.

    The first 32 bits of a digest are compared as hexadecimal text, which orders like the number,
    so the outcome is the same on every run, partitioning and engine.
    """
    text = F.concat_ws("-", *[key.cast("string") for key in keys], F.lit(str(seed)))
    limit = min(max(math.ceil(fraction * 2**32), 0), 2**32)
    if limit == 2**32:
        return F.lit(True)
    return F.substring(F.md5(text), 1, 8) < F.lit(f"{limit:08x}")


def random_flag(seed: int, *keys: Column) -> Column:
    """0 or 1 with equal odds: from ``rand`` without keys, repeatable from them otherwise."""
    zero = hash_below(0.5, seed, *keys) if keys else F.rand(seed) < 0.5
    return F.when(zero, 0).otherwise(1)
