"""Shared pieces of the text operators: rows, word hashes, shingles, slices and settled tables.

All operators take ``doc_id`` (any integer, may be null or repeated) and ``text`` (null counts as
empty) and ignore every other column, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.session import scratch_dir

SLICE_BYTES = 1 << 20
STRETCH = 1 << 18
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
SHINGLE = 5

_SEED = np.random.default_rng(20_240_611)
_BYTE_VALUE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


#: Python workers outlive their tasks: let them give memory back as it is freed, in place of holding on to
#: the most that any stage before has needed.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(4 << 20),
}


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session hold more than BATCH_ROWS rows or about BATCH_BYTES.

    Spark's defaults, 10,000 rows or 64 MB, would take several hundred MB of a Python worker for texts.
    Sets how workers give back memory too, unless the session says how.
    """
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def text_rows(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null becomes empty)."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer run is met."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.back, k, 1 << 64))])
        return self.up, self.down


_BYTES = _Powers(_BASE)
_WORDS = _Powers(0xD1342543DE82EF95 | 1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and each row's bounds in them (length rows + 1)."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has about ``most`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, bounds = text_buffer(batch.column(batch.schema.get_field_index("text")))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, as 64-bit hashes.

    Returns hashes, starts and ends (bytes) of all words, and for each row where its words begin
    (length rows + 1). ``lower`` lower-cases A-Z first. The text is taken in stretches that end
    between words, so that memory is bounded however long a row is.
    """
    n, found = len(data), []
    head = np.zeros(n + 1, dtype=bool)
    head[bounds] = True
    at = 0
    while at < n:
        to = min(n, at + STRETCH)
        while to < n:  # move on to the next place that no word spans
            window = data[to : to + 4096]
            free = np.flatnonzero(~_IS_WORD[window] | head[to : to + len(window)])
            if len(free):
                to += int(free[0])
                break
            to += len(window)
        piece = data[at:to]
        inside, first = _IS_WORD[piece], head[at:to]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        if len(s):
            up, down = _BYTES.upto(len(piece))
            values = _BYTE_VALUE[_LOWER[piece] if lower else piece]
            values *= up[: len(piece)]
            total = np.cumsum(values, dtype=np.uint64)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), total])
            h = total[e] - total[s]
            h *= down[s]
            found.append((mix(h), s + at, e + at))
        at = to
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), dtype=np.int64)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, bounds).astype(np.int64)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words (``len(words) - width + 1`` values), whatever the rows."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.upto(len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n] + np.uint64(width))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``width`` words of each row, repeats kept; a shorter row is one shingle.

    ``rows`` has where each row's words begin. Returns the hashes in row order and each row's
    bounds in them; a row without words has none.
    """
    counts = np.diff(rows)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(bounds[-1], dtype=np.uint64)
    runs = run_hashes(words, width)
    long = counts >= width
    if long.any():
        row = np.repeat(np.flatnonzero(long), made[long])
        into = np.arange(bounds[-1])[np.repeat(long, made)]
        out[into] = runs[rows[row] + (into - bounds[row])]
    for r in np.flatnonzero(~long & (counts > 0)):
        part = words[rows[r] : rows[r + 1]]
        out[bounds[r]] = run_hashes(part, len(part))[0]
    return out, bounds


def distinct_shingles(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of lower-cased word shingles of each row."""
    words, _, _, rows = word_hashes(data, bounds)
    shingles, at = shingle_hashes(words, rows, width)
    return [np.unique(shingles[at[r] : at[r + 1]]) for r in range(len(bounds) - 1)]


def id_ranges(docs: DataFrame, group_bytes: int) -> list[tuple[int | None, int]]:
    """Ranges of ``doc_id`` of at most ``group_bytes`` of text, or of one id: first id and bytes, in order.

    Bytes are summed by id in a sorted exchange of ids and bytes, texts stay where they are. Rows
    without an id come first, as a range of their own. Read once from the table; as the ranges are plain
    numbers (one for each ``group_bytes``), a task that runs again deals its rows as before.
    """
    sizes = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int | None, int]] = []
        for batch in batches:
            for i, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if made and made[-1][0] is not None and made[-1][1] + size <= group_bytes:
                    made[-1] = (made[-1][0], made[-1][1] + size)
                else:
                    made.append((i, size))
        first, total = zip(*made, strict=True) if made else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(total, pa.int64())], ["first", "bytes"])

    found = sizes.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(walk, "first long, bytes long").collect()
    out: list[tuple[int | None, int]] = []
    for first, size in sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0] or 0)):
        if out and out[-1][0] is not None and out[-1][1] + size <= group_bytes:
            out[-1] = (out[-1][0], out[-1][1] + size)
        else:
            out.append((first, size))
    return out


def range_bounds(docs: DataFrame, group_bytes: int) -> list[int]:
    """Cuts of ``doc_id`` between ranges of at most ``group_bytes`` of text, or of one id."""
    return [first for first, _ in id_ranges(docs, group_bytes) if first is not None][1:]


def range_group(doc_id: str, cuts: list[int]) -> Column:
    """Number of the range that holds ``doc_id``: how many cuts are at or below it (null: -1)."""
    if not cuts:
        return F.when(F.col(doc_id).isNull(), -1).otherwise(0).cast("int")
    at = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return F.when(F.col(doc_id).isNull(), -1).otherwise(place(F.coalesce(F.col(doc_id), F.lit(0))))


def range_parts(docs: DataFrame, group_bytes: int) -> tuple[int, list[int], Column]:
    """Parts of about ``group_bytes`` of text in order of doc_id (null last) and ``mark``, a 64-bit hash of the text.

    Returns the number of parts, those that share an id (or its absence) with others, and the part of
    a row. Only copies of one text under one id cannot be told apart.
    """
    ranges = id_ranges(docs, group_bytes)
    known = [r for r in ranges if r[0] is not None]
    widths = [-(-size // group_bytes) if size > group_bytes else 1 for _, size in known]
    widths.append(max([1, *(-(-size // group_bytes) for first, size in ranges if first is None)]))
    width = np.array(widths, dtype=np.int64)
    begin = np.cumsum(width) - width
    cuts = np.array([first for first, _ in known][1:], dtype=np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series, absent: pd.Series, mark: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, ids.to_numpy(dtype=np.int64), side="right")
        at[absent.to_numpy(dtype=bool)] = len(width) - 1
        share = mark.to_numpy(dtype=np.float64) / 2.0**64 + 0.5
        own = np.minimum((share * width[at]).astype(np.int64), width[at] - 1)
        return pd.Series((begin[at] + own).astype(np.int32))

    split = [int(b) + k for b, w in zip(begin, width, strict=True) if w > 1 for k in range(w)]
    part = place(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), F.col("mark"))
    return int(width.sum()), split, part
