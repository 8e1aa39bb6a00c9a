"""Operator 2: document fingerprints by one-permutation MinHash.

Each shingle of five lower-cased words is hashed once and put into one of ``BINS`` bins by its high
bits; a bin keeps its least hash. An empty bin takes the hash of another one, found by a sequence of
probes that depends on the bin alone (optimal densification), so that two documents with the same
filled bins look in the same places. ``BITS`` low-order bits per bin are stored, one hexadecimal
digit each. Two unequal hashes agree in these bits by chance once in 2**BITS; the likeness takes
that out again.

Cases: null text counts as empty; a text of fewer than five words is one shingle; a text without
words has the empty string as fingerprint, like only to another such text. Repeated rows have
equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.textwork import mix, range_bounds, range_group, shingle_hashes, slices, text_buffer, text_rows, word_hashes

BINS = 512
BITS = 4
GROUP_BYTES = 6 << 20
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(64 - 9)
_BIN = np.arange(BINS, dtype=np.uint64)
_SALT = mix(_BIN + np.uint64(0x5DEECE66D))
_DIGIT = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    """The bin that an empty bin looks at in an attempt; the same for every document."""
    return (mix(_SALT[bins] + np.uint64(attempt)) >> _SHIFT).astype(np.int64)


def fingerprint_digits(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits per row and bin, and which rows have shingles at all."""
    words, _, _, at = word_hashes(data, bounds)
    shingles, rows = shingle_hashes(words, at)
    n = len(bounds) - 1
    least = np.full(n * BINS, NOTHING, dtype=np.uint64)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(rows))
    np.minimum.at(least, row * BINS + (shingles >> _SHIFT).astype(np.int64), shingles)
    least = least.reshape(n, BINS)
    filled = least != NOTHING
    some = filled.any(axis=1)
    donor = np.broadcast_to(np.arange(BINS), (n, BINS)).copy()
    r, b = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        other = _probe(b, attempt)
        found = filled[r, other]
        donor[r[found], b[found]] = other[found]
        r, b = r[~found], b[~found]
    value = np.take_along_axis(least, donor, axis=1)
    # the bin's own salt makes copies of one hash independent in their low-order bits
    return (mix(value ^ _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def as_strings(digits: np.ndarray, some: np.ndarray) -> list[str]:
    return [bytes(_DIGIT[d]).decode() if s else "" for d, s in zip(digits, some, strict=True)]


def digit_likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from stored bits, chance agreement taken out."""
    chance = 1 / (1 << BITS)
    equal = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    estimate = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, estimate, (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Returns doc_id and fingerprint (string) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = as_strings(*fingerprint_digits(*text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fingerprint string")


def likeness(left: str, right: str) -> Column:
    """Likeness of two fingerprint columns, 0 to 1; null if either is null."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        known = a.notna() & b.notna()
        def digits(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            some = (s != "").to_numpy()
            text = "".join(x or "0" * BINS for x in s).encode()
            return np.frombuffer(text, dtype=np.uint8).reshape(len(s), BINS), some
        out = pd.Series(np.nan, index=a.index)
        if known.any():
            out[known] = digit_likeness(*digits(a[known]), *digits(b[known]))
        return out.where(known, None)

    return compare(left, right)


def edited_text(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the following document's beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _in_order(docs: DataFrame, group_bytes: int) -> DataFrame:
    """Rows dealt into ranges of doc_id, each with the first row of the range that follows it.

    Only the largest doc_id of each range (at most 100,000) passes the driver; texts do not.
    """
    spark = docs.sparkSession
    rows = text_rows(docs)
    cuts = range_bounds(rows, group_bytes)
    placed = rows.withColumn("part", range_group("doc_id", cuts))
    heads = sorted(((r["part"], r["head"]) for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    # descending order: the head of each range also goes to the range before it, the first to the last
    to = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads) if head is not None]
    extra = spark.createDataFrame(to, "head long, visit int")
    visits = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))
    both = F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")),
        F.struct(F.col("visit").alias("part"), F.lit(True).alias("guest")),
    )
    nulls_visit = heads[-2][0] if len(heads) > 1 and heads[-1][1] is None else None
    marked = placed.join(F.broadcast(extra), F.col("doc_id") == F.col("head"), "left")
    if nulls_visit is not None:  # rows without an id come last: one of them follows the smallest id
        marked = marked.withColumn("visit", F.when(F.col("doc_id").isNull(), F.lit(nulls_visit)).otherwise(F.col("visit")))
    return marked.select("doc_id", "text", F.explode(F.when(F.col("visit").isNull(), visits).otherwise(both)).alias("at")).select(
        "doc_id", "text", "at.part", "at.guest"
    )


def edited_fingerprints(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Fingerprints of texts, of their edited forms, and their likenesses.

    The following document is the next by descending doc_id (equal ids by text; rows without an id
    last); after the last comes the first. Ranges of doc_id of about ``group_bytes`` of text are
    worked on in one task each. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(table: pa.Table) -> pa.Table:
        ids = np.array([-(1 << 63) if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        guest = table.column("guest").to_pylist()
        texts = table.column("text").to_pylist()
        own = sorted((i for i, g in enumerate(guest) if not g), key=lambda i: (-int(ids[i]), texts[i]))
        others = sorted((i for i, g in enumerate(guest) if g), key=lambda i: (-int(ids[i]), texts[i]))
        order = own + (others[:1] or own[:1])
        texts = [texts[i] for i in order]
        out: dict[str, list] = {name: [] for name in names}
        at = 0
        while at < len(own):
            to, size = at, 0
            while to < len(own) and (to == at or size < 2 << 20):
                size += len(texts[to])
                to += 1
            part = texts[at : to + 1]
            edited = [edited_text(a, b) for a, b in zip(part, part[1:])]
            d, some = fingerprint_digits(*text_buffer(pa.array(part, pa.large_string())))
            e, e_some = fingerprint_digits(*text_buffer(pa.array(edited, pa.large_string())))
            out["n_chars"] += [len(t) for t in part[:-1]]
            out["edited_sha256"] += [hashlib.sha256(t.encode()).hexdigest() for t in edited]
            out["fingerprint"] += as_strings(d[:-1], some[:-1])
            out["edited_fingerprint"] += as_strings(e, e_some)
            out["near_edited"] += digit_likeness(d[:-1], some[:-1], e, e_some).tolist()
            out["near_next"] += digit_likeness(d[:-1], some[:-1], d[1:], some[1:]).tolist()
            at = to
        columns = [table.column("doc_id").combine_chunks().take(pa.array(own, pa.int64()))]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns += [pa.array(out[name], kind) for name, kind in zip(names[1:], kinds, strict=True)]
        return pa.Table.from_arrays(columns, names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return _in_order(docs, group_bytes).groupBy("part").applyInArrow(run, schema)
