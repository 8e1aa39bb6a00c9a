"""Operator 3: toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

Features are the distinct n-grams of 3 to 5 characters of the lower-cased text (with a space at
either end), hashed into 2**18 buckets. A bucket's weight is its naive Bayes log-count ratio; the
buckets that tell the classes apart best go, scaled by these ratios, into a logistic regression.

The fit uses at most ``max_rows`` labelled rows, chosen by a hash of doc_id; the model has at most
``FEATURES`` weights. Scoring covers every whole text. Labels, language, source and doc_id are never
inputs of a score.

Cases: null and empty texts score as texts without known n-grams; labels that are null or
whose document is missing are left out; of repeated labels the largest counts; without both classes
the model gives everyone the share of label 1, 0.49 at most, as nothing then tells texts apart (0 without
labels). Repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.textwork import slices, text_rows

GRAMS = (3, 4, 5)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
FEATURES = 8192
MAX_ROWS = 20_000
SMOOTH = 0.5
PENALTY = 2e-4
LEAST_GAIN = 12.0
BLOCK = 4096


@dataclass
class ToxicityModel:
    """A bias and a weight for each kept bucket: bounded whatever the corpus."""

    bias: float
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


def gram_buckets(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of texts, ordered by row; only ``wanted`` buckets if given."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(f" {' '.join(lowered)} ".encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1)  # where the space after each text is
    begins = ends - lengths - 1  # where the space before it is
    found, h = [], codes
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in GRAMS:
            bucket = (h * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS)
            at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
            row = np.searchsorted(begins, at, side="right") - 1
            keep = at + n <= ends[row] + 1
            found.append(row[keep] * BUCKETS + bucket[at[keep]].astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BUCKET_BITS, pairs & (BUCKETS - 1)


def _text_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in slices(batches, 1 << 19):
        yield part, part.column("text").to_pylist()


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled texts, chosen by a hash of doc_id (columns text, label)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > max_rows:
        share = int((1 << 32) * max_rows / n)
        known = known.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1)) < share)
    # at most max_rows ids and labels, 20 bytes each
    return text_rows(docs).join(F.broadcast(known.limit(2 * max_rows)), "doc_id").select("text", F.col("label").cast("int").alias("label"))


def _class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of class 0 and 1 by bucket; the last place has their number. Summed by block of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, BUCKETS + BLOCK), dtype=np.int64)
        for part, texts in _text_lists(batches):
            label = part.column("label").to_numpy(zero_copy_only=False)
            row, bucket = gram_buckets(texts)
            for c in (0, 1):
                counts[c, :BUCKETS] += np.bincount(bucket[label[row] == c], minlength=BUCKETS)
                counts[c, BUCKETS] += int((label == c).sum())
        used = counts.any(axis=0).reshape(-1, BLOCK).any(axis=1)
        for k in np.flatnonzero(used):
            part = counts[:, k * BLOCK : (k + 1) * BLOCK]
            blob = pa.array([part.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), blob], ["block", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in frame["counts"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "counts": [total.tobytes()]})

    schema = "block int, counts binary"
    blocks = sample.mapInArrow(count, schema).groupBy("block").applyInPandas(add, schema).collect()  # 65 rows at most
    counts = np.zeros((2, BUCKETS + BLOCK), dtype=np.int64)
    for r in blocks:
        counts[:, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], dtype=np.int64).reshape(2, BLOCK)
    return counts[:, :BUCKETS], counts[:, BUCKETS]


def _choose(counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart best, by likelihood ratio, and their log-count ratios."""
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = (counts.sum(axis=0) + 2 * SMOOTH) / (rows.sum() + 4 * SMOOTH)
    gain = np.zeros(BUCKETS)
    for c in (0, 1):
        have, n = counts[c] + SMOOTH, rows[c] + 2 * SMOOTH
        gain += have * np.log(have / n / share) + (n - have) * np.log((n - have) / n / (1 - share))
    gain[counts.sum(axis=0) < 2] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    best = np.sort(best[gain[best] > LEAST_GAIN])
    return best, ratio[best]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on labelled texts.

    Args: ``docs`` with doc_id and text; ``labels`` with doc_id and label (0 or 1), the rows that
    may be learnt from; ``max_rows``, the bound of the sample.
    """
    sample = _sample(docs, labels, max_rows).persist()
    try:
        counts, rows = _class_counts(sample)
        if not rows.all():
            share = min(0.49, (rows[1] + 1e-6) / (rows.sum() + 2e-6)) if rows.sum() else 1e-6
            return ToxicityModel(math.log(share / (1 - share)))
        buckets, ratios = _choose(counts, rows)
        if not len(buckets):
            return ToxicityModel(min(-0.04, math.log(rows[1] / rows[0])))
        place = np.full(BUCKETS, -1, dtype=np.int64)
        place[buckets] = np.arange(len(buckets))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in _text_lists(batches):
                row, bucket = gram_buckets(texts, place >= 0)
                at = np.searchsorted(row, np.arange(len(texts) + 1))
                rows_of = [place[bucket[a:b]].astype(np.int32) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows_of, pa.list_(pa.int32()))], ["label", "at"])

        size = len(buckets)
        vector = F.udf(lambda at: SparseVector(size, at, ratios[at]), VectorUDT())
        ready = sample.mapInArrow(features, "label int, at array<int>").select(F.col("label").cast("double"), vector("at").alias("features"))
        ready = ready.persist()
        try:
            model = LogisticRegression(maxIter=60, regParam=PENALTY, standardization=False).fit(ready)
        finally:
            ready.unpersist()
        return ToxicityModel(float(model.intercept), buckets, model.coefficients.toArray() * ratios)
    finally:
        sample.unpersist()


def scores(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    row, bucket = gram_buckets(texts, table != 0)
    total = bias + np.bincount(row, weights=table[bucket], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def score_column(model: ToxicityModel, text: str = "text") -> Column:
    """Score of a text column, 0 to 1. Call ``bound_batches`` first where texts are long."""

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        table = model.table()
        texts = [t or "" for t in column]
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 1 << 19):
                size += len(texts[to])
                to += 1
            out.append(scores(texts[at:to], table, model.bias))
            at = to
        return pd.Series(np.concatenate(out))

    return score(F.coalesce(F.col(text).cast("string"), F.lit("")))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Returns doc_id and score (0 to 1, higher: label 1 likelier) of every whole text."""
    return text_rows(docs).select("doc_id", score_column(model).alias("score"))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row's labels may not be learnt from: crc32 of doc_id as text leaves 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0
