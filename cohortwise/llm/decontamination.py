"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets (powers of two). For each partition,
long documents are looked at in overlapping blocks of four times the partition's least size, so that
an item that a document contains is a fair part of some block: the containment threshold becomes a
Jaccard threshold of at least 0.17 there. A block is a candidate for an item if one of ``SLOTS``
minima of the two agree; a pair is missed with a probability under 1e-10. Candidates are verified
by the exact containment of the item's five-word shingles in the whole document's set.

A block without any shingle that is the minimum of an item in some slot cannot agree with an item,
so its minima are not computed.

The items are worked on in shards of at most about ``SHARD_SHINGLES`` shingles, each broadcast in its
turn, so that what is broadcast stays bounded however many items there are.

Cases: null texts count as empty; an item or document without words matches nothing; fewer than
five words are one shingle; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.textwork import distinct_shingles, mix, shingle_hashes, slices, text_buffer, text_rows, word_hashes

SLOTS = 128
SHARD_SHINGLES = 1 << 21
_SALT = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ROW = "doc_id long, item_id long, n_shared long, n_item long"


def minima(sets: np.ndarray) -> np.ndarray:
    """Least hash of each row of a matrix of shingles in each slot (rows x SLOTS).

    Slots use different bijections of the shingle hash, so equal minima mean the same shingle.
    """
    out = np.empty((len(sets), SLOTS), dtype=np.uint64)
    for k in range(SLOTS):
        out[:, k] = mix(sets ^ _SALT[k]).min(axis=1)
    return out


@dataclass
class Partition:
    """Items of one size class: their minima, ordered, with the item that each belongs to."""

    block: int
    minima: np.ndarray
    owner: np.ndarray


@dataclass
class ItemIndex:
    """One shard of test items, partitioned by size."""

    ids: list
    sets: list[np.ndarray]
    partitions: list[Partition]
    probes: np.ndarray

    @classmethod
    def build(cls, ids: list, sets: list[np.ndarray]) -> ItemIndex:
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                classes.setdefault(len(s).bit_length() - 1, []).append(i)
        partitions, probes = [], [np.zeros(0, dtype=np.uint64)]
        for size, members in sorted(classes.items()):
            values = np.concatenate([minima(sets[i][None, :])[0] for i in members])
            owner = np.repeat(np.array(members), SLOTS)
            probes += [sets[i][np.unique([mix(sets[i] ^ s).argmin() for s in _SALT])] for i in members]
            order = np.argsort(values, kind="stable")
            partitions.append(Partition(4 << size, values[order], owner[order]))
        return cls(ids, sets, partitions, np.unique(np.concatenate(probes)))

    def quick(self) -> np.ndarray:
        """A table by the high 20 bits of a shingle: whether any probe has them."""
        out = np.zeros(1 << 20, dtype=bool)
        out[self.probes >> np.uint64(44)] = True
        return out

    def candidates(self, shingles: np.ndarray, hits: np.ndarray) -> set[int]:
        """Items that agree in some slot with a block of one document; ``hits`` are places of probes."""
        found: set[int] = set()
        for p in self.partitions:
            half = p.block // 2
            blocks = np.unique(np.concatenate([hits // half, hits // half - 1]))
            blocks = blocks[(blocks >= 0) | (len(shingles) <= half)]
            starts = np.unique(np.clip(blocks, 0, None)) * half
            for at in range(0, len(starts), 1024):
                # places beyond the end repeat the last shingle, which leaves the minimum as it is
                where = np.minimum(starts[at : at + 1024, None] + np.arange(p.block), len(shingles) - 1)
                values = np.unique(minima(shingles[where]))
                lo, hi = np.searchsorted(p.minima, values, "left"), np.searchsorted(p.minima, values, "right")
                for a, b in zip(lo[hi > lo], hi[hi > lo]):
                    found.update(p.owner[a:b].tolist())
        return found

    def contained(self, batch: pa.RecordBatch, quick: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of a slice of rows, each item that meets the threshold."""
        data, bounds = text_buffer(batch.column(batch.schema.get_field_index("text")))
        words, _, _, at = word_hashes(data, bounds)
        shingles, rows = shingle_hashes(words, at)
        near = np.flatnonzero(quick[shingles >> np.uint64(44)])
        if not len(near) or not len(self.probes):
            return
        k = np.minimum(np.searchsorted(self.probes, shingles[near]), len(self.probes) - 1)
        near = near[self.probes[k] == shingles[near]]
        row = np.searchsorted(rows, near, side="right") - 1
        for r in np.unique(row):
            own = shingles[rows[r] : rows[r + 1]]
            items = sorted(self.candidates(own, near[row == r] - rows[r]))
            if items:
                held = np.unique(own)
                for i in items:
                    shared = int(np.isin(self.sets[i], held, assume_unique=True).sum())
                    if 100 * shared >= percent * len(self.sets[i]):
                        yield int(r), i, shared


def item_shards(items: DataFrame, item_id: str = "item_id") -> Iterator[ItemIndex]:
    """Indexes of the test items, one shard after the other."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // (4 * SHARD_SHINGLES)) or 1
    for k in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect()  # about SHARD_SHINGLES words
        if part:
            part.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
            buffer = text_buffer(pa.array([r["text"] for r in part], pa.large_string()))
            yield ItemIndex.build([r["item_id"] for r in part], distinct_shingles(*buffer))


def contaminations(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """Test items found inside documents.

    Args: ``docs`` with doc_id and text; ``items`` with item_id and text; ``percent``, the least
    share of an item's shingles that the document must hold. Returns doc_id, item_id, n_shared,
    n_item (shingles of the item) and containment, one row for each document and item.
    """
    spark, parts = docs.sparkSession, []
    for index in item_shards(items):
        shared_index = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            index = shared_index.value
            quick = index.quick()
            for part in slices(batches):
                ids = part.column("doc_id").to_pylist()
                found = [(ids[r], index.ids[i], n, len(index.sets[i])) for r, i, n in index.contained(part, quick, percent)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "n_shared", "n_item"]
                    )

        parts.append(text_rows(docs).mapInArrow(run, ROW))
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], ROW)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _holds(shared_index, percent: int):
    """Whether a text holds an item of one shard."""

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        index, done = shared_index.value, []
        quick = index.quick()
        batch = pa.RecordBatch.from_arrays([pa.array(column, pa.string())], ["text"])
        for part in slices(iter([batch])):
            flags = np.zeros(part.num_rows, dtype=bool)
            flags[[r for r, _, _ in index.contained(part, quick, percent)]] = True
            done.append(flags)
        return pd.Series(np.concatenate(done)) if done else pd.Series([], dtype=bool)

    return holds


def contaminated_columns(docs: DataFrame, items: DataFrame, percent: int = 75, text: str = "text") -> list[Column]:
    """For each shard of items, whether a text holds one of them."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [_holds(broadcast(index), percent)(whole) for index in item_shards(items)]
