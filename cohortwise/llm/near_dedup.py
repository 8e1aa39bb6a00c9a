"""Operator 7: near-duplicate documents by SetSketch registers.

A document's set holds its distinct five-word shingles (lower-cased A-Z). Each of REGISTERS registers
keeps the least of exponentially distributed values of the shingles, truncated to an integer power
of BASE: maxima of two sketches, register by register, are the sketch of the union. Registers of two
sets agree about as often as their Jaccard similarity, which makes bands of them locality-sensitive.

1. Documents with equal sets form a class; one row stands for it.
2. Classes that agree in all ROWS registers of a band share a bucket. Each class is paired with two
   hubs (smallest members) of its buckets; nothing is paired with everything.
3. Pairs whose similarity, estimated jointly from the two sketches and sizes by maximum likelihood,
   is far below the threshold are left aside; the others are verified on the whole sets.
4. Verified links make components. Buckets that still hold several components are looked at again:
   members of different components are compared by their sketches, large buckets in blocks, and
   pairs that may be similar are verified in place. So no pair in a bucket is lost to a hub.

Of pairs of equal size exactly at the threshold 0.75, 2.5e-7 share no bucket and fewer are ruled out by their
sketches: under 5e-7 in sum; of more similar ones far fewer.

Cases: null text counts as empty; a text without words has an empty set and no links; fewer than
five words are one shingle; rows of one doc_id with different texts count as one document in links;
rows without doc_id have no links, no component and are kept; repeated rows are in one component; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.components import components
from cohortwise.llm.textwork import distinct_shingles, mix, settle, slices, text_buffer, text_rows

BANDS = 40
ROWS = 4
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
TOP = 65534
MARGIN = 0.20
BLOCK = 512

_SALTS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ODD = mix(_SALTS) | np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets of shingle hashes (sets x REGISTERS, 16 bits)."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((len(sets), REGISTERS), dtype=np.uint64)
    for k in range(REGISTERS):
        least[:, k] = np.minimum.reduceat((values ^ _SALTS[k]) * _ODD[k], starts)
    # the least of uniform values gives the least of exponential ones, as the map is monotone
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows) of sets with known sizes, by maximum likelihood.

    Given the sizes, the numbers of registers that are larger on one side, on the other, or equal
    have known probabilities for each similarity; the most likely of 100 steps is taken.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]
    part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = part(u - v * j), part(v - u * j)
    tiny = 1e-12
    score = more[:, None] * np.log(p + tiny) + less[:, None] * np.log(q + tiny)
    score += (a.shape[1] - more - less)[:, None] * np.log(np.maximum(1 - p - q, 0) + tiny)
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit mark, and registers (null for an empty set)."""
    names = ["doc_id", "n_shingles", "mark", "mark2", "registers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            sets = distinct_shingles(*text_buffer(part.column("text")))
            full = [s for s in sets if len(s)]
            made = iter(registers(full)) if full else iter(())
            blobs = [next(made).tobytes() if len(s) else None for s in sets]
            marks = [[int(mix(s + np.uint64(k)).sum().astype(np.int64)) for s in sets] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(m, pa.int64()) for m in marks],
                    pa.array(blobs, pa.binary()),
                ],
                names,
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_shingles long, mark long, mark2 long, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), REGISTERS)


def _bands(nodes: DataFrame) -> DataFrame:
    """One row for each class and band: bucket and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                r = _matrix(part.column("registers")).astype(np.uint64).reshape(-1, BANDS, ROWS)
                key = _BAND[None, :]
                for k in range(ROWS):
                    key = mix(key ^ (r[:, :, k] + np.uint64(k << 20)))
                node = np.repeat(part.column("node").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node, pa.int64())], ["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "bucket long, node long")


def _close_enough(percent: int):
    """Whether a pair of sketches may reach the threshold; sizes alone can rule it out."""
    floor = percent / 100 - MARGIN

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), REGISTERS) for s in (a, b))
        return pd.Series(estimate(x, y, n_a.to_numpy(float), n_b.to_numpy(float)) >= floor)

    return close


def _sizes_fit(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts of the documents that pairs name."""
    wanted = settle(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "wanted")
    rows = text_rows(docs)
    found = rows.join(wanted, rows["doc_id"] == wanted["node"]).select("node", "text", F.xxhash64("text").alias("copy"))
    return settle(found.dropDuplicates(["node", "copy"]).select("node", "text"), "texts")


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return False
    shared = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets reach the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a = distinct_shingles(*text_buffer(part.column("text_a")))
                coded = part.column("text_b").dictionary_encode()
                b = distinct_shingles(*text_buffer(coded.dictionary))
                keep = [similar(s, b[k], percent) for s, k in zip(a, coded.indices.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _near(
    table: pa.Table, root: np.ndarray, percent: int, known: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a group those after it whose sketches may reach the threshold, and the estimates.

    Members of one component (``root``) and, in a group of two blocks, of one block are left out. Components
    that the caller joins in ``root`` meanwhile do not come up again, nor do pairs of two ``known`` members.
    """
    floor = percent / 100 - MARGIN
    r = _matrix(table.column("registers").combine_chunks())
    n, mine, low, high = (table.column(c).to_numpy() for c in ("n", "own", "low", "high"))
    for i in range(len(n) - 1):
        rest = np.arange(i + 1, len(n))
        apart = (root[rest] != root[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
        if low[0] != high[0]:
            apart &= mine[rest] != mine[i]  # pairs inside one block belong to that block's own group
        if known is not None and known[i]:
            apart &= ~known[rest]
        rest = rest[apart]
        # the share of equal registers, quick to count, is near the estimate: it goes first
        rest = rest[(r[rest] == r[i]).mean(axis=1) >= floor - 0.05]
        if len(rest):
            one = np.repeat(r[i : i + 1], len(rest), axis=0)
            near = estimate(one, r[rest], np.full(len(rest), float(n[i])), n[rest].astype(float))
            yield i, rest[near >= floor], near[near >= floor]


def _links_across(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between components within a bucket: enough of them to join all components that a link joins.

    ``rows``: bucket, node, root, n and registers. A bucket of many members is cut into blocks of about
    BLOCK, and each pair of blocks is one group. Sketches alone go to all groups, and tell which members
    of a group may have a link; texts go to the groups for those members, and the sets are
    verified there and then, so that only links leave a group.
    """

    def candidates(table: pa.Table) -> pa.Table:
        marked = np.zeros(len(table), dtype=bool)
        for i, near, _ in _near(table, table.column("root").to_numpy(), percent, marked):
            marked[i] |= len(near) > 0
            marked[near] = True
        return table.select(["bucket", "low", "high", "node"]).filter(pa.array(marked))

    def run(table: pa.Table) -> pa.Table:
        sets = distinct_shingles(*text_buffer(table.column("text").combine_chunks()))
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy().copy()
        links: list[tuple[int, int]] = []
        for i, rest, near in _near(table, root, percent):
            for k in rest[np.argsort(-near, kind="stable")].tolist():
                if root[k] != root[i] and similar(sets[i], sets[k], percent):
                    links.append((int(node[i]), int(node[k])))
                    root[root == root[k]] = root[i]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    kind = rows.schema["bucket"].dataType.simpleString()
    some = spread.groupBy("bucket", "low", "high").applyInArrow(candidates, f"bucket {kind}, low int, high int, node long")
    some = settle(some, "some")
    texts = _texts(docs, some.select(F.col("node").alias("a"), F.col("node").alias("b")))
    whole = some.join(placed, ["bucket", "node"]).join(texts, "node")
    return whole.groupBy("bucket", "low", "high").applyInArrow(run, "a long, b long").distinct()


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bucket, node, root) of buckets with several components; of equal buckets only one."""
    tied = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    buckets = tied.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("content")
    )
    mixed = buckets.where("low < high").groupBy("size", "content", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket")
    return tied.join(mixed, "bucket").select("bucket", "node", "root")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Components of documents linked by 100 * shared >= percent * union.

    Returns doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable, itself
    included) and kept (doc_id = component_id), one row for each row of ``docs``.
    """
    sketched = settle(_sketched(docs), "sketches")
    has_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    nodes = settle(
        sketched.where(has_set)
        .groupBy("mark", "mark2")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")),
        "classes",
    )
    bands = _bands(nodes).repartition("bucket")  # read by the two branches below
    hubs = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    members = settle(bands.join(hubs, "bucket").select("bucket", "node", "hub"), "members")

    sketch = nodes.select("node", "n", "registers")
    left, right = sketch.toDF("a", "n_a", "r_a"), sketch.toDF("b", "n_b", "r_b")
    # each class goes to the hubs with which it shares most bands
    shared = members.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("bands"))
    best = shared.groupBy("node").agg(F.max_by("hub", F.struct("bands", -F.col("hub"))).alias("most"), F.min("hub").alias("least"))
    hub_pairs = best.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("most", "least"))).alias("b"))
    near = hub_pairs.join(left, "a").join(right, "b").where(_sizes_fit(percent))
    pairs = settle(near.where(_close_enough(percent)("r_a", "r_b", "n_a", "n_b")).select("a", "b"), "pairs")
    links = settle(_verified(pairs, _texts(docs, pairs), percent), "verified")

    roots = components(links)
    mixed = settle(_mixed(members, roots), "mixed")
    if not mixed.isEmpty():
        more = settle(_links_across(mixed.join(sketch, "node"), docs, percent), "verified")
        if not more.isEmpty():
            roots = components(links.unionAll(more))

    classes = nodes.select("mark", "mark2", "node").join(roots, "node", "left")
    labelled = classes.select("mark", "mark2", F.coalesce("root", "node").alias("root"))
    out = sketched.select("doc_id", "n_shingles", "mark", "mark2").join(labelled, ["mark", "mark2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
