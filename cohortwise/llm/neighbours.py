"""Operator 12: approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected on ``DIMENSIONS`` normal directions. The squared projected distance of two
vectors, divided by their squared distance, follows a chi-square law with as many degrees of freedom. So
candidates are taken in the order of their projected distance and verified on the original vectors,
until the law says that a vector nearer than the k-th best so far would have come up already with a
chance of ``assurance``: a true neighbour is found with at least that chance.

On the cluster, a kd-tree of projections cuts the space into cells, and cells of many rows into parts by
a hash of the id, which splits copies of one vector too. A query first visits one part of its own cell;
its k-th distance there bounds the projected distance at which it can stop, and so the cells that it
visits next. Each part has its own kd-tree, walked nearest box first. Only the layout of the cells is
fitted on a sample (``SAMPLE`` rows with the smallest hashes of their ids); every row is in the index.

Cases: null ids and vectors that are null, empty, zero or hold null or non-finite components take no
part; of several lengths the one that most rows have (the longest, if tied) counts, others take no part.
Rows that share an id are candidates of their own, but never of a query with that id; a query that is
there several times takes its smallest vector (in array order). With fewer than k candidates all are
found. Empty tables give an empty table, other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.textwork import bound_batches, settle

DIMENSIONS = 8
SAMPLE = 20_000
CELL_ROWS = 8192
MOST_CELLS = 1024
PART_BYTES = 32 << 20
LEAF_ROWS = 64
VERIFIED = 512
SLACK = 1e-9


def chi_square_share(x: float, degrees: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_share(high, degrees) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, degrees) < share else (low, middle)
    return high


def directions(size: int) -> np.ndarray:
    """The fixed normal directions for vectors of a length, one per column."""
    return np.random.default_rng(size).standard_normal((size, DIMENSIONS))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An array column of equal lengths without nulls, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def box_distances(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    away = np.maximum(np.maximum(low - point, point - high), 0.0)
    return np.einsum("ij,ij->i", away, away)


@dataclass
class Cells:
    """The kd-tree that cuts the projected space: split dimension (or -1) and value, children, leaf number."""

    dimension: list[int]
    value: list[float]
    child: list[tuple[int, int]]
    leaf: list[int]

    @classmethod
    def fit(cls, points: np.ndarray, most: int) -> Cells:
        """Median cuts of the most crowded leaf along its widest side, until there are ``most`` leaves."""
        tree = cls([-1], [0.0], [(-1, -1)], [0])
        waiting = [(-len(points), 0, points)]
        leaves = 1
        while waiting and leaves < most:
            _, node, own = heapq.heappop(waiting)
            if len(own) < 2:
                break
            wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            cut = float(np.median(own[:, wide]))
            right = own[:, wide] > cut
            if not right.any():
                continue  # copies: no plane parts them
            at = len(tree.leaf)
            tree.dimension[node], tree.value[node], tree.child[node] = wide, cut, (at, at + 1)
            for side, part in ((0, own[~right]), (1, own[right])):
                tree.dimension.append(-1)
                tree.value.append(0.0)
                tree.child.append((-1, -1))
                tree.leaf.append(0)
                heapq.heappush(waiting, (-len(part), at + side, part))
            leaves += 1
        number = 0
        for node, wide in enumerate(tree.dimension):
            if wide < 0:
                tree.leaf[node] = number
                number += 1
        return tree

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), dtype=np.int32)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if self.dimension[node] < 0 or not len(rows):
                out[rows] = self.leaf[node]
                continue
            right = points[rows, self.dimension[node]] > self.value[node]
            stack += [(self.child[node][0], rows[~right]), (self.child[node][1], rows[right])]
        return out


class Part:
    """A kd-tree over the projections of some vectors, searched nearest box first.

    Of equal vectors only the k + 1 smallest ids, k rows of each, can be among the nearest k of a query
    that may hold one of the ids itself; the others are left out.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        vectors = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
        same = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)[1]
        order = np.lexsort([ids, same])
        ids, vectors, same = ids[order], vectors[order], same[order]
        new_vector = np.diff(same, prepend=-1) != 0
        new_id = new_vector | (np.diff(ids, prepend=0) != 0)
        numbered = np.cumsum(new_id)
        copy = np.arange(len(ids)) - np.flatnonzero(new_id)[numbered - 1]
        kept = (copy < k) & (numbered - numbered[new_vector][np.cumsum(new_vector) - 1] <= k)
        ids, vectors = ids[kept], vectors[kept]
        points = vectors @ directions(vectors.shape[1])
        low, high, child, span, order = [], [], [], [], []
        at, stack = 0, [(np.arange(len(ids)), None)]
        while stack:
            rows, above = stack.pop()
            node = len(low)
            if above is not None:
                child[above].append(node)
            own = points[rows]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            child.append([])
            span.append((0, 0))
            wide = int(np.argmax(high[-1] - low[-1]))
            if len(rows) <= LEAF_ROWS or high[-1][wide] == low[-1][wide]:
                span[node] = (at, at + len(rows))
                order.append(rows)
                at += len(rows)
                continue
            halves = np.argpartition(own[:, wide], len(rows) // 2)
            stack += [(rows[halves[: len(rows) // 2]], node), (rows[halves[len(rows) // 2 :]], node)]
        rows = np.concatenate(order)
        self.ids, self.vectors, self.points = ids[rows], vectors[rows], points[rows]
        self.low, self.high, self.child, self.span = np.array(low), np.array(high), child, span

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, factor: float, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest k, as far as found, nearest first.

        ``kth`` is a known bound of the k-th distance. Candidates are verified in the order of their
        projected distance; the walk stops when the next is beyond ``factor`` times the squared k-th
        distance, which is the chi-square test.
        """
        slack = SLACK * (1.0 + float(point @ point))
        bounds = box_distances(self.low, self.high, point).tolist()
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        limit = factor * kth * kth + slack
        heap, waiting, held, enough = [(bounds[0], 0)], [], 0, VERIFIED
        while heap or held:
            ahead = heap[0][0] if heap else np.inf
            if heap and ahead <= limit:
                node = heapq.heappop(heap)[1]
                if self.child[node]:
                    for x in self.child[node]:
                        if bounds[x] <= limit:
                            heapq.heappush(heap, (bounds[x], x))
                    continue
                begin, end = self.span[node]
                away = self.points[begin:end] - point
                waiting.append((np.einsum("ij,ij->i", away, away), np.arange(begin, end)))
                held += end - begin
                if held < enough and heap:
                    continue
                ahead = heap[0][0] if heap else np.inf
            elif not held:
                break
            # everything nearer than the next box has come up by now
            near, rows = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(near, kind="stable")
            near, rows = near[order], rows[order]
            due = int(np.searchsorted(near, min(ahead, limit), side="right"))
            for at in range(0, due, VERIFIED):
                if near[at] > limit:
                    break
                some = rows[at : min(at + VERIFIED, due)]
                some = some[self.ids[some] != own]
                away = self.vectors[some] - vector
                found = np.einsum("ij,ij->i", away, away)
                best_ids, best = np.concatenate([best_ids, self.ids[some]]), np.concatenate([best, found])
                if len(best) > k:
                    front = np.flatnonzero(best <= np.partition(best, k - 1)[k - 1])
                    front = front[np.lexsort([best_ids[front], best[front]])[:k]]
                    best_ids, best = best_ids[front], best[front]
                if len(best) >= k:
                    limit = min(limit, factor * float(best.max()) + slack)
            left = slice(due, int(np.searchsorted(near, limit, side="right")))
            waiting, held = [(near[left], rows[left])], max(0, left.stop - left.start)
            enough = held + VERIFIED  # what is not due yet is not looked at again for each leaf
            if ahead > limit and not held:
                break
        order = np.lexsort([best_ids, best])
        return best_ids[order], np.sqrt(best[order])


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """``id`` (long) and ``vector`` of the rows that take part, of any length."""
    at = F.col(vector)
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    sound = F.forall(at, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    sound &= F.exists(at, lambda x: x != 0) & F.col(key).isNotNull()
    return vectors.where(sound).select(F.col(key).cast("long").alias("id"), at.cast(kind).alias("vector"))


def _cells(rows: DataFrame, size: int, total: int) -> Cells:
    """The cells, fitted on at most ``SAMPLE`` rows."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1), size) @ directions(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(points), pa.list_(pa.float64()))], ["mark", "point"])

    # marks are spread evenly, so about two samples pass the filter; the smallest make the sample
    share = F.pmod(F.col("mark"), F.lit(1 << 40)) < min(1 << 40, (2 * SAMPLE << 40) // total + 1)
    marked = rows.select(F.xxhash64("id").alias("mark"), "vector").where(share)
    chosen = marked.mapInArrow(project, "mark long, point array<double>").orderBy("mark").limit(SAMPLE)
    points = np.array([r["point"] for r in chosen.collect()])
    return Cells.fit(points, max(1, min(MOST_CELLS, total // CELL_ROWS)))


def _boxes(index: DataFrame, size: int) -> list:
    """Rows and bounds of each cell's projections, at most ``MOST_CELLS``: cell, n, low and high values."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, points = batch.column(0).to_numpy(), matrix(batch.column(1), size) @ directions(size)
            for c in np.unique(cell).tolist():
                own = points[cell == c]
                n, low, high = made.get(c, (0, own[0], own[0]))
                made[c] = [n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))]
        if made:
            n, low, high = zip(*made.values(), strict=True)
            columns = [pa.array(made, pa.int32()), pa.array(n, pa.int64()), pa.array([*map(list, low)]), pa.array([*map(list, high)])]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "low", "high"])

    each = index.select("cell", "vector").mapInArrow(bounds, "cell int, n long, low array<double>, high array<double>")
    low = [F.min(F.col("low")[i]) for i in range(DIMENSIONS)]
    high = [F.max(F.col("high")[i]) for i in range(DIMENSIONS)]
    return each.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*low).alias("low"), F.array(*high).alias("high")).collect()


def _visit(points: DataFrame, visits: DataFrame, size: int, k: int, factor: float) -> DataFrame:
    """What each visit of a query to a part finds: query, id, score; at most k rows a visit.

    A part's points come before its queries, which stream past them, so memory is bounded by a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tree = None, [], None
        for batch in batches:
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows] if batch.num_rows else []
            for low, high in zip(bounds, bounds[1:], strict=False):
                ids = batch.column("id").to_numpy()[low:high]
                vectors = matrix(batch.column("vector").slice(low, high - low), size)
                if part[low] != at:
                    at, parts, tree = part[low], [], None
                if kind[low] == 0:
                    parts.append((ids, vectors))
                    continue
                if parts:
                    tree = Part(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
                    parts = []
                if tree is None:
                    continue
                kth = batch.column("kth").to_numpy()[low:high]
                projected = vectors @ directions(size)
                found = [tree.search(int(i), v, p, k, factor, float(b)) for i, v, p, b in zip(ids, vectors, projected, kth, strict=True)]
                n = [len(x) for x, _ in found]
                columns = [np.repeat(ids, n), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["query", "id", "score"])

    laid = points.select("part", F.lit(0).alias("kind"), "id", "vector", F.lit(0.0).alias("kth"))
    both = laid.unionByName(visits.select("part", F.lit(1).alias("kind"), "id", "vector", "kth"))
    return both.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, "query long, id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "vec_id", assurance: float = 0.99
) -> DataFrame:
    """The k nearest rows of ``vectors`` to each of ``queries``, by Euclidean distance.

    Both tables have ``key`` and ``vector``. Returns query_id (long), rank (int, from 1), vec_id (long) and
    score (the distance, in double precision on the original vectors), ties to the smaller id. A true
    neighbour is missed with a chance of at most 1 - ``assurance``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vector, key)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    size, total = sizes[0]
    of_size = F.size("vector") == size
    rows = rows.where(of_size)
    cells = _cells(rows, size, total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.place(matrix(batch.column(1), size) @ directions(size))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["cell", "id", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    shape = f"cell int, id long, vector {kind}"
    index = settle(rows.mapInArrow(place, shape), "vectors")
    boxes = sorted(_boxes(index, size), key=lambda r: r["cell"])
    most = max(1, PART_BYTES // (8 * size))
    parts = [0] * (max(cells.leaf) + 1)
    for r in boxes:
        parts[r["cell"]] = -(-r["n"] // most)
    first = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
    # number of a row's part: its cell's first part and a hash of its id
    many, begin = (F.get(F.lit(x), F.col("cell")) for x in ([max(1, p) for p in parts], first.tolist()))
    part: Column = (begin + F.pmod(F.xxhash64("id"), many.cast("long"))).cast("long")
    points = index.withColumn("part", part)

    asked = usable(queries, vector, key).where(of_size).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = settle(asked.mapInArrow(place, shape), "queries")
    factor = chi_square_quantile(assurance, DIMENSIONS)
    at_home = _visit(points, asked.withColumn("part", part).withColumn("kth", F.lit(float("inf"))), size, k, factor)
    known = at_home.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("kth"))
    bounded = asked.join(known, "id", "left").select("id", "vector", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    numbers = np.array([r["cell"] for r in boxes])
    low, high = (np.array([r[c] for r in boxes]) for c in ("low", "high"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projected, wanted = matrix(batch.column(1), size) @ directions(size), []
            for p, kth in zip(projected, batch.column(2).to_numpy(), strict=True):
                near = numbers[box_distances(low, high, p) <= factor * kth * kth + SLACK * (1.0 + float(p @ p))]
                wanted.append(np.concatenate([np.arange(first[c], first[c + 1]) for c in near] or [first[:0]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wanted, pa.list_(pa.int64()))], ["id", "vector", "kth", "parts"])

    visits = bounded.mapInArrow(spread, f"id long, vector {kind}, kth double, parts array<long>")
    found = _visit(points, visits.select(F.explode("parts").alias("part"), "id", "vector", "kth"), size, k, factor)
    order = Window.partitionBy("query").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
