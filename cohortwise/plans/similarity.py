"""The rows most similar to a given one, by Euclidean distance over unscaled attributes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

QUERY_BLOCK = 512
ROW_BLOCK = 4096
PIVOTS = 4


def query_vs_candidates(
    df: DataFrame, features: Sequence[Column], id_column: str, query: Column, pool: Column, extra: Sequence[str] = ()
) -> DataFrame:
    """id, ``extra``, is_query and distance of every row of the pool, and of the query row itself.

    The query row enters as a scalar subquery: a constant to all tasks, without a join. When
    several rows satisfy ``query`` the one with the smallest id is used.
    """
    vector = F.array(*features)
    target = df.filter(query).agg(F.min_by(F.struct(F.col(id_column).alias("id"), vector.alias("f")), id_column)).scalar()
    rows = df.withColumns({"_q": target, "_f": vector})
    is_query = F.coalesce(F.col(id_column) == F.col("_q.id"), F.lit(False))
    terms = [f"power(_f[{i}] - _q.f[{i}], 2)" for i in range(len(features))]
    return rows.filter(pool | is_query).select(
        id_column, *extra, is_query.alias("is_query"), F.expr(f"sqrt({' + '.join(terms)})").alias("distance")
    )


def top_k_similar(
    df: DataFrame,
    features: Sequence[Column],
    id_column: str,
    name: str,
    query_name,
    pool: Column,
    k: int = 10,
    extra: Sequence[str] = (),
) -> DataFrame:
    """The query row (rank 0) and its ``k`` nearest rows among ``pool``, ties in id order.

    Rows that carry the query's own name are not candidates. A small pool gives what it has; an
    unknown name gives nothing.
    """
    query = F.col(name) == F.lit(query_name)
    near = query_vs_candidates(df, features, id_column, query, pool & (F.col(name) != F.lit(query_name)), extra)
    order = [F.desc("is_query"), F.asc("distance"), F.asc(id_column)]
    best = near.orderBy(*order).limit(k + 1)
    whole = Window.partitionBy(F.lit(0))  # the k + 1 rows just kept
    ranked = best.select(
        (F.row_number().over(whole.orderBy(*order)) - 1).alias("rank"),
        id_column, *extra, "distance",
        F.bool_or("is_query").over(whole).alias("_known"),
    )
    return ranked.filter("_known").drop("_known")


def top_k_similar_batch(
    df: DataFrame, vector: Column, id_column: str, query_ids: Sequence, pool: Column, k: int = 10
) -> DataFrame:
    """query_id, rank, id, distance for a list of query rows: each query row (rank 0) and its ``k`` nearest.

    The rules are those of ``top_k_similar``: ties in id order, the query's own id is no candidate, a
    small pool gives what it has, an unknown id nothing. Ids may be of any type that can be ordered.

    The pool is read once for all queries, whose vectors travel with the tasks: the caller's list is
    their bound (8 bytes a component). Each task keeps its ``k`` nearest rows per query and only those
    are shuffled; no pair table is made.
    """
    id_type = df.schema[id_column].dataType
    wanted = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(query_ids)], StructType([StructField("_id", id_type)]))
    queries = df.join(F.broadcast(wanted), F.col(id_column) == F.col("_id"), "left_semi").select(id_column, vector.cast("array<double>"))
    found = queries.dropDuplicates([id_column]).collect()  # at most one row for each listed id
    ids = [row[0] for row in found]
    search = _Nearest(ids, [row[1] for row in found], k)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = search.start()
        for batch in batches:
            if len(batch) and ids:
                task.add(batch["id"].to_numpy(), np.stack(batch["v"].to_numpy()).astype("float64"))
        yield task.result()

    rows = df.filter(pool).filter(F.col(id_column).isNotNull())
    schema = StructType([StructField("query_id", id_type), StructField("id", id_type), StructField("distance", DoubleType())])
    local = rows.select(F.col(id_column).alias("id"), vector.cast("array<double>").alias("v")).filter("v is not null")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = local.mapInPandas(nearest, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    itself = df.sparkSession.createDataFrame([(i, 0, i, 0.0) for i in ids], _with_rank(id_type, id_column))
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "distance").unionAll(itself)


class _Nearest:
    """The nearest rows to many queries, batch by batch.

    Queries are laid out by their distance to a pivot (the queries' mean) and taken in blocks. A row whose
    distance to a pivot differs from a query's by more than the query's k-th distance so far cannot be
    nearer; so each block looks at the rows between its bounds only, for each of ``PIVOTS`` pivots. For
    those, distances come from one matrix product; where its rounding leaves a doubt they are computed
    again, so results are exact.
    """

    def __init__(self, ids: Sequence, vectors: Sequence, k: int):
        self.k, known = k, [v if v is not None else [] for v in vectors]
        points = np.array(known, dtype="float64").reshape(len(known), -1)
        centre = points.mean(axis=0) if len(points) else points.sum(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        order = np.argsort(away, kind="stable")
        self.ids, self.points = np.array([*ids, None], dtype=object)[:-1][order], points[order]
        picked = np.linspace(0, len(points) - 1, PIVOTS - 1).astype(int) if len(points) else []
        self.pivots = np.concatenate([centre[None], self.points[picked]]) if len(points) else points

    def start(self) -> _Nearest:
        """An empty search for one task."""
        task = copy(self)
        task.squares = (self.points**2).sum(axis=1)
        task.to_pivots = np.sqrt(((self.points[:, None] - self.pivots) ** 2).sum(axis=2)) if len(self.points) else None
        task.kth = np.full(len(self.points), np.inf)
        task.best = [pd.DataFrame({"q": [], "id": [], "distance": []}) for _ in range(0, len(self.points), QUERY_BLOCK)]
        return task

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        far = np.sqrt(np.stack([((rows - p) ** 2).sum(axis=1) for p in self.pivots], axis=1))
        squares = (rows**2).sum(axis=1)
        for block, at in enumerate(range(0, len(self.points), QUERY_BLOCK)):
            own = slice(at, at + QUERY_BLOCK)
            kth, near = self.kth[own, None], self.to_pivots[own]
            slack = 1e-9 * (1 + self.to_pivots[own].max() + far.max())
            low, high = (near - kth).min(axis=0) - slack, (near + kth).max(axis=0) + slack
            some = np.flatnonzero(((far >= low) & (far <= high)).all(axis=1))
            for start in range(0, len(some), ROW_BLOCK):
                part = some[start : start + ROW_BLOCK]
                self._take(block, own, ids[part], rows[part], squares[part])

    def _take(self, block: int, own: slice, ids: np.ndarray, rows: np.ndarray, squares: np.ndarray) -> None:
        queries, lengths = self.points[own], self.squares[own]
        about = lengths[:, None] + squares - 2 * (queries @ rows.T)
        doubt = 1e-9 * (1 + lengths[:, None] + squares.max())  # far above the rounding of the product
        most = (self.kth[own, None]) ** 2 + doubt
        if len(ids) > self.k + 1:  # one row more, as the query itself may be among them
            most = np.minimum(most, np.partition(about, self.k, axis=1)[:, self.k, None] + 2 * doubt)
        q, r = np.nonzero(about <= most)
        distance = np.concatenate(
            [np.sqrt(((rows[r[i : i + ROW_BLOCK]] - queries[q[i : i + ROW_BLOCK]]) ** 2).sum(axis=1)) for i in range(0, len(q), ROW_BLOCK)] or [squares[:0]]
        )
        other = ids[r] != self.ids[own][q]
        more = pd.DataFrame({"q": q[other], "id": ids[r][other], "distance": distance[other]})
        both = pd.concat([self.best[block], more]) if len(self.best[block]) else more
        kept = both.sort_values(["q", "distance", "id"]).groupby("q").head(self.k)
        self.best[block] = kept
        full = kept.groupby("q")["distance"].agg(["size", "max"])
        full = full[full["size"] >= self.k]
        self.kth[own.start + full.index.to_numpy(dtype=int)] = full["max"].to_numpy()

    def result(self) -> pd.DataFrame:
        parts = [b.assign(query_id=self.ids[b["q"].to_numpy(dtype=int) + k * QUERY_BLOCK]) for k, b in enumerate(self.best)]
        whole = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "id": [], "distance": []})
        return whole[["query_id", "id", "distance"]]


def _with_rank(id_type: DataType, id_column: str) -> StructType:
    fields = [("query_id", id_type), ("rank", IntegerType()), (id_column, id_type), ("distance", DoubleType())]
    return StructType([StructField(name, kind) for name, kind in fields])
