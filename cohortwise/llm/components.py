"""Connected components of a table of links.

Each round contracts the links of a task to stars (union-find over at most about LOCAL_LINKS links),
then takes alternating star steps over all of them. Links that fit one task need no step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.textwork import settle

LOCAL_LINKS = 250_000


def _large_star(links: DataFrame) -> DataFrame:
    """Ties each node's larger neighbours to the smallest node near it."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them. ``links`` have b < a."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select("a", F.col("least").alias("b")))


def _contracted(links: DataFrame) -> DataFrame:
    """Each task's links as stars: every node tied to the smallest it reaches within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.get(top, top)) != top:
                top = up
            while x != top:  # shorten the path
                root[x], x = top, root.get(x, x)
            return top

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                root.setdefault(a, a)
                root.setdefault(b, b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one root and no root has one of its own."""
    sides = links.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("root")).unionAll(
        links.select("b", F.lit(0), F.lit(1))
    )
    return sides.groupBy("node").agg(F.sum("tied").alias("ties"), F.max("root").alias("root")).where("ties + root > 1").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each linked node.

    Args: ``links`` with long columns a and b. Returns node and root; the smallest node of a
    component is not listed. Links are pre-aggregated by node, so that a node with very many links
    costs one row in each task. Each round is settled in the shared folder.
    """
    now = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        parts = -(-now.count() // LOCAL_LINKS) or 1
        now = settle(_contracted(now.coalesce(parts)), "links")
        if parts == 1 or _are_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = settle(_small_star(_large_star(now).distinct()).distinct(), "links")
    raise RuntimeError("components did not settle")
