"""Operator 12 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from cohortwise.llm import neighbours, queries

NAN, INF = float("nan"), float("inf")


def plain(rows, asked, k):
    """Exact neighbours: {query id: [(id, distance)]}."""
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    lengths = [len(v) for _, v in usable]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    usable = [(i, v) for i, v in usable if len(v) == size]
    out = {}
    for q in asked:
        own = [v for i, v in usable if i == q]
        if own:
            near = sorted((float(np.sqrt(((v - min(own, key=tuple)) ** 2).sum())), i) for i, v in usable if i != q)
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, exact):
    assert found.keys() == exact.keys()
    hit = sum(len({i for i, _ in found[q]} & {i for i, _ in exact[q]}) for q in exact)
    return hit / sum(map(len, exact.values()))


def rows_of(df):
    return [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = rows_of(vectors)
    found = got(queries.QUERIES["op12_nearest"](spark, f"/root/testdata/{sf}"))
    exact = plain(rows, sorted(i for i, _ in rows if i % 100 == 0), 10)
    assert recall(found, exact) >= 0.97
    known = dict(rows)
    for q, near in found.items():
        assert len(near) == 10 and near == sorted(near, key=lambda x: (x[1], x[0]))
        for i, d in near:
            assert abs(d - np.sqrt(((np.array(known[i]) - np.array(known[q])) ** 2).sum())) < 1e-12


def test_cells_parts_and_copies(spark, monkeypatch):
    """Many cells, cells of several parts, a third of the rows one vector, ties to the smaller id."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    monkeypatch.setattr(neighbours, "PART_BYTES", 64 * 8 * 6)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 6))
    rows = [(i, (centres[i % 20] + rng.normal(scale=0.1, size=6)).tolist()) for i in range(1000)]
    rows += [(5000 + i, [1.0] * 6) for i in range(500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [0, 7, 500, 999, 5000, 5003, 5499]
    found = got(neighbours.nearest(vectors, vectors.where(f"vec_id in ({','.join(map(str, asked))})"), k=5))
    exact = plain(rows, asked, 5)
    assert recall(found, exact) >= 0.97
    for q in (5000, 5003, 5499):
        assert found[q] == exact[q]


def test_the_stop(monkeypatch):
    """A walk without a known bound finds what its chance promises, and the walk is in order."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(4000, 16))
    tree = neighbours.Part(np.arange(4000), vectors, 10)
    assert sorted(tree.ids.tolist()) == list(range(4000))
    hits = 0
    for q in range(0, 400, 10):
        ids, scores = tree.search(q, vectors[q], vectors[q] @ neighbours.directions(16), 10, neighbours.chi_square_quantile(0.9, 8), np.inf)
        exact = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        near = np.argsort(exact, kind="stable")[1:11]
        hits += len(set(near.tolist()) & set(ids.tolist()))
        assert np.allclose(exact[ids], scores, atol=1e-12)
    assert hits >= 0.9 * 400


def test_chi_square():
    # fixed values: 95 % points of the chi-square law
    for degrees, point in ((2, 5.991), (4, 9.488), (8, 15.507), (10, 18.307)):
        assert abs(neighbours.chi_square_quantile(0.95, degrees) - point) < 1e-3


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (200, [0.0, 0.0]), (300, [None, 1.0]), (400, [NAN, 1.0]), (500, [INF, 1.0]), (600, []),
            (None, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 4.0]), (700, [5.0, 5.0]), (700, [4.0, 4.0]), (800, [1.0, 2.0, 3.0]),
            (-100, [-1.0, -0.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, part int, score int")
    found = got(neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0")))
    exact = plain(rows, [0, 700, -100], 10)
    assert found.keys() == exact.keys()
    for q in exact:
        assert [i for i, _ in found[q]] == [i for i, _ in exact[q]]
    none = vectors.limit(0)
    assert neighbours.nearest(none, none).count() == 0
    assert neighbours.nearest(vectors, none).count() == 0
    assert neighbours.nearest(none, vectors).count() == 0
