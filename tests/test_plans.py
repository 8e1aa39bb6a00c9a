from __future__ import annotations

import datetime
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise import session
from cohortwise.operators import aggregates, relational
from cohortwise.plans import charts, curves, selection, similarity, stability, structural, universe

# --- universe --------------------------------------------------------------------------------


# The counts of a published credit sample.
def test_shares_of_a_credit_sample(spark):
    counts = {("train", 0): 12578, ("test", 0): 5476, ("train", 1): 1375, ("test", 1): 571}
    parts = [
        spark.range(n).select(F.lit(s).alias("sample"), F.lit(t).alias("target"), F.lit(1).alias("segment"))
        for (s, t), n in counts.items()
    ]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    shares = {(r.sample, r.target): r.proportion for r in universe.distribution(df, ["sample", "target"]).collect()}
    assert shares == {("train", 0): 0.6289, ("test", 0): 0.2738, ("train", 1): 0.06875, ("test", 1): 0.02855}
    report = universe.distribution_report(df, "segment", "sample", "target").filter("view = 'sample_target'")
    assert {(r.sample, r.target): r.proportion for r in report.collect()} == shares


def test_distribution_report_keeps_null_keys_apart_from_totals(spark):
    df = spark.createDataFrame([(None, "a", 0), (None, "b", 1), (1, "a", 1)], "segment int, sample string, target int")
    report = universe.distribution_report(df, "segment", "sample", "target")
    rows = {(r.view, r.segment, r.sample, r.target): r["count"] for r in report.collect()}
    assert rows[("segment", None, None, None)] == 2 and rows[("sample", None, "a", None)] == 2
    assert len(rows) == 2 + 2 + 3 + 2 + 3


def test_default_rate_counts_known_keys_only(spark):
    df = spark.createDataFrame([(201501, 1), (201501, 0), (None, 1)], "cohort int, target int")
    rows = {r.cohort: (r.total, r.bads, r.goods, r.tm) for r in universe.default_rate_by_cohort(df, "cohort", "target").collect()}
    assert rows == {201501: (2, 1, 1, 0.5), None: (0, 1, -1, None)}


# --- stability -------------------------------------------------------------------------------


def brute_index(x, y, n):
    """Stability index by its definition, with quantile cuts of x."""
    ordered = sorted(x)
    cuts = sorted({ordered[max(1, math.ceil(round(i / n, 2) * len(x) - 1e-9)) - 1] for i in range(1, n)})
    bucket = lambda v: sum(v >= c for c in cuts)
    rows = {}
    for b in sorted({bucket(v) for v in x}):
        fx, fy = sum(bucket(v) == b for v in x), sum(bucket(v) == b for v in y)
        px, py = round(fx / len(x), 3), round(fy / len(y), 3) if y else 0
        rows[b] = (fx, px, fy or None, py if fy else None, (px - py) * math.log(px / py) if px and py else None)
    return rows


def test_stability_against_brute_force_with_edge_cases(spark):
    x = [float(i % 13) for i in range(200)]
    y = [float(i % 7) for i in range(150)]
    sentinel = -99999999.0
    rows = [("x", v, sentinel, 4.0, v if v > 6 else None) for v in x]
    rows += [("y", v, 1.0, 4.0, sentinel) for v in y]
    rows += [("x", sentinel, sentinel, 4.0, sentinel)] * 5
    df = spark.createDataFrame(rows, "s string, v double, gone double, flat double, mixed double")
    specials = {"v": [sentinel], "gone": [sentinel], "mixed": [sentinel]}
    buckets, cuts = stability.stability_index(df, ["v", "gone", "flat", "mixed"], "s", 5, specials)
    found = {}
    for r in buckets.collect():
        found.setdefault(r.variable, {})[r.bucket] = (r.frequency_x, r.proportion_x, r.frequency_y, r.proportion_y, r.ie)
    expected = brute_index(x, y, 5)
    assert found["v"].keys() == expected.keys()
    for b, row in expected.items():
        assert found["v"][b] == pytest.approx(row, nan_ok=True) if None not in row else found["v"][b] == row
    assert "gone" not in found  # X holds special values only
    assert found["flat"] == {1: (205, 1.0, 150, 1.0, 0.0)}  # one cut, everything reaches it
    assert all(row[2] is None and row[4] is None for row in found["mixed"].values())  # Y is empty
    summary = {r.variable: (r.ie, r.band) for r in stability.stability_summary(buckets).collect()}
    assert summary["v"][0] == pytest.approx(sum(r[4] or 0 for r in expected.values()))
    assert summary["flat"] == (0.0, "no difference") and summary["mixed"] == (None, None)
    assert {r.variable for r in cuts.collect()} == {"v", "flat", "mixed"}


def test_stability_bands(spark):
    df = spark.createDataFrame([("a", 0.05), ("b", 0.1), ("c", 0.25), ("d", 0.3)], "variable string, ie double")
    bands = {r.variable: r.band for r in stability.stability_summary(df).collect()}
    assert bands == {"a": "no difference", "b": "some difference", "c": "some difference", "d": "significant difference"}


def test_stability_needs_two_labels(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "s string, v double")
    with pytest.raises(ValueError):
        stability.stability_index(df, ["v"], "s", 5)


def test_psi_buckets_special_values_and_rounds(spark):
    base = [(201501, float(i), 1.0) for i in range(829)]
    later = [(201502, float(i * 2), 1.0) for i in range(100)] + [(201502, -99999999.0, 1.0)] * 10
    other = [(201412, 5.0, 1.0), (201502, None, 1.0), (201502, 1.0, None)]
    df = spark.createDataFrame(base + later + other, "cohort int, v double, w double")
    table = stability.psi_table(df, ["v", "w"], "cohort", 5, 201501, {"v": [-99999999]})
    rows = {(r.cohort, r.variable, r.bucket): (r.freq, r.total, r.proportion) for r in table.collect()}
    assert rows[(201501, "v", 0)] == (165, 829, 0.19903)
    assert rows[(201501, "v", 1)] == (166, 829, 0.20024)
    assert rows[(201502, "v", 0)][1] == 110 and rows[(201502, "v", 0)][0] == 83 + 10
    assert min(c for c, _, _ in rows) == 201501
    psi = {(r.variable, r.cohort): r.psi for r in stability.psi_by_cohort(table, "cohort", 201501).collect()}
    assert psi[("v", 201501)] == 0.0 and psi[("w", 201502)] == 0.0 and psi[("v", 201502)] > 0.25
    implicit = stability.psi_table(df.filter("cohort >= 201501"), ["v", "w"], "cohort", 5, None, {"v": [-99999999]})
    assert implicit.exceptAll(table).isEmpty() and table.exceptAll(implicit).isEmpty()


def _scans(df):
    """Scans that ran: the adaptive plan without the parts it dropped or reused."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return text.count("FileScan"), text


def test_scans_do_not_grow_with_the_variables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"),
        *[(F.col("id") * (i + 1) % 97).cast("double").alias(f"v{i}") for i in range(6)],
    ).write.parquet(path)
    df = spark.read.parquet(path)
    counts = []
    for n in (1, 6):
        buckets, _ = stability.stability_index(df, [f"v{i}" for i in range(n)], "s", 5, labels=("x", "y"))
        scans, text = _scans(buckets)
        counts.append(scans)
        assert "Python" not in text and "ArrowEval" not in text
    assert counts == [2, 2]  # brackets; cuts and buckets together


# --- chart tables ----------------------------------------------------------------------------


def test_information_value_of_a_known_split(spark):
    rows = [(1.0, 0)] * 40 + [(1.0, 1)] * 10 + [(2.0, 0)] * 20 + [(2.0, 1)] * 30
    df = spark.createDataFrame(rows, "v double, t int")
    iv = charts.information_value_by_percentile(df, ["v"], "t", 4).collect()
    found = {r.percentile: r.iv for r in iv}
    g, b = 40 / 60, 10 / 40
    expected = (g - b) * math.log(g / b) + ((1 - g) - (1 - b)) * math.log((1 - g) / (1 - b))
    assert found[0.75] == pytest.approx(expected)
    assert found[0.25] is None  # nothing lies left of the smallest value


def test_control_limits(spark):
    df = spark.createDataFrame([("v", 1.0), ("v", 3.0), ("w", 2.0)], "variable string, mean double")
    rows = {(r.variable, r.mean): (r.lower, r.upper) for r in charts.control_limits(df, "mean", below=10).collect()}
    assert rows[("v", 1.0)] == pytest.approx((2 - 10 * 2**0.5, 2 + 5 * 2**0.5))
    assert rows[("w", 2.0)] == (None, None)


def test_default_rate_by_quantile_ends_at_infinity(spark):
    df = spark.createDataFrame([(float(i), int(i >= 8)) for i in range(10)], "v double, t int")
    rows = {r.bucket: (r.total, r.bads, r.upper_cut) for r in charts.default_rate_by_quantile(df, ["v"], "t", 2).collect()}
    assert rows == {0: (4, 0, 4.0), 1: (6, 2, float("inf"))}


# --- selection -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    noise = lambda k: ((F.col("id") * k) % 1009) / 1009.0
    df = spark.range(4000).select(
        noise(37).alias("a"), (noise(37) * 2 + noise(541) * 0.1).alias("b"), noise(251).alias("c"),
        F.lit(3.0).alias("flat"), (noise(37) + noise(613) > 1.1).cast("int").alias("target"), F.lit("x").alias("text"),
    )
    return df.persist()


def test_candidates_leave_out_text_target_and_black_list(model):
    names = ["a", "b", "text", "target", "flat"]
    assert selection.candidates(model, names, "target", ["b"]) == ["a", "flat"]


def test_pairs_ginis_and_drop_list(model):
    names = ["a", "b", "c", "flat"]
    pairs = selection.correlated_pairs(model, names, 0.5)
    assert [(r.row, r.column) for r in pairs.collect()] == [("a", "b")]
    gini = selection.univariate_gini(model, names, "target", only=selection.pair_members(pairs))
    values = {r.variable: r.gini for r in gini.collect()}
    assert set(values) == {"a", "b"}
    weaker = "b" if values["a"] >= values["b"] else "a"
    assert [r.variable for r in selection.correlation_drop_list(pairs, gini).collect()] == [weaker]


def test_no_pairs_give_an_empty_drop_list(model):
    pairs = selection.correlated_pairs(model, ["a", "c"], 0.999)
    gini = selection.univariate_gini(model, ["a", "c"], "target", only=selection.pair_members(pairs))
    assert gini.isEmpty() and selection.correlation_drop_list(pairs, gini).isEmpty()


def test_one_column_has_no_pairs(model):
    assert aggregates.pearson_matrix(model, ["a"]).isEmpty()
    report = selection.select_features(model, ["a"], "target", lim_corr=0.5, lim_variab=10, lim_importance=1, num_trees=3)
    assert report["pairs"].isEmpty() and report["matrix"].first().low_importance == 1


@pytest.mark.parametrize("width", [7, 11, 12, 60])
def test_correlations_are_one_algorithm(spark, width):
    """Any number of columns: equal to a plain calculation, from one scan."""
    rng = np.random.default_rng(width)
    x = rng.normal(1e6, 1, (300, width))
    x[:, 1] = x[:, 0] + rng.normal(0, 0.1, 300)
    x[:, 2] = 5.0
    names = [f"v{i}" for i in range(width)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names)).repartition(5)
    table = aggregates.pearson_matrix(df, names)
    assert len(re.findall(r"\bScan ", table._jdf.queryExecution().executedPlan().toString())) == 1
    found = {(r.row, r.column): r.correlation for r in table.collect()}
    with np.errstate(all="ignore"):
        wanted = np.abs(np.corrcoef(x.T))
    assert len(found) == width * (width - 1) // 2
    for (a, b), value in found.items():
        i, j = names.index(a), names.index(b)
        assert i < j and (value is None if 2 in (i, j) else value == pytest.approx(wanted[i, j], abs=1e-6))
    strong = aggregates.pearson_matrix(df, names, 0.9).collect()
    assert [(r.row, r.column) for r in strong] == [("v0", "v1")]


def test_correlations_of_many_tasks_and_blocks(spark, monkeypatch):
    """2,000 tasks, blocks of unequal width: the same values, merged by slots and then together."""
    monkeypatch.setattr(aggregates, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(aggregates, "MERGE_SLOTS", 16)
    names = [f"v{i}" for i in range(10)]
    exprs = [f"1e6 + {i} * rand({i}) + id % {i + 2} as v{i}" for i in range(10)]
    df = spark.range(0, 6000, 1, 2000).selectExpr(*exprs)
    x = np.array([list(r) for r in df.collect()])
    found = aggregates.pearson_matrix(df, names).collect()
    wanted = np.abs(np.corrcoef(x.T))
    assert len(found) == 45
    for r in found:
        assert r.correlation == pytest.approx(wanted[names.index(r.row), names.index(r.column)], abs=1e-9)


def test_a_merge_holds_one_block():
    """Rows of any number of tasks pass through a merge one by one."""
    import tracemalloc

    size, side = 64, slice(0, 64)
    rng = np.random.default_rng(1)

    def parts(n):
        for _ in range(n):
            x = rng.normal(5, 1, (10, size))
            c = x - x.mean(axis=0)
            sides = np.concatenate([x.mean(axis=0)] * 2 + [(c * c).sum(axis=0)] * 2)
            yield aggregates._block_rows([(0, 0, 10, sides.tobytes(), (c.T @ c).tobytes())])

    peaks = []
    for n in (50, 3000):
        tracemalloc.start()
        count, sides, product = aggregates._merge_blocks(parts(n), side, side)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == 10 * n and np.allclose(np.diag(product), sides[2 * size : 3 * size])
    assert peaks[1] < peaks[0] + 20_000


def test_correlations_of_a_thousand_columns(spark):
    names = [f"v{i}" for i in range(1000)]
    df = spark.range(0, 90, 1, 3).selectExpr(*[f"cast(pmod(hash(id, {i}), 1000) as double) + id * {i % 3} as v{i}" for i in range(1000)])
    x = np.array([list(r) for r in df.collect()])
    strong = {(r.row, r.column): r.correlation for r in aggregates.pearson_matrix(df, names, 0.4).collect()}
    wanted = np.triu(np.abs(np.corrcoef(x.T)), 1)
    assert len(strong) == (wanted > 0.4).sum() > 0
    for (a, b), value in strong.items():
        assert value == pytest.approx(wanted[int(a[1:]), int(b[1:])], abs=1e-9)


@pytest.mark.parametrize("width", [11, 12])
def test_correlations_without_complete_rows(spark, width):
    names = [f"v{i}" for i in range(width)]
    rows = [tuple([None] + [float(i * k) for k in range(1, width)]) for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = aggregates.pearson_matrix(df, names).collect()
    assert len(found) == width * (width - 1) // 2 and all(r.correlation is None for r in found)
    assert aggregates.pearson_matrix(df.limit(0), names).count() == len(found)


def test_rank_gini_is_close_to_logistic(model):
    rank = {r.variable: r.gini for r in selection.univariate_gini(model, ["a", "b", "c"], "target").collect()}
    logistic = {r.variable: r.gini for r in selection.univariate_gini(model, ["a", "b", "c"], "target", method="logistic").collect()}
    assert all(rank[v] == pytest.approx(logistic[v], abs=1e-3) for v in rank)


def test_logistic_fits_are_those_of_spark_ml(spark, model, monkeypatch):
    """All fits share each read of the table; the number of reads does not grow with the variables."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rare = F.when(F.col("id") % 3 == 0, F.exp((F.col("id") * 7 % 101) / 12.0)).when(F.col("id") % 7 == 0, float("nan"))
    rows = model.select("a", (-F.col("b")).alias("b"), "c", "flat", F.col("target").cast("double").alias("label"), (F.col("a") * 4000).cast("int").alias("id"))
    rows = rows.withColumn("rare", rare).drop("id").persist()
    reads, sums = [], selection._logistic_sums
    monkeypatch.setattr(selection, "_logistic_sums", lambda table, fits: reads.append(len(fits)) or sums(table, fits))
    names = ["a", "b", "c", "flat", "rare"]
    found = selection._logistic_fits(rows, names)
    assert len(reads) <= selection.LOGISTIC_READS and reads[0] == 4
    for name in names:
        data = VectorAssembler(inputCols=[name], outputCol="features").transform(rows.select(name, "label").na.drop())
        fit = LogisticRegression(maxIter=100, tol=1e-12).fit(data)
        assert found[name] == pytest.approx((fit.intercept, fit.coefficients[0]), rel=1e-4, abs=1e-5)
    rows.unpersist()


def test_logistic_gini_of_odd_columns(spark):
    """Parted classes, one value, unknown values and labels, and a target of one class."""
    rows = [(float(i), -float(i), 1.0, None if i % 2 else float(i % 8), int(i >= 30)) for i in range(50)] + [(1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "up double, down double, flat double, some double, t int")
    names = ["up", "down", "flat", "some"]
    found = {r.variable: (round(r.gini, 9), r.direction) for r in selection.univariate_gini(df, names, "t", method="logistic").collect()}
    exact = {r.variable: round(r.gini, 9) for r in selection.univariate_gini(df, names, "t").collect()}
    assert found == {v: (exact[v], "d") for v in names} and found["up"][0] == found["down"][0] == 1 and found["flat"][0] == 0
    none = spark.createDataFrame([], "variable string")
    assert selection.univariate_gini(df, names, "t", only=none, method="logistic").isEmpty()
    one = selection.univariate_gini(df.filter("t = 1"), ["up"], "t", method="logistic").collect()
    assert [(r.gini, r.direction) for r in one] == [(1.0, "d")]
    for wrong in (df.withColumn("t", F.lit(2)), df.withColumn("up", F.lit(float("inf"))), df.withColumn("up", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="up"):
            selection.univariate_gini(wrong, ["up"], "t", method="logistic")


def test_variability_of_constant_and_unknown_columns(model):
    rows = {r.variable: r for r in selection.variability(model, ["a", "flat"], {"c": [1.0]}).collect()}
    assert rows["flat"].variability == 0.0 and rows["flat"].iqr == 0.0
    assert 45 < rows["a"].variability < 55
    sketch = {r.variable: r.variability for r in selection.variability(model, ["a"], accuracy=10000).collect()}
    assert sketch["a"] == pytest.approx(rows["a"].variability, abs=0.5)


def test_forest_importance_sums_to_one(model):
    rows = selection.forest_importance(model, ["a", "c", "flat"], "target", 5, 3, 1).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1) and rows[0].variable == "a"
    again = selection.forest_importance(model, ["a", "c", "flat"], "target", 5, 3, 1).collect()
    assert rows == again


def test_parts_of_a_working_table_grow_with_its_rows(spark, model, monkeypatch):
    rows, cores = model.select("a", "c"), spark.sparkContext.defaultParallelism
    for numbers, extra, parts in ((1 << 24, 0, cores), (400, 0, 20), (400, 3, 50), (401, 3, 50)):
        monkeypatch.setattr(selection, "PART_NUMBERS", numbers)
        with selection.working_table(rows, extra) as table:
            sizes = table.rdd.mapPartitions(lambda found: [sum(1 for _ in found)]).collect()
        assert len(sizes) == parts and sum(sizes) == 4000 and max(sizes) - min(sizes) <= 16
    first = selection.forest_importance(model, ["a", "c", "flat"], "target", 5, 3, 1).collect()
    assert sum(r.importance for r in first) == pytest.approx(1) and first[0].variable == "a"


def test_selection_matrix_counts_flags(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "variable string")
    lists = [spark.createDataFrame([(v,) for v in vs], "variable string") for vs in (["a", "b"], ["b"], [])]
    matrix = selection.selection_matrix(names, *lists)
    assert {r.variable: (r.correlation, r.variability, r.low_importance, r["count"]) for r in matrix.collect()} == {
        "a": (1, 0, 0, 1), "b": (1, 1, 0, 2), "c": (0, 0, 0, 0),
    }
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.95), ("b", "c", 0.8)], "row string, column string, correlation double")
    kept = selection.selection_matrix_filtered(matrix, pairs).collect()
    assert [(r.variable, r.correlation_with) for r in kept] == [("b", "c & a"), ("a", "c & b")]


def test_select_features_releases_its_table(spark, model):
    report = selection.select_features(
        model.select("*"), ["a", "b", "c", "flat", "text"], "target", lim_corr=0.5, lim_variab=10, lim_importance=1, num_trees=5, max_depth=3
    )
    flagged = {r.variable for r in report["matrix_filtered"].collect()}
    assert "flat" in flagged and flagged & {"a", "b"}
    assert report["pairs"].columns == ["row", "column", "correlation", "row_gini", "column_gini", "drop"]


def test_scratch_tables_go_with_their_owner(model, monkeypatch):
    """Nothing of a selection is left after its block, whether it ends well, fails inside or after."""
    names = ["a", "b", "c", "flat"]
    limits = {"lim_corr": 0.5, "lim_variab": 10, "lim_importance": 1, "num_trees": 2, "max_depth": 2}
    made, folder = [], session.scratch_dir
    monkeypatch.setattr(session, "scratch_dir", lambda spark, name: made.append(folder(spark, name)) or made[-1])
    left = lambda: [p for p in made if Path(p.removeprefix("file:")).exists()]
    with session.scratch_tables():
        report = selection.select_features(model, names, "target", **limits)
        assert report["pairs"].collect() and len(left()) == 3
    assert left() == []
    with pytest.raises(RuntimeError), session.scratch_tables():
        selection.select_features(model, names, "target", **limits)
        raise RuntimeError("after")
    assert left() == []
    with pytest.raises(Exception, match="(?i)maxdepth"):
        selection.select_features(model, names, "target", **limits | {"max_depth": 99})
    assert left() == []
    with session.scratch_tables():
        with session.scratch_tables(keep=True):
            session.scratch_table(model, "kept")
        assert len(left()) == 1
    assert left() == []


# --- curves and profiles ---------------------------------------------------------------------


# Worked out by hand: points, corrected points, whether one was raised (S), the last bound met (S upper, I lower).
CURVES = [
    ([0.1, 0.3, 0.2, 0.5], [0.1, 0.3, 0.3, 0.5], "S", None),  # the dip takes the point before it
    ([-3.0, -2.5, 0.5, 2.0, 1.0], [-3.0, -2.0, 0.5, 1.5, 1.5], "S", "S"),  # the first point is free of bounds
    ([1.9, 1.0, 0.2], [1.9, 1.5, 1.5], "S", "S"),  # raised to 1.9, held at 1.5, then raised to 1.5
    ([None, None, -1.0, 0.2], [None, None, -1.0, 0.2], "S", None),  # below an unknown point, nothing to raise it to
    ([0.4, None, None, 0.6], [0.4, 0.4, 0.4, 0.6], "S", None),
    ([-1.0, None, -0.5, None], [-1.0, None, -0.5, None], "S", None),  # -0.5 is below zero, which an unknown stands for
    ([None, -2.5, None, 1.6], [None, -2.0, None, 1.5], "S", "S"),
    ([0.5], [0.5], None, None),
]


@pytest.mark.parametrize("points, wanted, corrected, clamped", CURVES)
def test_curve_matches_its_rules(spark, points, wanted, corrected, clamped):
    df = spark.createDataFrame([(points,)], "curve array<double>")
    row = curves.monotone_clamped_curve(df).first()
    assert (row.curve, row.corrected, row.clamped) == (wanted, corrected, clamped)


def test_mean_curve_without_weight_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 2.0, 5.0), ("a", 3.0, None, 4.0, 1.0)], "k string, w1 double, w2 double, v1 double, v2 double")
    row = curves.weighted_mean_curve(df, ["w1", "w2"], ["v1", "v2"], ["k"]).first()
    assert row.curve == [1.5, None]


def test_weighted_std_of_single_rows_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1.0, 1), ("b", 1.0, 2.0, 1.0, 1), ("b", 3.0, 4.0, 1.0, 1)], "k string, w double, v double, m double, f int")
    rows = {r.k: r for r in aggregates.weighted_std(df, ["k"], ["w"], ["v"], ["m"], ["f"], error=True).collect()}
    assert rows["a"].std_1 is None and rows["a"].freq == 1
    assert rows["b"].std_1 == pytest.approx(math.sqrt(28 / (1 * 4 / 2)))
    assert rows["b"].error_1 == pytest.approx(rows["b"].std_1 / 2)


def brute_profile(known, first, last):
    """Month by month: own December, otherwise what was known at the end of the year before."""
    out, carried = {}, known.get(first)
    for year in range(first, last + 1):
        own = known.get(year) or carried
        for month in range(1, 13):
            out[year * 100 + month] = own if month == 12 else carried
        carried = own
    return out


def test_profile_fill(spark):
    clients = {"full": {2005: "p", 2006: "q", 2007: "r"}, "late": {2006: "q"}, "gap": {2005: "p", 2007: "r"}}
    rows = [(c, y * 100 + 12, p, 1) for c, ys in clients.items() for y, p in ys.items()]
    rows += [("gap", 200712, "older", 0), ("full", 200412, "before", 9)]
    df = spark.createDataFrame(rows, "client string, period int, profile string, o int")
    found = {}
    for r in curves.profile_fill(df, "client", "period", "profile", 2005, 2007, order="o").collect():
        found.setdefault(r.client, {})[r.period] = r.profile
    assert found == {c: brute_profile(ys, 2005, 2007) for c, ys in clients.items()}


def test_profile_fill_keeps_every_client(spark):
    rows = [("before", 200412, "a"), ("midyear", 200503, "b"), ("known", 200512, "c")]
    df = spark.createDataFrame(rows, "client string, period int, profile string")
    found = curves.profile_fill(df, "client", "period", "profile", 2005, 2006).collect()
    assert len(found) == 3 * 24
    assert {r.client for r in found if r.profile is None} == {"before", "midyear"}
    assert {r.profile for r in found if r.client == "known"} == {"c"}


def test_collect_ordered_keeps_every_value(spark):
    rows = [("a", 3, "z"), ("a", 1, "x"), ("a", 1, "w"), ("a", 1, "w"), ("b", 9, None), ("a", 20, "y")]
    df = spark.createDataFrame(rows, "k string, p int, v string")
    found = {r.k: r.vs for r in aggregates.collect_ordered(df, ["k"], "p", F.col("v"), "vs").collect()}
    assert found == {"a": ["w", "w", "x", "z", "y"], "b": []}
    assert aggregates.collect_ordered(df, ["k"], "p", F.col("v"), "vs", [1, 3, 9, 20]).count() == 2
    with pytest.raises(Exception, match="period outside the list: 20"):
        aggregates.collect_ordered(df, ["k"], "p", F.col("v"), "vs", [1, 3, 9]).collect()


def test_ordered_rows_of_a_hot_key(spark):
    """A key with most of the rows fills many ranges; positions go on from range to range."""
    df = spark.range(30_000).selectExpr("case when id % 10 < 6 then 'hot' when id % 10 < 9 then null else 'k' || id % 50 end as k", "id % 7 as p", "hash(id) % 9000 as v")
    df = df.withColumn("v", F.when(F.col("p") != 6, F.col("v"))).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = aggregates.ordered_rows(df, ["k"], "p", F.col("v"), "v").collect()
        ranges = aggregates._in_ranges(df.distinct(), ["k", "p", "v"]).where("k = 'hot'").groupBy("_range").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(ranges) >= 2
    wanted = {}
    for r in df.collect():
        if r.v is not None:
            wanted.setdefault(r.k, []).append((r.p, r.v))
    got = {}
    for r in sorted(found, key=lambda r: r.position):
        got.setdefault(r.k, []).append((r.p, r.v))
        assert r.position == len(got[r.k])
    assert got == {k: sorted(rows) for k, rows in wanted.items()}
    assert aggregates.ordered_rows(df.limit(0), ["k"], "p", F.col("v"), "v").isEmpty()


# --- structural break ------------------------------------------------------------------------

# Two samples of ten whose published p-value is 0.974231.
FIRST = [(1.2, 1.9, 0.9), (1.6, 2.7, 1.3), (3.5, 3.7, 2.0), (4.0, 3.1, 1.8), (5.6, 3.5, 2.2),
         (5.7, 7.5, 3.5), (6.7, 1.2, 1.9), (7.5, 3.7, 2.7), (8.5, 0.6, 2.1), (9.7, 5.1, 3.6)]
SECOND = [(1.4, 1.3, 0.5), (1.5, 2.3, 1.3), (3.1, 3.2, 2.5), (4.4, 3.6, 1.1), (5.1, 3.1, 2.8),
          (5.2, 7.3, 3.3), (6.5, 1.5, 1.3), (7.8, 3.2, 2.2), (8.1, 0.1, 2.8), (9.5, 5.6, 3.9)]


def test_chow_reaches_the_published_p_value(spark):
    rows = [(*r, 0) for r in FIRST] + [(*r, 1) for r in SECOND] + [(None, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double, half int")
    row = structural.chow_test(df, "y", ["x1", "x2"], F.col("half") == 1).first()
    assert round(row.p_value, 6) == 0.974232 or math.floor(row.p_value * 1e6) / 1e6 == 0.974231
    assert (row.n_1, row.n_2) == (10, 10)


def test_chow_finds_a_break_far_from_zero(spark):
    rows = [(1e6 + i, 5.0 * i + (i % 3) + (200 if i >= 30 else 0), i >= 30) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, later boolean")
    row = structural.chow_scan(df.withColumn("g", F.lit(1)), "y", ["x"], F.col("later"), ["g"]).first()
    assert row.breaks == 1 and row.p_value < 1e-9


@pytest.mark.parametrize("regressors", [["x1"], ["x1", "x2"]])
def test_every_break_date_equals_a_test_of_its_own(spark, regressors):
    rng = random.Random(4)
    rows = []
    for g, moves in (("a", 12), ("b", 25), ("c", None)):
        for i in range(40):
            for _ in range(rng.randint(1, 4)):
                x1, x2 = 1e5 + rng.gauss(0, 3), rng.gauss(0, 1)
                y = 1e6 + 2 * x1 + x2 + rng.gauss(0, 1) + (30 if moves is not None and i >= moves else 0)
                rows.append((g, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), x1, x2, y))
    rows += [("a", None, 1.0, 1.0, 1.0), ("a", datetime.date(2020, 1, 2), None, 1.0, 1.0), (None, datetime.date(2020, 1, 2), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, day date, x1 double, x2 double, y double").repartition(6)
    found = {(r.g, r.break_date): r for r in structural.chow_by_date(df, "y", regressors, "day", ["g"]).collect()}
    known = df.na.drop(subset=["day", "g"])
    for day in (datetime.date(2020, 1, 6), datetime.date(2020, 1, 13), datetime.date(2020, 1, 26), datetime.date(2020, 2, 3)):
        for r in structural.chow_test(known, "y", regressors, F.col("day") >= F.lit(day), ["g"]).collect():
            own = found[r.g, day]
            assert (own.n_1, own.n_2) == (r.n_1, r.n_2)
            assert own.statistic == pytest.approx(r.statistic, rel=1e-6) and own.p_value == pytest.approx(r.p_value, rel=1e-6, abs=1e-7)
    best = {r.g: r for r in structural.largest_break(structural.chow_by_date(df, "y", regressors, "day", ["g"]), ["g"]).collect()}
    assert best["a"].break_date == datetime.date(2020, 1, 13) and best["b"].break_date == datetime.date(2020, 1, 26)
    assert best["a"].p_value < 1e-9 and all(best[g].statistic == max(r.statistic for (h, _), r in found.items() if h == g) for g in best)


def test_break_dates_take_one_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3000).selectExpr("id % 3 as g", "date_add(date'2020-01-01', cast(id % 200 as int)) as day", "rand(1) as x", "rand(2) as y").write.parquet(path)
    scans, _ = _scans(structural.largest_break(structural.chow_by_date(spark.read.parquet(path), "y", ["x"], "day", ["g"], "month"), ["g"]))
    assert scans == 1
    assert structural.chow_by_date(spark.read.parquet(path).limit(0), "y", ["x"], "day").isEmpty()


def test_residuals_of_an_exact_fit_are_zero(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(20)], "x double, y double")
    assert structural.ols_rss(df, "y", ["x"]).first().rss == pytest.approx(0, abs=1e-9)


def test_f_tail_against_closed_forms(spark):
    df = spark.createDataFrame([(f, d) for f in (0.0, 0.3, 1.0, 4.2, 50.0) for d in (1.0, 7.0, 200.0, 1e6)], "f double, d double")
    rows = df.select("f", "d", structural.f_survival(F.col("f"), F.lit(2), F.col("d")).alias("p")).collect()
    assert all(r.p == pytest.approx((1 + 2 * r.f / r.d) ** (-r.d / 2), rel=1e-7, abs=1e-15) for r in rows)


# --- similarity ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def players(spark):
    rows = [(i, "p0" if i in (0, 9) else f"p{i}", float(i), float(i % 3), i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "id bigint, name string, a double, b double, foot int")


def test_nearest_players(players):
    features = [F.col("a"), F.col("b")]
    found = similarity.top_k_similar(players, features, "id", "name", "p0", F.col("a") >= 1, k=5).orderBy("rank").collect()
    expected = sorted((math.hypot(i, i % 3), i) for i in range(1, 40) if i != 9)[:5]
    assert [(r.rank, r.id) for r in found] == [(0, 0)] + [(n, i) for n, (_, i) in enumerate(expected, 1)]
    assert [r.distance for r in found[1:]] == pytest.approx([d for d, _ in expected])


def test_small_pools_give_what_they_have(players):
    features = [F.col("a"), F.col("b")]
    few = similarity.top_k_similar(players, features, "id", "name", "p0", F.col("a") > 36, k=5).orderBy("rank").collect()
    pool = players.filter("a > 36 and name <> 'p0'").count()
    assert 0 < pool < 5 and [r.rank for r in few] == list(range(pool + 1))
    assert similarity.top_k_similar(players, features, "id", "name", "nobody", F.lit(True), k=5).isEmpty()


def test_batch_agrees_with_single(players):
    features = [F.col("a"), F.col("b")]
    for pool, k in ((F.lit(True), 4), (F.col("a") > 36, 5)):
        batch = similarity.top_k_similar_batch(players.repartition(5), F.array("a", "b"), "id", [3, 20, -1], pool, k=k)
        found = {(r.query_id, r.rank): r.id for r in batch.collect()}
        assert {q for q, _ in found} == {3, 20}
        for query in (3, 20):
            single = similarity.top_k_similar(players, features, "id", "id", query, pool, k=k)
            assert {(query, r.rank): r.id for r in single.collect()} == {p: v for p, v in found.items() if p[0] == query}


def test_batches_of_any_number_and_id_type(players, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 10)
    monkeypatch.setattr(similarity, "ROW_BLOCK", 7)
    ids = [r.id for r in players.select("id").collect()]
    batch = similarity.top_k_similar_batch(players, F.array("a", "b"), "id", [*ids, *range(10_000, 11_001)][:1001], F.lit(True), k=1)
    assert sorted(r.query_id for r in batch.filter("rank = 0").collect()) == sorted(ids)
    named = similarity.top_k_similar_batch(players, F.array("a", "b"), "name", ["p0", "p3"], F.lit(True), k=2)
    assert {(r.query_id, r.rank) for r in named.collect()} == {(q, k) for q in ("p0", "p3") for k in range(3)}


def test_ten_thousand_queries_in_one_scan(spark, tmp_path):
    """Points of a grid, so that ties abound: exact, in id order."""
    rng = np.random.default_rng(2)
    points = rng.integers(0, 40, (10_000, 3)).astype(float) + 1e4
    path = str(tmp_path / "points")
    spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").repartition(6).write.parquet(path)
    best = similarity.top_k_similar_batch(spark.read.parquet(path), F.col("v"), "id", range(10_500), F.lit(True), k=3)
    scans, text = _scans(best)
    assert scans == 1
    found = {(r.query_id, r.rank): (r.id, r.distance) for r in best.collect()}
    assert len(found) == 40_000
    for q in range(0, 10_000, 37):
        distance = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        order = np.lexsort((np.arange(10_000), distance))[:3]
        assert [found[q, n][0] for n in (1, 2, 3)] == order.tolist()
        assert [found[q, n][1] for n in (1, 2, 3)] == distance[order].tolist()


# --- what the reports leave out is said ----------------------------------------------------------


def test_psi_tells_how_many_buckets_it_skipped(spark):
    rows = [("v", 1, b, 0.2) for b in range(5)] + [("v", 2, 0, 1.0), ("v", 3, 7, 0.5), ("v", 3, 1, 0.5)]
    table = spark.createDataFrame(rows, "variable string, cohort int, bucket int, proportion double")
    found = {r.cohort: r for r in stability.psi_by_cohort(table, "cohort", 1).collect()}
    assert {c: r.skipped for c, r in found.items()} == {1: 0, 2: 4, 3: 5}


def test_unlisted_categories_are_counted(spark):
    rows = [(1, "v", "a", 3), (1, "v", "x", 4), (1, "v", None, 5), (2, "v", "b", 1)]
    table = spark.createDataFrame(rows, "cohort int, variable string, category string, freq long")
    found = {r.cohort: r for r in charts.category_pivot(table, "cohort", ["a", "b"]).collect()}
    assert (found[1].freq_a, found[1].freq_other) == (3, 9) and (found[2].freq_b, found[2].freq_other) == (1, 0)


def test_two_sides_are_one_scan_that_filters(spark, tmp_path):
    import datetime

    spark.sql("select date'2015-02-01' as d union all select date'2016-02-01' union all select null").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    before, after = relational.split_at_threshold(df, "d", datetime.date(2016, 1, 1))
    assert "LessThan(d,2016-01-01)" in before._jdf.queryExecution().executedPlan().toString() and after.count() == 1
    sides = df.groupBy(relational.side_of("d", datetime.date(2016, 1, 1)).alias("side")).count()
    assert {r.side: r["count"] for r in sides.collect()} == {"before": 1, "after": 1, None: 1}


def test_many_groups_of_two_regressors(spark):
    """A hundred thousand fits in batches, against one plain fit."""
    rng = "rand(1)"
    rows = spark.range(800_000).selectExpr("id % 100000 as g", "rand(2) as x", "rand(3) as z", f"{rng} + rand(2) as y")
    fits = structural.ols_rss(rows, "y", ["x", "z"], ["g"])
    assert fits.count() == 100_000 and fits.filter("rss is null or rss < 0").isEmpty()
    own = rows.filter("g = 77").collect()
    a = np.array([[1, r.x, r.z] for r in own])
    y = np.array([r.y for r in own])
    left = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    assert fits.filter("g = 77").first().rss == pytest.approx(float(left @ left), rel=1e-6)


def test_f_tail_against_known_values(spark):
    """Upper tails of the F distribution in closed form."""
    cases = [(s, 2.0, d) for s in (0.1, 1.0, 5.0, 400.0) for d in (1.0, 4.0, 30.0, 5000.0)]
    df = spark.createDataFrame(cases, "s double, a double, b double")
    for r in df.select("*", structural.f_survival(F.col("s"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx((1 + 2 * r.s / r.b) ** (-r.b / 2), rel=1e-9)
    for r in df.select("*", structural.f_survival(1 / F.col("s"), F.col("b"), F.col("a")).alias("p")).collect():
        assert r.p == pytest.approx(1 - (1 + 2 * r.s / r.b) ** (-r.b / 2), rel=1e-9, abs=1e-12)
