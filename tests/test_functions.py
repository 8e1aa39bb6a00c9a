from __future__ import annotations

import random
from bisect import bisect_left, bisect_right

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortwise.functions import quantiles, scalars
from cohortwise.operators import relational, sampling


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_parse_mixed_date(spark):
    found = column(spark, ["31/12/2019", "2019-12-31", "x", None, "99/99/2019"], scalars.parse_mixed_date)
    assert [str(d) if d else None for d in found] == ["2019-12-31", "2019-12-31", None, None, None]


def test_composite_key_pads_the_branch(spark):
    found = column(
        spark,
        ["9", "10", "999", "1000", "9999", "10000", " 7 ", None],
        lambda b: scalars.composite_key(F.lit(" 74"), b, F.lit("123")),
    )
    assert found == ["00740009123", "00740010123", "00740999123", "00741000123", "00749999123", None, "00740007123", None]


def test_classify_by_sets_rejects_overlap(spark):
    rules = {"a": ["1", "2"], "b": ["3"]}
    assert column(spark, ["2", "3", "4", None], lambda c: scalars.classify_by_sets(c, rules)) == ["a", "b", None, None]
    with pytest.raises(ValueError):
        scalars.classify_by_sets(F.col("x"), {"a": ["1"], "b": ["1"]})


def test_elapsed_time_goes_back_a_day(spark):
    df = spark.createDataFrame([("23:59:00 PM", "00:00:30 AM"), ("09:05:07 AM", "10:15:17 AM")], "a string, b string")
    rows = df.select(scalars.elapsed_time(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == ["-1 day, 0:01:30", "1:10:10"]


def test_local_time_label(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 03:04:05' as t union all select timestamp_ntz'2024-01-01 20:00:00'")
    assert sorted(r[0] for r in df.select(scalars.local_time_label(F.col("t"))).collect()) == ["14:00:00 PM", "21:04:05 PM"]


def test_strip_suffix_and_split(spark):
    assert column(spark, ["L. Messi  - FC X - Y", "plain"], scalars.strip_suffix) == ["L. Messi", "plain"]
    assert column(spark, ["a|b", "a|"], lambda c: scalars.empty_to_null(scalars.split_field(c, "|", 2))) == ["b", None]


def test_ratio_and_sentinel_greatest(spark):
    df = spark.createDataFrame([(99999999.0, 5.0), (10.26, 7.0), (1e9, 0.0)], "a double, b double")
    rows = df.select(scalars.sentinel_greatest(F.col("a"), F.col("b")), scalars.ratio(F.col("a"), F.col("b"))).collect()
    assert [str(r[0]) for r in rows] == ["5.0", "10.3", "1000000000.0"]
    assert rows[0][1] is None and str(rows[1][1]) == "1.46571" and rows[2][1] is None  # overflow, value, zero income


def test_year_of_cohort_truncates(spark):
    assert column(spark, [199599, 201512], scalars.yyyymm_year, "int") == [1995, 2015]


def test_drop_sentinels_also_drops_nulls(spark):
    df = spark.createDataFrame([(1.0,), (-99999999.0,), (None,)], "x double")
    assert relational.drop_sentinels(df, "x", [-99999999]).count() == 1
    assert relational.drop_sentinels(df, "x", None).count() == 3
    nulled = relational.null_out_sentinels(df, {"x": [-99999999], "other": [1]})
    assert nulled.filter("x is null").count() == 2


def test_split_keeps_duplicates_and_is_repeatable(spark):
    rows = [(k, 1) for k in range(2000)] * 2 + [(5, None), (6, 7)]
    df = spark.createDataFrame(rows, "k int, target int")
    one = sampling.split_train_test(df, "target", ["k"], 0.7, 42)
    two = sampling.split_train_test(df.repartition(7), "target", ["k"], 0.7, 42)
    assert one.count() == len(rows)
    assert one.exceptAll(two).isEmpty()
    assert one.filter("target is null or target = 7").select("sample").distinct().collect()[0][0] == "test"
    share = one.filter("sample = 'train'").count() / len(rows)
    assert abs(share - 0.7) < 0.04


def test_samples(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 2).alias("target"))
    for sampled in (sampling.sample_simple(df, 0.3, 1), sampling.sample_stratified(df, "target", 0.3, 1)):
        assert abs(sampled.count() - 6000) < 5 * (20_000 * 0.3 * 0.7) ** 0.5
    assert sampling.sample_simple(df, 0.3, 1).exceptAll(sampling.sample_simple(df, 0.3, 1)).isEmpty()
    assert not sampling.sample_simple(df, 0.3, 1).exceptAll(sampling.sample_simple(df, 0.3, 2)).isEmpty()


def test_random_flag_without_keys(spark):
    flags = spark.range(10_000).select(scalars.random_flag(3).alias("f")).agg(F.sum("f")).first()[0]
    assert abs(flags - 5000) < 250


def test_except_forms(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,), (3,)], "x int")
    right = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(r[0] or 0 for r in relational.except_distinct(left, right).collect()) == [0, 2]
    assert sorted(r[0] or 0 for r in relational.except_all(left, right).collect()) == [0, 1, 2, 3]


# --- quantiles and AUC against brute force ---------------------------------------------------


def brute_quantile(values, p):
    """Smallest value whose rank reaches p * n, for p given in hundredths."""
    ordered = sorted(values)
    rank = max(1, -(-p * len(ordered) // 100))
    return ordered[rank - 1]


def brute_auc(pairs):
    bad = [v for v, t in pairs if t == 1]
    good = [v for v, t in pairs if t == 0]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    return wins / (len(bad) * len(good)) if bad and good else None


VALUES = st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, width=32),
    st.sampled_from([0.0, -0.0, 1.0, 1.0000001, 1e-9, -1e-9, 1e12, 1e12 + 1]),
    st.integers(-3, 3).map(float),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VALUES, min_size=1, max_size=60), st.sampled_from([5, 7, 20, 10_000]))
def test_exact_quantiles_match_brute_force(spark, values, accuracy):
    before = quantiles.ACCURACY, quantiles.BRACKET_CELLS
    quantiles.ACCURACY, quantiles.BRACKET_CELLS = accuracy, 4
    try:
        groups = {"a": values, "b": values[: len(values) // 2 + 1]}
        df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
        points = [0, 7, 25, 50, 60, 100]
        found = quantiles.exact_quantiles(df, "v", [str(p / 100) for p in points], ["g"]).collect()
    finally:
        quantiles.ACCURACY, quantiles.BRACKET_CELLS = before
    expected = {(g, i): brute_quantile(vs, p) for g, vs in groups.items() for i, p in enumerate(points, 1)}
    assert {(r.g, r.position): r.value for r in found} == expected
    assert len(found) == len(expected)


def test_quantiles_of_a_hot_value_and_nulls(spark):
    values = [5.0] * 700 + [float(i) for i in range(300)] + [None] * 50 + [float("nan")] * 10
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = quantiles.exact_quantiles(df, "v", ["0.1", "0.5", "1"])
    known = [v for v in values if v is not None and v == v]
    assert [r.value for r in found.orderBy("position").collect()] == [brute_quantile(known, p) for p in (10, 50, 100)]


SHAPES = {
    "log_uniform": "pow(10D, -12 + 10 * rand(3))",
    "one_outlier": "case when id = 7 then 1.04e9 else 1e9 + rand(4) end",
    "shifted": "1e9 + 1e-4 * rand(5)",
    "signed": "(rand(6) - 0.5) * pow(10D, 300 * rand(7))",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_crowded_values(spark, monkeypatch, shape):
    """Values that crowd together stay exact, and are dealt evenly over the ranges of the rank statistic."""
    df = spark.range(40_000).selectExpr(f"{SHAPES[shape]} as v", "cast(rand(9) < 0.4 as int) as t", "'x' as k").persist()
    values = sorted(r.v for r in df.collect())
    for accuracy in (10, 100, 10_000):
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        found = quantiles.exact_quantiles(df.repartition(12), "v", ["0.01", "0.5", "0.9"])
        assert [r.value for r in found.orderBy("position").collect()] == [brute_quantile(values, p) for p in (1, 50, 90)]
    rows = df.collect()
    found = quantiles.rank_auc(df, "k", "v", "t")
    bads, goods = sorted(r.v for r in rows if r.t), sorted(r.v for r in rows if not r.t)
    wins = sum((bisect_left(goods, b) + bisect_right(goods, b)) / 2 for b in bads)
    assert found.first().auc == pytest.approx(wins / (len(bads) * len(goods)), abs=1e-12)
    ranges = df.select("k", "v").distinct().repartitionByRange(8, "k", "v").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranges.collect()) < 2 * 40_000 / 8
    df.unpersist()


TIES = {"two_values": "id % 2", "few": "id % 7 + 0.5", "hot": "case when id % 3 = 0 then 5 else rand(1) * 10 end", "none": "rand(2)"}


@pytest.mark.parametrize("shape", TIES)
def test_bracket_counts_hold_all_rows(spark, monkeypatch, shape):
    """Two reads: counts by code rise with the value, their sum is all rows, a bracket's values are few."""
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    df = spark.range(20_000).selectExpr(f"cast({TIES[shape]} as double) as v", "id % 4 = 0 as r", "id % 5 as k").repartition(6).persist()
    counts = quantiles.bracket_counts(df, "v", ["0.2", "0.5"], keep=["k"], reference=F.col("r")).collect()
    assert sum(c["_n"] for c in counts) == 20_000 and sum(c["_n"] for c in counts if c["_ref"]) == 5000
    assert sum(c["_n"] for c in counts if c["_x"] is not None and c["_code"] % 2 == 0) <= 2 * 20_000 * 8 / 200
    known = sorted(r.v for r in df.where("r").collect())
    found = quantiles.settle_quantiles(quantiles.bracket_counts(df, "v", ["0.2", "0.5"], reference=F.col("r")), ["0.2", "0.5"])
    cuts = [r.value for r in found.orderBy("position").collect()]
    assert cuts == [brute_quantile(known, 20), brute_quantile(known, 50)]
    for cut in cuts:  # no count without a value is split by a cut
        upto = sum(c["_n"] for c in counts if (c["_x"] if c["_x"] is not None else c["_at"] if c["_at"] is not None else -1e99) < cut)
        assert upto == df.where(F.col("v") < cut).count()
    df.unpersist()


def test_quantiles_of_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g string, v double")
    found = quantiles.exact_quantiles(df, "v", ["0.5", "1"], ["g"]).collect()
    assert sorted((r.g or "", r.position, r.value) for r in found) == [("", 1, 1.0), ("", 2, 3.0), ("a", 1, 2.0), ("a", 2, 2.0)]


def test_quantiles_read_the_rows_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).selectExpr("id % 3 as g", "pow(10D, -12 + 10 * rand(3)) as v").write.parquet(path)
    found = quantiles.exact_quantiles(spark.read.parquet(path), "v", ["0.1", "0.5", "0.9"], ["g"])
    found.collect()
    ran = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan") == 2


def test_quantiles_without_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(empty, "v", ["0.5"], ["g"]).isEmpty()


@pytest.mark.parametrize("coalesced, batch", [("false", 10_000), ("true", 10_000), ("false", 7)])
def test_rank_auc_matches_brute_force(spark, coalesced, batch):
    """With as many ranges as there are, with ranges put together, and with batches shorter than a group."""
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = random.Random(batch)
    data = {
        "ties": [(float(rng.randint(0, 4)), rng.randint(0, 1)) for _ in range(120)],
        "cluster": [(1e9 + rng.random(), rng.randint(0, 1)) for _ in range(120)],
        "signed": [(rng.gauss(0, 100), rng.randint(0, 1)) for _ in range(120)],
        "hot": [(7.0, 0)] * 80 + [(rng.gauss(7, 2), 1) for _ in range(40)],
        "one_class": [(float(i), 1) for i in range(10)],
    }
    df = spark.createDataFrame([(k, v, t) for k, rows in data.items() for v, t in rows], "k string, v double, t int")
    try:
        found = {r.k: r.auc for r in quantiles.rank_auc(df, "k", "v", "t").collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for key, pairs in data.items():
        expected = brute_auc(pairs)
        assert found[key] == (pytest.approx(expected, abs=1e-12) if expected is not None else None)


def test_no_task_gets_the_rows_of_a_whole_group(spark):
    """Brackets of a caller's few names go to the rows; rows of other groups are dealt into parts before they meet theirs."""
    df = spark.range(20_000).selectExpr("if(id % 100 = 0, 'b', 'a') as g", "cast(id % 7919 as double) as v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = "hashpartitioning(coalesce(g"
        listed, dealt = (quantiles.bracket_counts(df, "v", ["0.5"], ["g"], few=few) for few in (True, False))
        plans = [counts._jdf.queryExecution().executedPlan().toString() for counts in (listed, dealt)]
        assert whole not in plans[0] and "SortMergeJoin" not in plans[0]
        assert all("_part#" in line for line in plans[1].splitlines() if whole in line and "_by0" not in line)
        parts = {few: quantiles.exact_quantiles(df, "v", ["0.1", "0.5"], ["g"], few=few).collect() for few in (True, False)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    values = {g: [i % 7919 for i in range(20_000) if (i % 100 == 0) == (g == "b")] for g in "ab"}
    expected = {(g, k): brute_quantile(values[g], p) for g in "ab" for k, p in ((1, 10), (2, 50))}
    assert all({(r.g, r.position): r.value for r in found} == expected for found in parts.values())
