from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.session import scratch_dir
from cohortwise.sources import readers, writers


def test_schema_from_pairs_keeps_order_and_nullability():
    schema = readers.schema_from_pairs([["b", "int"], ["a", "decimal"], ["c", "date"], ["d", "str"], ["e", "float"]])
    assert [f.name for f in schema] == ["b", "a", "c", "d", "e"]
    assert schema["a"].dataType == T.DecimalType(30, 10)
    assert all(f.nullable for f in schema)
    with pytest.raises(KeyError):
        readers.schema_from_pairs([["a", "blob"]])


def test_from_rows_and_preview(spark):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.DoubleType())])
    people = readers.from_rows(spark, [["ana", 31.0], ["luis", 0.5]], schema)
    assert people.schema == schema
    assert readers.preview(people.orderBy("name"), 1) == [{"name": "ana", "age": 31.0}]


def test_json_schema_rules_over_inference(spark, tmp_path):
    (tmp_path / "people.json").write_text('{"name":"ana","age":30}\n{"name":"luis"}\n')
    path = str(tmp_path / "people.json")
    assert dict(readers.read_json(spark, path).dtypes) == {"age": "bigint", "name": "string"}
    schema = readers.schema_from_pairs([["age", "int"], ["name", "str"]])
    assert readers.read_json(spark, path, schema).filter("age is null").count() == 1


def test_csv_typed_reads_only_the_wanted_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b;c\n1;2.5;x\n;3.5;y\n")
    schema = readers.schema_from_pairs([["a", "int"], ["b", "double"], ["c", "str"]])
    rows = readers.read_csv_typed(spark, str(tmp_path / "t.csv"), schema, ["b", "a"], sep=";").collect()
    assert [tuple(r) for r in rows] == [(2.5, 1), (3.5, None)]


def test_tsv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes(b"\xef\xbb\xbfplayer\tteam\nx y\tz\n")
    df = readers.read_delimited_tsv(spark, str(tmp_path / "t.tsv"), "player")
    assert df.columns == ["player", "team"] and df.first()[0] == "x y"


def test_count_approx_holds_the_true_count(spark):
    row = readers.count_approx(spark.range(100_000), 0.05, seed=3).first()
    assert row.lower <= 100_000 <= row.upper
    exact = readers.count_approx(spark.range(1000), 1.0).first()
    assert tuple(exact) == (1000, 1000, 1000)
    with pytest.raises(ValueError):
        readers.count_approx(spark.range(1), 0)


def test_is_empty(spark):
    assert readers.is_empty(spark.range(0)) and not readers.is_empty(spark.range(1))


def test_persist_stage_releases_on_error(spark):
    df = spark.range(10)
    with pytest.raises(RuntimeError):
        with readers.persist_stage(df) as stage:
            assert stage.is_cached
            raise RuntimeError
    assert not df.is_cached


def test_month_list_crosses_years():
    assert writers.month_list("2014-11-17", 4) == ["2014-11-01", "2014-12-01", "2015-01-01", "2015-02-01"]


def _rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("m", "v").collect()))


def test_refresh_is_idempotent_and_leaves_other_partitions(spark):
    path = scratch_dir(spark, "refresh")
    old = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "m int, v int")
    writers.write_partitioned(old, path, "m")
    new = spark.createDataFrame([(1, 11), (1, 12), (2, 21), (4, 41)], "m int, v int")
    for _ in range(2):
        writers.refresh_partitions(new, path, "m", [1, 2])
        assert _rows(spark, path) == [(1, 11), (1, 12), (2, 21), (3, 30), (4, 40)]


def test_refresh_drops_a_requested_partition_without_rows(spark):
    path = scratch_dir(spark, "refresh")
    writers.write_partitioned(spark.createDataFrame([(1, 10), (2, 20)], "m int, v int"), path, "m")
    writers.refresh_partitions(spark.createDataFrame([(1, 11)], "m int, v int"), path, "m", [1, 2])
    assert _rows(spark, path) == [(1, 11)]


@pytest.mark.parametrize("stop", range(6))
def test_a_refresh_that_was_stopped_is_finished(spark, monkeypatch, stop):
    """Stopped at any step: before the commit the old table stands, after it the next call completes the new one."""
    path = scratch_dir(spark, "refresh")
    old, new = [(m, 10 * m) for m in range(1, 6)], [(1, 11), (2, 21), (6, 61)]
    writers.write_partitioned(spark.createDataFrame(old, "m int, v int"), path, "m")
    left = {"steps": stop}

    class Stopped(Exception):
        pass

    def counted(step):
        def run(*args):
            if left["steps"] == 0:
                raise Stopped
            left["steps"] -= 1
            return step(*args)

        return run

    with monkeypatch.context() as m:
        for name in ("move", "commit"):
            m.setattr(writers._Files, name, counted(getattr(writers._Files, name)))
        with pytest.raises(Stopped):
            writers.refresh_partitions(spark.createDataFrame(new, "m int, v int"), path, "m", [1, 2, 3, 6])
    committed = stop >= 2  # the write of the commit and its move
    if not committed:
        assert _rows(spark, path) == old
    writers.finish_refresh(spark, path)
    assert _rows(spark, path) == (sorted(new + old[3:]) if committed else old)
    writers.refresh_partitions(spark.createDataFrame(new, "m int, v int"), path, "m", [1, 2, 3, 6])
    assert _rows(spark, path) == sorted(new + old[3:])
    assert not [p for p in Path(path.removeprefix("file:")).iterdir() if p.name.startswith(writers.ASIDE)]


def test_a_table_can_be_refreshed_from_itself(spark):
    path = scratch_dir(spark, "refresh")
    writers.write_partitioned(spark.createDataFrame([(1, 10), (2, 20)], "m int, v int"), path, "m")
    table = spark.read.parquet(path)
    writers.refresh_partitions(table.withColumn("v", F.col("v") + 1), path, "m", [1])
    assert _rows(spark, path) == [(1, 11), (2, 20)]


def test_refresh_of_a_new_table_and_text_values(spark):
    path = scratch_dir(spark, "refresh")
    df = spark.createDataFrame([("2015-01-01", 1), ("a b/c", 2)], "m string, v int")
    writers.refresh_partitions(df, path, "m", ["2015-01-01", "a b/c"])
    writers.refresh_partitions(df.filter("v = 1"), path, "m", ["2015-01-01", "a b/c"])
    assert _rows(spark, path) == [("2015-01-01", 1)] or [str(r[0]) for r in _rows(spark, path)] == ["2015-01-01"]


def test_backfill_scales_and_repeats(spark):
    path = scratch_dir(spark, "backfill")
    df = spark.createDataFrame(
        [("2015-01-01", 1.234567), ("2015-02-01", 2.0), ("2015-04-01", 9.0)], "d string, num double"
    ).withColumn("d", F.col("d").cast("date"))
    for _ in range(2):
        writers.backfill_months(df, "2015-01-20", 3, path, "d", "num")
    rows = spark.read.parquet(path).orderBy("d").collect()
    assert [(str(r.d), str(r.scaled)) for r in rows] == [("2015-01-01", "123.45670"), ("2015-02-01", "200.00000")]


def _session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_dir_follows_the_session_setting():
    first, second = (scratch_dir(_session("yarn", "hdfs:///shared/"), "x") for _ in range(2))
    assert first.startswith("hdfs:///shared/x-") and first != second
    with pytest.raises(ValueError):
        scratch_dir(_session("yarn"), "x")
    assert scratch_dir(_session("local[2]"), "x").startswith("/tmp/run-")


def test_stage_results_come_from_memory(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    with readers.persist_stage(spark.read.parquet(f"{tmp_path}/t")) as stage:
        plans = [stage.agg(F.sum("id")), stage.filter("id > 5").agg(F.count("*"))]
        assert all("InMemoryTableScan" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
        kept = readers.settled(plans[0])
    assert kept.first()[0] == 499500
    assert "Scan parquet" not in kept._jdf.queryExecution().executedPlan().toString()


def test_refresh_reads_its_source_once(spark):
    path = scratch_dir(spark, "refresh")
    writers.write_partitioned(spark.range(100).selectExpr("id % 4 as m", "id as v"), path, "m")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = spark.range(1000).selectExpr("id % 3 as m", "id as v").mapInArrow(count, "m long, v long")
    writers.refresh_partitions(source, path, "m", [1, 3])
    assert read.value == 1000
    left = {r.m: r["count"] for r in spark.read.parquet(path).groupBy("m").count().collect()}
    assert left == {0: 25, 1: 333, 2: 25}


def test_backfill_filter_reaches_the_scan(spark, tmp_path, monkeypatch):
    spark.sql("select date'2015-02-01' as d, 1.5D as num union all select date'2016-02-01', 2.5D").write.parquet(f"{tmp_path}/t")
    seen = []
    monkeypatch.setattr(writers, "refresh_partitions", lambda df, path, column, values: seen.append(df.filter(F.col(column).isin(list(values)))))
    writers.backfill_months(spark.read.parquet(f"{tmp_path}/t"), "2015-01-20", 3, "x", "d", "num")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(d, [2015-01-01,2015-02-01,2015-03-01])]" in plan
    assert seen[0].count() == 1


def test_keyed_counts_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    rows = [tuple(readers.count_approx(df.repartition(n), 0.2, 3, ["id"]).first()) for n in (1, 7)]
    assert rows[0] == rows[1] and rows[0][1] <= 5000 <= rows[0][2]
