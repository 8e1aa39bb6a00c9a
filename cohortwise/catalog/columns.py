"""Queries on projections, scalar functions and filters."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.catalog.registry import SCORE_SQL, query, score, table
from cohortwise.functions import scalars
from cohortwise.operators import relational
from cohortwise.plans.selection import indicator_columns


@query("project", "P1", "SELECT *, o_totalprice AS amount FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    narrow = orders[["o_orderkey", "o_custkey", "o_totalprice"]]
    return narrow.select("*", narrow.o_totalprice.alias("amount"))


@query(
    "replace_and_drop",
    "P2",
    "SELECT c_custkey, c_name, c_nationkey, upper(c_mktsegment) AS segment, c_acctbal * 2 AS doubled FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    new = {"segment": F.upper("c_mktsegment"), "doubled": F.col("c_acctbal") * 2}
    return relational.replace_and_drop(table(spark, sf, "customer"), new, ["c_mktsegment", "c_acctbal"])


@query(
    "stage_columns",
    "P3",
    "SELECT p_partkey, p_size, p_size + 1 AS a, (p_size + 1) * 3 AS b, (p_size + 1) * 3 - p_size AS c FROM part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return relational.stage_columns(
        parts, {"a": F.col("p_size") + 1}, {"b": F.col("a") * 3}, {"c": F.col("b") - F.col("p_size")}
    )


@query(
    "with_literal",
    "P4",
    """SELECT p_partkey, 'x' AS tag, p_size AS copy, p_size + 10 AS plus, p_size - 10 AS minus, p_size * 10 AS times,
              CASE WHEN p_size = 25 THEN NULL ELSE p_retailprice / (p_size - 25) END AS divided FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.lit("x").alias("tag"),
        size.alias("copy"),
        (size + 10).alias("plus"),
        (size - 10).alias("minus"),
        (size * 10).alias("times"),
        scalars.safe_ratio(F.col("p_retailprice"), size - 25).alias("divided"),
    )


@query(
    "cast_types",
    "P5",
    """SELECT o_orderkey::VARCHAR AS key_text, floor(o_totalprice)::BIGINT AS whole,
              round(o_totalprice::VARCHAR::DECIMAL(20,10), 1)::VARCHAR AS one_place,
              strftime(o_orderdate, '%Y-%m-%d') AS day, NULL::INT AS not_a_number FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").astype("string").alias("key_text"),
        F.col("o_totalprice").cast("bigint").alias("whole"),
        F.col("o_totalprice").cast("decimal(20,1)").cast("string").alias("one_place"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.col("o_orderstatus").try_cast("int").alias("not_a_number"),
    )


@query("rename", "P6", "SELECT s_suppkey AS supplier_id, s_name, s_nationkey, s_acctbal AS balance FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "supplier_id")
    return suppliers.withColumnRenamed("s_acctbal", "balance")


@query(
    "fill_nulls",
    "P7",
    """SELECT p_partkey, coalesce(nullif(p_size, 50), 0) AS filled, nullif(p_size, 50) AS kept,
              coalesce(nullif(p_retailprice, 900), -1) AS price FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = F.nullif("p_size", F.lit(50))
    parts = table(spark, sf, "part").select(
        "p_partkey", size.alias("filled"), size.alias("kept"), F.nullif("p_retailprice", F.lit(900.0)).alias("price")
    )
    return parts.fillna(0, subset=["filled"]).fillna({"price": -1.0})


@query(
    "case_when",
    "P8",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS two_way,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'rest' END AS nested
       FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, 1).otherwise(2).alias("two_way"),
        F.when(F.col("c_mktsegment") == "BUILDING", "b")
        .otherwise(F.when(F.col("c_acctbal") > 5000, "rich").otherwise("rest"))
        .alias("nested"),
    )


@query(
    "sentinel_greatest",
    "P9",
    """SELECT c_custkey, round((CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey * 300.0::DOUBLE
                ELSE greatest(c_acctbal, c_nationkey * 300.0::DOUBLE) END)::VARCHAR::DECIMAL(20,10), 1)::DOUBLE AS max_column
       FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.when(F.col("c_mktsegment") == "BUILDING", 99999999.0).otherwise(F.col("c_acctbal"))
    income = F.col("c_nationkey") * 300.0
    return table(spark, sf, "customer").select(
        "c_custkey", scalars.sentinel_greatest(amount, income).cast("double").alias("max_column")
    )


@query(
    "ratio",
    "P10",
    """SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE
              round((c_acctbal / (c_nationkey * 300.0::DOUBLE))::VARCHAR::DECIMAL(28,18), 5)::DOUBLE END AS ratio FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", scalars.ratio(F.col("c_acctbal"), F.col("c_nationkey") * 300.0).cast("double").alias("ratio")
    )


@query(
    "random_flag",
    "P11",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey || '-11'), 1, 8))::BIGINT / 4294967296.0 < 0.5
              THEN '2018-11-01' ELSE '2018-12-01' END AS day FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    flag = scalars.random_flag(11, F.col("o_orderkey"))
    day = F.when(flag == 0, F.lit("2018-11-01").cast("date")).otherwise(F.lit("2018-12-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", day.cast("string").alias("day"))


BRAND_SETS = {
    "cards": ["Brand#1", "Brand#2", "Brand#3"],
    "loans": ["Brand#4", "Brand#5"],
    "autos": ["Brand#10", "Brand#11", "Brand#12", "Brand#13"],
}


@query(
    "classify_by_sets",
    "P12",
    """SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'cards'
              WHEN p_brand IN ('Brand#4', 'Brand#5') THEN 'loans'
              WHEN p_brand IN ('Brand#10', 'Brand#11', 'Brand#12', 'Brand#13') THEN 'autos' END AS portfolio FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", scalars.classify_by_sets(F.col("p_brand"), BRAND_SETS).alias("portfolio")
    )


@query(
    "composite_key",
    "P13",
    """SELECT p_partkey, CASE WHEN p_partkey * 7 <= 9999 THEN '00' || p_size ||
              lpad((p_partkey * 7)::VARCHAR, 4, '0') || p_partkey END AS contract FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    branch = (F.col("p_partkey") * 7).cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", scalars.composite_key(F.col("p_size"), branch, F.col("p_partkey")).alias("contract")
    )


@query(
    "yyyymm_year",
    "P14",
    f"WITH {SCORE_SQL} SELECT cohort, (cohort // 100)::INT AS year, count(*) AS n FROM score GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return (
        score(spark, sf)
        .groupBy("cohort", scalars.yyyymm_year(F.col("cohort")).alias("year"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "parse_mixed_date",
    "P15",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    status, day = F.col("o_orderstatus"), F.col("o_orderdate")
    text = (
        F.when(status == "F", F.date_format(day, "dd/MM/yyyy"))
        .when(status == "O", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    parsed = scalars.parse_mixed_date(text).cast("string")
    return table(spark, sf, "orders").select("o_orderkey", parsed.alias("day"))


@query(
    "elapsed_time",
    "P16",
    """WITH d AS (SELECT event_id, (extract(hour FROM ts + INTERVAL 6 HOUR) - extract(hour FROM ts)) * 3600 AS s FROM events)
       SELECT event_id, s::BIGINT AS seconds, CASE WHEN s < 0 THEN '-1 day, ' ELSE '' END ||
              ((s + 86400) % 86400 // 3600) || ':00:00' AS elapsed FROM d""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_format("ts", "HH:mm:ss a")
    end = F.date_format(F.col("ts") + F.expr("interval 6 hours"), "HH:mm:ss a")
    return table(spark, sf, "events").select(
        "event_id", scalars.elapsed_seconds(start, end).alias("seconds"), scalars.elapsed_time(start, end).alias("elapsed")
    )


@query(
    "local_time_label",
    "P17",
    "SELECT event_id, strftime(ts - INTERVAL 6 HOUR, '%H:%M:%S %p') AS label FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", scalars.local_time_label(F.col("ts")).alias("label"))


@query("strip_suffix", "P18", "SELECT p_partkey, p_name AS name FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws(" ", "p_name", F.lit("-"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", scalars.strip_suffix(label).alias("name"))


@query(
    "split_field",
    "P19",
    "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_brand, '#', 2) AS number FROM part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        scalars.split_field(F.col("p_name"), " ", 1).alias("first"),
        scalars.split_field(F.col("p_brand"), "#", 2).alias("number"),
    )


@query("empty_to_null", "P20", "SELECT p_partkey, nullif(replace(p_type, 'ECONOMY', ''), '') AS kind FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    emptied = F.replace("p_type", F.lit("ECONOMY"), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", scalars.empty_to_null(emptied).alias("kind"))


@query(
    "indicator_columns",
    "P21",
    """SELECT p_brand AS variable, max(p_size >= 50)::INT AS large, max(p_retailprice < 905)::INT AS cheap
       FROM part GROUP BY p_brand""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumnRenamed("p_brand", "variable")
    lists = {"large": parts.filter(F.col("p_size") >= 50), "cheap": parts.filter(F.col("p_retailprice") < 905)}
    return indicator_columns(parts.select("variable").distinct(), lists)


@query(
    "label_concat",
    "P22",
    f"WITH {SCORE_SQL} SELECT segment || '_' || sample AS label, count(*) AS n FROM score GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    label = scalars.label_concat(F.col("segment"), F.col("sample"))
    return score(spark, sf).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "math_functions",
    "P23",
    """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log,
              abs(p_size - 25) AS distance, round(pow(p_size / 10.0::DOUBLE, 2), 6) AS square FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.round(F.sqrt("p_retailprice"), 6).alias("root"),
        F.round(F.ln("p_retailprice"), 6).alias("log"),
        F.abs(F.col("p_size") - 25).alias("distance"),
        F.round(F.pow(F.col("p_size") / 10.0, F.lit(2)), 6).alias("square"),
    )


@query(
    "compare",
    "F1",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity < 10 AND l_discount >= 0.05 AND l_returnflag = 'R' AND l_tax > 0.02""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    kept = lines.filter(lines.l_quantity < 10).filter("l_discount >= 0.05d and l_returnflag = 'R'")
    return kept.filter(F.col("l_tax") > 0.02).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "boolean_filter",
    "F2",
    "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_type = 'ECONOMY' AND NOT p_brand = 'Brand#1'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = (F.col("p_size") > 10) & (F.col("p_type") == "ECONOMY") & ~(F.col("p_brand") == "Brand#1")
    return table(spark, sf, "part").filter(kept).select("p_partkey", "p_size")


@query(
    "null_tests",
    "F3",
    "SELECT count(*) FILTER (p_size = 50) AS unknown, count(*) FILTER (p_size <> 50 AND p_retailprice <> 900) AS known FROM part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        F.nullif("p_size", F.lit(50)).alias("size"), F.nullif("p_retailprice", F.lit(900.0)).alias("price")
    )
    known = F.col("size").isNotNull() & F.col("price").isNotNull()
    return parts.agg(F.count_if(F.col("size").isNull()).alias("unknown"), F.count_if(known).alias("known"))


@query(
    "in_list",
    "F4",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
       AND o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").filter("o_orderpriority in ('1-URGENT', '2-HIGH')")
    kept = orders.filter(F.col("o_orderstatus").isin("F", "P")).join(listed, "o_custkey", "left_semi")
    return kept.select("o_orderkey", "o_orderpriority")


@query(
    "drop_sentinels",
    "F5",
    """SELECT p_partkey, nullif(p_size, 1) AS size FROM part WHERE nullif(p_size, 1) NOT IN (49, 50)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("size"))
    return relational.drop_sentinels(parts, "size", [49, 50])


@query(
    "range_filter",
    "F6",
    """SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 30
       AND p_retailprice BETWEEN 905 AND 1050 AND p_type IN ('ECONOMY', 'SMALL') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = relational.range_filter(
        table(spark, sf, "part"),
        {"p_size": (10, 30), "p_retailprice": (905, 1050)},
        {"p_type": ["ECONOMY", "SMALL"], "p_brand": ["Brand#1", "Brand#2", "Brand#3"]},
    )
    return kept.select("p_partkey", "p_size", "p_retailprice")


@query("drop_null_rows", "F7", "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size <> 50 AND p_brand <> 'Brand#1'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(50)).alias("p_size"), F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand")
    )
    return relational.drop_null_rows(parts, ["p_size", "p_brand"])


@query(
    "split_at_threshold",
    "F8",
    """SELECT CASE WHEN o_orderdate < '1998-01-01' THEN 'before' ELSE 'after' END AS side, count(*) AS n,
              round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    threshold = orders.schema["o_orderdate"].dataType.typeName()
    side = relational.side_of("o_orderdate", date(1998, 1, 1) if threshold == "date" else datetime(1998, 1, 1))
    sides = orders.withColumn("side", side).filter("side is not null").groupBy("side")
    return sides.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
