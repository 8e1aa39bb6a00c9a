"""Queries on joins, aggregates, windows, ordering, sets, reshaping and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.catalog.registry import (
    MELT_SQL,
    ROW_KEYS,
    SCORE_SQL,
    SPECIAL,
    VARIABLES,
    query,
    score,
    table,
)
from cohortwise.functions.quantiles import exact_quantiles, quantiles_approx
from cohortwise.operators import aggregates, relational, sampling
from cohortwise.plans.charts import control_limits
from cohortwise.plans.curves import profile_fill


# --- joins -----------------------------------------------------------------------------------


@query(
    "left_join_chain",
    "J1",
    """SELECT c_custkey, c_mktsegment, n_orders, n_events FROM customer
       JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
       JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    clients = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))
    return relational.left_join_chain(clients, "c_custkey", [orders, events], ["n_orders", "n_events"])


@query(
    "left_join_buckets",
    "J2",
    f"""WITH {SCORE_SQL},
        x AS (SELECT l_quantity AS bucket, count(*) AS frequency_x FROM score WHERE sample = 'test' GROUP BY 1),
        y AS (SELECT l_quantity AS bucket, count(*) AS frequency_y FROM score WHERE sample = 'train' AND l_quantity < 40 GROUP BY 1)
        SELECT bucket, frequency_x, frequency_y FROM x LEFT JOIN y USING (bucket)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = score(spark, sf).withColumnRenamed("l_quantity", "bucket")
    x = rows.filter("sample = 'test'").groupBy("bucket").agg(F.count("*").alias("frequency_x"))
    y = rows.filter("sample = 'train' and bucket < 40").groupBy("bucket").agg(F.count("*").alias("frequency_y"))
    return x.join(y, "bucket", "left")


@query(
    "left_join_totals",
    "J3",
    f"""WITH {SCORE_SQL}, c AS (SELECT cohort, l_discount, count(*) AS freq FROM score GROUP BY ALL)
        SELECT cohort, l_discount, freq, sum(freq) OVER (PARTITION BY cohort)::BIGINT AS total FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    counts = score(spark, sf).groupBy("cohort", "l_discount").agg(F.count("*").alias("freq"))
    return relational.share_within(counts, ["cohort"], "freq", total="total").select("cohort", "l_discount", "freq", "total")


# --- aggregates ------------------------------------------------------------------------------


@query(
    "global_agg",
    "A1",
    """SELECT round(sum(value), 4) AS total, max(value) AS largest, min(value) AS smallest,
              round(avg(value), 6) AS mean FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(
        F.round(F.sum("value"), 4).alias("total"),
        F.max("value").alias("largest"),
        F.min("value").alias("smallest"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


@query(
    "group_simple",
    "A2",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "events").groupBy("event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest"))


@query(
    "group_multi",
    "A3",
    """SELECT event_type, user_id, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) AS n
       FROM events GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy("event_type", "user_id")
        .agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
        .orderBy(F.desc("total"), F.asc("user_id"))
    )


@query(
    "group_sum_numeric",
    "A4",
    """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, sum(units)::BIGINT AS units, round(sum(value), 4) AS value
       FROM (SELECT *, 1 AS units FROM events) GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    sales = table(spark, sf, "events").select(
        "event_type", F.col("ts").cast("date").cast("string").alias("day"), F.lit(1).alias("units"), "value", "props"
    )
    return aggregates.group_sum_numeric(sales, ["event_type", "day"]).withColumn("value", F.round("value", 4))


@query(
    "group_mean",
    "A5",
    f"WITH {SCORE_SQL} SELECT cohort, round(avg(l_extendedprice), 4) AS l_extendedprice FROM score GROUP BY cohort",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = aggregates.group_mean(score(spark, sf), ["cohort"], ["l_extendedprice"])
    return means.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(
    "distinct_and_spread",
    "A6",
    """SELECT l_returnflag, count(DISTINCT l_quantity) AS n_distinct, round(avg(l_quantity), 6) AS mean,
              round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    spread = aggregates.distinct_and_spread(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return spread.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _profile_sql(quartiles: bool) -> str:
    extra = (
        ", quantile_disc(v, 0.25) AS q_25, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.75) AS q_75"
        if quartiles
        else ""
    )
    parts = " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS v FROM lineitem" for v in VARIABLES)
    return f"""SELECT variable, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
                      min(v) AS min, max(v) AS max{extra} FROM ({parts}) GROUP BY variable"""


@query("describe", "A7", _profile_sql(False))
def _(spark: SparkSession, sf: str) -> DataFrame:
    table_ = aggregates.describe(table(spark, sf, "lineitem"), VARIABLES)
    return table_.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("numeric_profile", "A8", _profile_sql(True))
def _(spark: SparkSession, sf: str) -> DataFrame:
    table_ = aggregates.numeric_profile(table(spark, sf, "lineitem"), VARIABLES)
    return table_.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "null_counts",
    "A9",
    """SELECT count(*) FILTER (l_quantity = 50) AS l_quantity, 0::BIGINT AS l_extendedprice,
              count(*) FILTER (l_discount = 0) AS l_discount, count(*) FILTER (l_tax = 0) AS l_tax FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.null_counts(relational.null_out_sentinels(table(spark, sf, "lineitem"), SPECIAL), VARIABLES)


@query(
    "share_table",
    "A10",
    """SELECT p_brand, count(*) AS count, count(*)::DOUBLE / (SELECT count(*) FROM part) AS proportion FROM part GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.share_table(table(spark, sf, "part"), ["p_brand"])


@query(
    "quantiles_exact",
    "A11",
    """SELECT l_returnflag, l_linestatus, p.i::INT AS position,
              CASE p.i WHEN 1 THEN q[1] WHEN 2 THEN q[2] WHEN 3 THEN q[3] ELSE q[4] END AS value
       FROM (SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS q
             FROM lineitem GROUP BY ALL), (SELECT unnest([1, 2, 3, 4]) AS i) p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    return exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", ["0.2", "0.4", "0.6", "0.8"], keys)


@query(
    "quantiles_five",
    "A12",
    f"""WITH {SCORE_SQL}, {MELT_SQL}
        SELECT variable, min(value) AS q_0, quantile_disc(value, 0.25) AS q_25, quantile_disc(value, 0.5) AS median,
               quantile_disc(value, 0.75) AS q_75, max(value) AS q_100 FROM melt GROUP BY variable""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    long = relational.melt_numeric(relational.null_out_sentinels(score(spark, sf), SPECIAL), VARIABLES)
    exact = exact_quantiles(long, "value", ["0", "0.25", "0.5", "0.75", "1"], ["variable"], few=True)
    five = exact.groupBy("variable").pivot("position", [1, 2, 3, 4, 5]).agg(F.max("value"))
    return five.toDF("variable", "q_0", "q_25", "median", "q_75", "q_100")


@query(
    "quantiles_approx",
    "A12",
    " UNION ALL ".join(f"SELECT '{v}' AS variable, {i} AS position, true AS within" for v in VARIABLES for i in range(5)),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the true rank of each approximate quantile is within the sketch's accuracy."""
    points, accuracy = [0.0, 0.25, 0.5, 0.75, 1.0], 10_000
    long = relational.melt_numeric(relational.null_out_sentinels(score(spark, sf), SPECIAL), VARIABLES)
    sketch = quantiles_approx(long, "value", points, ["variable"], accuracy)
    ranks = [F.struct(F.count_if(F.col("value") < F.col("quantiles")[i]).alias("below"), F.count_if(F.col("value") <= F.col("quantiles")[i]).alias("upto")) for i in range(5)]
    counted = long.join(F.broadcast(sketch), "variable").groupBy("variable").agg(F.count("value").alias("n"), F.array(*ranks).alias("r"))
    each = counted.select("variable", "n", F.posexplode("r").alias("position", "r"))
    wanted = F.element_at(F.array(*map(F.lit, points)), F.col("position") + 1) * F.col("n")
    slack = F.col("n") / accuracy + 1
    return each.select("variable", "position", ((F.col("r.below") <= wanted + slack) & (F.col("r.upto") >= wanted - slack)).alias("within"))


def _pairs_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(VARIABLES) for b in VARIABLES[i + 1 :]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS row, '{b}' AS column, round(abs(corr({a}, {b})), 8) AS correlation FROM lineitem" for a, b in pairs
    )


@query("pearson_matrix", "A13", _pairs_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = aggregates.pearson_matrix(table(spark, sf, "lineitem"), VARIABLES)
    return pairs.withColumn("correlation", F.round("correlation", 8))


@query(
    "lookup_join",
    "J4",
    f"""WITH pairs AS ({_pairs_sql()}), means AS ({_profile_sql(False)})
        SELECT p.row, p.column, p.correlation, a.mean AS row_mean, b.mean AS column_mean
        FROM pairs p LEFT JOIN means a ON a.variable = p.row LEFT JOIN means b ON b.variable = p.column""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    pairs = aggregates.pearson_matrix(lines, VARIABLES).withColumn("correlation", F.round("correlation", 8))
    means = aggregates.describe(lines, VARIABLES).withColumn("mean", F.round("mean", 6))
    both = relational.lookup_join(pairs, means, "row", "variable", "mean", "row_mean")
    return relational.lookup_join(both, means, "column", "variable", "mean", "column_mean")


LINES = range(1, 8)


def curve_families(spark: SparkSession, sf: str) -> DataFrame:
    """weight_i, value_i, mean_i and flag_i by line number: the wide input of the curve reports."""
    lines = table(spark, sf, "lineitem")
    columns = []
    for i in LINES:
        here = F.col("l_linenumber") == i
        columns += [
            F.when(here, F.col("l_quantity")).alias(f"weight_{i}"),
            F.when(here, F.col("l_discount")).alias(f"value_{i}"),
            F.when(here, F.col("l_tax")).alias(f"mean_{i}"),
            F.when(here, 1).alias(f"flag_{i}"),
        ]
    return lines.select("l_returnflag", "l_linestatus", *columns)


def _weighted_std(spark: SparkSession, sf: str, error: bool) -> DataFrame:
    names = {kind: [f"{kind}_{i}" for i in LINES] for kind in ("weight", "value", "mean", "flag")}
    wide = aggregates.weighted_std(
        curve_families(spark, sf), ["l_returnflag"], names["weight"], names["value"], names["mean"], names["flag"], error
    )
    return wide.withColumns({c: F.round(c, 8) for c in wide.columns if c.startswith(("std", "error"))})


def _weighted_std_sql(error: bool) -> str:
    columns = []
    for i in LINES:
        f = f"FILTER (l_linenumber = {i})"
        std = f"""sqrt(sum(l_quantity * pow(l_discount - l_tax, 2)) {f} /
                  ((count(*) {f} - 1) * sum(l_quantity) {f} / count(*) {f}))"""
        columns.append(f"round({std}, 8) AS std_{i}")
        if error:
            columns.append(f"round({std} / sqrt(sum(l_quantity) {f}), 8) AS error_{i}")
    return f"SELECT l_returnflag, {', '.join(columns)}, count(*) AS freq FROM lineitem GROUP BY l_returnflag"


@query("weighted_std", "A14", _weighted_std_sql(False))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted_std(spark, sf, False)


@query("weighted_std_error", "A15", _weighted_std_sql(True))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted_std(spark, sf, True)


@query(
    "ordered_rows",
    "A17",
    """SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate), o_orderpriority, o_totalprice) AS position,
              year(o_orderdate)::INT AS year, o_orderpriority || ' ' || o_totalprice::DECIMAL(12,2) AS profile
       FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Few keys with many distinct values each, which as arrays would each be one task's."""
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    profile = F.struct(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").cast("decimal(12,2)").alias("t"))
    known = orders.where("o_orderpriority is not null and o_totalprice is not null")
    rows = aggregates.ordered_rows(known, ["o_orderstatus"], "year", profile, "_s")
    return rows.select("o_orderstatus", "position", "year", F.concat_ws(" ", "_s.p", "_s.t").alias("profile"))


@query(
    "collect_ordered",
    "A17",
    """SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY year(o_orderdate), o_orderpriority) AS profiles
       FROM orders GROUP BY o_custkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    lists = aggregates.collect_ordered(orders, ["o_custkey"], "year", F.col("o_orderpriority"), "profiles")
    return lists.withColumn("profiles", F.array_join("profiles", "|"))


@query(
    "join_strings",
    "A18",
    f"""WITH pairs AS ({_pairs_sql()})
        SELECT row, string_agg("column", ' & ' ORDER BY "column") AS partners FROM pairs GROUP BY row""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = aggregates.pearson_matrix(table(spark, sf, "lineitem"), VARIABLES)
    return aggregates.join_strings(pairs.filter("correlation >= 0"), ["row"], "column", "partners")


@query("distinct_values", "A19", "SELECT DISTINCT p_brand FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.distinct_values(table(spark, sf, "part"), "p_brand")


@query(
    "dedup_group",
    "A20",
    "SELECT DISTINCT o_orderstatus, o_orderpriority, max(o_totalprice) AS largest FROM orders GROUP BY 1, 2",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.max("o_totalprice").alias("largest"))


# --- windows ---------------------------------------------------------------------------------


@query(
    "share_of_total",
    "W1",
    """SELECT o_custkey, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 10) AS proportion
       FROM orders GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("count"))
    return relational.share_of_total(counts).withColumn("proportion", F.round("proportion", 10))


@query(
    "profile_fill",
    "W2",
    """WITH yearly AS (SELECT o_custkey, year(o_orderdate) AS y, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY ALL),
       grid AS (SELECT o_custkey, y.y, m.m, greatest(1996, y.y - (m.m <> 12)::INT) AS upto
                FROM (SELECT DISTINCT o_custkey FROM yearly), (SELECT unnest(range(1996, 1999)) AS y) y,
                     (SELECT unnest(range(1, 13)) AS m) m)
       SELECT g.o_custkey, (g.y * 100 + g.m)::INT AS period, arg_max(k.p, k.y) AS profile
       FROM grid g LEFT JOIN yearly k ON k.o_custkey = g.o_custkey AND k.y BETWEEN 1996 AND g.upto GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    yearly = table(spark, sf, "orders").select(
        "o_custkey", (F.year("o_orderdate") * 100 + 12).alias("period"), F.col("o_orderpriority").alias("profile"), "o_orderkey"
    )
    return profile_fill(yearly, "o_custkey", "period", "profile", 1996, 1998, order="o_orderkey")


@query(
    "control_limits",
    "W3",
    f"""WITH {SCORE_SQL}, m AS (SELECT cohort, segment, avg(l_extendedprice) AS mean FROM score GROUP BY ALL)
        SELECT cohort, segment, round(mean, 4) AS mean,
               round(avg(mean) OVER w - 5 * stddev_samp(mean) OVER w, 4) AS lower,
               round(avg(mean) OVER w + 5 * stddev_samp(mean) OVER w, 4) AS upper
        FROM m WINDOW w AS (PARTITION BY segment)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = score(spark, sf).groupBy("cohort", "segment").agg(F.avg("l_extendedprice").alias("mean"))
    limits = control_limits(means, "mean", ["segment"])
    return limits.withColumns({c: F.round(c, 4) for c in ("mean", "lower", "upper")})


# --- order -----------------------------------------------------------------------------------


@query("order_by", "L1", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC")
def _(spark: SparkSession, sf: str) -> DataFrame:
    clients = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return clients.orderBy(F.asc("c_mktsegment"), F.desc("c_acctbal"))


@query("top_rows", "L2", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 20")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return relational.top_rows(lines, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey")], 20)


@query(
    "bottom_k",
    "L3",
    "SELECT p_brand, sum(p_size)::BIGINT AS weight FROM part GROUP BY 1 ORDER BY weight, p_brand DESC LIMIT 5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    weights = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").alias("weight"))
    return relational.top_rows(weights, [F.asc("weight"), F.desc("p_brand")], 5)


@query(
    "threshold_rank",
    "L4",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 ORDER BY n DESC",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return relational.threshold_rank(counts, "n", 12)


# --- sets ------------------------------------------------------------------------------------


@query(
    "union_all",
    "X1",
    """SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS kind FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    clients = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id")
    )
    return relational.union_all(clients, suppliers)


@query(
    "except_distinct",
    "X2",
    "SELECT l_quantity, l_discount, l_tax FROM lineitem EXCEPT SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_returnflag = 'R'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    columns = ["l_quantity", "l_discount", "l_tax"]
    return relational.except_distinct(lines.select(*columns), lines.filter("l_returnflag = 'R'").select(*columns))


@query(
    "except_all",
    "X2",
    """SELECT l_quantity, l_discount, l_tax FROM lineitem EXCEPT ALL
       SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_returnflag <> 'R'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    columns = ["l_quantity", "l_discount", "l_tax"]
    return relational.except_all(lines.select(*columns), lines.filter("l_returnflag <> 'R'").select(*columns))


# --- reshape ---------------------------------------------------------------------------------


@query(
    "pivot_long_to_wide",
    "H1",
    "SELECT o_custkey, "
    + ", ".join(f"max(o_totalprice) FILTER (year(o_orderdate) = {y}) AS cohor_{y}" for y in range(1995, 2002))
    + " FROM orders GROUP BY o_custkey",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return relational.pivot_long_to_wide(orders, ["o_custkey"], "year", list(range(1995, 2002)), "o_totalprice", "cohor_")


@query(
    "unpivot_wide_to_long",
    "H2",
    """SELECT p_partkey, 'size' AS variable, p_size::DOUBLE AS value FROM part
       UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")
    )
    return relational.unpivot_wide_to_long(parts, ["p_partkey"], ["size", "price"])


@query(
    "explode_array",
    "H3",
    """SELECT vec_id, i::INT AS position, round(embedding[i]::DOUBLE, 6) AS value
       FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    rows = relational.explode_array(vectors, "embedding", "value")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(
    "columns_to_vector",
    "H4",
    """SELECT p_partkey, p_size::DOUBLE AS back_1, p_retailprice AS back_2, 2::INT AS width FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("x_1"), F.col("p_retailprice").alias("x_2")
    )
    vectors = relational.columns_to_vector(parts, "x", 2, "v").withColumn("width", F.size("v"))
    return relational.vector_to_columns(vectors, "v", "back", 2)


# --- samples ---------------------------------------------------------------------------------


def _kept_sql(fraction: float, seed: int, *keys: str) -> str:
    text = " || '-' || ".join([*keys, f"'{seed}'"])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0 < {fraction}"


@query("sample_simple", "R1", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_kept_sql(0.3, 5, 'o_orderkey')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_simple(orders, 0.3, 5, ["o_orderkey"])


@query(
    "sample_stratified",
    "R2",
    f"""WITH t AS (SELECT {", ".join(ROW_KEYS)}, (l_returnflag = 'R')::INT AS target FROM lineitem)
        SELECT * FROM t WHERE {_kept_sql(0.2, 5, *ROW_KEYS, "target")}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*ROW_KEYS, (F.col("l_returnflag") == "R").cast("int").alias("target"))
    return sampling.sample_stratified(lines, "target", 0.2, 5, ROW_KEYS)


@query(
    "split_train_test",
    "R3",
    f"""WITH {SCORE_SQL.replace("AS sample,", "AS sample, l_orderkey, l_partkey, l_suppkey, l_linenumber,")}
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, sample FROM score""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*ROW_KEYS, (F.col("l_returnflag") == "R").cast("int").alias("target"))
    return sampling.split_train_test(lines, "target", ROW_KEYS, 0.7, seed=42).drop("target")
