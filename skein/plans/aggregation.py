"""Aggregates, grouping sets, pivots and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import sketches
from skein.operators.order import percentiles, ranked, tile
from skein.operators.slices import over_slices
from skein.plans.registry import query
from skein.sources.tables import table


@query("""
    SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(avg(l_discount), 6) AS avg_disc,
        min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n,
        round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS corr
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
        F.count("*").alias("n"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
        F.round(F.var_pop("l_quantity"), 6).alias("var"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"),
    )


@query("""
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem GROUP BY l_returnflag""")
def agg2_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")
    )


GROUPED = """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty
    FROM lineitem GROUP BY {}"""


def _measures():
    return [F.grouping_id().alias("gid"), F.count("*").alias("n"), F.sum("l_quantity").alias("qty")]


@query(GROUPED.format("CUBE (l_returnflag, l_linestatus)"))
def agg3_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(*_measures())


@query(GROUPED.format("ROLLUP (l_returnflag, l_linestatus)"))
def agg3_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(*_measures())


@query(GROUPED.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def agg3_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    sets = [[rows["l_returnflag"]], [rows["l_linestatus"]], []]
    return rows.groupingSets(sets, "l_returnflag", "l_linestatus").agg(*_measures())


@query("""
    SELECT l_returnflag, median(l_quantity) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, quantile_disc(l_quantity, 0.25) AS q25
    FROM lineitem GROUP BY l_returnflag""")
def agg4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    quantity = percentiles(rows, ["l_returnflag"], "l_quantity", 10.0, {"median": (0.5, True), "q25": (0.25, False)})
    price = percentiles(rows, ["l_returnflag"], "l_extendedprice", 500.0, {"p90": (0.9, True)})
    return quantity.join(price, "l_returnflag").select("l_returnflag", "median", F.round("p90", 4).alias("p90"), "q25")


@query()
def agg5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates only; tests hold them to an error bound."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("approx_parts"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(14))).alias("hll_parts"),
        F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("theta_parts"),
        F.percentile_approx("l_extendedprice", 0.5, 10000).alias("approx_median"),
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("l_extendedprice", F.lit(400)), F.lit(0.5)).alias("kll_median"),
    )


def _daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events with their day, and the stored sketches of each day and type."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "user_id", "value")
    return events, sketches.stored(sketches.sketched(events, ["day", "event_type"], "user_id", "value"), ["day"])


@query("""
    SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS hll_holds, true AS theta_holds, true AS ranks_hold
    FROM events GROUP BY event_type""")
def agg5_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of days merged to the whole time, held against exact counts: distinct users
    within the error, and the ranks of the merged quantiles."""
    events, daily = _daily(spark, sf_dir)
    whole = sketches.merged(daily, ["event_type"])
    marks = {f"q{int(100 * f)}": f for f in (0.1, 0.5, 0.9)}
    estimated = whole.select("event_type", sketches.distinct(F.col("hll")).alias("hll_users"), F.theta_sketch_estimate("theta").alias("theta_users"), *[sketches.quantile(F.col("kll"), f).alias(q) for q, f in marks.items()])
    joined = events.join(estimated, "event_type")  # a row for each of few types: Spark sees its size
    ranks = [(F.sum((F.col("value") <= F.col(q)).cast("long")) / F.count("*")).alias(f"r_{q}") for q in marks]
    users = events.groupBy("event_type", "user_id").agg(F.lit(1)).groupBy("event_type").agg(F.count("*").alias("users"))
    exact = joined.groupBy("event_type").agg(F.count("*").alias("rows"), F.first("hll_users").alias("hll_users"), F.first("theta_users").alias("theta_users"), *ranks).join(users, "event_type")
    near = F.lit(True)
    for q, f in marks.items():
        near = near & (F.abs(F.col(f"r_{q}") - f) <= sketches.KLL_ERROR)
    return exact.select(
        "event_type", "rows", "users",
        sketches.within(F.col("hll_users"), F.col("users"), sketches.HLL_ERROR).alias("hll_holds"),
        sketches.within(F.col("theta_users"), F.col("users"), sketches.THETA_ERROR).alias("theta_holds"),
        near.alias("ranks_hold"),
    )


@query("""
    WITH half AS (
        SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) < (SELECT CAST(min(ts) AS DATE) + 15 FROM events) AS early FROM events
    ), users AS (
        SELECT event_type, user_id, bool_or(early) AS a, bool_or(NOT early) AS b FROM half GROUP BY ALL
    ) SELECT event_type, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS first_only, true AS both_hold, true AS first_only_holds
    FROM users GROUP BY event_type""")
def agg5_common_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of both halves of the time, and of the first alone, from stored days."""
    events, daily = _daily(spark, sf_dir)
    start = events.agg(F.min("day").alias("d")).head()["d"]
    early = (F.col("day") < F.date_add(F.lit(start), 15)).alias("early")
    side = lambda flag, name: sketches.merged(daily.where(early == flag), ["event_type"]).select("event_type", F.col("theta").alias(name))
    estimated = side(True, "a").join(side(False, "b"), "event_type").select("event_type", sketches.common(F.col("a"), F.col("b")).alias("e_both"), sketches.only_first(F.col("a"), F.col("b")).alias("e_first"))
    users = events.groupBy("event_type", "user_id").agg(F.bool_or(early).alias("a"), F.bool_or(~early).alias("b"))
    exact = users.groupBy("event_type").agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first_only"), F.count("*").alias("n"))
    # The error of an intersection is one of the union's size.
    holds = lambda e, x: F.abs(F.col(e) - F.col(x)) <= F.greatest(F.col("n") * sketches.THETA_ERROR, F.lit(1.0))
    return exact.join(estimated, "event_type").select("event_type", "both", "first_only", holds("e_both", "both").alias("both_hold"), holds("e_first", "first_only").alias("first_only_holds"))


@query("""
    SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list_sort(list(n_nationkey)) AS keys, arg_max(n_name, n_nationkey) AS last_name,
        bool_and(n_nationkey >= 0) AS all_positive, CAST(count_if(n_nationkey > 10) AS BIGINT) AS high
    FROM nation GROUP BY n_regionkey""")
def agg6_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"),
        F.array_sort(F.collect_list("n_nationkey")).alias("keys"),
        F.max_by("n_name", "n_nationkey").alias("last_name"),
        F.bool_and(F.col("n_nationkey") >= 0).alias("all_positive"),
        F.count_if(F.col("n_nationkey") > 10).alias("high"),
    )


@query("""
    SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f,
        round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS p
    FROM orders GROUP BY o_orderpriority""")
def agg7_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))
    return wide.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("""
    SELECT s_suppkey, 'balance' AS what, s_acctbal AS value FROM supplier
    UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""")
def agg7_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return rows.unpivot("s_suppkey", ["balance", "nation"], "what", "value")


@query("""
    SELECT p_partkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER b AS INTEGER) AS rk, CAST(dense_rank() OVER b AS INTEGER) AS dr,
        CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER b, 9) AS pr, round(cume_dist() OVER b, 9) AS cd
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), b AS (PARTITION BY p_brand ORDER BY p_size)""")
def win1_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return ranked(rows, ["p_brand"], "p_size", ["p_partkey"], 10.0).select(
        "p_partkey",
        F.col("row_number").cast("int").alias("rn"),
        F.col("rank").cast("int").alias("rk"),
        F.col("dense_rank").cast("int").alias("dr"),
        tile(4).cast("int").alias("quarter"),
        F.round("percent_rank", 9).alias("pr"),
        F.round("cume_dist", 9).alias("cd"),
    )


@query("""
    SELECT p_partkey, lag(p_size, 1, -1) OVER w AS before, lead(p_size, 2) OVER w AS after, first_value(p_partkey) OVER w AS first,
        last_value(p_partkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
        nth_value(p_partkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def win2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    found = over_slices(
        rows, ["p_brand"], [F.asc("p_size"), F.asc("p_partkey")],
        lag={"before": ("p_size", 1, -1)}, lead={"after": ("p_size", 2, None)}, first={"first": "p_partkey"}, last={"last": "p_partkey"}, nth={"second": ("p_partkey", 2)},
    )
    return found.select("p_partkey", "before", "after", "first", "last", "second")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three,
        count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near
    FROM lineitem""")
def win3_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(-2, 0)
    near = Window.partitionBy("l_orderkey").orderBy("l_quantity").rangeBetween(-5, 5)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sum("l_quantity").over(rows).alias("last_three"), F.count("*").over(near).alias("near")
    )
