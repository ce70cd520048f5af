"""Scans, projections, joins, set operations and sorts over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.joins import theta_totals, top_n_per_key
from skein.plans.registry import query
from skein.sources import formats
from skein.sources.calendar import calendar_source
from skein.sources.tables import table


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""
    SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01'""")
def scan1_pruned_and_pushed_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "lineitem")
        .where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1996-02-01")))
        .select("l_orderkey", "l_quantity", "l_extendedprice")
    )


ALL_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(ALL_ORDERS)
def scan2_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.round_trip(table(spark, sf_dir, "orders"), "csv", header="true")


@query(ALL_ORDERS)
def scan2_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.round_trip(table(spark, sf_dir, "orders"), "json")


@query(ALL_ORDERS)
def scan2_orc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.round_trip(table(spark, sf_dir, "orders"), "orc")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def scan3_partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = formats.partitioned(table(spark, sf_dir, "orders"), ["o_orderstatus"])
    return written.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""
    SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def scan3_dynamic_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored by nation: the join names the nations, and only their folders are read."""
    stored = formats.partitioned(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_nationkey"])
    asia = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return stored.join(asia, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_name")


@query()
def scan4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").sample(fraction=0.1, seed=7)


@query("""
    SELECT CAST(d AS DATE) AS day, CAST(dayofyear(d) AS INTEGER) AS day_of_year
    FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY) g(d)""")
def scan5_custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(calendar_source())
    days = spark.read.format("calendar").options(start="1996-01-01", stop="1997-12-31", slices="4").load()
    return days.select("day", F.dayofyear("day").alias("day_of_year"))


@query("""
    SELECT CAST(d AS DATE) AS day, count(event_id) AS events
    FROM generate_series((SELECT date_trunc('week', min(ts)) FROM events), (SELECT max(ts) FROM events), INTERVAL 1 DAY) g(d)
    LEFT JOIN (SELECT *, CAST(ts AS DATE) AS on_day FROM events WHERE event_type = 'signup' AND user_id % 30 = 0) e ON on_day = CAST(d AS DATE) GROUP BY d""")
def scan5_calendar_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users' signups on each day of the table's time, days without any included: the
    days come from the custom source, from the Monday before the first event on."""
    events = table(spark, sf_dir, "events")
    edges = events.agg(F.date_trunc("week", F.min("ts")).cast("date").alias("a"), F.max("ts").cast("date").alias("b")).head()
    spark.dataSource.register(calendar_source())
    days = spark.read.format("calendar").options(start=str(edges["a"]), stop=str(edges["b"]), slices="4").load()
    counts = events.where("event_type = 'signup' and user_id % 30 = 0").groupBy(F.col("ts").cast("date").alias("on_day")).agg(F.count("*").alias("n"))
    return days.join(counts, F.col("day") == F.col("on_day"), "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("events"))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(12, 2)) * (CAST(1 AS DECIMAL(3, 2)) - CAST(l_discount AS DECIMAL(3, 2)))
            * (CAST(1 AS DECIMAL(3, 2)) + CAST(l_tax AS DECIMAL(3, 2))), 2) AS DOUBLE) AS charge,
        CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS class
    FROM lineitem""")
def proj1_computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money is multiplied as decimals, as halves of a cent are not exact in doubles."""
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    price, discount, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(3,2)"), F.col("l_tax").cast("decimal(3,2)")
    charge = F.round(price * (F.lit(1) - discount) * (F.lit(1) + tax), 2).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"), size.alias("class"))


@query("""
    SELECT p_partkey, p_name, p_size FROM part
    WHERE p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')
        AND p_type LIKE '%E%' AND NOT regexp_matches(p_name, '^z') AND p_retailprice IS NOT NULL""")
def proj2_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("p_size").between(10, 30) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")
    keep &= F.col("p_type").like("%E%") & ~F.col("p_name").rlike("^z") & F.col("p_retailprice").isNotNull()
    return table(spark, sf_dir, "part").where(keep).select("p_partkey", "p_name", "p_size")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join1_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    return table(spark, sf_dir, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


def _outer(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id").select("label_id", "quality")
    return docs.join(labels, F.col("doc_id") == F.col("label_id"), how)


OUTER = """
    SELECT doc_id, lang, label_id, quality FROM (SELECT doc_id, lang FROM documents WHERE lang = 'en') d
    {} JOIN (SELECT doc_id AS label_id, quality FROM labels) l ON doc_id = label_id"""


@query(OUTER.format("LEFT"))
def join2_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "left")


@query(OUTER.format("RIGHT"))
def join2_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "right")


@query(OUTER.format("FULL"))
def join2_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "full")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join3_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join3_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def join3_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT o_orderkey FROM {o} WHERE o_custkey NOT IN (SELECT c_custkey FROM {c} WHERE c_acctbal > 0)",
        o=table(spark, sf_dir, "orders"),
        c=table(spark, sf_dir, "customer"),
    )


@query("""
    SELECT a.s_suppkey AS s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b
    ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal GROUP BY a.s_suppkey""")
def join4_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    poorer = rows.select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("low"))
    richer = rows.select("s_nationkey", F.col("s_acctbal").alias("high"))
    return theta_totals(poorer, richer, ["s_nationkey"], "low", "high", {}).groupBy("s_suppkey").agg(F.sum("pairs").alias("richer"))


@query("""
    SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey % 7 * (c_custkey % 5)) AS BIGINT) AS mixed FROM orders JOIN customer ON o_totalprice < c_acctbal
    WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderstatus""")
def join4_theta_without_a_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of products over pairs is made of the sums of both sides, so no pair is made."""
    orders = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_totalprice").agg(F.count("*").alias("rows"), F.sum(F.col("o_orderkey") % 7).alias("left"))
    builders = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey") % 5, "c_acctbal").toDF("rest", "c_acctbal")
    found = theta_totals(orders, builders, [], "o_totalprice", "c_acctbal", {"right": "rest"})
    return found.groupBy("o_orderstatus").agg(F.sum(F.col("rows") * F.col("pairs")).alias("n"), F.sum(F.col("left") * F.col("right")).alias("mixed"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_regionkey <> r_regionkey")
def join4_cross_of_fixed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).where("n_regionkey <> r_regionkey").select("r_name", "n_name")


HINTED = "SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderpriority"


def _hinted(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    builders = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").hint(hint)
    return table(spark, sf_dir, "orders").join(builders, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(HINTED)
def join5_merge_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hinted(spark, sf_dir, "merge")


@query(HINTED)
def join5_shuffle_hash_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hinted(spark, sf_dir, "shuffle_hash")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join5_broadcast_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation has 25 rows at every scale."""
    nations = table(spark, sf_dir, "nation").hint("broadcast")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("""
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def join8_lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer())
    best = own.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")
    return table(spark, sf_dir, "customer").lateralJoin(best).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)""")
def join8_lateral_top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name""")
def join9_regional_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    local = (
        t("supplier")
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_nationkey", "n_name")
    )
    return (
        t("lineitem")
        .join(local, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .groupBy("n_name")
        .agg(F.round(F.sum(revenue()), 2).alias("revenue"))
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders
    ORDER BY price ASC NULLS LAST, o_orderkey""")
def sort1_explicit_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price")).orderBy(F.asc_nulls_last("price"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sort2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("""
    SELECT c_nationkey, c_custkey, c_acctbal FROM (
        SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3""")
def sort2_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n_per_key(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


SETS = "SELECT c_nationkey AS k FROM customer {} SELECT s_nationkey AS k FROM supplier"


@query(SETS.format("UNION ALL"))
def set1_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b)


@query(SETS.format("UNION"))
def set1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


@query(SETS.format("INTERSECT ALL"))
def set1_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


@query(SETS.format("INTERSECT"))
def set1_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query(SETS.format("EXCEPT ALL"))
def set1_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set1_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").subtract(side("O"))


@query("SELECT DISTINCT lang, source FROM documents")
def set2_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def set2_first_row_of_each_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("lang", "source", "doc_id").withColumn("n", first).where("n = 1").drop("n")
