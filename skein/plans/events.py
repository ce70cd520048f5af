"""Event-time joins and windows over the events table, as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.joins import asof_join, interval_join, range_join
from skein.operators.windows import sessions, sliding, tumbling
from skein.plans.registry import query
from skein.sources.tables import table


def _typed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


@query("""
    SELECT p.user_id AS user_id, p.ts AS ts, p.event_id AS event_id, c.click_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, event_id AS click_id FROM events WHERE event_type = 'click') c
    ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join6_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = _typed(spark, sf_dir, "purchase").select("user_id", "ts", "event_id")
    clicks = _typed(spark, sf_dir, "click").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return asof_join(purchases, clicks, ["user_id"], "ts", ["click_id"])


@query("""
    SELECT p.event_id AS event_id, c.event_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p JOIN (SELECT * FROM events WHERE event_type = 'click') c
    ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts""")
def join7_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = _typed(spark, sf_dir, "purchase").select("user_id", "ts", "event_id")
    clicks = _typed(spark, sf_dir, "click").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return interval_join(purchases, clicks, ["user_id"], "ts", "click_ts", before=6 * 3600, after=0).select("event_id", "click_id")


@query("""
    SELECT o_orderkey, b.lo AS lo FROM orders JOIN (SELECT CAST(i * 25000 AS DOUBLE) AS lo, CAST((i + 1) * 25000 AS DOUBLE) AS hi FROM generate_series(0, 19) g(i)) b
    ON o_totalprice >= b.lo AND o_totalprice < b.hi""")
def join4_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(20).select((F.col("id") * 25000.0).alias("lo"), ((F.col("id") + 1) * 25000.0).alias("hi"))
    return range_join(table(spark, sf_dir, "orders"), bands, "o_totalprice", "lo", "hi", 25000.0).select("o_orderkey", "lo")


@query("""
    SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def str1_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"])


@query("""
    SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
        SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, value FROM events
        UNION ALL SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR, event_type, value FROM events)
    GROUP BY ALL""")
def str2_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(table(spark, sf_dir, "events"), "ts", "1 day", "12 hours", ["event_type"])


@query("""
    SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s""")
def str3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "ts", "2 hours", ["user_id"])
