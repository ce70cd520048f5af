"""Structured Streaming runs over the events table, to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.registry import query
from skein.sources.tables import table
from skein.streaming import expiry, jobs, replay

CLOSED = "start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query(f"""
    SELECT start, event_type, n, total FROM (
        SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
    WHERE {CLOSED}""")
def str4_watermarked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.closed_windows(spark, sf_dir)


#: Slices of five days; of ten events one comes one to three slices late. A row is late
#: if the largest time of the batches before its own, less six days, has reached it.
LATE = """
    WITH placed AS (
        SELECT event_id, ts, date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) // 5
            + CASE WHEN event_id % 10 = 3 THEN 1 + (event_id // 10) % 3 ELSE 0 END AS batch FROM events
    ), mark AS (
        SELECT b.batch AS batch, date_trunc('milliseconds', max(e.ts)) - INTERVAL 6 DAY AS w
        FROM (SELECT DISTINCT batch FROM placed) b LEFT JOIN placed e ON e.batch < b.batch GROUP BY b.batch
    ) """


def _late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return replay.replayed(events, replay.days_late(events, days=5, every=10), lambda stream: replay.in_time(stream, "6 days"))


@query(LATE + "SELECT event_id, ts, CAST(batch AS INTEGER) AS batch FROM placed JOIN mark USING (batch) WHERE w IS NULL OR ts > w")
def str4_late_rows_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = _late(spark, sf_dir)
    return kept.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "batch")


@query(LATE + "SELECT CAST(batch AS INTEGER) AS batch, count(*) AS rows, count(*) FILTER (WHERE ts <= w) AS dropped FROM placed JOIN mark USING (batch) GROUP BY batch")
def str4_late_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the progress of the stream."""
    return replay.progress_table(spark, _late(spark, sf_dir)[1])


@query("SELECT event_id, user_id FROM events")
def str5_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.deduplicated(spark, sf_dir)


@query("SELECT user_id, count(*) AS n, max(value) AS largest FROM events GROUP BY user_id")
def str6_arbitrary_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.running_users(spark, sf_dir)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def str6_state_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.first_events(spark, sf_dir)


@query("""
    SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s""")
def str6_session_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that timers closed and, from the state of the stream, those still open."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    closed, still, _ = expiry.timed_sessions(events, replay.days_late(events, days=5), gap_seconds=7200, delay="1 hour")
    closed = closed.select("user_id", "start", "stop", "n")
    return closed.union(still) if still else closed


@query("""
    SELECT p.event_id AS event_id, c.event_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p JOIN (SELECT * FROM events WHERE event_type = 'click') c
    ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts""")
def str7_stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.clicks_before_purchases(spark, sf_dir)
