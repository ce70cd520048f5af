from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.streaming import expiry, replay

T = datetime(2024, 1, 1)


def at(minutes):
    return T + timedelta(minutes=minutes)


def test_rows_dropped_and_kept_follow_the_watermark(spark):
    """batch, minutes: the largest time of the batches before, less ten minutes, is the mark."""
    rows = [(0, 0), (0, 30), (1, 19), (1, 20), (1, 21), (1, 60), (2, 50), (2, 51), (2, 5), (4, 90), (4, 49)]
    df = spark.createDataFrame([(i, at(m), b) for i, (b, m) in enumerate(rows)], "event_id long, ts timestamp_ntz, b int")
    kept, progress = replay.replayed(df, F.col("b"), lambda s: replay.in_time(s, "10 minutes"))
    marks = {b: max((m for c, m in rows if c < b), default=None) for b in range(5)}
    late = lambda b, m: marks[b] is not None and m <= marks[b] - 10
    assert sorted((r["event_id"], r["batch"]) for r in kept.collect()) == [(i, b) for i, (b, m) in enumerate(rows) if not late(b, m)]
    table = [tuple(r) for r in replay.progress_table(spark, progress).collect()]
    assert table == [(b, sum(c == b for c, _ in rows), sum(c == b and late(b, m) for c, m in rows)) for b in range(5)]
    none, progress = replay.replayed(df.where("false"), F.col("b"), lambda s: replay.in_time(s, "10 minutes"))
    assert none.count() == 0 and progress == []


def sessions(rows, gap):
    out, last = [], {}
    for user, m in sorted(rows):
        if user in last and m - last[user][1] < gap:
            last[user][1:] = [m, last[user][2] + 1]
        else:
            out += [(user, *last.pop(user))] if user in last else []
            last[user] = [m, m, 1]
    return sorted(out + [(u, *v) for u, v in last.items()])


def test_timers_close_sessions_and_state_holds_the_open_ones(spark):
    rows = [(u, m) for u in range(20) for m in (u, u + 5, u + 16, u + 40)] + [(99, m) for m in (1000, 1005)]
    batches = lambda m: 0 if m < 20 else 1 if m < 500 else 2
    df = spark.createDataFrame([(u, at(m), batches(m)) for u, m in rows], "user_id long, ts timestamp_ntz, b int").repartition(3)
    closed, still, progress = expiry.timed_sessions(df, F.col("b"), gap_seconds=600, delay="1 minute")
    shape = lambda d: sorted((r["user_id"], round((r["start"] - T).total_seconds() / 60), round((r["stop"] - T).total_seconds() / 60), r["n"]) for r in d.collect())
    assert sorted(shape(closed) + shape(still)) == sessions(rows, 10)
    assert shape(still) == [(99, 1000, 1005, 2)]
    assert progress[-1]["state"] < progress[1]["state"] and progress[-1]["state"] <= 4
    assert spark.conf.get(expiry.PROVIDER) != expiry.ROCKS_DB


def test_many_users_share_a_state_and_rows_come_in_any_order(spark):
    """Rows of a later batch lie before, inside and between the open sessions of their users, of
    which there are more than buckets; the state has no row for each of them."""
    rows = [(u, m) for u in range(3000) for m in ((60, 65, 90), (57, 67, 75), (20, 100))[u % 3]] + [(u, m) for u in range(0, 3000, 3) for m in (40, 70, 80)]
    late = {40, 70, 80}
    df = spark.createDataFrame([(u, at(m), 1 if m in late else 0) for u, m in rows], "user_id long, ts timestamp_ntz, b int").repartition(3)
    closed, still, progress = expiry.timed_sessions(df, F.col("b"), gap_seconds=600, delay="2 hours")
    shape = lambda d: sorted((r["user_id"], round((r["start"] - T).total_seconds() / 60), round((r["stop"] - T).total_seconds() / 60), r["n"]) for r in d.collect())
    assert closed.count() == 0 and shape(still) == sessions(rows, 10)
    assert all(p["state"] <= 3 * expiry.BUCKETS for p in progress)


def test_keys_are_forgotten_after_their_time_to_live(spark):
    df = spark.createDataFrame([(k, b) for b in range(3) for k in (1, 2)] + [(3, 2)], "k long, b int")
    seen = {}
    for live in (1, 3_600_000):
        with expiry.rocks_db(spark, idle=False):
            out, _ = replay.replayed(df, F.col("b"), lambda s, live=live: expiry.first_seen(s, "k", live))
        seen[live] = sorted((r["k"], r["batch"]) for r in out.collect())
    assert seen[1] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 2)]
    assert seen[3_600_000] == [(1, 0), (2, 0), (3, 2)]
