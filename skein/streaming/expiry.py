"""State that ends: sessions closed by event-time timers, keys forgotten after a time to
live, and the state of a stream read back as a table.

Users are dealt to BUCKETS by a hash, and a bucket is a key of the state: it holds the open
sessions of its users and one timer, at the first end of a gap. A batch is read, merged with
what is open and written back at once for a bucket, so its cost is not a call of the
worker and several of the state store for each user. Sessions are closed when the
watermark has passed their gap, so rows may come in any order that it allows, and a user
who does not come back leaves no state behind. Rows behind the watermark are dropped
before they come here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.session import ship
from skein.streaming.replay import replayed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
SESSION = "user_id long, start long, stop long, n long"
OPEN = "user_id array<long>, start array<long>, stop array<long>, n array<long>"
#: A bucket's state is one value: at a million open sessions it has about a thousand of them.
BUCKETS = 1024


@contextmanager
def rocks_db(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Timers and lives need the RocksDB store, which a stream takes from the session when it
    starts; the session's own settings are put back. A stream on processing time that runs
    over what is there must not run batches while idle, as it would never end."""
    wanted = {PROVIDER: ROCKS_DB} | ({} if idle else {IDLE: "false"})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def merged(user: np.ndarray, start: np.ndarray, stop: np.ndarray, n: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Spans of users joined where the next one starts within the gap of all before it."""
    if not len(user):
        return user, start, stop, n
    order = np.lexsort((start, user))
    user, start, stop, n = user[order], start[order], stop[order], n[order]
    users = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
    until = np.concatenate([np.maximum.accumulate(part) for part in np.split(stop, users[1:])])
    first = np.r_[True, (user[1:] != user[:-1]) | (start[1:] - until[:-1] >= gap)]
    at = np.flatnonzero(first)
    return user[at], start[at], np.maximum.reduceat(stop, at), np.add.reduceat(n, at)


def session_processor(gap_micros: int) -> StatefulProcessor:
    """Times are microseconds; timers, which are in milliseconds, are set to the first
    one at which a gap is over."""

    class Sessions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getValueState("session", OPEN)

        def known(self) -> list[np.ndarray]:
            return [np.array(c, dtype=np.int64) for c in (self.open.get() if self.open.exists() else ([], [], [], []))]

        def ends(self, stop: np.ndarray) -> np.ndarray:
            return -(-(stop + gap_micros) // 1000)

        def keep(self, spans: tuple[np.ndarray, ...]) -> None:
            self.open.update(tuple(c.tolist() for c in spans))
            self.handle.registerTimer(int(self.ends(spans[2]).min()))

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = self.known()
            if len(known[0]):
                self.handle.deleteTimer(int(self.ends(known[2]).min()))
            for f in rows:
                user, times = f["user_id"].to_numpy("int64"), f["micros"].to_numpy("int64")
                fresh = merged(user, times, times, np.ones(len(user), np.int64), gap_micros)
                known = [np.concatenate(c) for c in zip(known, fresh)]
            self.keep(merged(*known, gap_micros))
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            known = self.known()
            over = self.ends(known[2]) <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            if over.all():
                self.open.clear()
            else:
                self.keep(tuple(c[~over] for c in known))
            yield pd.DataFrame({name: c[over] for name, c in zip(("user_id", "start", "stop", "n"), known)})

        def close(self) -> None:
            pass

    return Sessions()


def timed_sessions(events: DataFrame, batch, gap_seconds: int, delay: str) -> tuple[DataFrame, DataFrame | None, list[dict]]:
    """Sessions that are closed, those still open as the state has them, and the progress of
    the batches. Both as user_id, start, stop, n."""
    spark = ship(events.sparkSession)

    def build(stream: DataFrame) -> DataFrame:
        rows = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("micros", F.unix_micros("ts")).withWatermark("ts", delay)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))
        return rows.groupBy("bucket").transformWithStateInPandas(session_processor(gap_seconds * 1_000_000), SESSION, "append", "eventtime")

    with rocks_db(spark):
        closed, progress = replayed(events, batch, build)
        still = open_sessions(spark, progress[-1]["checkpoint"]) if progress else None
    return times(closed), still, progress


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a session stream, read with the state data source."""
    state = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    return times(state.select(F.inline(F.arrays_zip("value.user_id", "value.start", "value.stop", "value.n"))))


def times(sessions: DataFrame) -> DataFrame:
    naive = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return sessions.select("user_id", naive("start"), naive("stop"), "n")


def first_seen(stream: DataFrame, key: str, live_ms: int) -> DataFrame:
    """Keys that were not seen in the last live_ms milliseconds of processing time; what
    has been kept that long is forgotten, so state holds recent keys only."""

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "n long", live_ms)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n = sum(len(f) for f in rows)
            fresh = not self.seen.exists()
            self.seen.update((n,))
            if fresh:
                yield pd.DataFrame({"key": [key[0]]})

        def close(self) -> None:
            pass

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(F.col(key).alias("key")).groupBy("key").transformWithStateInPandas(Seen(), f"key {kind}", "append", "processingtime").withColumnRenamed("key", key)
