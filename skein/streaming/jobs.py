"""Streaming jobs. Each reads the events file as a stream, runs until all of it
is processed, and returns what its sink holds.

Event times are cast to timestamp for watermarks, which do not take
timestamp_ntz, and back for the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.windows import tumbling
from skein.session import ship
from skein.sources.shared import new_dir
from skein.sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, with a checkpoint, into a folder."""
    spark = stream.sparkSession
    out = new_dir(spark, "stream")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", new_dir(spark, "stream-checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark, an hour behind, has closed."""
    return drained(tumbling(event_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "ts", "1 day", ["event_type"]))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, though the stream brings each twice."""
    once = event_stream(spark, sf_dir).select("event_id", "user_id", "ts")
    return drained(once.union(event_stream(spark, sf_dir).select("event_id", "user_id", "ts")).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])).select("event_id", "user_id")


def running_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and largest value of each user, kept as state across batches; the
    last emitted row of a user is the result."""
    ship(spark)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, largest = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, largest = n + len(f), max(largest, float(f["value"].max()))
        state.update((n, largest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "largest": [largest]})

    rows = event_stream(spark, sf_dir).select("user_id", "value")
    kept = rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, largest double", "n long, largest double", "update", GroupStateTimeout.NoTimeout)
    out = new_dir(spark, "running-users")

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    kept.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", new_dir(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("user_id long, n long, largest double, batch int").parquet(out)
    return rows.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.max_by("largest", "batch").alias("largest"))


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, by event id, with one map of state a
    user. Arbitrary state needs the RocksDB store, which a stream takes from the
    session when it starts; the session's own setting is put back."""
    ship(spark)

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.first = handle.getMapState("first", "event_type string", "event_id long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            for frame in rows:
                for kind, event in frame.groupby("event_type")["event_id"].min().items():
                    if not self.first.containsKey((kind,)) or event < self.first.getValue((kind,))[0]:
                        self.first.updateValue((kind,), (int(event),))
            kept = [(key[0], kind[0], event[0]) for kind, event in self.first.iterator()]
            yield pd.DataFrame(kept, columns=["user_id", "event_type", "event_id"])

        def close(self) -> None:
            pass

    rows = event_stream(spark, sf_dir).select("user_id", "event_type", "event_id")
    kept = rows.groupBy("user_id").transformWithStateInPandas(First(), "user_id long, event_type string, event_id long", "update", "none")
    out, before = new_dir(spark, "first-events"), spark.conf.get(PROVIDER, None)
    write = lambda batch, number: batch.write.mode("append").parquet(out)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", new_dir(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    found = spark.read.schema("user_id long, event_type string, event_id long").parquet(out)
    return found.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


def clicks_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream join: clicks in the hour before a purchase of the user."""
    events = lambda kind: event_stream(spark, sf_dir).where(F.col("event_type") == kind)
    purchases = events("purchase").select("event_id", "user_id", F.col("ts").alias("bought")).withWatermark("bought", "1 hour")
    clicks = events("click").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("clicker"), F.col("ts").alias("clicked")).withWatermark("clicked", "1 hour")
    near = F.expr("user_id = clicker AND clicked BETWEEN bought - INTERVAL 1 HOUR AND bought")
    return drained(purchases.join(clicks, near).select("event_id", "click_id"))
