"""A table replayed as a stream in batches, some of its rows late.

Each batch is written as files of its own and the stream is run over what is new, from
the checkpoint of the run before, so a batch may have any number of files and tasks. Rows
that come later than the watermark allows are dropped by Spark; how many is read from
the progress of the runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from skein.sources.shared import new_dir


def replayed(rows: DataFrame, batch: Column, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> tuple[DataFrame, list[dict]]:
    """What the stream that `build` makes of the rows has written, with the number of the
    batch in which it was, and the progress of each batch: number, rows read, rows dropped by the
    watermark, the watermark, and the rows in state."""
    spark = rows.sparkSession
    source, out, checkpoint = (new_dir(spark, f"replay-{x}") for x in ("in", "out", "checkpoint"))
    numbered = rows.withColumn("__batch", batch.cast("int"))
    last = numbered.agg(F.max("__batch").alias("b")).head()["b"]
    progress = []
    stream = build(spark.readStream.schema(rows.schema).parquet(f"{source}/*"))
    for number in range(0 if last is None else last + 1):
        numbered.where(F.col("__batch") == number).drop("__batch").write.parquet(f"{source}/{number:06d}")
        progress.append({"batch": number} | run(stream, number, out, checkpoint, mode))
    schema = stream.schema.add("batch", IntegerType())
    if not progress:
        return spark.createDataFrame([], schema), progress
    return spark.read.schema(schema).parquet(out), progress


def run(stream: DataFrame, number: int, out: str, checkpoint: str, mode: str) -> dict:
    """One run over what is new. A batch that is repeated after a failure writes its own folder again."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/epoch={epoch:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    runs = query.recentProgress
    states = [s for p in runs for s in p.stateOperators]
    marks = [p.eventTime["watermark"] for p in runs if "watermark" in p.eventTime]
    return {
        "rows": sum(p.numInputRows for p in runs),
        "dropped": sum(s.numRowsDroppedByWatermark for s in states),
        "watermark": marks[-1] if marks else None,
        "state": runs[-1].stateOperators[0].numRowsTotal if runs and runs[-1].stateOperators else 0,
        "checkpoint": checkpoint,
    }


def days_late(events: DataFrame, days: int, every: int | None = None) -> Column:
    """The batch of an event: its slice of so many days; of every so many events, if
    any, one comes one to three slices later."""
    start = events.agg(F.min("ts").alias("t")).head()["t"]
    slice_ = F.floor(F.datediff(F.col("ts"), F.lit(start).cast("date")) / days)
    if every is None:
        return slice_
    return slice_ + F.when(F.col("event_id") % every == 3, 1 + F.floor(F.col("event_id") / every) % 3).otherwise(0)


def in_time(events: DataFrame, delay: str) -> DataFrame:
    """Rows that come before the watermark has passed them, each event once."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicates(["event_id", "ts"]).select("event_id", "ts")


def progress_table(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """(batch, rows, dropped): one row for each batch."""
    return spark.createDataFrame([(p["batch"], p["rows"], p["dropped"]) for p in progress], "batch int, rows long, dropped long")
