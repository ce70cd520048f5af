"""User-defined functions: vectorised, grouped, aggregate and table ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.aggregates import Moments, two_phase
from skein.plans.registry import query
from skein.session import ship
from skein.sources.tables import table


@query("SELECT event_id, round(value * 2 + 1, 6) AS scaled FROM events")
def udf1_pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def scaled(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return table(ship(spark), sf_dir, "events").select("event_id", F.round(scaled("value"), 6).alias("scaled"))


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def udf1_arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("string")
    def upper(v: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.utf8_upper(v)

    return table(ship(spark), sf_dir, "events").select("event_id", upper("event_type").alias("kind"))


@query("SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id")
def udf2_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return v.max() - v.min()

    return table(ship(spark), sf_dir, "events").groupBy("user_id").agg(spread("value").alias("spread")).select("user_id", F.round("spread", 6).alias("spread"))


@query("""
    WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type)
    SELECT event_type, count(*) AS n, round(any_value(mean), 6) AS mean, round(var_pop(value), 6) AS variance,
        round(avg(pow(value - mean, 3)) / pow(var_pop(value), 1.5), 6) AS skewness, round(avg(pow(value - mean, 4)) / pow(var_pop(value), 2) - 3, 6) AS kurtosis
    FROM events JOIN m USING (event_type) GROUP BY event_type""")
def udf2_two_phase_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate in Python whose states, and not its rows, are shuffled."""
    found = two_phase(table(spark, sf_dir, "events"), ["event_type"], "value", Moments())
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "skewness", "kurtosis")])


@query("""
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS place FROM events""")
def udf2_apply_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def placed(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame.sort_values(["value", "event_id"], ascending=[False, True])
        return out.assign(place=range(1, len(out) + 1))[["user_id", "event_id", "place"]]

    rows = table(ship(spark), sf_dir, "events").select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInPandas(placed, "user_id long, event_id long, place long")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def udf2_apply_in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(key: tuple, t):
        return pa.table({"event_type": [key[0].as_py()], "n": pa.array([t.num_rows], pa.int64())})

    rows = table(ship(spark), sf_dir, "events").select("event_type", "user_id")
    parts = rows.withColumn("part", F.pmod("user_id", F.lit(8))).groupBy("event_type", "part").applyInArrow(lambda k, t: counted(k[:1], t), "event_type string, n long")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, CAST(length(s) AS INTEGER) AS chars FROM (
        SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS s FROM documents)""")
def udf3_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="line int, chars int")
    class Lines:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, s in enumerate((text or "").split("\n")):
                yield i, len(s)

    ship(spark).udtf.register("skein_lines", Lines)
    return spark.sql("SELECT doc_id, line, chars FROM {d}, LATERAL skein_lines(text)", d=table(spark, sf_dir, "documents"))


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, round(value * 10, 6) AS scaled FROM events WHERE event_type = 'purchase'")
def udf3_arrow_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over Arrow batches of a table argument."""

    @F.arrow_udtf(returnType="event_id long, hour int, value double")
    class Purchases:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            import pyarrow.compute as pc

            kept = rows.filter(pc.equal(rows["event_type"], "purchase"))
            hour = pc.cast(pc.hour(kept["ts"]), pa.int32())
            yield pa.table({"event_id": kept["event_id"], "hour": hour, "value": kept["value"]})

    events = table(ship(spark), sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return Purchases(events.asTable()).select("event_id", "hour", F.round(F.col("value") * 10, 6).alias("scaled"))
