"""Writing tables in other formats and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.sources.shared import new_dir


def round_trip(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """Write and read with an explicit schema, so that types survive."""
    path = new_dir(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path)


def partitioned(df: DataFrame, by: list[str], rows_per_file: int = 1_000_000) -> DataFrame:
    """Write one folder for each value of `by`, in files of bounded length. A value is dealt
    by a hash of its rows to as many tasks as it needs files, so one with a third of
    all rows is many tasks; the counts have one row for each value."""
    path = new_dir(df.sparkSession, "partitioned")
    files = df.groupBy(*by).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("__files"))
    named = files.withColumnsRenamed({c: f"__of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]
    dealt = df.join(named, same).withColumn("__file", F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.col("__files")))
    # Two values that meet in a task write files of their own; a hash may bring files of one together.
    dealt.repartition(*by, "__file").drop("__files", "__file", *[f"__of_{c}" for c in by]).write.partitionBy(*by).option("maxRecordsPerFile", rows_per_file).parquet(path)
    schema = StructType([f for f in df.schema if f.name not in by] + [df.schema[c] for c in by])
    return df.sparkSession.read.schema(schema).parquet(path).select(*df.columns)
