"""Staged tables, batches of bounded size and column checks used here."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import ship
from skein.sources.shared import dropped, new_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage, and no
    recomputation when it is used more than once or an executor is lost."""
    return written(df, new_dir(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    ship(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Staged tables under one folder, which goes when the work is done: for
    tables that the returned plan does not read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, new_dir(spark, name), 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return written(df, f"{self.root}/{self.count:03d}-{name}")

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *error) -> None:
        dropped(self.spark, self.root)


_holder: list[tuple[str, Callable[[], object]]] = []


def hold(owner: str, clear: Callable[[], object]) -> None:
    """Called in a Python worker before an operator fills its caches there. Spark
    uses a worker again for later stages, so what another operator has kept in
    it is cleared first and its memory given back."""
    if _holder and _holder[0][0] != owner:
        _holder[0][1]()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _holder[:] = [(owner, clear)]


def ranges(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded total size; a larger row is a range by itself."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(batch, column: str = "text", most: int = 2_000_000) -> Iterator:
    """Slices of an Arrow batch whose texts have a bounded number of bytes, so
    that what Python makes of them is bounded however long the texts are."""
    import pyarrow.compute as pc

    for lo, hi in ranges(pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist(), most):
        yield batch.slice(lo, hi - lo)


def documents(df: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a document table; a null text is empty."""
    ship(df.sparkSession)
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
