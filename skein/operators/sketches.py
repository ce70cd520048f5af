"""Sketches as columns of tables: made once for each part of the data, stored, and merged.

Distinct counts are HyperLogLog sketches (for unions) and theta sketches (also for
intersections and differences); quantiles are KLL sketches. Each is a binary column of
bounded size, so a table of daily sketches answers questions over any days without the rows:
merging sketches gives the sketch of all their rows.

Defined results: null values are not counted; a part without values has sketches of
nothing, or none for quantiles; merging no sketches gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.shared import new_dir

#: Sizes, and the error that they stay in with more than 99 of 100 chances.
HLL_BITS, HLL_ERROR = 14, 0.03
THETA_BITS, THETA_ERROR = 14, 0.03
KLL_K, KLL_ERROR = 400, 0.02


def sketched(df: DataFrame, by: list[str], counted: str, measured: str) -> DataFrame:
    """by, rows, and the sketches hll and theta of `counted` and kll of `measured`."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.hll_sketch_agg(counted, F.lit(HLL_BITS)).alias("hll"),
        F.theta_sketch_agg(counted, F.lit(THETA_BITS)).alias("theta"),
        F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(KLL_K)).alias("kll"),
    )


def stored(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Written to the shared folder by the columns of `by`, and read back."""
    path = new_dir(sketches.sparkSession, "sketches")
    sketches.write.partitionBy(*by).parquet(path)
    return sketches.sparkSession.read.parquet(path)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of all rows of coarser groups."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.hll_union_agg("hll").alias("hll"),
        F.theta_union_agg("theta").alias("theta"),
        F.kll_merge_agg_double("kll").alias("kll"),
    )


def distinct(hll: Column) -> Column:
    return F.hll_sketch_estimate(hll)


def common(a: Column, b: Column) -> Column:
    """About how many values both sketches have seen."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_first(a: Column, b: Column) -> Column:
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def quantile(kll: Column, fraction: float) -> Column:
    return F.kll_sketch_get_quantile_double(kll, F.lit(fraction))


def within(estimate: Column, exact: Column, error: float) -> Column:
    """Whether an estimate is as near to the exact number as the error says, or by one."""
    return F.abs(estimate - exact) <= F.greatest(exact * error, F.lit(1.0))
