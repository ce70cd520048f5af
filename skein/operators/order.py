"""Ranks and percentiles of large groups, from counts of their values.

A window over a group is one task, and an exact percentile keeps the group's
values in one. Here rows are counted by value first, and only the counts are
summed up along the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """keys, value, n (rows), before (rows of smaller values), values (distinct ones
    up to this), total (rows of the key). Null values are left out. Sums run over
    blocks of values `width` long and, inside a block, over its values."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("__block", F.floor(F.col(value) / width))
    blocks = n.groupBy(*keys, "__block").agg(F.sum("n").alias("__n"), F.count("*").alias("__d"))
    key = Window.partitionBy(*keys)
    below = key.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(below), F.lit(0)).alias(a) for c, a in (("__n", "__n0"), ("__d", "__d0"))]
    blocks = blocks.select(*keys, "__block", *sums, F.sum("__n").over(key).alias("total"))
    inside = Window.partitionBy(*keys, "__block").orderBy(value)
    n = n.withColumns({"__n1": F.sum("n").over(inside) - F.col("n"), "__d1": F.row_number().over(inside)})
    same = [n[k].eqNullSafe(blocks[k]) for k in keys]
    joined = n.join(blocks, [*same, n["__block"] == blocks["__block"]])
    return joined.select(*(n[k] for k in keys), n[value], "n", (F.col("__n0") + F.col("__n1")).alias("before"), (F.col("__d0") + F.col("__d1")).alias("values"), "total")


def percentiles(df: DataFrame, keys: list[str], value: str, width: float, wanted: dict[str, tuple[float, bool]]) -> DataFrame:
    """keys and one column for each name: the exact percentile at a fraction,
    interpolated if the flag is set and else the first value that reaches it."""
    counts = counted(df, keys, value, width)
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value)))
    picked, out = [], []
    for name, (fraction, interpolated) in wanted.items():
        place = F.lit(fraction) * (F.col("total") - 1)
        low = F.floor(place) if interpolated else F.greatest(F.ceil(F.lit(fraction) * F.col("total")) - 1, F.lit(0))
        picked += [at(low).alias(f"{name}_low"), at(F.ceil(place) if interpolated else low).alias(f"{name}_high"), F.first(place - F.floor(place)).alias(f"{name}_part")]
        between = F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")
        out.append((between if interpolated else F.col(f"{name}_low")).alias(name))
    return counts.groupBy(*keys).agg(*picked).select(*keys, *out)


def ranked(df: DataFrame, keys: list[str], value: str, order: list[Column | str], width: float) -> DataFrame:
    """df with the ranks of its rows by `value` in each key (rank, dense_rank,
    percent_rank, cume_dist) and, by `value` and then `order`, row_number and
    row_count, the rows of the key. A task holds the rows of one value."""
    counts = counted(df, keys, value, width).withColumnsRenamed({k: f"__{k}" for k in keys} | {value: "__value"})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = df.join(counts, [*same, F.col(value) == F.col("__value")])
    tied = Window.partitionBy(*keys, value).orderBy(*order)
    return rows.withColumns(
        {
            "row_number": F.col("before") + F.row_number().over(tied),
            "rank": F.col("before") + 1,
            "dense_rank": F.col("values"),
            "percent_rank": F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0),
            "cume_dist": (F.col("before") + F.col("n")) / F.col("total"),
            "row_count": F.col("total"),
        }
    ).drop(*(f"__{k}" for k in keys), "__value", "n", "before", "values", "total")


def tile(tiles: int) -> Column:
    """ntile from row_number and row_count: the first tiles are one row longer
    where the rows do not divide."""
    short, long = F.floor(F.col("row_count") / tiles), F.col("row_count") % tiles
    longer = long * (short + 1)
    return F.when(F.col("row_number") <= longer, F.ceil(F.col("row_number") / (short + 1))).otherwise(long + F.ceil((F.col("row_number") - longer) / short))
