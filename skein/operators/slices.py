"""Neighbours and ends of large ordered groups: lag, lead, first, last and nth by sorted slices.

A window over a group is one task. Here rows are dealt by ranges of keys and order, so that a
group is cut into sorted slices, and each slice is a window of its own. What it needs from its
neighbours is carried over: the last rows before it and the first behind it, as many as
the farthest lag or lead. Rows have a place in their group, which is the count of the
slices before and the place in the slice, and carried rows are found by it; so slices that
are shorter than a lag do no harm. First, last and nth are rows of known places.

Defined results: as those of the built-in window functions with the same order, which must
tell any two rows of a group apart; rows with null keys are a group; nulls are ordered as
the order says; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.shared import new_dir


def over_slices(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    lag: dict[str, tuple] | None = None,
    lead: dict[str, tuple] | None = None,
    first: dict[str, str] | None = None,
    last: dict[str, str] | None = None,
    nth: dict[str, tuple[str, int]] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """df with a column for each name: lag and lead take (column, distance, default or
    None), first and last a column, nth (column, n from 1), over the whole group."""
    lag, lead, first, last, nth = lag or {}, lead or {}, first or {}, last or {}, nth or {}
    spark, columns = df.sparkSession, df.columns
    far = max([1, *(v[1] for v in [*lag.values(), *lead.values(), *nth.values()])])
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The cut is written, as it is read more than once and must not change between.
    path = new_dir(spark, "slices")
    dealt = df.repartitionByRange(count, *[F.col(k).asc() for k in keys], *order).withColumn("__slice", F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)

    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    placed = rows.withColumns({"__p": F.row_number().over(inside), "__n": F.count("*").over(Window.partitionBy(*keys, "__slice"))})
    edges = placed.where((F.col("__p") <= far) | (F.col("__p") > F.col("__n") - far))
    # One row for each slice of a group: at most as many as there are partitions.
    sizes = rows.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    along = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumns({"__start": F.coalesce(F.sum("__n").over(along), F.lit(0)), "__total": F.sum("__n").over(Window.partitionBy(*keys))})
    named = starts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__s"), "__start")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    by_place = edges.join(named, [*same, F.col("__slice") == F.col("__s")]).select(*[f"__k_{k}" for k in keys], (F.col("__start") + F.col("__p") - 1).alias("__g"), F.struct(*columns).alias("__row"))

    stop = F.col("__start") + F.col("__n")
    wanted = F.concat(F.sequence(F.col("__start") - far, F.col("__start") - 1), F.sequence(stop, stop + far - 1))
    needed = starts.select(*keys, "__slice", "__total", F.explode(wanted).alias("__at")).where((F.col("__at") >= 0) & (F.col("__at") < F.col("__total")))
    halo = needed.join(by_place, [*same, F.col("__at") == F.col("__g")]).select(*[F.col(f"__row.{c}").alias(c) for c in columns], "__slice", F.lit(True).alias("__carried"))
    window = Window.partitionBy(*keys, "__slice").orderBy(*order)
    moved = {name: F.lag(c, k, default).over(window) for name, (c, k, default) in lag.items()} | {name: F.lead(c, k, default).over(window) for name, (c, k, default) in lead.items()}
    both = rows.withColumn("__carried", F.lit(False)).unionByName(halo)
    if moved:
        both = both.withColumns(moved)
    found = both.where(~F.col("__carried")).drop("__carried")

    picked = {name: (c, F.lit(0)) for name, c in first.items()} | {name: (c, F.col("__total") - 1) for name, c in last.items()} | {name: (c, F.lit(n - 1)) for name, (c, n) in nth.items()}
    if picked:
        places = starts.select(*keys, "__slice", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, (_, at) in picked.items()])).alias("__w"))
        ends = places.join(by_place, [*same, F.col("__w.at") == F.col("__g")], "left")
        values = [F.first(F.when(F.col("__w.name") == name, F.col(f"__row.{c}")), ignorenulls=True).alias(name) for name, (c, _) in picked.items()]
        ended = ends.groupBy(*keys, "__slice").agg(*values).withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__slice": "__s"})
        found = found.join(ended, [*same, F.col("__slice") == F.col("__s")])
    return found.select(*columns, *moved, *picked)
