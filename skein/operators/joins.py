"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark limits groups before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Each left row with the values of the last right row of its key at or
    before its time; nulls where there is none or a key or the time is null. Of
    right rows at one time the largest values win.

    Both sides are stacked, and a running last value is carried along time, right
    rows first at equal times. Time is cut into slices, so that a key with a third
    of all rows is many tasks; what a slice starts with is the last value of the
    slices before it, which have one row each."""
    marker = F.struct(*values).alias("__value")
    nothing = F.lit(None).cast(right.select(marker).schema[0].dataType).alias("__value")
    columns = [c for c in left.columns if c not in keys and c != time]
    row = F.struct(*columns).alias("__row")
    no_row = F.lit(None).cast(left.select(row).schema[0].dataType).alias("__row")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    cut = (micros - F.pmod(micros, F.lit(slice_seconds * 1_000_000))).alias("__slice")
    a = left.select(*keys, time, cut, F.lit(1).alias("__side"), row, nothing)
    b = right.dropna(subset=[*keys, time]).select(*keys, time, cut, F.lit(0).alias("__side"), no_row, marker)
    both = a.unionByName(b)
    latest = F.max(F.when(F.col("__side") == 0, F.struct(time, "__value"))).alias("__latest")
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    first = both.groupBy(*keys, "__slice").agg(latest).withColumn("__latest", F.last("__latest", ignorenulls=True).over(before))
    first = first.select(*keys, F.col(f"__latest.{time}").alias(time), "__slice", F.lit(-1).alias("__side"), no_row, F.col("__latest.__value").alias("__value"))
    along = Window.partitionBy(*keys, "__slice").orderBy(time, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.unionByName(first.where(f"__slice is not null and `{time}` is not null")).withColumn("__value", F.last("__value", ignorenulls=True).over(along))
    return carried.where("__side = 1").select(*keys, time, *(F.col(f"__row.{c}").alias(c) for c in columns), *(F.col(f"__value.{v}").alias(v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, other: str, before: int, after: int) -> DataFrame:
    """Pairs of rows of one key whose times differ by at most `before` seconds
    back and `after` seconds ahead, compared in whole microseconds. Times are cut
    into buckets as long as the interval, and the right side is dealt to the
    buckets its interval touches, so a key with a third of all rows is spread over
    time and not joined whole. left has the column `time`, right the column `other`."""
    back, ahead = before * 1_000_000, after * 1_000_000
    width = max(1_000_000, back + ahead)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda t: t - F.pmod(t, F.lit(width))
    a = left.withColumn("__bucket", bucket(micros(time)))
    b = right.withColumn("__bucket", F.explode(F.sequence(bucket(micros(other) - ahead), bucket(micros(other) + back), F.lit(width))))
    gap = micros(other) - micros(time)
    return a.join(b, [*keys, "__bucket"]).where((gap >= -back) & (gap <= ahead)).drop("__bucket")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them, by buckets of the
    given width; a range is repeated for each bucket it touches."""
    a = points.withColumn("__bucket", F.floor(F.col(value) / width))
    b = ranges.where(F.col(low) < F.col(high)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, "__bucket").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__bucket")


def ranges_of(value: Column, edges: list[float]) -> Column:
    """The range of a value between sorted edges. A value that stands for several
    edges, as one that many rows have does, is dealt to all ranges that it touches."""
    low, high = edges_until(value, edges, False), edges_until(value, edges, True)
    return (low + F.pmod(F.xxhash64(value, F.monotonically_increasing_id()), high - low + 1)).cast("int")


def edges_until(value: Column, edges: list[float], equal: bool) -> Column:
    """How many of the sorted edges are smaller than a value, or equal if wanted. Found by
    halving, as there are the more edges the more rows there are."""
    marks = F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))]).cast("array<int>")
    before = lambda e: (e <= value) if equal else (e < value)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(before(F.get(marks, n + step - 1)), n + step).otherwise(n))


def quantile_edges(df: DataFrame, value: str, ranges: int) -> list[float]:
    """About equal numbers of rows between the edges; no row comes to the driver."""
    if ranges < 2:
        return []
    at = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(50 * ranges))
    return sorted(df.agg(at.alias("e")).head()["e"] or [])


def regions(left: DataFrame, right: DataFrame, low: str, high: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to the regions (__i, __j) of the join matrix in which low < high
    is possible. The matrix is cut at quantiles of both sides so that a region has about
    `rows` rows of each; a row goes to the regions of its row or column that are not empty.
    Rows beyond all values of the other side have no pairs and no part in the cut."""
    ends = [left.agg(F.min(low)).head()[0], right.agg(F.max(high)).head()[0]]
    sides = [left.where(F.col(low) < F.lit(ends[1])), right.where(F.col(high) > F.lit(ends[0]))]
    cuts = [quantile_edges(df, c, -(-df.count() // rows)) for df, c in zip(sides, (low, high))]
    # The least value of a range of the left, and the largest of one of the right.
    least, most = [float("-inf"), *cuts[0]], [*cuts[1], float("inf")]
    beyond = lambda c: F.col(c).cast("double")
    # Values of the left grow along i, those of the right along j: what is empty lies below.
    first_j = [next((j for j, m in enumerate(most) if m > v), len(most)) for v in least]
    last_i = [max((i for i, v in enumerate(least) if v < m), default=-1) for m in most]
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    a = sides[0].withColumn("__i", ranges_of(beyond(low), cuts[0]))
    b = sides[1].withColumn("__j", ranges_of(beyond(high), cuts[1]))
    some_j, some_i = pick(first_j, F.col("__i")), pick(last_i, F.col("__j"))
    a = a.where(some_j < len(most)).withColumn("__j", F.explode(F.sequence(some_j, F.lit(len(most) - 1))))
    b = b.where(some_i >= 0).withColumn("__i", F.explode(F.sequence(F.lit(0), some_i)))
    return a, b


def theta_join(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, rows: int = 100_000) -> DataFrame:
    """Pairs with equal keys and low < high, where `low` is a numeric column of the left and
    `high` one of the right (Okcan and Riedewald 2011). Every pair is made in one region, and a
    task takes a bounded number of rows however many share a key or a value. Rows with
    a null key or value have no pairs; the keys appear once."""
    a, b = regions(left, right, low, high, rows)
    return a.join(b, ["__i", "__j", *keys]).where(F.col(low) < F.col(high)).drop("__i", "__j")


def theta_totals(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, sums: dict[str, str]) -> DataFrame:
    """The left rows that have pairs in `theta_join`, each with `pairs`, their number, and for
    each name the sum of a column of the right over them. No pair is made, so the work grows
    with the rows and not with their product: the right side is summed up for each key and
    value, and the sums run along the values from the largest down, over ranges of them first.
    A range has about equal numbers of rows; a task holds the left rows of one value."""
    totals = {"pairs": F.count("*")} | {name: F.sum(f"__{name}") for name in sums}
    values = right.select(*keys, F.col(high).alias("__value"), *[F.col(c).alias(f"__{name}") for name, c in sums.items()])
    values = values.where("__value is not null").groupBy(*keys, "__value").agg(*[c.alias(name) for name, c in totals.items()])
    own = left.where(F.col(low) < F.lit(right.agg(F.max(high)).head()[0]))
    columns = [c for c in left.columns if c not in keys]
    row = F.struct(*columns).alias("__row")
    no_row = F.lit(None).cast(own.select(row).schema[0].dataType).alias("__row")
    nothing = [F.lit(None).cast(values.schema[name].dataType).alias(name) for name in totals]
    a = own.select(*keys, F.col(low).alias("__value"), F.lit(0).alias("__side"), row, *nothing)
    b = values.select(*keys, "__value", F.lit(1).alias("__side"), no_row, *totals)
    both = a.unionByName(b)
    edges = quantile_edges(both, "__value", int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.withColumn("__range", edges_until(F.col("__value").cast("double"), edges, True))
    # One row for each range of a key.
    above = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.groupBy(*keys, "__range").agg(*[F.sum(name).alias(name) for name in totals])
    ranges = ranges.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"), *[F.sum(name).over(above).alias(f"__{name}") for name in totals])
    # Of equal values the left ones come first: a right one is not above them.
    inside = Window.partitionBy(*keys, "__range").orderBy(F.desc("__value"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumns({name: F.sum(name).over(inside) for name in totals}).where("__side = 0")
    found = summed.join(ranges, [F.col("__range") == F.col("__r"), *[F.col(k) == F.col(f"__k_{k}") for k in keys]])
    total = {name: F.coalesce(F.col(name) + F.col(f"__{name}"), name, f"__{name}") for name in totals}
    return found.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns], *[c.alias(name) for name, c in total.items()]).where("pairs is not null")
