import random
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import joins, slices


def sides(spark, n, seed):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([0.0, 0.0, rnd.gauss(0, 5), float(rnd.randint(-3, 3))])
    left = [(rnd.choice(["a", "a", "b", None]), i, value()) for i in range(n)] + [("a", -1, None)]
    right = [(rnd.choice(["a", "a", "b", None]), i, value()) for i in range(n)] + [("a", -1, None), ("c", -2, 1e300)]
    return left, right, spark.createDataFrame(left, "k string, x int, low double"), spark.createDataFrame(right, "k string, y int, high double")


@pytest.mark.parametrize("rows", [7, 50, 10_000])
def test_theta_join_equals_all_pairs(spark, rows):
    left, right, a, b = sides(spark, 150, 1)
    want = sorted((i, j) for k, i, v in left for m, j, w in right if k and k == m and v is not None and w is not None and v < w)
    assert sorted((r["x"], r["y"]) for r in joins.theta_join(a, b, ["k"], "low", "high", rows).collect()) == want
    free = sorted((i, j) for _, i, v in left for _, j, w in right if v is not None and w is not None and v < w)
    assert sorted((r["x"], r["y"]) for r in joins.theta_join(a.drop("k"), b.drop("k"), [], "low", "high", rows).collect()) == free
    assert joins.theta_join(a.where("false"), b, ["k"], "low", "high", rows).count() == 0
    assert joins.theta_join(a, b.where("false"), ["k"], "low", "high", rows).count() == 0


def test_regions_are_bounded_and_empty_ones_are_left_out(spark):
    """Four times the rows: more regions, no larger ones, though a third of all rows have
    one value; and no region below the diagonal."""
    largest = []
    for n in (2000, 8000):
        left, right, a, b = sides(spark, n, 2)
        dealt = joins.regions(a, b, "low", "high", 500)
        sizes = [df.groupBy("__i", "__j").count().collect() for df in dealt]
        largest.append(max(r["count"] for s in sizes for r in s))
        cells = {(r["__i"], r["__j"]) for r in sizes[0]} & {(r["__i"], r["__j"]) for r in sizes[1]}
        made = {(r["__i"], r["__j"]) for r in dealt[0].select("__i", "__j", "low").join(dealt[1].select("__i", "__j", "high"), ["__i", "__j"]).where("low < high").select("__i", "__j").distinct().collect()}
        side = n // 500
        assert made <= cells and len(cells) <= side * (side + 1) // 2 + 3 * side
    assert largest[1] <= 1.6 * 500 and largest[0] <= 1.6 * 500


def test_theta_totals_equal_all_pairs_and_make_none(spark):
    left, right, a, b = sides(spark, 150, 3)
    left, a = left + left[:40], a.union(a.limit(0)).union(spark.createDataFrame(left[:40], a.schema))
    for keyed in (True, False):
        above = lambda k, v: [j for m, j, w in right if v is not None and w is not None and v < w and (not keyed or (k and k == m))]
        want = sorted((i, len(y), sum(y)) for k, i, v in left if (y := above(k, v)))
        keys, sides_ = (["k"], (a, b)) if keyed else ([], (a.drop("k"), b.drop("k")))
        got = joins.theta_totals(*sides_, keys, "low", "high", {"total": "y"})
        assert sorted((r["x"], r["pairs"], r["total"]) for r in got.collect()) == want
        assert joins.theta_totals(sides_[0].where("false"), sides_[1], keys, "low", "high", {"total": "y"}).count() == 0
        assert joins.theta_totals(sides_[0], sides_[1].where("false"), keys, "low", "high", {"total": "y"}).count() == 0
    same = spark.createDataFrame([(u, u % 3, u % 7) for u in range(50)], "u int, k int, v int")
    got = joins.theta_totals(same.selectExpr("k", "u", "v low"), same.selectExpr("k", "v high"), ["k"], "low", "high", {})
    assert sorted((r["u"], r["pairs"]) for r in got.collect()) == sorted((u, n) for u in range(50) if (n := sum(w % 3 == u % 3 and w % 7 > u % 7 for w in range(50))))
    many = spark.range(200_000).selectExpr("id % 1000 x", "cast(id % 1000 as double) low")
    one = joins.theta_totals(many, many.selectExpr("x y", "low high"), [], "low", "high", {"total": "y"}).agg(F.sum("pairs"), F.count("*")).head()
    assert tuple(one) == (200 * 200 * 999 * 500, 199_800)  # 2 * 10^10 pairs


def test_rows_beyond_the_other_side_take_no_part_in_the_cut(spark):
    a = spark.range(10_000).selectExpr("id x", "cast(id as double) low")
    b = spark.range(100).selectExpr("id y", "cast(id as double) high")
    i, j = joins.regions(a, b, "low", "high", 50)
    assert i.agg(F.max("low")).head()[0] < 99 and i.select("__i").distinct().count() == 2 and j.where("high <= 0").count() == 0
    edges = [0.0, 1.0, 1.0, 2.5, 7.0]
    got = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 2.0, 2.5, 7.0, 8.0)], "v double").select("v", *(joins.edges_until(F.col("v"), edges, e).alias(str(e)) for e in (False, True)))
    assert [tuple(r)[1:] for r in got.collect()] == [(sum(e < v for e in edges), sum(e <= v for e in edges)) for v in (-1.0, 0.0, 1.0, 2.0, 2.5, 7.0, 8.0)]


WANT = """
    select id, k, lag(x, 3, -7) over w a, lag(s, 1) over w b, lead(x, 2) over w c, first_value(id) over w d, last_value(x) over v e, nth_value(id, 4) over v f from sliced
    window w as (partition by k order by x desc nulls first, id), v as (partition by k order by x desc nulls first, id rows between unbounded preceding and unbounded following)"""


def test_slices_equal_the_built_in_windows(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, *range(8)]), i, rnd.choice([None, "s"])) for k, n in (("hot", 300), ("b", 3), (None, 40), ("one", 1), ("two", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, x int, id int, s string").repartition(3)
    df.createOrReplaceTempView("sliced")
    want = sorted(map(str, map(tuple, spark.sql(WANT).collect())))
    for count in (1, 23, 200):
        got = slices.over_slices(
            df, ["k"], [F.desc_nulls_first("x"), F.asc("id")],
            lag={"a": ("x", 3, -7), "b": ("s", 1, None)}, lead={"c": ("x", 2, None)}, first={"d": "id"}, last={"e": "x"}, nth={"f": ("id", 4)}, slices=count,
        )
        assert sorted(map(str, map(tuple, got.select("id", "k", *"abcdef").collect()))) == want
    assert slices.over_slices(df.where("false"), ["k"], [F.asc("id")], lag={"a": ("x", 1, None)}, first={"d": "id"}).count() == 0


def test_one_key_with_all_rows_is_many_tasks(spark):
    df = spark.range(20_000).selectExpr("1 k", "id", "id % 100 x")
    got = slices.over_slices(df, ["k"], [F.asc("x"), F.asc("id")], lag={"a": ("id", 1, None)}, slices=16)
    assert got.where("a is null").count() == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if re.search(r"Window \[(lag|row_number)", line)]
    assert windows and all(re.search(r", \[k#\d+, __slice#\d+", w) for w in windows)
    files = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()})
    sizes = [r["count"] for r in files.groupBy("__slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
