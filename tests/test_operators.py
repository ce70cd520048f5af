from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.operators.joins import asof_join, interval_join, range_join, top_n_per_key
from skein.operators.order import percentiles, ranked, tile
from skein.operators.windows import tumbling

T = datetime(2024, 1, 1)


def at(minutes):
    return T + timedelta(minutes=minutes)


def test_asof_takes_the_last_row_at_or_before_and_ties_the_largest(spark):
    left = spark.createDataFrame([("a", at(5), 1), ("a", at(1), 2), ("b", at(9), 3), (None, at(9), 4)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(5), 10), ("a", at(5), 11), ("a", at(2), 9), ("b", at(10), 12)], "k string, ts timestamp_ntz, v int")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "ts", ["v"]).collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None}


def test_asof_carries_values_over_slices_and_ignores_null_times_and_keys(spark):
    left = spark.createDataFrame([("a", at(m), m) for m in range(0, 400, 7)] + [("a", None, 1000), (None, at(3), 1001), ("c", at(3), 1002)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(m), m) for m in (10, 11, 150, 390)] + [("a", None, -1), (None, at(1), -2)], "k string, ts timestamp_ntz, v int")
    got = {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "ts", ["v"], slice_seconds=600).collect()}
    want = {m: max((v for v in (10, 11, 150, 390) if v <= m), default=None) for m in range(0, 400, 7)}
    assert got == want | {1000: None, 1001: None, 1002: None}


def test_interval_join_holds_its_bounds(spark):
    left = spark.createDataFrame([("a", at(10), 1), ("a", None, 2)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(m), m) for m in (4, 5, 10, 12, 13)] + [("b", at(10), 99)], "k string, other timestamp_ntz, v int")
    assert sorted(r["v"] for r in interval_join(left, right, ["k"], "ts", "other", 300, 120).collect()) == [5, 10, 12]


def test_range_join_equals_the_condition(spark):
    points = spark.createDataFrame([(float(i),) for i in range(-5, 20)] + [(None,)], "x double")
    ranges = spark.createDataFrame([(-3.0, 4.5), (2.0, 2.0), (10.0, 30.0)], "lo double, hi double")
    got = sorted((r["x"], r["lo"]) for r in range_join(points, ranges, "x", "lo", "hi", 4.0).collect())
    assert got == sorted((float(x), lo) for x in range(-5, 20) for lo, hi in [(-3.0, 4.5), (10.0, 30.0)] if lo <= x < hi)


def test_ranks_and_percentiles_equal_the_built_in_ones(spark):
    rows = spark.createDataFrame([(k, (i * i) % 37 - 9, i) for k, n in (("a", 50), ("b", 3), (None, 7), ("one", 1)) for i in range(n)] + [("a", None, 99)], "k string, x int, id int")
    rows.where("x is not null").createOrReplaceTempView("ranked_rows")
    want = spark.sql("""
        select id, k, row_number() over (partition by k order by x, id) r, rank() over (partition by k order by x) s, dense_rank() over (partition by k order by x) d,
            ntile(4) over (partition by k order by x, id) t, percent_rank() over (partition by k order by x) p, cume_dist() over (partition by k order by x) c
        from ranked_rows""").collect()
    got = ranked(rows, ["k"], "x", ["id"], 5.0).select("id", "k", "row_number", "rank", "dense_rank", tile(4), "percent_rank", "cume_dist").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    want = spark.sql("select k, median(x) m, percentile_disc(0.25) within group (order by x) q, percentile(x, 0.9) p from ranked_rows group by k").collect()
    got = percentiles(rows, ["k"], "x", 5.0, {"m": (0.5, True), "q": (0.25, False), "p": (0.9, True)}).collect()
    key = lambda r: str(r["k"])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a["k"] == b["k"] and a["q"] == b["q"] and abs(a["m"] - b["m"]) + abs(a["p"] - b["p"]) < 1e-9
    assert percentiles(rows.where("false"), ["k"], "x", 5.0, {"m": (0.5, True)}).count() == 0


def test_top_n_of_an_empty_table(spark):
    assert top_n_per_key(spark.createDataFrame([], "k int, v int"), ["k"], [F.desc("v")], 2).count() == 0


def test_late_rows_are_dropped_once_the_watermark_has_passed(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for i, minutes in enumerate(([1], [200], [300], [2])):
        rows = [(at(m), "a", 1.0) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = tumbling(stream.withWatermark("ts", "10 minutes"), "ts", "10 minutes", ["event_type"])
    q = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    counts = {r["start"]: r["n"] for r in spark.sql("select * from late").collect()}
    assert counts[T] == 1
