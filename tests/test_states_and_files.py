import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.operators import aggregates, sketches
from skein.sources import formats


def moments(values):
    x = np.array(values)
    d = x - x.mean()
    v = (d**2).mean()
    return len(x), x.mean(), v, None if v == 0 else (d**3).mean() / v**1.5, None if v == 0 else (d**4).mean() / v**2 - 3


def close(a, b):
    return (a is None and b is None) or abs(a - b) <= 1e-8 * max(1, abs(b))


def test_moments_of_many_tasks_equal_those_of_the_group(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "KEYS", 3)
    rnd = random.Random(1)
    rows = [("hot", i % 2, 1e6 + rnd.gauss(0, 2)) for i in range(5000)] + [(k, 0, rnd.gauss(0, 1)) for k in (None, "a", "b", "c", "d") for _ in range(60)] + [("one", 1, 3.5), ("a", 0, None), ("none", 0, None), ("none", 0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, j int, x double").repartition(23)
    got = {(r["k"], r["j"]): tuple(r)[2:] for r in aggregates.two_phase(df, ["k", "j"], "x", aggregates.Moments()).collect()}
    want = {}
    for k, j, x in rows:
        if x is not None and x == x:
            want.setdefault((k, j), []).append(x)
    assert set(got) == set(want)
    for key, values in want.items():
        assert all(close(a, b) for a, b in zip(got[key], moments(values))), key
    whole = aggregates.two_phase(df.where("k = 'hot'"), [], "x", aggregates.Moments()).collect()
    assert len(whole) == 1 and whole[0]["n"] == 5000
    assert aggregates.two_phase(df.where("false"), ["k"], "x", aggregates.Moments()).count() == 0


def test_a_hot_key_sends_a_state_for_each_task(spark):
    """Merging one state at a time or all at once gives the same."""
    m = aggregates.Moments()
    parts = [np.random.default_rng(k).normal(k, 2, 50) for k in range(12)]
    names = [c.split()[0] for c in m.state.split(", ")]
    frames = [pd.DataFrame(dict(zip(names, m.partial(np.zeros(50, int), 1, p)))) for p in parts]
    assert all(len(f) == 1 for f in frames)
    at_once, held = aggregates.combined(m, frames, []), frames[0]
    for f in frames[1:]:
        held = aggregates.combined(m, [held, f], [])
    assert np.allclose(at_once.to_numpy(), held.to_numpy()) and at_once["n"][0] == 600


def test_stored_sketches_merge_to_those_of_all_rows(spark):
    df = spark.range(40_000).selectExpr("cast(id % 10 as int) day", "if(id % 3 = 0, 'a', 'b') kind", "id % 9000 user", "id % 1000 x")
    daily = sketches.stored(sketches.sketched(df, ["day", "kind"], "user", "x"), ["day"])
    assert daily.count() == 20 and dict(daily.dtypes)["hll"] == "binary"
    got = {r["kind"]: r for r in sketches.merged(daily, ["kind"]).select("kind", "rows", sketches.distinct(F.col("hll")).alias("users"), F.theta_sketch_estimate("theta").alias("theta"), sketches.quantile(F.col("kll"), 0.5).alias("median")).collect()}
    exact = {r["kind"]: r for r in df.groupBy("kind").agg(F.count("*").alias("rows"), F.count_distinct("user").alias("users")).collect()}
    for kind, r in exact.items():
        assert got[kind]["rows"] == r["rows"]
        assert abs(got[kind]["users"] - r["users"]) <= sketches.HLL_ERROR * r["users"] and abs(got[kind]["theta"] - r["users"]) <= sketches.THETA_ERROR * r["users"]
        assert abs(got[kind]["median"] - 500) <= 1000 * sketches.KLL_ERROR
    sides = sketches.merged(daily, ["kind"]).groupBy().pivot("kind", ["a", "b"]).agg(F.first("theta"))
    both, only = sides.select(sketches.common(F.col("a"), F.col("b")), sketches.only_first(F.col("a"), F.col("b"))).head()
    a, b = ({r["user"] for r in df.where(f"kind = '{k}'").select("user").distinct().collect()} for k in "ab")
    assert abs(both - len(a & b)) <= 0.03 * len(a | b) and abs(only - len(a - b)) <= 0.03 * len(a | b)


@pytest.fixture
def uncoalesced(spark):
    """Small shuffles keep their partitions, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_a_hot_value_is_written_by_many_tasks_in_bounded_files(spark, uncoalesced):
    df = spark.range(9000).selectExpr("if(id < 6000, 'hot', concat('v', id % 3)) k", "id", "cast(null as string) s")
    df = df.union(spark.createDataFrame([(None, -1, "x")], "k string, id long, s string"))
    written = formats.partitioned(df, ["k"], rows_per_file=500)
    assert written.columns == df.columns and sorted(map(tuple, written.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files = written.groupBy("k", F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.max("id")).collect()
    assert max(r["n"] for r in files) <= 500 and sum(r["k"] == "hot" for r in files) >= 12
    tasks = {re.search(r"part-(\d+)", r["f"])[1] for r in files if r["k"] == "hot"}
    assert len(tasks) > 1
    assert sum(r["k"] == "v1" for r in files) <= 4


def test_a_join_prunes_the_folders_of_a_partitioned_table(spark):
    """The dimension is filtered by a column that the stored table does not have."""
    stored = formats.partitioned(spark.range(5000).selectExpr("id", "cast(id % 20 as int) k"), ["k"])
    names = spark.createDataFrame([(i, f"n{i % 4}") for i in range(20)], "k2 int, name string")
    joined = stored.join(names.where("name = 'n1'"), F.col("k") == F.col("k2"))
    assert joined.count() == 1250
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
