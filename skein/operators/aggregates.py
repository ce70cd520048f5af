"""User-defined aggregates in two phases: partial states where the rows are, merged behind a shuffle.

A grouped function in Python needs a whole group in one task. Here each task turns its own
rows into one state for each key, batch by batch, and hands over the states alone; states
are Arrow tables with a row for each key. They are merged in two steps, first for each key and
salt and then for each key, so that no merge holds more states than about the square root of
the tasks. A key with all rows costs one row a task.

An aggregate has `state`, the DDL of its columns, and two functions of numpy arrays:
`partial(codes, groups, values)` and `merged(codes, groups, states)`, where codes number the
group of each row; and `finished`, columns of the result from the state's.

Defined results: null keys are a group; rows with a null or NaN value are left out, so a
key with no other rows is absent; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import ship

#: Keys that a task holds before it hands over what it has.
KEYS = 100_000


class Moments:
    """Count, mean, variance, skewness and kurtosis (population) from central moments, which
    are merged by the binomial rule, so that no large powers are subtracted."""

    state = "n double, mean double, m2 double, m3 double, m4 double"

    def partial(self, codes: np.ndarray, groups: int, values: np.ndarray) -> list[np.ndarray]:
        total = lambda w: np.bincount(codes, w, groups)
        n = np.bincount(codes, minlength=groups).astype(float)
        mean = total(values) / n
        d = values - mean[codes]
        return [n, mean, total(d**2), total(d**3), total(d**4)]

    def merged(self, codes: np.ndarray, groups: int, states: list[np.ndarray]) -> list[np.ndarray]:
        total = lambda w: np.bincount(codes, w, groups)
        n, mean, m2, m3, m4 = states
        size = total(n)
        middle = total(n * mean) / size
        d = mean - middle[codes]
        return [size, middle, total(m2 + n * d**2), total(m3 + 3 * d * m2 + n * d**3), total(m4 + 4 * d * m3 + 6 * d**2 * m2 + n * d**4)]

    def finished(self) -> dict[str, Column]:
        n, m2 = F.col("n"), F.col("m2")
        spread = lambda c: F.when(m2 > 0, c)
        return {
            "n": n.cast("long"),
            "mean": F.col("mean"),
            "variance": m2 / n,
            "skewness": spread(F.sqrt(n) * F.col("m3") / F.pow(m2, 1.5)),
            "kurtosis": spread(n * F.col("m4") / (m2 * m2) - 3),
        }


def numbered(frame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row of a pandas frame, and a row of each group."""
    codes = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(frame), np.int64)
    return codes, np.unique(codes, return_index=True)[1]


def combined(aggregate, frames: list, keys: list[str]):
    """One frame of states, a row for each key."""
    import pandas as pd

    frame = pd.concat(frames, ignore_index=True)
    codes, first = numbered(frame, keys)
    names = [c.split()[0] for c in aggregate.state.split(", ")]
    out = frame.loc[first, keys].reset_index(drop=True)
    for name, values in zip(names, aggregate.merged(codes, len(first), [frame[c].to_numpy() for c in names])):
        out[name] = values
    return out


def two_phase(df: DataFrame, keys: list[str], value: str, aggregate) -> DataFrame:
    """keys and the aggregate's results for each key."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in aggregate.state.split(", ")]
    key_ddl = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__value"))

    def partial(frames: Iterator) -> Iterator:
        held = None
        for frame in frames:
            if not len(frame):
                continue
            codes, first = numbered(frame, keys)
            state = frame.loc[frame.index[first], keys].reset_index(drop=True)
            for name, values in zip(names, aggregate.partial(codes, len(first), frame["__value"].to_numpy())):
                state[name] = values
            held = state if held is None else combined(aggregate, [held, state], keys)
            if len(held) > KEYS:
                yield held
                held = None
        if held is not None:
            yield held

    schema = ", ".join([*key_ddl, aggregate.state])
    states = rows.mapInPandas(partial, schema)
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    salted = states.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(max(1, int(np.sqrt(tasks))))))
    by = [F.col(k) for k in keys]
    some = salted.groupBy(*by, "__salt").applyInPandas(lambda f: combined(aggregate, [f], keys), schema)
    whole = some.groupBy(*by).applyInPandas(lambda f: combined(aggregate, [f], keys), schema)
    return whole.select(*keys, *[c.alias(name) for name, c in aggregate.finished().items()])
