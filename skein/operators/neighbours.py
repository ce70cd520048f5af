"""Nearest neighbours by cosine: exact ones in blocks, approximate ones by sketches of signs.

A sketch holds the sides of random hyperplanes on which a vector lies (Charikar 2002):
vectors at an angle t agree in a bit with probability 1 - t / pi. Each of several
tables has its own planes, and a bucket is a table's rows of one sketch. A query is
sent to its own bucket and to those that differ in the bits whose planes it lies
nearest to, in order of the squared distances that are crossed (multi-probe).

Rows are dealt to buckets with their vectors, so that a bucket scores its queries exactly
and hands over no more than k rows for each. A bucket of more rows than SLICE is cut
into slices by a hash of row and place, so that one with a third of all rows is many
tasks; a query goes to each slice. Nothing is dropped: what is approximate is only which
buckets a query visits. Without a bit there is one bucket, and the search is exact.

How many bits a sketch has and how many buckets a query visits is fitted: the exact
neighbours of SAMPLE queries, by a hash of their ids, are found among all rows, and it is seen
at which probe each of them is met. Of the sizes that meet TARGET of them the cheapest is taken. With
all buckets visited all are met, so there always is one. A fixed number of probes would
find fewer and fewer as tables grow.

Defined results: vectors that are null, empty, of length zero or hold a null, NaN or
infinite component take no part, nor do null keys; vectors of different length are not
compared; rows with a query's own key are not its neighbours; a key that stands for
several rows counts once, by its best; scores are rounded to 9 digits and ties go to
the smaller key; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import ship

SLICE = 16_384
CHUNK = 512
#: Rows that a bucket has at least, on average.
BUCKET = 128
#: Queries that the fit looks at, the share of their neighbours to be met, and what a visit
#: of a bucket costs in rows scored.
SAMPLE, TARGET, VISIT = 64, 0.95, 512
#: Bits beyond which no fit is tried.
MOST_BITS = 16


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v array<double>, dim): vectors of unit length."""
    v = F.col(column)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    # The largest component goes first, so that no square leaves the doubles.
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = rows.withColumn("most", most).where("most > 0").withColumn("v", F.transform("v", lambda x: x / F.col("most")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return scaled.withColumn("length", length).select("id", F.transform("v", lambda x: x / F.col("length")).alias("v"), F.size("v").alias("dim"))


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables * bits, dim))


def probes(side: np.ndarray, most: int) -> list[int]:
    """Sketches to visit for one query and table, given its signed distances from the
    planes: its own, then by the squared distances crossed."""
    own = int(sum(1 << i for i, x in enumerate(side) if x > 0))
    near = np.argsort(side**2, kind="stable").tolist()
    cost = (side**2)[near].tolist()
    found, heap = [own], [(cost[0], (0,))]
    # A set of turned bits is followed by the one with its last bit moved on, and with the next bit added.
    while heap and len(found) < most:
        crossed, turned = heapq.heappop(heap)
        found.append(own ^ sum(1 << near[i] for i in turned))
        if (i := turned[-1] + 1) < len(cost):
            heapq.heappush(heap, (crossed + cost[i], (*turned, i)))
            heapq.heappush(heap, (crossed - cost[i - 1] + cost[i], (*turned[:-1], i)))
    return found


def places(query: np.ndarray, others: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The probe, from 0, at which a query meets each of the other vectors in the table where
    it does so first."""
    p = planes(len(query), tables, bits, seed)
    sides, theirs = (p @ query).reshape(tables, bits), (others @ p.T).reshape(len(others), tables, bits)
    turned = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    first = np.full(len(others), 1 << bits)
    for t in range(tables):
        cost = sides[t] ** 2
        every = np.sort(turned @ cost)
        own = ((theirs[:, t] > 0) != (sides[t] > 0)) @ cost
        # A hair more, so that a sum made in another order does not put a place too early.
        first = np.minimum(first, np.maximum(np.searchsorted(every, own + 1e-12, "right") - 1, 0))
    return first


def fitted(base: DataFrame, queries: DataFrame, k: int, tables: int, sizes: list[int], rows: int, seed: int) -> tuple[int, int]:
    """(bits, probes): of the sizes of sketches the one with the cheapest search that meets TARGET of
    the exact neighbours of a sample. SAMPLE queries and their neighbours come to the driver."""
    chosen = queries.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).collect()
    asked = {(r["id"], r["dim"]): np.array(r["v"]) for r in chosen}
    truth = exact(base, base.sparkSession.createDataFrame(chosen, queries.schema), k).select("query_id", "id") if chosen else None
    near = base.join(F.broadcast(truth), "id").groupBy("query_id", "id", "dim").agg(F.first("v").alias("v")).collect() if chosen else []
    groups: dict[tuple, list] = {}
    for r in near:
        if (r["query_id"], r["dim"]) in asked:
            groups.setdefault((r["query_id"], r["dim"]), []).append(r["v"])
    best = None
    for bits in sizes:
        met = [places(asked[key], np.array(v), tables, bits, seed) for key, v in groups.items()]
        at = np.sort(np.concatenate(met)) if met else np.zeros(1, int)
        most = int(at[math.ceil(TARGET * len(at)) - 1]) + 1
        cost = most * (VISIT + rows / (1 << bits))
        best = min(best or (cost, bits, most), (cost, bits, most))
    return best[1:]


def dealt(rows: DataFrame, tables: int, bits: int, most: int, seed: int) -> DataFrame:
    """A row (tab, code) for each table and, with most above 1, each probe of a row."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            take, tab, code = [], [], []
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = b["v"].take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                sides = (v @ planes(dim, tables, bits, seed).T).reshape(len(at), tables, bits)
                if most == 1:
                    take.append(np.repeat(at, tables))
                    tab.append(np.tile(np.arange(tables), len(at)))
                    code.append(((sides > 0) @ (1 << np.arange(bits, dtype=np.int64))).ravel())
                else:
                    for i, row in zip(at, sides):
                        for t in range(tables):
                            found = probes(row[t], most)
                            take.append(np.full(len(found), i)), tab.append(np.full(len(found), t)), code.append(np.array(found))
            if take:
                picked = pa.array(np.concatenate(take))
                columns = [pa.array(np.concatenate(tab), pa.int32()), pa.array(np.concatenate(code), pa.int64()), *(b[c].take(picked) for c in ("id", "v", "dim"))]
                yield pa.RecordBatch.from_arrays(columns, ["tab", "code", "id", "v", "dim"])

    return rows.mapInArrow(sketch, "tab int, code long, id long, v array<double>, dim int")


def best_of_buckets(stacked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best rows of each bucket slice for each query. Rows
    come sorted: the members of a slice, and behind them its queries."""

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, ids, members, block = None, [], [], None
        for b in batches:
            keys = np.stack([b[c].to_numpy() for c in ("tab", "code", "slice", "dim", "side")], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if group != tuple(keys[lo, :4]):
                    group, ids, members, block = tuple(keys[lo, :4]), [], [], None
                own = b["id"].slice(lo, hi - lo).to_numpy()
                v = b["v"].slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, int(keys[lo, 3]))
                if keys[lo, 4] == 0:
                    ids.append(own)
                    members.append(v)
                    continue
                if not ids:
                    continue
                if block is None:
                    block, known = np.concatenate(members), np.concatenate(ids)
                for at in range(0, hi - lo, CHUNK):
                    out = answers(block, known, v[at : at + CHUNK], own[at : at + CHUNK], k)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])

    return stacked.mapInArrow(best, "query_id long, id long, score double")


def answers(block: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Best rows of a block: equal keys count once, so that they cannot fill the k."""
    scores = np.round(queries @ block.T, 9) + 0.0
    found = []
    for q, row in zip(own, scores):
        row = np.where(ids == q, -np.inf, row)
        first, wanted = None, k
        while True:
            # The wanted-th score and all that equal it, then by key.
            at = np.arange(len(row)) if wanted >= len(row) else np.flatnonzero(row >= np.partition(row, -wanted)[-wanted])
            at = at[np.lexsort((ids[at], -row[at]))]
            at = at[row[at] > -np.inf]
            first = at[np.sort(np.unique(ids[at], return_index=True)[1])][:k]
            if len(first) == k or wanted >= len(row):
                break
            wanted *= 2
        found.append((np.full(len(first), q), ids[first], row[first]))
    return [np.concatenate(c) for c in zip(*found)]


def searched(base: DataFrame, queries: DataFrame, k: int, tables: int, bits: int, most: int, seed: int = 0) -> DataFrame:
    """query_id, rank, id, score; base and queries as from usable()."""
    ship(base.sparkSession)
    n, partitions = base.count(), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if bits:
        left, right = dealt(base, tables, bits, 1, seed), dealt(queries, tables, bits, most, seed)
        sizes = left.groupBy("tab", "code", "dim").agg(F.count("*").alias("n"))
        slices = sizes.select("tab", "code", "dim", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
        large = slices.where("slices > 1")
    else:
        place = [F.lit(0).alias("tab"), F.lit(0).cast("long").alias("code"), "id", "v", "dim"]
        left, right = base.select(place), queries.select(place)
        # Blocks for every core, though a block is never made for fewer rows than a chunk.
        blocks = max(1, -(-n // SLICE), min(2 * base.sparkSession.sparkContext.defaultParallelism, n // CHUNK))
        large = left.select("tab", "code", "dim").distinct().withColumn("slices", F.lit(blocks))
    cut = large.select(F.col("tab").alias("t"), F.col("code").alias("c"), F.col("dim").alias("d"), "slices")
    same = (F.col("tab") == F.col("t")) & (F.col("code") == F.col("c")) & (F.col("dim") == F.col("d"))
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.coalesce("slices", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    # There are at most rows * tables / SLICE large buckets: few, and Spark sees their size.
    left = left.join(cut, same, "left").select("tab", "code", salt.alias("slice"), "dim", F.lit(0).alias("side"), "id", "v")
    right = right.join(cut, same, "left").select("tab", "code", every.alias("slice"), "dim", F.lit(1).alias("side"), "id", "v")
    stacked = left.union(right).repartition(partitions, "tab", "code", "slice").sortWithinPartitions("tab", "code", "slice", "dim", "side", "id")
    found = best_of_buckets(stacked, k).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return searched(base, queries, k, tables=1, bits=0, most=1)


def approximate(base: DataFrame, queries: DataFrame, k: int, tables: int = 8, most: int | None = None, bits: int | None = None, seed: int = 0) -> DataFrame:
    """`bits` of a sketch and `most`, the buckets that a query visits in a table, are fitted if
    not given. A sketch has no more bits than leave about BUCKET rows in a bucket."""
    rows = base.count() if bits is None or most is None else 0
    largest = bits or max(1, min(MOST_BITS, int(np.ceil(np.log2(max(2, rows) / BUCKET)))))
    if most is None:
        bits, most = fitted(base, queries, k, tables, [bits] if bits else list(range(1, largest + 1)), rows, seed)
    return searched(base, queries, k, tables, bits or largest, most, seed)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, hits): neighbours of the exact search, and those of them that were found."""
    hit = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
