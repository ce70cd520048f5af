"""Exact top-k search by integer inner product over a bit-sliced index.

A bundle of candidates holds, for each component, the high bits of its quantised
values as bitmaps over the rows. For a query, the bitmaps of each component are
added, shifted by the signed binary digits of the query's component, with
carry-save adders: whole bitmaps at a time, so that the sum of all components
is again a stack of bitmaps. Reading that stack from the most significant slice
down gives the k-th highest coarse score; the bits left out of the index bound
the error, and the rows within it are scored exactly.

Candidates are dealt into bundles by a hash of vec_id. One shuffle brings to each
bundle its candidates and, behind them, all queries in chunks; a task reads them
in that order, builds the index of the bundle once and answers chunk after
chunk. Candidates are moved once; the queries are moved once for each bundle of up
to BUNDLE vectors. The best rows of the bundles are merged for each query.

Defined results: vectors that are null, empty or hold a null, NaN or infinite
component take no part; vectors of different length are not compared; equal
scores rank by the smaller vec_id; rows that share the query's vec_id count as
the query's own; a null vec_id takes no part; an empty table gives no rows;
columns other than the two named do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import ship

BUNDLE = 262_144
LEAST = 4096
CHUNK = 1024
RESULT = "query_id long, vec_id long, score long"


def codes(vectors: DataFrame, key: str, column: str, scale: float) -> DataFrame:
    """(vec_id, code array<long>, dim): floor(scale * x) of usable vectors."""
    v = F.col(column)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.where(F.col(key).isNotNull() & usable)
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("code"))
        .withColumn("dim", F.size("code"))
    )


class SlicedIndex:
    """Bitmaps of the high bits of each component of a block of vectors."""

    def __init__(self, code: np.ndarray, bits: int = 6):
        self.code, self.n, self.dim = code, *code.shape
        self.low = code.min(axis=0).astype(np.int64)
        width = max(1, (int(code.max()) - int(code.min())).bit_length())
        self.drop = max(0, width - bits)
        self.width = width - self.drop
        words = -(-self.n // 64)
        self.slices = np.zeros((self.dim, self.width, words), np.uint64)
        for d in range(self.dim):
            coarse = (code[:, d] - self.low[d]) >> self.drop
            for j in range(self.width):
                packed = np.packbits(((coarse >> j) & 1).astype(np.uint8), bitorder="little")
                self.slices[d, j].view(np.uint8)[: len(packed)] = packed
        full = np.zeros(words * 8, np.uint8)
        ones = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        full[: len(ones)] = ones
        self.full = full.view(np.uint64)

    def coarse(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of sum(q_d * coarse_d) plus a constant: a
        negative digit adds the complement of a slice instead."""
        levels: dict[int, list[np.ndarray]] = {}
        for k, digit in enumerate(signed_digits(query)):
            for sign, flip in ((1, False), (-1, True)):
                at = np.flatnonzero(digit == sign)
                if len(at):
                    for j in range(self.width):
                        part = self.slices[at, j]
                        levels.setdefault(j + k, []).append(~part & self.full if flip else part)
        return add(levels, len(self.full))

    def top(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k with the highest inner product."""
        if k >= self.n:
            return np.arange(self.n)
        sums = self.coarse(query)
        error = int(np.abs(query).sum()) * ((1 << self.drop) - 1)
        goal = kth(sums, k, self.full) - -(-error >> self.drop)
        return rows_of(at_least(sums, max(goal, 0), self.full), self.n)


def signed_digits(values: np.ndarray) -> list[np.ndarray]:
    """Non-adjacent form: digits -1, 0, 1, lowest first, few of them not 0."""
    left, out = values.astype(np.int64).copy(), []
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        out.append(digit)
        left = (left - digit) >> 1
    return out


def add(levels: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """One slice for each power of two, from any number: three slices of a level
    become one of it and one of the next, all triples of a level at a time."""
    out, level = [], 0
    last = max(levels, default=-1)
    while level <= last:
        stack = levels.pop(level, [])
        rows = np.concatenate(stack) if stack else np.zeros((0, words), np.uint64)
        carries = []
        while len(rows) > 2:
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
            t = a ^ b
            carries.append((a & b) | (t & c))
            rows = np.concatenate([t ^ c, rows[3 * n :]])
        if len(rows) == 2:
            carries.append((rows[:1] & rows[1:]))
            rows = rows[:1] ^ rows[1:]
        out.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        if carries:
            levels.setdefault(level + 1, []).extend(carries)
            last = max(last, level + 1)
        level += 1
    return out


def kth(sums: list[np.ndarray], k: int, full: np.ndarray) -> int:
    """The k-th highest sum, bit by bit from the most significant slice."""
    equal, above, value = full.copy(), 0, 0
    for j in range(len(sums) - 1, -1, -1):
        ones = equal & sums[j]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            equal, value = ones, value | 1 << j
        else:
            above += n
            equal &= ~sums[j]
    return value


def at_least(sums: list[np.ndarray], goal: int, full: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose sum is at least the goal."""
    more, equal = np.zeros_like(full), full.copy()
    for j in range(len(sums) - 1, -1, -1):
        if goal >> j & 1:
            equal &= sums[j]
        else:
            more |= equal & sums[j]
            equal &= ~sums[j]
    return more | equal


def rows_of(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def answers(index: SlicedIndex, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """query_id, vec_id and score of the k best rows of a bundle for each query."""
    counts = np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left")
    out = []
    for q, value, n in zip(own, queries, counts):
        rows = index.top(value, k + int(n))
        rows = rows[ids[rows] != q]
        score = index.code[rows].astype(np.int64) @ value
        first = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(first), q), ids[rows][first], score[first]))
    return [np.concatenate(c) for c in zip(*out)]


def search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score. Both
    sides have vec_id, code, dim, as from codes()."""
    spark = ship(candidates.sparkSession)
    n, cores = candidates.count(), spark.sparkContext.defaultParallelism
    bundles = max(1, -(-n // BUNDLE), min(2 * cores, n // LEAST))
    bundle = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(bundles)).cast("int")
    left = candidates.select("dim", bundle.alias("bundle"), F.lit(0).alias("side"), "vec_id", "code")
    every = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))
    right = queries.select("dim", every.alias("bundle"), F.lit(1).alias("side"), "vec_id", "code")
    dealt = left.union(right).repartition(bundles, "bundle").sortWithinPartitions("bundle", "dim", "side", "vec_id")

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, ids, codes_, index = None, [], [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("bundle", "dim", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if group != tuple(keys[lo, :2]):
                    group, ids, codes_, index = tuple(keys[lo, :2]), [], [], None
                own = batch["vec_id"].slice(lo, hi - lo).to_numpy()
                code = batch["code"].slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, int(keys[lo, 1]))
                if keys[lo, 2] == 0:
                    ids.append(own)
                    codes_.append(narrow(code))
                    continue
                if index is None and ids:
                    index, known = SlicedIndex(np.concatenate(codes_)), np.concatenate(ids)
                for at in range(0, hi - lo if ids else 0, CHUNK):
                    found = answers(index, known, own[at : at + CHUNK], code[at : at + CHUNK], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(best, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def narrow(code: np.ndarray) -> np.ndarray:
    """The codes in the smallest type that holds them."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= code.min() and code.max() <= np.iinfo(t).max)
    return code.astype(kind)


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Queries are the rows whose key is divisible by `every`."""
    rows = codes(vectors, key, column, scale)
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
