"""Best-fit packing of token sequences by non-negative least squares.

Lengths run from 1 to the capacity, so their histogram is small whatever the
corpus. On it the driver enumerates the patterns of up to three lengths that
fill a sequence exactly, fits repeat counts to the histogram by non-negative
least squares, rounds them, and packs what is left best-fit, again pattern by
pattern. Where the histogram is thin, rounding costs more than it gains, so the
plan with fewest sequences is kept: of two ways of rounding, and of best-fit
alone. Spark then ranks the pieces inside each length and a piece finds its
sequence from its length and rank alone.

Defined results: a null or empty text is one piece that holds the end id alone;
a document longer than the capacity is cut into full pieces and a last shorter
one; equal rows are separate pieces; a null doc_id is kept; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import documents, slices, staged
from skein.llm.encoding import encoder

END = (0).to_bytes(4, "little")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, step = encoder(tokenizer), 4 * capacity
        for batch in batches:
            for part in slices(batch):
                rows = [
                    (key, i // step, i // 4, min(step, len(raw) - i) // 4, zlib.crc32(raw[i : i + step]))
                    for key, raw in zip(part["doc_id"].to_pylist(), (r + END for r in enc.ids(part["text"].to_pylist())))
                    for i in range(0, len(raw), step)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return documents(docs).mapInArrow(cut, PIECES)


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths, 0 for none, of which the sum is the capacity."""
    have = np.flatnonzero(present[1:]) + 1
    a, b = (x.ravel() for x in np.meshgrid(have, np.append(0, have), indexing="ij"))
    c = capacity - a - b
    keep = (a >= b) & (c >= 0) & (b >= c)
    a, b, c = a[keep], b[keep], c[keep]
    keep = (c == 0) | present[c]
    return np.stack([a, b, c], axis=1)[keep]


def fit(rows: np.ndarray, counts: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: repeats of each
    pattern whose sums come close to the counts. Long lengths weigh more, as
    short ones find a place later."""
    size = len(counts)
    weight = np.where(np.arange(size) >= size // 16, 1.0, 0.1) / np.sqrt(np.maximum(counts, 1))
    weight[0] = 0
    back = lambda y: y[rows[:, 0]] + y[rows[:, 1]] + y[rows[:, 2]]
    x = np.full(len(rows), counts.sum() / 3 / max(1, len(rows)))
    aim = back(weight * counts)
    for _ in range(steps):
        made = sum(np.bincount(rows[:, k], x, minlength=size) for k in range(3))
        x *= aim / np.maximum(back(weight * made), 1e-12)
    return x


Plan = list[tuple[list[tuple[int, int]], int]]


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Patterns that take, again and again, the longest piece that still fits."""
    left, out = counts.astype(np.int64).copy(), []
    while left.any():
        gap, own, spare = capacity, [], left.copy()
        while gap:
            fits = np.flatnonzero(spare[: gap + 1])
            if not len(fits):
                break
            v = int(fits[-1])
            n = min(int(spare[v]), gap // v)
            own.append((v, n))
            spare[v] = 0
            gap -= n * v
        times = min(int(left[v]) // n for v, n in own)
        out.append((own, times))
        for v, n in own:
            left[v] -= n * times
    return out


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray, capacity: int, up: float) -> Plan:
    """Repeats of the patterns, rounded and held to the counts; the rest best-fit."""
    left, out = counts.astype(np.int64).copy(), []
    for i in np.argsort(-x, kind="stable"):
        own = [(int(v), int(n)) for v, n in zip(*np.unique(rows[i][rows[i] > 0], return_counts=True))][::-1]
        times = min(int(np.floor(x[i] + up)), *(int(left[v]) // n for v, n in own))
        if times > 0:
            out.append((own, times))
            for v, n in own:
                left[v] -= n * times
    return out + best_fit(left, capacity)


def plan(counts: np.ndarray, capacity: int, most: int = 4096) -> Plan:
    """Patterns [(length, times), ...] with how often each is used; together
    they hold every piece once. The final fit is of the `most` patterns with most
    repeats in a first one of all; pieces that they do not reach are packed
    best-fit, so none is left out."""
    plans, rows = [best_fit(counts, capacity)], patterns(capacity, counts > 0)
    if len(rows):
        rows = rows[np.argsort(-fit(rows, counts.astype(float), 120), kind="stable")[:most]]
        x = fit(rows, counts.astype(float), 300)
        plans = [rounded(rows, x, counts, capacity, up) for up in (0.5, 0.0)] + plans
    return min(plans, key=lambda p: sum(times for _, times in p))


def slots(planned: list[tuple[list[tuple[int, int]], int]], capacity: int) -> np.ndarray:
    """Columns: length * 2**40 + first rank, times in a pattern, first
    sequence, offset; sorted. A few rows for each pattern, at most one for each
    distinct length in it, so it is bounded by the capacity alone."""
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for own, times in planned:
        offset = 0
        for v, n in own:
            rows.append(((v << 40) + int(used[v]), n, sequence, offset))
            used[v] += n * times
            offset += n * v
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """The pieces with their rank inside their length, from 0. A length is dealt
    to about the square root of its count of groups, so one that holds a third
    of all pieces is ranked by many tasks."""
    spark = cut.sparkSession
    groups = spark.createDataFrame([(k, int(np.ceil(np.sqrt(n)))) for k, n in histogram.items()], "length long, groups int")
    dealt = cut.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "groups").cast("int")).drop("groups")
    sums = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return dealt.withColumn("own", own).join(before, ["length", "salt"]).select(*cut.columns, (F.col("before") + F.col("own")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece with its place: PIECES, sequence_id long, offset long."""
    cut = staged(pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    table = slots(plan(counts, capacity), capacity)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = table[np.searchsorted(table[:, 0], (length << 40) + rank, "right") - 1]
            step = rank - (row[:, 0] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + step // row[:, 1]), pa.array(row[:, 3] + step % row[:, 1] * length)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked(cut, histogram).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
