"""Vector code compression: one codebook for each part of the vectors, by Lloyd rounds
over parts that stay where their entry is.

Vectors are cut into parts; a part lives with the owner of its entry, the partition of
(position, entry, salt). In a round the owners sum up their resident members, the sums
give the entries, and every member is compared with the new codebook where it is. Members
that keep their entry stay in their partition, and only those that change it go
through the next shuffle. Salts split an entry, so that one with all rows is many
partitions; owners hand over one row of sums for each entry. The driver holds the
codebooks alone, `entries` times the length of a vector. Each generation of members is
written to the shared folder, and its predecessor is deleted.

The codes come from a last pass over the vectors in place, with the final codebooks.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite
component are dropped, and so are vectors whose length does not divide into the parts or
is not that of the smallest kept key; an entry's first rows are those of the smallest
keys, null keys last, of equal keys the smaller vector; rows with a null or a repeated
key are coded like others; fewer rows than entries make a codebook of as many entries;
components beyond +-2^30 / sqrt(length) are held there (for 64 components |x| > 32,768),
so that no error leaves a long, and sums of errors beyond a long are its largest value; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Stages, ship, staged
from skein.sources.shared import dropped, new_dir

RESULT = "vec_id long, label {label}, code string, error long"
#: Members of one owner, about, and the fewest salts of an entry.
MEMBERS, SALTS = 65_536, 16
#: Labels up to which their sums are broadcast.
BROADCAST = 100_000


def integers(vectors: DataFrame, key: str, column: str, label: str, scale: float, parts: int) -> DataFrame:
    """(vec_id, label, v array<int>) of the kept rows."""
    v = F.col(column)
    usable = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = F.floor(F.lit(2.0**30) / F.sqrt(F.size(v))).cast("double")
    held = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -most), most)).cast("int")
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(v, held).alias("v"))


def nearest(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equals, and the squared distance."""
    best, least = np.zeros(len(members), np.int64), np.full(len(members), np.iinfo(np.int64).max)
    for k, entry in enumerate(book):
        far = ((members - entry) ** 2).sum(axis=1)
        closer = far < least
        best[closer], least[closer] = k, far[closer]
    return best, least


def matrix(array, width: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), width).astype(np.int64)


def assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members (pos, entry, salt, part) with the entry nearest in the codebooks, and
    whether that is another one than before."""

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pos, before, values = b["pos"].to_numpy(), b["entry"].to_numpy(), matrix(b["part"], books.shape[2])
            now = np.empty(len(pos), np.int32)
            for p in np.unique(pos):
                rows = np.flatnonzero(pos == p)
                now[rows] = nearest(values[rows], books[p])[0]
            yield pa.RecordBatch.from_arrays([b["pos"], pa.array(now, pa.int32()), b["salt"], b["part"], pa.array(now != before)], ["pos", "entry", "salt", "part", "moved"])

    return members.mapInArrow(assign, "pos int, entry int, salt int, part array<int>, moved boolean")


def migrated(members: DataFrame) -> DataFrame:
    """Members that keep their entry where they are, the others at its owner."""
    columns = ["pos", "entry", "salt", "part"]
    stay = members.where("not moved").select(columns)
    return stay.union(members.where("moved").select(columns).repartition("pos", "entry", "salt"))


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of their members; an entry
    without one stays."""
    width = books.shape[2]

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for b in batches:
            owner, values = np.stack([b["pos"].to_numpy(), b["entry"].to_numpy()], axis=1), matrix(b["part"], width)
            keys, at = np.unique(owner, axis=0, return_inverse=True)
            added = np.zeros((len(keys), width), np.int64)
            np.add.at(added, at.ravel(), values)
            for key, n, s in zip(map(tuple, keys.tolist()), np.bincount(at.ravel()).tolist(), added):
                n0, s0 = total.get(key, (0, 0))
                total[key] = n + n0, s + s0
        if total:
            columns = [pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)] + [pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "entry", "n", "sums"])

    owners = members.mapInArrow(sums, "pos int, entry int, n long, sums array<long>")
    every = owners.select("pos", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("pos", "entry", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    after = books.copy()
    for r in every.collect():  # as many rows as the codebooks have components
        after[r["pos"], r["entry"], r["i"]] = int(r["s"]) // r["n"]
    return after


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """(part, entry, component), learned from all rows of (vec_id, v)."""
    spark, n = rows.sparkSession, rows.count()
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not first:
        return None
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width, salts = books.shape[2], max(SALTS, -(-n // MEMBERS))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("pos"), F.slice("v", p * width + 1, F.lit(width)).alias("part"))))
    members = rows.select("v", salt.alias("salt")).select("salt", cut.alias("c")).select("c.pos", F.lit(-1).alias("entry"), "salt", "c.part")
    with Stages(spark, "lloyd") as keep:
        for k in range(rounds):
            members = keep(migrated(assigned(members, books)), f"members-{k}")
            books = updated(members, books)
            if k:
                dropped(spark, before)
            before = f"{keep.root}/{keep.count:03d}-members-{k}"
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape

    def code(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            v = matrix(b["v"], parts * width)
            found = [nearest(v[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            names = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([r.tobytes().hex() for r in names], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(code, RESULT.format(label=rows.schema["label"].dataType.simpleString()))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: at most 256 entries")
    ship(vectors.sparkSession)
    rows = staged(integers(vectors, key, column, label, scale, parts), "vectors")
    smallest = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).head()
    rows = rows.where(F.size("v") == (smallest[0] if smallest else 0))
    books = codebooks(rows, parts, entries, rounds)
    if books is None:
        empty = F.lit(None).cast("string")
        return rows.select("vec_id", empty.alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), empty.alias("codebooks_sha256"))
    codes = staged(coded(rows, books), "codes")
    sums = staged(codes.groupBy("label").agg(bounded(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    small = F.broadcast if sums.count() <= BROADCAST else (lambda df: df)
    return codes.join(small(sums), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def bounded(total: Column) -> Column:
    return F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
