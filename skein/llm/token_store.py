"""Token-id files with a minimal perfect hash index for keyed access.

A shard file holds, in this order: the ids of its documents without gaps (16 or
32 bits wide), the id offset of each document, the document keys in payload
order, the hash displacements, and for each slot a fingerprint, the first
document of the key and the number of its documents; then a fixed footer. A
lookup reads the index once and then costs two hashes, one fingerprint
comparison and one ranged read, whatever the number of documents.

Shards are written to the shared folder under their final name by a rename of a
finished file, and their content depends on the rows alone, so a task that is
repeated after a lost executor replaces its file with the same bytes.

Defined results: a null text is empty (its only id is the end id); documents
with a null doc_id come first and can be scanned but not looked up; documents
that share a doc_id are kept in text order and a lookup returns them all; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import mph
from skein.llm.common import documents, new_dir, slices, staged
from skein.llm.encoding import encoder

FOOTER = struct.Struct("<8sQQQQQQ")
MAGIC = b"SKTOKEN1"
END_ID = 0


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams documents of one shard; only keys and offsets stay in memory."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.width = width
        self.keys: list[int | None] = []
        self.offsets = [0]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.keys.append(key)
        self.offsets.append(self.offsets[-1] + len(ids))

    def close(self) -> int:
        nulls = sum(k is None for k in self.keys)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        distinct, first, count = np.unique(keys[nulls:], return_index=True, return_counts=True)
        as_u8 = distinct.astype(np.uint64)
        shift = mph.build(as_u8)
        slot = mph.slots(as_u8, shift, len(distinct))
        marks, at, many = (np.zeros(len(distinct), "<u4") for _ in range(3))
        marks[slot], at[slot], many[slot] = mph.fingerprints(as_u8), first + nulls, count
        for part in (np.array(self.offsets, "<u8"), keys, shift.astype("<u4"), marks, at, many):
            self.out.write(part.tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.width, len(keys), nulls, len(distinct), len(shift), self.offsets[-1]))
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.offsets[-1]


class Shard:
    """Keyed and sequential access to one shard file."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, n, self.nulls, d, m, self.n_ids = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        raw = self.file.read_at(size - FOOTER.size - self.n_ids * self.width, self.n_ids * self.width)
        parts, at = [], 0
        for kind, k in (("<u8", n + 1), ("<i8", n), ("<u4", m), ("<u4", d), ("<u4", d), ("<u4", d)):
            parts.append(np.frombuffer(raw, kind, k, at))
            at += parts[-1].nbytes
        self.offsets, self.keys, self.shift, self.marks, self.first, self.count = parts

    def ids(self, document: int) -> np.ndarray:
        a, b = int(self.offsets[document]), int(self.offsets[document + 1])
        raw = self.file.read_at((b - a) * self.width, a * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents for a
        key whose fingerprint or stored key differs."""
        if not len(self.marks):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        as_u8 = keys.astype(np.int64).astype(np.uint64)
        slot = mph.slots(as_u8, self.shift, len(self.marks))
        first = self.first[slot].astype(np.int64)
        hit = (self.marks[slot] == mph.fingerprints(as_u8)) & (self.keys[first] == keys)
        return first, np.where(hit, self.count[slot], 0)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Encode and write whole texts in ascending doc_id order.

    Returns the manifest, one row for each shard: shard, path, n_docs, n_ids,
    first_id, last_id, start (ids of all shards before it).
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 65536 else 4
    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def shard(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        enc, out = encoder(tokenizer), None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(folder, f"shard-{number:06d}.bin", width)
            for part in slices(batch):
                for key, raw in zip(part["doc_id"].to_pylist(), enc.ids(part["text"].to_pylist())):
                    out.add(key, np.append(np.frombuffer(raw, "<u4"), np.uint32(END_ID)))
        if out:
            n = out.close()
            keys = [k for k in out.keys if k is not None]
            yield pa.RecordBatch.from_pylist(
                [{"shard": number, "path": f"{folder}/shard-{number:06d}.bin", "n_docs": len(out.keys), "n_ids": n, "first_id": keys[0] if keys else None, "last_id": keys[-1] if keys else None}],
                pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]),
            )

    manifest = staged(ordered.mapInArrow(shard, "shard int, path string, n_docs long, n_ids long, first_id long, last_id long"), "token-manifest")
    return with_starts(manifest)


def with_starts(manifest: DataFrame, per_group: int = 1024) -> DataFrame:
    """Prefix sums over shards in two levels, so that no task sees them all."""
    m = manifest.withColumn("block", F.floor(F.col("shard") / per_group))
    totals = m.groupBy("block").agg(F.sum("n_ids").alias("t"))
    before = totals.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("block").orderBy("shard")) - F.col("n_ids")
    return m.withColumn("inside", inside).join(before, "block").select(*manifest.columns, (F.col("before") + F.col("inside")).alias("start"))


def scan(manifest: DataFrame) -> DataFrame:
    """Every document of the files, found again through the index: doc_id,
    start, n_tokens, ids_crc32, shard."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                s = Shard(row.path)
                first, count = s.find(np.unique(s.keys[s.nulls :]))
                found = np.concatenate([np.arange(s.nulls), np.repeat(first, count) + _within(count)]).astype(np.int64)
                if len(found) != len(s.keys):
                    raise ValueError(f"{row.path}: the index finds {len(found)} of {len(s.keys)} documents")
                for lo in range(0, len(found), 4096):
                    part = found[lo : lo + 4096]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(np.where(part < s.nulls, 0, s.keys[part]), "Int64").copy() if not s.nulls else pd.array([None if d < s.nulls else int(s.keys[d]) for d in part], "Int64"),
                            "start": row.start + s.offsets[part].astype(np.int64),
                            "n_tokens": (s.offsets[part + 1] - s.offsets[part]).astype(np.int64),
                            "ids_crc32": np.array([zlib.crc32(s.ids(d).tobytes()) for d in part], np.int64),
                            "shard": np.full(len(part), row.shard, np.int32),
                        }
                    )

    spread = manifest.select("shard", "path", "start").repartition(max(1, manifest.count()))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """ids of the documents with the given doc_id values (one column): doc_id,
    ids. A key that no shard holds gives no row."""

    def read(key, frame: pd.DataFrame) -> pd.DataFrame:
        s = Shard(frame["path"].iloc[0])
        want = frame["doc_id"].drop_duplicates().to_numpy(np.int64)
        first, count = s.find(want)
        rows = [(int(k), s.ids(d).tolist()) for k, f, c in zip(want, first, count) for d in range(f, f + c)]
        return pd.DataFrame(rows, columns=["doc_id", "ids"])

    k = keys.select(F.col(keys.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    near = k.join(manifest.select("shard", "path", "first_id", "last_id"), F.col("doc_id").between(F.col("first_id"), F.col("last_id")))
    return near.groupBy("shard").applyInPandas(read, "doc_id long, ids array<long>")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write documents as token files and return what the files hold."""
    return scan(write(docs, tokenizer))
