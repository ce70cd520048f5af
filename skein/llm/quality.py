"""Quality classification by supervised subword embeddings.

Words and their character n-grams are hashed to learned vectors; a text is the
average over its words, each the average of its own vectors; a softmax gives the
class. Training is plain stochastic gradient descent in numpy on a bounded,
hashed sample of labelled rows. As averaging and the output layer are linear, a
word's share of the logit is one number, so scoring keeps that number for each
word it has met and adds them up over the whole text.

Defined results: a null, empty or blank text gets the score of the bias alone;
labels that are null or belong to no document do not count; without labels every
score is 0.5; null doc_ids and repeated rows are kept and scored, and an id of several
texts is learned from once, by the smallest; a very long text is scored whole; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import documents, hold, ship, slices
from skein.llm.languages import held_out

BUCKETS = 1 << 16
GRAMS = (3, 4)
SCORED = "doc_id long, score double"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their n-grams of bytes between word ends,
    and the word of each bucket."""
    marked = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    buckets = [np.fromiter(map(zlib.crc32, marked), np.uint64, len(marked)) % np.uint64(BUCKETS)]
    owners = [np.arange(len(marked))]
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ raw[j : len(raw) - n + 1 + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            inside = owner[: len(raw) - n + 1] == owner[n - 1 :]
            buckets.append(h[inside] % np.uint64(BUCKETS))
            owners.append(owner[: len(raw) - n + 1][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """share: what each bucket adds to the logit of label 1; bias."""

    share: np.ndarray
    bias: float

    def words(self, words: list[str]) -> list[float]:
        buckets, owner = word_features(words)
        return (np.bincount(owner, self.share[buckets], len(words)) / np.bincount(owner, minlength=len(words))).tolist()


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights in its average."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    names, counts = np.unique(words, return_counts=True)
    buckets, owner = word_features(names.tolist())
    weight = (counts / len(words) / np.bincount(owner, minlength=len(names)))[owner]
    distinct, at = np.unique(buckets, return_inverse=True)
    return distinct, np.bincount(at, weight)


def fit(rows: list[tuple[str, int]], size: int = 8, epochs: int = 8, rate: float = 20.0, seed: int = 1) -> Model:
    """Stochastic gradient descent, one text at a time, the rate falling to 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS, size))
    output, bias = np.zeros((2, size)), np.zeros(2)
    bags = [(*bag(t), int(y)) for t, y in rows]
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, weight, y = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = weight @ vectors[ids]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ output
            output -= 0.05 * lr * np.outer(p, hidden)
            bias -= 0.005 * lr * p
            vectors[ids] -= lr * np.outer(weight, back)
    return Model((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most_rows: int = 4000, most_bytes: int = 64_000_000) -> Model:
    """Fit on at most most_rows labelled documents, the first by a hash of the id, whose
    texts have at most most_bytes together; both bounds hold however many labels, rows of an
    id or long texts there are. Of rows that share an id the smallest text is taken.
    Labels of absent documents use up none of the bounds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(column) > 0).cast("int").alias("y"))
    known = known.join(documents(docs).select("doc_id"), "doc_id", "left_semi")
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    # The window runs over most_rows rows at most, and over their lengths only.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    within = texts.select("doc_id", F.octet_length("text").alias("n")).withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= most_bytes).select("doc_id")
    found = texts.join(F.broadcast(within), "doc_id", "left_semi").collect()
    rows = [(r["text"], r["y"]) for r in sorted(found, key=lambda r: r["doc_id"])]
    return fit(rows) if rows else Model(np.zeros(BUCKETS), 0.0)


_KNOWN: dict[int, dict[str, float]] = {}


def score(docs: DataFrame, model: Model, limit: int = 1_000_000) -> DataFrame:
    """SCORED of every document: the probability of label 1."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.share, model.bias))
    name = zlib.crc32(model.share.tobytes() + repr(model.bias).encode())

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hold("quality", _KNOWN.clear)
        if name not in _KNOWN:
            _KNOWN.clear()
        known, own = _KNOWN.setdefault(name, {}), Model(*shared.value)
        for batch in batches:
            for part in slices(batch):
                cut = [t.split() for t in part["text"].to_pylist()]
                met: set[str] = set()
                for words in cut:
                    met.update(words)
                if len(known) + len(met) > limit:
                    known.clear()
                new = list(met.difference(known))
                if new:
                    known.update(zip(new, own.words(new)))
                sums = np.array([sum(map(known.__getitem__, words)) / max(1, len(words)) for words in cut])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(1 / (1 + np.exp(-(sums + own.bias))))], ["doc_id", "score"])

    return documents(docs).mapInArrow(read, SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from the labels that are not held out, and score all documents."""
    kept = held_out(parts=5, part=0)
    return (
        score(docs, train(docs, labels.where(~kept)))
        .withColumn("held_out", kept)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .select("doc_id", "held_out", "score", "predicted")
    )
