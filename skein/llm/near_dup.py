"""Near-duplicate classes by BagMinHash, banding and exact verification.

A document is the multiset of its five-word shingles. BagMinHash draws, for each
shingle, the points of a Poisson process over (weight, signature component):
weights are cut into the levels [0, 1), [1, 2), [2, 4), ..., and each level has a
process of its own whose rate is its width, so that a shingle draws only from
levels below its weight, in order of time, and stops as soon as its next point
is later than every component of the signature. Two signatures agree in a
component with the weighted Jaccard similarity of the multisets.

Signatures are cut into bands; documents that share bands are candidates and
their multisets are compared exactly. Copies (equal word sequences) count once
throughout. In a band every text is first compared with one pivot; only texts
that remain in different components after that, and could still be similar
enough, are compared with each other (see links), so a large group of near
copies costs about one comparison for each member.

Defined results: words are runs of letters, digits and underscores in lower
case; a text of fewer than five words is one shingle; texts without words are
copies of each other; a null text is empty; rows that share a doc_id are one
document, which is linked through each of its texts; a row with a null doc_id is
returned with a null class and joins no class, but in deduplication it is a
document by its text; an empty table gives no rows; texts of any length are
compared whole; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Stages, documents, hold, ship, slices, staged

WORDS = 5
#: Members of a group that are compared with its hub in one slice, and documents
#: of a band in one cell of its grid.
SLICE, CELL = 256, 1024
BANDS, ROWS = 32, 4
SIGNED = "doc_id long, mark long, copy binary, bands array<long>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
word = re.compile(r"\w+").findall


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, kept for words that were met lately."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_HASHES = WordHashes()


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out = (out + h[j : len(h) - n + 1 + j]) * np.uint64(0x9FB21C651E98DF25)
    return np.unique(mix(out), return_counts=True)


def bag_minhash(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures (n x size, 64-bit) of n bags given as flat arrays."""
    best = np.full(n * size, np.inf)
    name = np.zeros(n * size, np.uint64)
    levels = np.maximum(1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1)
    at = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    with np.errstate(over="ignore"):
        seed = mix(hashes[at] + level.astype(np.uint64) * _GOLD)
    owner, weight, time = owner[at], weights[at].astype(float), np.zeros(len(at))
    latest = np.full(n, np.inf)
    step = 0
    while len(seed):
        points = 1 if len(seed) > 4096 else 16
        count = np.arange(step, step + points, dtype=np.uint64)
        step += points
        with np.errstate(over="ignore"):
            draw = mix(seed[:, None] + (np.uint64(2) * count + np.uint64(1)) * _GOLD)
            other = mix(draw + _GOLD)
        gap = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[:, None]
        when = time[:, None] + np.cumsum(gap, axis=1)
        inside = low[:, None] + width[:, None] * ((other >> np.uint64(32)).astype(float) * 2.0**-32) < weight[:, None]
        good = inside & (when < latest[owner][:, None])
        slot = (owner[:, None] * size + (other & np.uint64(0xFFFFFFFF)).astype(np.int64) * size // 2**32)[good]
        found = when[good]
        np.minimum.at(best, slot, found)
        won = best[slot] == found
        name[slot[won]] = draw[good][won]
        latest = best.reshape(n, size).max(axis=1)
        live = when[:, -1] < latest[owner]
        seed, owner, weight, low, width, time = seed[live], owner[live], weight[live], low[live], width[live], when[live, -1]
    return name.reshape(n, size)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
        for r in range(ROWS):
            out = mix(out + parts[:, :, r] * _GOLD + np.uint64(r + 1))
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """SIGNED of every document: a hash of its text as it stands, a digest that
    copies share, and band keys."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        hold("near_dup", forget)
        for batch in batches:
            for part in slices(batch):
                copies, hashes, weights = [], [], []
                for text in part["text"].to_pylist():
                    words = word(text.lower())
                    copies.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                    h, w = shingles(words)
                    hashes.append(h)
                    weights.append(w)
                owner = np.repeat(np.arange(len(copies)), list(map(len, hashes)))
                keys = band_keys(bag_minhash(np.concatenate(hashes), np.concatenate(weights), owner, len(copies), BANDS * ROWS))
                offsets = np.cumsum([0] + [BANDS if len(h) else 0 for h in hashes])
                flat = keys[[len(h) > 0 for h in hashes]].ravel()
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["mark"], pa.array(copies, pa.binary()), bands], ["doc_id", "mark", "copy", "bands"])

    return documents(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(sign, SIGNED)


@lru_cache(1024)
def bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of a text, their counts and the sum of these. A text is in many
    pairs of its group, so a worker keeps the latest."""
    hashes, counts = shingles(word(text.lower()))
    return hashes, counts.astype(np.int32), int(counts.sum())


def forget() -> None:
    _HASHES.clear()
    bag.cache_clear()


def reaches(a: tuple, b: tuple, threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two bags is high enough."""
    if min(a[2], b[2]) < threshold * max(a[2], b[2]):
        return False
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = int(np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum())
    return both >= threshold * (a[2] + b[2] - both)


def compared(pairs: DataFrame, texts: DataFrame, threshold: float, stage: Stages) -> DataFrame:
    """The (a, b) of which the weighted Jaccard similarity reaches threshold. A
    hub a is dealt to slices of about SLICE partners, and its text is sent once to
    each; a task keeps the shingles of one hub and meets its partners in turn."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hold("near_dup", forget)
        hub, own = None, None
        for batch in batches:
            for part in slices(batch):
                good = []
                for a, b, text in zip(*(part[c].to_pylist() for c in ("a", "b", "text"))):
                    if b is None:
                        hub, own = a, bag(text)
                    good.append(b is not None and a == hub and reaches(own, bag(text), threshold))
                yield pa.RecordBatch.from_arrays([part["a"], part["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).alias("many"))
    dealt = stage(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "many").alias("slice")), "slices")
    partners = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "slice", "b", "text")
    hubs = dealt.select("a", "slice").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "slice", F.lit(None).cast("long").alias("b"), "text")
    met = hubs.union(partners).repartition("a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("b"))
    return met.select("a", "b", "text").mapInArrow(verify, "a long, b long")


def components(edges: DataFrame, stage: Stages) -> DataFrame:
    """(node, root) of every node of the edges (a, b): alternating large-star
    and small-star steps until nothing changes. Each round's edges are written
    to the shared folder; only a count and a checksum reach the driver."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(least, "a")
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    while True:
        e = stage(stars(stars(e, True), False), "edges")
        now = state(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = now


def pivot_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): every document b of a band with the one that meets most others in
    all its bands, a, so that the text which copies were made from comes first."""
    degree = bands.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    best = F.max(F.struct("degree", (-F.col("doc_id")).alias("minus")))
    first = bands.join(degree, "doc_id").groupBy("band").agg(best.alias("best")).select("band", (-F.col("best.minus")).alias("pivot"))
    pairs = bands.join(first, "band").where("doc_id <> pivot").select("pivot", F.least("doc_id", "pivot").alias("low"), F.greatest("doc_id", "pivot").alias("high"))
    pairs = pairs.groupBy("low", "high").agg(F.count("*").alias("shared"), F.min("pivot").alias("a")).where("shared >= 2")
    return pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def sizes(texts: DataFrame) -> DataFrame:
    """doc_id, n, m: shingles of each text, and how many of them, at most, any
    other of the texts can share: those whose hash is in another text too."""

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                bags = [bag(t) for t in part["text"].to_pylist()]
                lengths = [len(x[0]) for x in bags]
                columns = (np.repeat(part["doc_id"].to_numpy(), lengths), np.concatenate([x[0] for x in bags]).astype(np.uint32).view(np.int32), np.concatenate([x[1] for x in bags]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "h", "c"])

    every = texts.mapInArrow(grams, "doc_id long, h int, c int")
    once = every.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other"), F.sum("c").alias("c"))
    alone = F.when(F.col("doc_id") == F.col("other"), F.col("c")).otherwise(0)
    unique = once.where(alone > 0).groupBy("doc_id").agg(F.sum("c").alias("u"))

    def totals(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [max(1, len(word(t.lower())) - WORDS + 1) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64())], ["doc_id", "n"])

    n = texts.mapInArrow(totals, "doc_id long, n long")
    return n.join(unique, "doc_id", "left").select("doc_id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m"))


def mixed(rooted: DataFrame) -> DataFrame:
    """The rows of bands that join documents of different components."""
    bands = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return rooted.join(bands, "band", "left_semi")


def grid(rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of every band with itself, by band, p and q: a band
    of many documents is dealt to parts, and each pair of parts is a key of its
    own, so that no task meets a large band whole."""
    parts = rooted.groupBy("band").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    dealt = rooted.join(parts, "band").withColumn("p", F.pmod(F.xxhash64("doc_id"), "parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = dealt.withColumn("q", every).drop("parts")
    return left, dealt.withColumnRenamed("p", "q").withColumn("p", every).drop("parts")


def links(texts: DataFrame, bands: DataFrame, threshold: float, stage: Stages) -> DataFrame:
    """Verified links (a, b) between distinct texts that connect exactly the
    documents which all links of at least the threshold connect.

    First every band's documents are compared with a pivot. What is left are
    pairs of different components; of these, a pair is compared only if the
    shingles that either shares with any other text would be enough for the
    threshold: texts edited too much to link to anything drop out here, and with
    them the square of the size of a group of loose copies. Of the bands that a
    pair shares, the first one brings it."""
    pivots = stage(pivot_pairs(bands), "pivots")
    strong = stage(compared(pivots, texts, threshold, stage), "links")
    roots = components(strong, stage)
    rooted = bands.join(roots, bands["doc_id"] == roots["node"], "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rooted = stage(mixed(rooted), "mixed-bands")
    left = texts.join(rooted.select("doc_id").distinct(), "doc_id", "left_semi")
    own = rooted.groupBy("doc_id").agg(F.collect_set("band").alias("bands"))
    able = stage(sizes(left).where(F.col("m") >= threshold * F.col("n")).join(own, "doc_id"), "sizes")
    rooted = stage(mixed(rooted.join(able, "doc_id")), "mixed-bands")
    one, other = grid(rooted)
    both = F.least("m", "m_b")
    common = F.array_intersect("bands", "bands_b")
    other = other.withColumnsRenamed({"doc_id": "b", "root": "root_b", "n": "n_b", "m": "m_b", "bands": "bands_b"})
    rest = one.withColumnsRenamed({"doc_id": "a", "root": "root_a"}).join(other, ["band", "p", "q"])
    rest = rest.where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (both >= threshold * (F.col("n") + F.col("n_b") - both)))
    rest = rest.where((F.size(common) >= 2) & (F.array_min(common) == F.col("band"))).select("a", "b").distinct()
    tried = pivots.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stage(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    return strong.union(stage(compared(rest, texts, threshold, stage), "links"))


def found_links(docs: DataFrame, threshold: float, stage: Stages) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All rows with the digest of their copies; the copies with their first
    document and their name; links between names of copies that are texts of one
    document; and verified links between names.

    A copy is named by its first document, but where that has other texts too, by
    a negative hash of the copy, so that two texts never have one name."""
    all_rows = stage(signed(docs), "signatures")
    named = all_rows.where("doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("copy").alias("low"), F.max("copy").alias("high")).where("low < high")
    several = stage(several.select("doc_id", "low"), "several")
    copies = named.groupBy("copy").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("bands").alias("bands"))
    own = F.when(F.col("several").isNull(), F.col("first")).otherwise(F.xxhash64("copy").bitwiseOR(F.lit(-1 << 63)))
    copies = copies.select("copy", "bands", F.col("one.doc_id").alias("first"), F.col("one.mark").alias("mark"))
    copies = copies.join(several.select(F.col("doc_id").alias("first"), F.lit(True).alias("several")), "first", "left")
    copies = stage(copies.select("copy", "first", "mark", own.alias("name"), "bands"), "copies")
    texts_of_one = named.join(several, "doc_id").where("copy > low").select("low", "copy").distinct()
    texts_of_one = texts_of_one.join(copies.select("copy", F.col("name").alias("a")), "copy").join(copies.select(F.col("copy").alias("low"), F.col("name").alias("b")), "low").select("a", "b")
    bands = copies.select(F.col("name").alias("doc_id"), F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    bands = stage(bands.join(shared, "band"), "bands")
    wanted = bands.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("doc_id").alias("name"))
    wanted = wanted.join(copies.select("name", "first", "mark"), "name").withColumnRenamed("first", "doc_id")
    texts = documents(docs).withColumn("mark", F.xxhash64("text")).join(wanted, ["doc_id", "mark"])
    texts = texts.groupBy(F.col("name").alias("doc_id")).agg(F.min("text").alias("text"))
    return all_rows, copies.select("copy", "first", "name"), texts_of_one, links(stage(texts, "candidates"), bands, threshold, stage)


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and class_id of every row; the class id is the smallest doc_id of
    the class. Documents are in one class if a chain of links of at least the
    threshold, or of equal word sequences, joins them."""
    with Stages(ship(docs.sparkSession), "near-duplicates") as stage:
        all_rows, copies, texts_of_one, found = found_links(docs, threshold, stage)
        roots = components(found.union(texts_of_one), stage)
        # Roots are names; the class id is the smallest first document under one.
        rooted = copies.join(roots, copies["name"] == roots["node"], "left").select("copy", "first", "root")
        least = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
        rooted = rooted.join(least, "root", "left").select("copy", F.coalesce("least", "first").alias("class"))
        placed = all_rows.select("doc_id", "copy").join(rooted, "copy", "left")
        return staged(placed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class_id")), "classes")


def linked(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The links behind the classes: (doc_id, first) names for each document the
    first one with the same words, one row for each of its texts, and (a, b) are
    verified links between the texts of such firsts that, with the texts of one
    document, hold every class together."""
    with Stages(ship(docs.sparkSession), "near-duplicates") as stage:
        all_rows, copies, _, found = found_links(docs, threshold, stage)
        firsts = all_rows.where("doc_id is not null").join(copies, "copy").select("doc_id", "first").distinct()
        first = copies.select("name", "first")
        pairs = found.join(first.toDF("a", "first_a"), "a").join(first.toDF("b", "first_b"), "b")
        pairs = pairs.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")).distinct()
        return staged(firsts, "firsts"), staged(pairs, "links")


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows and columns of one document of each class, its smallest doc_id. A
    row with a null doc_id is a document named by its text, behind all ids below
    2 ** 62: it stays if no document with an id is in its class."""
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)))
    kept = classes(docs.select(named.alias("doc_id"), "text"), threshold).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    mark, count = "__document_named", "__row_of_document"
    stay = docs.select("*", named.alias(mark)).join(kept, F.col(mark) == kept["kept_id"], "left_semi")
    stay = stay.withColumn(count, F.row_number().over(Window.partitionBy(mark).orderBy("text"))).where(F.col(count) == 1)
    return stay.select(*(stay[c] for c in docs.columns))
