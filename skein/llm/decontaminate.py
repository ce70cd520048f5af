"""Benchmark decontamination by SimHash of item-sized windows.

Only DataFrame and SQL functions are used. Words are runs of letters and digits
in lower case. Windows as long as some item are laid at every start where enough
of the document's shingles are shingles of items of that length for the
threshold; no other window reaches it. Which item a window may hold is found by
fingerprints: a SimHash of BITS bits over the shingles of the window, cut into
one block more than RADIUS, is joined on equal blocks with the fingerprints of
the items of that length, so every pair within the radius is met. Pairs within
it are verified: the weighted Jaccard similarity of the two multisets of shingles
must reach the threshold.

At a similarity of 0.8 the bits of two fingerprints differ with a probability of
about 0.15, so RADIUS lies more than six standard deviations of their number above
its mean; the README states what was measured.

Defined results: an item of fewer than five words has one shingle, itself; an
item without words, or with a null id, is not searched; a document shorter than
an item is one window; a null text is empty; rows that share a doc_id are
reported if one of them holds the item; a null doc_id is not reported; when
documents are filtered, each row is judged by its own text, whatever its id;
equal items are reported each; of windows with equal similarity the first
counts; empty tables give no rows; other columns do not matter, whatever their
names, and are kept when documents are filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Stages, documents, staged

SHINGLE = 5
BITS = 128
RADIUS = 44
#: Rows up to which a side is broadcast; beyond, Spark joins by shuffling. They
#: have a few numbers and a digest each.
SMALL = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def hashes(array: str, size: int) -> Column:
    """Hashes of all runs of `size` words of an array column, in order."""
    parts = ", ".join(f"get({array}, i + {j})" for j in range(size))
    return F.expr(f"if(size({array}) < {size}, array(), transform(sequence(0, size({array}) - {size}), i -> xxhash64({parts})))")


def sized(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has few rows; df must be cheap to count."""
    return F.broadcast(df) if df.count() <= limit else df


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, n, size (words to a shingle)."""
    found = benchmark.where("item_id is not null").select("item_id", words(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    return found.withColumns({"n": F.size("words"), "size": F.least(F.lit(SHINGLE), F.size("words"))})


def fingerprinted(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """keys, low, high: the SimHash of an array of shingle hashes, each occurrence
    counting. A bit is set where more than half of the shingles have it in their
    own BITS bits. A column counts two bits at once, one in each of its halves."""
    each = df.select(*keys, F.explode(array).alias("h")).select(*keys, F.xxhash64(F.lit(1), "h").alias("low"), F.xxhash64(F.lit(2), "h").alias("high"))
    pair = "4294967297L"
    sums = [F.expr(f"sum(shiftright({half}, {j}) & {pair})").alias(f"{half}_{j}") for half in ("low", "high") for j in range(32)]
    counted = each.groupBy(*keys).agg(F.count("*").alias("all"), *sums)

    def bits(half: str) -> Column:
        own = "array(" + ", ".join(f"{half}_{j}" for j in range(32)) + ")"
        return F.expr(f"""aggregate(zip_with({own}, sequence(0, 31), (s, j) -> struct(s as s, j as j)), 0L,
            (v, x) -> v | if(2 * (x.s & 4294967295L) > all, shiftleft(1L, x.j), 0L) | if(2 * shiftrightunsigned(x.s, 32) > all, shiftleft(1L, x.j + 32), 0L))""")

    return counted.select(*keys, bits("low").alias("low"), bits("high").alias("high"))


def blocks() -> Column:
    """(block number, bits) of RADIUS + 1 blocks that cover low and high; none
    spans both."""
    half = (RADIUS + 2) // 2
    out = []
    for column, first, count in (("low", 0, half), ("high", half, RADIUS + 1 - half)):
        edges = [64 * i // count for i in range(count + 1)]
        out += [F.struct(F.lit(first + i).alias("block"), F.shiftrightunsigned(F.col(column), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.array(*out)


def windows(docs: DataFrame, shingle: DataFrame, size: int, threshold: float) -> DataFrame:
    """row, n, m, start of every window of n words (all of a shorter document) in
    which so many shingles, of m, are shingles of items of n words that it may
    reach the threshold with one. row: a digest that equal texts share; shingle:
    n, h.

    Arrays are made before they are exploded, so that no row copies the words, and
    exploded by the outer form: the other would test the array's size first and
    make it once more for that.

    Of the `need` places that a window must have, the first is hit k and the last
    hit k + need - 1, so its start lies after hit k - 1, not after hit k, and at
    most m - 1 before hit k + need - 1."""
    texts = documents(docs).select(F.md5("text").alias("row"), words(F.col("text")).alias("words"))
    at = texts.select("row", F.size("words").alias("length"), hashes("words", size).alias("all"))
    at = at.select("row", "length", F.posexplode_outer("all").alias("p", "h"))
    at = at.join(sized(shingle.select("h").distinct()), "h", "left_semi")
    hits = at.join(sized(shingle), "h").groupBy("row", "n", "length").agg(F.sort_array(F.collect_set("p")).alias("hits"))
    hits = hits.withColumn("m", F.least("n", "length") - (size - 1))
    need = F.ceil(threshold * (F.col("m") + F.col("n") - (size - 1)) / (1 + threshold) - 1e-9)
    hits = hits.withColumn("need", F.greatest(F.lit(1), need.cast("int"))).where(F.size("hits") >= F.col("need"))
    begin = "greatest(0, if(k > 0, get(hits, k - 1) + 1, 0), get(hits, k + need - 1) - m + 1)"
    some = F.expr(f"transform(slice(hits, 1, size(hits) - need + 1), (p, k) -> struct({begin} as low, least(p, length - least(n, length)) as high))")
    first = hits.select("row", "n", "m", F.filter(some, lambda x: x["low"] <= x["high"]).alias("some")).select("row", "n", "m", F.explode_outer("some").alias("at")).where("at is not null")
    return first.select("row", "n", "m", F.explode(F.sequence("at.low", "at.high")).alias("start"))


def candidates(marked: DataFrame, known: DataFrame) -> DataFrame:
    """row, n, m, start, item_id of the windows and items of n words whose
    fingerprints are within the radius; both sides have n, low, high."""
    own = known.select("n", "item_id", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(blocks()).alias("k")).select("n", "item_id", "low_b", "high_b", "k.block", "k.bits")
    met = marked.select("row", "n", "m", "start", "low", "high", F.explode(blocks()).alias("k")).select("row", "n", "m", "start", "low", "high", "k.block", "k.bits")
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_b")))
    met = met.join(sized(own), ["n", "block", "bits"]).where(apart <= RADIUS)
    return met.select("row", "n", "m", "start", "item_id").distinct()


def similar(met: DataFrame, cut: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """row, item_id, start, similarity of the candidates that reach it."""
    window = ["row", "n", "start"]
    own = cut.select(*window, F.explode("shingles").alias("h")).groupBy(*window, "h").agg(F.count("*").alias("c"))
    item = known.select("item_id", F.size("shingles").alias("size"), F.explode("shingles").alias("h")).groupBy("item_id", "size", "h").agg(F.count("*").alias("d"))
    both = met.join(own, window).join(sized(item), ["item_id", "h"]).groupBy("row", "item_id", "start", "m", "size").agg(F.sum(F.least("c", "d")).alias("both"))
    return both.select("row", "item_id", "start", (F.col("both") / (F.col("m") + F.col("size") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold)


def held(docs: DataFrame, benchmark: DataFrame, threshold: float, stage: Stages) -> DataFrame:
    """row, item_id, start, similarity of every item that a text holds, at its
    most similar window."""
    bench = stage(items(benchmark), "items")
    found = docs.sparkSession.createDataFrame([], "row string, item_id long, start int, similarity double")
    for size in sorted(r["size"] for r in bench.select("size").distinct().collect()):
        known = stage(bench.where(F.col("size") == size).select(F.col("item_id").cast("long").alias("item_id"), "n", hashes("words", size).alias("shingles")), "items")
        shingle = stage(known.select("n", F.explode("shingles").alias("h")).distinct(), "item-shingles")
        laid = stage(windows(docs, shingle, size, threshold).groupBy("row").agg(F.collect_set(F.struct("n", "m", "start")).alias("laid")), "windows")
        texts = documents(docs).select(F.md5("text").alias("row"), "text").join(sized(laid.select("row")), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
        texts = texts.join(laid, "row").select("row", "laid", words(F.col("text")).alias("words")).select("row", "laid", hashes("words", size).alias("all"))
        texts = stage(texts, "window-texts")  # else the hashes would be made anew for each window
        cut = texts.select("row", F.expr("transform(laid, w -> struct(w.n as n, w.m as m, w.start as start, slice(all, w.start + 1, w.m) as shingles))").alias("cut"))
        cut = cut.select("row", F.explode_outer("cut").alias("w")).select("row", "w.*")
        cut = stage(cut, "cut-windows")
        marked = fingerprinted(cut, ["row", "n", "m", "start"], "shingles")
        met = candidates(marked, stage(fingerprinted(known, ["item_id", "n"], "shingles"), "fingerprints"))
        found = found.union(similar(met, cut, known, threshold))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("start")))
    found = found.groupBy("row", "item_id").agg(best.alias("best"))
    return stage(found.select("row", "item_id", F.col("best.start").cast("int").alias("start"), "best.similarity"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, start (word, from 0), similarity of every item that a
    document holds, at its most similar window."""
    with Stages(docs.sparkSession, "decontamination") as stage:
        found = held(docs, benchmark, threshold, stage)
        named = documents(docs).where("doc_id is not null").select("doc_id", F.md5("text").alias("row"))
        best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("start")))
        found = named.join(sized(found), "row").groupBy("doc_id", "item_id").agg(best.alias("best"))
        return staged(found.select("doc_id", "item_id", "best.start", "best.similarity"), "leaks")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows and columns of the documents whose text holds no item."""
    with Stages(docs.sparkSession, "decontamination") as stage:
        bad = staged(held(docs, benchmark, threshold, stage).select("row").distinct(), "leaked-texts")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(sized(bad), F.md5(text) == bad["row"], "left_anti")
