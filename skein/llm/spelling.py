"""Spelling variants: words within one edit of a much more frequent word.

Near words are found by asymmetric q-chunks. A word contributes two disjoint chunks, its
halves; every word contributes, for the chunks of words one letter shorter, as long and
one letter longer, its positional grams of their length. One edit leaves one half whole,
and a whole half stands in the other word at the same place from its start or, behind
the edit, from its end: at most one place further. Only grams within that shift are
made. What is left of both words must lie within one edit itself, so the rule is
applied to it once more: a key holds a half and a chunk of the rest, about three
quarters of the word, and a frequent beginning or ending alone brings no words
together. Pairs that a key brings together are verified, and kept under their
first common key only, which is seen from the two words.

Words are counted in each task first; what is shuffled are distinct words with counts, and
hashes of keys. Forms are followed by doubling the reach of each step; a form is at
least `times` as frequent as its word, so a chain is as short as a logarithm.

Defined results: a null text has no words; a null doc_id reads as an empty one where
letters are taken out; of equally frequent near words the first in code-point order is
the form; repeated rows count as often as they stand; an empty table gives no rows; other
columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Stages, ship, staged

LETTERS = r"A-Za-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def thinned(run: Column, doc_id: Column, every: int) -> Column:
    """A run in lower case, without one of its code points where `every` divides
    the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, least: int, occurrences: int, every: int) -> DataFrame:
    """(word, n). A shorter run cannot become a word of the least length, so only
    runs that are long enough are taken from a text."""
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(runs).alias("run"))
    each = each.select(thinned(F.translate("run", CAPITALS, SMALL), F.col("doc_id"), every).alias("word")).where(F.char_length("word") >= least)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def cuts(length: Column) -> list[Column]:
    """Where the four pieces of a word of this length begin, and its end: two halves,
    each of two chunks."""
    half = F.floor(length / 2).cast("int")
    return [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((length - half) / 2).cast("int"), length]


def around(word: Column, length: Column, k: int) -> tuple[Column, Column]:
    """What a word has before and behind the k-th piece of a word of some length:
    a half and a chunk of the other half, which stand at the start or the end."""
    c = cuts(length)
    behind = length - c[k + 1]
    return F.substring(word, F.lit(1), c[k]), F.substring(word, F.char_length(word) - behind + 1, behind)


def keys(df: DataFrame, shifts: list[int]) -> DataFrame:
    """df with a row for each piece and each length of the other word."""
    found = []
    for shift in shifts:
        length = F.char_length("word") + shift
        found += [F.struct(F.xxhash64(length, F.lit(k), *around(F.col("word"), length, k)).alias("key"), F.lit(k).cast("tinyint").alias("k")) for k in range(4)]
    return df.select("*", F.explode(F.array(*found)).alias("f")).select("word", "n", "f.key", "f.k")


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words one edit apart."""
    chunks = keys(counted, [0])
    grams = keys(counted, [-1, 0, 1]).select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("key").alias("key2"), F.col("k").alias("k2"))
    met = chunks.join(grams, (F.col("key") == F.col("key2")) & (F.col("word") != F.col("other")) & (F.abs(F.char_length("word") - F.char_length("other")) <= 1))
    length = F.char_length("word")
    common = []
    for k in range(3):
        mine, its = around(F.col("word"), length, k), around(F.col("other"), length, k)
        common.append((F.col("k") > k) & (mine[0] == its[0]) & (mine[1] == its[1]))
    return met.where((F.levenshtein("word", "other", 1) == 1) & ~(common[0] | common[1] | common[2])).select("word", "n", "other", "other_n")


def roots(forms: DataFrame, keep: Stages, longest: int) -> DataFrame:
    """(word, root) of words that have a form: each step doubles how far a root is."""
    reach, last = keep(forms.select("word", F.col("form").alias("root")), "roots"), None
    for _ in range(max(1, math.ceil(math.log2(longest + 1)))):
        further = reach.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = reach.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = keep(moved, "roots")
        reach = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            break
    return reach


def group(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    ship(docs.sparkSession)
    counted = staged(words(docs, least, occurrences, every), "words")
    with Stages(docs.sparkSession, "spelling") as keep:
        frequent = F.when(F.col("other_n") >= times * F.col("n"), F.struct(-F.col("other_n"), "other"))
        best = near_words(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(frequent).alias("best"))
        near = keep(best.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.col1")).alias("form_n")), "near")
        # Counts are below 2^63, so a chain of forms has fewer steps than digits of base `times`.
        ends = roots(near.where("form is not null"), keep, math.ceil(63 / math.log2(times)))
        linked = near.join(ends.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left").drop("of")
        joined = counted.join(linked.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
        return staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")), "spelling-forms")
