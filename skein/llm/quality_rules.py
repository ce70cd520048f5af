"""Quality rules of whole texts: base counts, and the distance of a text from its language.

The references are learned from all documents: for each language the shares of
character classes and of its most common words. A document is compared with the
reference of its language by the Jensen-Shannon distance (base 2, from 0 to 1) of
both histograms. A histogram of n words lies about sqrt(bins / (8 n ln 2)) from the
one it was drawn from, which is added to the limit for words, and histograms of
fewer than `least_words` words or `least_chars` characters are not judged.

SQL functions only. A text is read in its row and never shuffled; what is shuffled
are counts of words, summed up in each task first. References have a row for each
language and are broadcast only if there are at most BROADCAST of them; the one of all
documents has a bounded length and goes into the plan.

Defined results: a null text is empty and has no words, so that it fails the base
rules; repeated rows are judged one by one; a null language, or one with fewer than
`least_reference` words in the corpus, is compared with the reference of all
documents; of equally common words the first in code-point order is taken; an empty
table gives no rows; columns other than doc_id, text and lang do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import staged

COMMON = 32
BROADCAST = 10_000
#: Character classes that are counted; the last bin has all others, letters without
#: a case among them.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{N}", "space": r"\x20\x09-\x0D", "mark": r"\p{P}", "sign": r"\p{S}"}
SPACE = r"\x20\x09-\x0D"  # in Java's expressions \s is the same
#: Columns of a language's common words.
REFERENCE = ("slots", "shares", "other_share")
#: Lengths tried for the slots of the common words.
SLOTS = range(128, 1024, 8)
#: Bits of a packed window that hold its place in the text.
PLACE = 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def with_slots(df: DataFrame) -> DataFrame:
    """Adds `slots`: the words, each at the place that its hash gives it modulo the
    length, null elsewhere; empty if each of the lengths tried brings two together."""
    place = lambda x, size: F.pmod(F.hash(x), size)
    fits = F.filter(F.array(*[F.lit(n) for n in SLOTS]), lambda n: F.size(F.array_distinct(F.transform("words", lambda x: place(x, n)))) == F.size("words"))
    df = df.withColumn("length", F.get(fits, F.lit(0))).withColumn("places", F.transform("words", lambda x: place(x, F.col("length")).cast("long")))
    slot = lambda i: F.get("words", F.array_position("places", i).cast("int") - 1)
    slots = F.transform(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1), slot)
    return df.withColumn("slots", F.coalesce(slots, F.array().cast("array<string>"))).drop("length", "places")


def present(array: Column, kind: str) -> Column:
    """The values of an array of distinct ones and nulls, in their order."""
    return F.array_except(array, F.array(F.lit(None).cast(kind)))


def sum_of(array: Column, zero: Column) -> Column:
    return F.aggregate(array, zero, lambda s, x: s + x)


def common_words(docs: DataFrame, common: int, least: int) -> DataFrame:
    """(lang, slots, shares, other_share) for each language of at least so many
    words; lang null: all documents. slots has its common words, shares the share
    of each, other_share is that of all other words."""
    counts = docs.select("lang", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    every = F.lit(None).cast("string")
    both = counts.select(F.explode(F.when(F.col("lang").isNull(), F.array(every)).otherwise(F.array("lang", every))).alias("lang"), "word", "n")
    total = staged(both.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    size = total.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "of")
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common)
    top = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    shares = F.map_from_arrays("top.word", F.transform("top", lambda t: t.n / F.col("total")))
    other = (F.col("total") - sum_of(F.col("top.n"), F.lit(0).cast("long"))) / F.col("total")
    kept = top.join(size, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("lang").isNull() | (F.col("total") >= least))
    return with_slots(kept.select("lang", F.col("top.word").alias("words"), shares.alias("shares"), other.alias("other_share"))).select("lang", *REFERENCE)


def term(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence of p from q."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return (part(p, q) + part(q, p)) / 2


def distance(terms: Column) -> Column:
    return F.sqrt(F.greatest(sum_of(terms, F.lit(0.0)), F.lit(0.0)))


def with_repeated_places(docs: DataFrame) -> DataFrame:
    """Adds `twice`: where a window of three words starts that the text has again.
    Windows are sorted as a hash and a place in one long, so that equal ones are
    neighbours; if neighbours of one hash differ, or a place is too long for its
    bits, the windows of the text themselves are sorted."""
    w, low = F.col("w"), (1 << PLACE) - 1
    packed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(~low).bitwiseOR(i.cast("long")))
    df = docs.withColumn("p", F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))))
    # Neighbours of one hash, the first ones and the second ones; the places in them are distinct.
    pair = lambda side: present(F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda x, y: F.when(F.shiftright(x.bitwiseXOR(y), PLACE) == 0, (x, y)[side])), "long")
    df = df.withColumn("first", pair(0))
    df = df.withColumn("second", F.when(F.size("first") > 0, pair(1)).otherwise(F.col("first"))).drop("p")
    place = lambda x: x.bitwiseAND(low).cast("int")
    differ = lambda x, y: (F.get(w, x) != F.get(w, y)) | (F.get(w, x + 1) != F.get(w, y + 1)) | (F.get(w, x + 2) != F.get(w, y + 2))
    whole = (F.size("w") > low) | F.exists(F.zip_with("first", "second", lambda x, y: differ(place(x), place(y))), lambda x: x)
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    at = F.when(F.size("w") > 2, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("o", F.when(whole, F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("s"), i.alias("i"))))))
    o = F.col("o")
    same = F.filter("o", lambda x, i: F.coalesce(F.get(o, i - 1).s == x.s, F.lit(False)) | F.coalesce(F.get(o, i + 1).s == x.s, F.lit(False)))
    return df.withColumn("twice", F.when(o.isNotNull(), F.transform(same, lambda x: x.i)).otherwise(F.transform(F.array_union("first", "second"), place))).drop("first", "second", "o")


def measured(docs: DataFrame) -> DataFrame:
    """docs (with text) and base counts, `classes` (characters of each class) and
    `w`, the words, in place of the text."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    # What is neither space nor a lower-case letter nor one without case is short; the other classes are counted in it.
    odd = F.regexp_replace("text", rf"[a-z{SPACE}\p{{Ll}}\p{{Lo}}]+", "")
    split = docs.withColumns({"w": words_of(F.col("text")), "odd": odd, "lines": lines, "chars": F.char_length("text")}).drop("text")
    length = lambda pattern: F.char_length("odd") - F.char_length(F.regexp_replace("odd", f"[{pattern}]+", ""))
    word_chars = F.char_length(F.array_join("w", ""))
    sized = split.withColumns({f"c_{k}": F.col("chars") - word_chars if k == "space" else length(v) for k, v in CLASSES.items()} | {"n_symbols": length(r"#*$%&|<>").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("odd", "lines")
    rest = F.col("chars")
    for k in CLASSES:
        rest = rest - F.col(f"c_{k}")
    counted = sized.withColumns({"classes": F.array(*[f"c_{k}" for k in CLASSES], rest), "n_words": F.size("w").cast("long"), "word_chars": (F.col("chars") - F.col("c_space")).cast("long")})
    repeated = with_repeated_places(counted.drop(*[f"c_{k}" for k in CLASSES], "chars"))
    inside = F.concat("twice", F.transform("twice", lambda i: i + 1), F.transform("twice", lambda i: i + 2))
    return repeated.withColumn("n_repeat_words", F.size(F.array_distinct(inside)).cast("long")).drop("twice")


def with_word_distance(df: DataFrame, least_words: int) -> DataFrame:
    """From w, and slots, shares and other_share of the reference. Common words are
    sorted, so that a word's count is the length of a run; bins without a word of
    the text add half their share."""
    size = F.size("slots")
    found = F.when(size > 0, F.filter("w", lambda x: F.get("slots", F.pmod(F.hash(x), size)) == x)).otherwise(F.filter("w", lambda x: F.map_contains_key("shares", x)))
    df = df.withColumn("s", F.sort_array(found)).drop("w", "slots")
    s, n = F.col("s"), F.size("s")
    df = df.withColumn("ends", present(F.transform("s", lambda x, i: F.when(F.coalesce(F.get(s, i + 1) != x, F.lit(True)), i + 1)), "int"))
    e, q, total = F.col("ends"), F.col("other_share"), F.greatest(F.col("n_words"), F.lit(1))
    bins = F.transform("ends", lambda i, k: F.struct(((i - F.coalesce(F.get(e, k - 1), F.lit(0))) / total).alias("p"), F.col("shares")[F.get(s, i - 1)].alias("q")))
    df = df.withColumn("bins", bins)
    met = F.transform("bins", lambda b: term(b.p, b.q) - b.q / 2)
    far = F.concat(F.array((1 - q) / 2, term((F.col("n_words") - n) / total, q)), met)
    return df.withColumn("word_distance", F.when(F.col("n_words") >= least_words, distance(far))).drop("s", "ends", "bins", "shares", "other_share")


def judge(docs: DataFrame, least_words: int = 50, least_chars: int = 200, words_limit: float = 0.15, class_limit: float = 0.25, common: int = COMMON, least_reference: int = 2000) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and class_distance and
    word_distance (null: not judged)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    known = staged(common_words(texts, common, least_reference), "common-words")
    general = known.where("lang is null").head() or (None, [], {}, 1.0)
    small = F.broadcast if known.count() <= BROADCAST else (lambda df: df)
    own = small(known.where("lang is not null").select(F.col("lang").alias("own"), *[F.col(c).alias(f"own_{c}") for c in REFERENCE]))
    literal = lambda values, kind: F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>")
    of_all = (literal(general[1], "string"), F.map_from_arrays(literal(general[2], "string"), literal(general[2].values(), "double")), F.lit(general[3]))
    placed = texts.join(own, F.col("lang") == F.col("own"), "left").withColumns({c: F.coalesce(f"own_{c}", x) for c, x in zip(REFERENCE, of_all)}).drop(*[f"own_{c}" for c in REFERENCE])
    counted = staged(with_word_distance(measured(placed), least_words), "measured")

    places = range(len(CLASSES) + 1)
    sums = counted.groupBy("own").agg(F.array(*[F.sum(F.get("classes", F.lit(i))) for i in places]).alias("q"))
    everything = counted.agg(*[F.coalesce(F.sum(F.get("classes", F.lit(i))), F.lit(0)) for i in places]).head()
    named = small(sums.where("own is not null").withColumnRenamed("own", "of"))
    q = F.coalesce("q", literal(everything, "long"))
    joined = counted.join(named, F.col("own") == F.col("of"), "left").withColumns({"q": q, "chars": F.greatest(sum_of(F.col("classes"), F.lit(0)), F.lit(1)), "of_all": F.greatest(sum_of(q, F.lit(0).cast("long")), F.lit(1))})
    classes = F.zip_with("classes", "q", lambda x, y: term(x / F.col("chars"), y / F.col("of_all")))
    far = joined.withColumn("class_distance", F.when(F.col("chars") >= least_chars, distance(classes)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    noise = F.sqrt(F.lit((common + 1) / (8 * math.log(2))) / F.greatest("n_words", F.lit(1)))
    odd = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > words_limit + noise, F.lit(False))
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
