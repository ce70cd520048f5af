"""Personal data and the terms that give it away, with SQL functions only.

Four base kinds are found by expressions, leftmost and non-overlapping, and
checked. Every distinct valid value is a protected entity. How much a term
reveals of an entity that it shares documents with is estimated from the corpus,
after the information theory of disclosure: with IC(x) = log2(N / df(x)) and
PMI(t; e) = log2(N co(t, e) / (df(t) df(e))), the share PMI / IC(e) of the
entity's information is what the term discloses; it is 1 for a term that occurs
with the entity alone. Terms from `removed` on are removed, from `generalised` on
they are generalised: cut to the longest beginning that, as the class of all
words with it, carries too little information to disclose so much. All counts
are of whole documents, over all documents.

Every step is linear in the matches of a text: offsets are running sums over
exploded matches, e-mail addresses are blanked before terms are looked for (the
other kinds hold no letters), and entities that occur in the same documents are
one class, as are such terms, so that pairs are of classes.

Defined results: a null text is empty; a null doc_id is kept; repeated rows are
rows of their own with the same spans; fewer than min_docs common documents say
nothing about a term, nor does an entity of all documents; an empty table gives
no rows; columns other than doc_id and text do not matter. Spans count code
points, the end is exclusive. A term that touches an address is no term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Stages, documents, staged

#: The base expressions, written without needless backtracking. A
#: start inside a run that has already failed cannot match, so only starts of
#: runs, and the place where the last match ended, are tried.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition without which a text has no match.
GUARDS = {
    "email": "contains(text, '@')",
    "ip": "text rlike '[0-9][.][0-9]+[.][0-9]'",
    "card": "text rlike '[0-9](?:[ -]?[0-9]){12}'",
    "phone": "contains(text, '+')",
}
DIGITS = "regexp_replace(value, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(transform(split(value, '[.]'), p -> ltrim('0', p)), p -> length(p) <= 3 and cast('0' || p as int) <= 255)",
    "card": f"""length({DIGITS}) between 13 and 19 and
        aggregate(sequence(1, length({DIGITS})), 0, (sum, i) -> sum + if(i % 2 = 1, 0, if(cast(substr({DIGITS}, -i, 1) as int) > 4, cast(substr({DIGITS}, -i, 1) as int) - 9, cast(substr({DIGITS}, -i, 1) as int)))
            + cast(substr({DIGITS}, -i, 1) as int)) % 10 = 0""",
    "phone": f"length({DIGITS}) between 9 and 15",
}
#: What stands for each character of an address, and terms with it.
BLANK = "\\u0001"
TERM = r"[\p{L}\x01]{3,}"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(kind: str) -> str:
    """SQL: array of (kind, gap, value, ok) of the matches in text, where gap is
    the number of code points since the match before."""
    p, number = quoted(PATTERNS[kind]), list(PATTERNS).index(kind)
    found = f"""zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0),
        (gap, value) -> if(value is null, null, struct({number} as kind, length(gap) as gap, value as value, {VALID[kind]} as ok)))"""
    return f"case when {GUARDS[kind]} then filter({found}, m -> m is not null) else array() end"


def blanked() -> Column:
    """The text with every address made of BLANK, code point for code point."""
    p = quoted(PATTERNS["email"])
    plain = f"translate(gap, '{BLANK}', ' ')"
    parts = f"zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (gap, value) -> concat({plain}, coalesce(repeat('{BLANK}', length(value)), '')))"
    return F.expr(f"case when {GUARDS['email']} then array_join({parts}, '') else {plain.replace('gap', 'text')} end")


def read(docs: DataFrame) -> DataFrame:
    """doc_id, row (a digest that equal texts share), matches and the blanked
    text of every document; null for texts without entities."""
    rows = documents(docs).select("doc_id", F.unhex(F.md5("text")).alias("row"), "text")
    rows = rows.withColumn("matches", F.concat(*(F.expr(matches(k)) for k in PATTERNS)))
    some = F.exists("matches", lambda m: m["ok"])
    return rows.select("doc_id", "row", F.when(some, F.col("matches")).alias("matches"), F.when(some, blanked()).alias("blanked"))


def located(rows: DataFrame, group: list[str], length: Column) -> DataFrame:
    """rows with start and stop: running sums of gap and length in order of place."""
    stop = F.sum(F.col("gap") + length).over(Window.partitionBy(*group).orderBy("place")).cast("int")
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - length)


def base_spans(texts: DataFrame) -> DataFrame:
    """row, w, kind, entity, start, stop of the valid matches."""
    each = texts.select("row", "w", F.posexplode("matches").alias("place", "m")).select("row", "w", "place", "m.*")
    return located(each, ["row", "kind"], F.length("value")).where("ok").select("row", "w", "kind", F.lower("value").alias("entity"), "start", "stop")


def posting() -> list[Column]:
    """Two checksums of the set of rows of a group."""
    return [F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: in how many documents each of the terms occurs. The outer form
    of explode does not split the text once more to see whether it has words."""
    words = F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))
    return documents(docs).select(F.explode_outer(words).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def disclosing(docs: DataFrame, texts: DataFrame, spans: DataFrame, total: int, min_docs: int, generalised: float, stage: Stages) -> DataFrame:
    """row, term, share, bits for the terms that disclose at least as much of an
    entity in the row: the largest share, and the least information of such an
    entity.

    A term of more than N (df(e) / N) ** generalised documents cannot: co is at
    most df(e). So common terms drop out before pairs are made."""
    n = F.lit(float(max(1, total)))
    held = spans.select("row", "w", "kind", "entity").distinct()
    known = held.groupBy("kind", "entity").agg(F.sum("w").alias("de"), *posting()).where((F.col("de") >= min_docs) & (F.col("de") < total))
    held = held.join(known, ["kind", "entity"]).select("row", "w", "x", "y", "de").distinct()
    held = stage(held.withColumn("most", n * F.pow(F.col("de") / n, F.lit(generalised)) + 1e-6), "entities")
    whole = texts.join(held.groupBy("row").agg(F.max("most").alias("most")), "row")
    found = F.expr(f"array_distinct(transform(filter(regexp_extract_all(blanked, {quoted(TERM)}, 0), t -> not contains(t, '{BLANK}')), t -> lower(t)))")
    near = stage(whole.select("row", "most", F.explode_outer(found).alias("term")).where("term is not null"), "terms")
    counts = stage(document_counts(docs, near.select("term").distinct()).where(F.col("df") >= min_docs), "counts")
    near = stage(near.join(counts, "term").where("df <= most").select("row", "term", "df"), "rare-terms")
    groups = near.groupBy("term").agg(*posting()).withColumnsRenamed({"x": "u", "y": "v"})
    near = stage(near.join(groups, "term"), "grouped-terms")
    pairs = held.join(near.select("row", "u", "v", "df").distinct(), "row").where("df <= most")
    pairs = pairs.groupBy("x", "y", "u", "v", "de", "df").agg(F.sum("w").alias("co")).where(F.col("co") >= min_docs)
    bits = F.log2(n / F.col("de"))
    share = F.log2(n * F.col("co") / (F.col("df") * F.col("de"))) / bits
    pairs = stage(pairs.select("x", "y", "u", "v", "df", share.alias("share"), bits.alias("bits")).where(F.col("share") >= generalised), "pairs")
    told = held.select("row", "x", "y").join(pairs, ["x", "y"]).groupBy("row", "u", "v", "df").agg(F.max("share").alias("share"), F.min("bits").alias("bits"))
    return told.join(near, ["row", "u", "v", "df"]).select("row", "term", "share", "bits")


def term_spans(texts: DataFrame, told: DataFrame) -> DataFrame:
    """row, term, start, stop, share, bits of every mention of a told term."""
    p = quoted(TERM)
    every = F.expr(f"slice(zip_with(split(blanked, {p}, -1), regexp_extract_all(blanked, {p}, 0), (gap, term) -> struct(length(gap) as gap, term as term)), 1, size(regexp_extract_all(blanked, {p}, 0)))")
    some = texts.join(told.select("row").distinct(), "row", "left_semi")
    each = some.select("row", F.posexplode(every).alias("place", "t")).select("row", "place", "t.*")
    return located(each, ["row"], F.length("term")).withColumn("term", F.lower("term")).join(told, ["row", "term"]).select("row", "term", "start", "stop", "share", "bits")


def spans(docs: DataFrame, stage: Stages, min_docs: int = 2, generalised: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Documents (doc_id, row), base spans and spans of disclosing terms of each
    distinct text (by row), and the number of documents."""
    found = stage(read(docs), "matches")
    texts = found.where("matches is not null").groupBy("row").agg(F.first("matches").alias("matches"), F.first("blanked").alias("blanked"), F.count("*").alias("w"))
    texts = stage(texts, "texts")
    base = stage(base_spans(texts), "spans")
    total = found.count()
    told = stage(disclosing(docs, texts, base, total, min_docs, generalised, stage), "told")
    return found.select("doc_id", "row"), base, stage(term_spans(texts, told), "term-spans"), total


def find(docs: DataFrame, removed: float = 0.95, **settings) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans as text: the
    base kinds, then context (terms to generalise), then term (to remove)."""
    with Stages(docs.sparkSession, "private") as stage:
        names, base, terms, _ = spans(docs, stage, **settings)
        kinds = "array(" + ", ".join(f"'{k}'" for k in PATTERNS) + ", 'context', 'term')"
        gone = (F.col("share") >= removed).cast("int")
        every = base.select("row", "kind", "start", "stop").union(terms.select("row", (len(PATTERNS) + gone).alias("kind"), "start", "stop"))
        rows = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("all"))
        shown = f"transform(all, s -> concat({kinds}[s.kind], ':', s.start, ':', s.stop))"
        digest = F.sha2(F.concat_ws(",", F.expr(shown.replace("(all,", f"(filter(all, s -> s.kind < {len(PATTERNS)}),"))), 256)
        counts = [F.expr(f"cast(size(filter(all, b -> b.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
        rows = rows.select("row", *counts, digest.alias("base_sha256"), F.concat_ws(",", F.expr(shown)).alias("spans"))
        zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in PATTERNS]
        empty = [F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")]
        return staged(names.join(rows, "row", "left").select("doc_id", *zero, *empty), "personal-data")


def beginnings(docs: DataFrame, terms: DataFrame, total: int, generalised: float) -> DataFrame:
    """term, bits, shown: the longest proper beginning of the term whose class of
    words has less information than the share `generalised` of the bits."""
    each = terms.select("term", "bits", F.explode(F.expr("transform(sequence(1, greatest(length(term) - 1, 1)), i -> substring(term, 1, i))")).alias("start"))
    words = F.array_distinct(F.split(F.lower("text"), r"\P{L}+"))
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.substring(w, F.lit(1), i)))))
    counts = documents(docs).select(F.explode(starts).alias("start")).join(each.select("start").distinct(), "start", "left_semi").groupBy("start").agg(F.count("*").alias("df"))
    able = each.join(counts, "start").where(F.log2(F.lit(float(max(1, total))) / F.col("df")) < generalised * F.col("bits"))
    return able.groupBy("term", "bits").agg(F.max_by("start", F.length("start")).alias("shown"))


def sanitised(docs: DataFrame, removed: float = 0.95, generalised: float = 0.75, **settings) -> DataFrame:
    """doc_id and text of every document: base spans become their kind in
    brackets, removed terms go, and of generalised terms a beginning stays,
    followed by a star (nothing where even one letter tells too much). Spans that
    overlap are replaced together by what stands for the first."""
    with Stages(docs.sparkSession, "sanitised") as stage:
        _, base, terms, total = spans(docs, stage, generalised=generalised, **settings)
        marks = "array(" + ", ".join(f"'[{k.upper()}]'" for k in PATTERNS) + ")"
        vague = terms.where(F.col("share") < removed)
        vague = vague.join(beginnings(docs, vague.select("term", "bits").distinct(), total, generalised), ["term", "bits"], "left")
        vague = vague.select("row", "start", "stop", F.coalesce(F.concat("shown", F.lit("*")), F.lit("")).alias("mark"))
        cuts = base.select("row", "start", "stop", F.expr(f"{marks}[kind]").alias("mark")).union(vague)
        cuts = cuts.union(terms.where(F.col("share") >= removed).select("row", "start", "stop", F.lit("").alias("mark")))
        along = Window.partitionBy("row").orderBy("start", "stop", "mark")
        fresh = F.coalesce(F.col("start") >= F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
        runs = cuts.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
        runs = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("mark", F.struct("start", "stop", "mark")).alias("mark"))
        cuts = stage(runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "mark"))).alias("cuts")), "cuts")
        rows = documents(docs).withColumn("row", F.unhex(F.md5("text"))).join(cuts, "row", "left")
        letters = F.when(F.col("cuts").isNotNull(), F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))
        kept = "array_join(slice(letters, at + 1, c.start - at), '') || c.mark"
        pieces = f"zip_with(cuts, slice(concat(array(0), transform(cuts, c -> c.stop)), 1, size(cuts)), (c, at) -> {kept})"
        rest = "array_join(slice(letters, element_at(cuts, -1).stop + 1, size(letters)), '')"
        text = F.expr(f"if(cuts is null, text, concat(array_join({pieces}, ''), {rest}))")
        return staged(rows.withColumn("letters", letters).select("doc_id", text.alias("text")), "sanitised-texts")
