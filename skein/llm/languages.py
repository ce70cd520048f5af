"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton of a bounded sample of its labelled text is
laid out as transition arrays. A text is parsed greedily into the longest
pieces that occur in the sample; a language whose sample covers the text in few
phrases is close to it. Phrases times the logarithm of the sample's length, by
the text's length, estimate the cross entropy, and the lowest wins.

Letters are lower-cased, everything else is one space. Lanes of LANE characters
of many texts advance together, each as if a phrase began with it; then the state
that the lane before ends in is carried over, and phrases are counted anew up to
where both parses meet in one state. So the phrases are those of the whole text.

Defined results: a null text or one without letters is `und` with score 0; the
score is h2 / (h1 + h2) for the two lowest entropies, 1 where one language is
known; ties go to the first language in order; nothing to learn from makes every
text `und`; null doc_ids and repeated rows are kept; an empty table gives no rows;
texts of any length are parsed whole; columns other than doc_id, text and lang
do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Stages, documents, hold, ranges, ship, slices

UNKNOWN = "und"
LANE = 512
MARK = "__language_predicted_here"
PREDICTED = "doc_id long, lang_pred string, score double, entropy double, known boolean"

Sample = tuple[tuple[str, str], ...]


def sample(labelled: DataFrame, chars: int = 20_000, most_docs: int = 64, total: int = 200_000, most_languages: int = 1_000) -> Sample:
    """(language, text) in order of language: the bounded sample that the model is
    fitted on. Of more than most_languages languages, those with most labelled rows
    are learned (ties in order of name). The documents of a language that hold a
    letter are taken whole, in order of a hash of their ids, until the text has
    `chars` characters or most_docs documents. Longer documents than `chars` are
    passed over; a language that has no others is learned from its shortest, of
    which at most total characters are taken. With more than total / chars languages
    each has at most its even part of total. All is cut before the chosen texts are collected, so at
    most most_languages * most_docs names and about total + total * total / chars
    characters reach the driver, however many labels and however long texts are."""
    rows = labelled.where("lang is not null and doc_id is not null")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages).select("lang")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(common), "lang", "left_semi")
    few = rows.select("lang", "doc_id", F.xxhash64("text").alias("mark"), F.length("text").alias("size")).distinct()
    order = [F.col("size") > chars, F.when(F.col("size") > chars, F.col("size")), F.xxhash64("doc_id"), "doc_id", "mark"]
    # The first of each of 32 parts of a language, then the first of all: no task
    # gets the first of a whole language from every partition.
    few = few.withColumn("part", F.pmod(F.xxhash64("mark", "doc_id"), F.lit(32)))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("n") <= most_docs)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where((F.col("n") <= most_docs) & ((F.col("size") <= chars) | (F.col("n") == 1)))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("before", before).where(F.col("before") < chars).select("lang", "doc_id", "mark", "n", "before")
    with Stages(labelled.sparkSession, "language-sample") as stage:
        few = stage(few, "chosen")
        known = few.agg(F.count_distinct("lang")).first()[0]
        own = min(chars, total // max(1, known))
        room = F.lit(total) if own == chars else F.lit(own) - F.col("before")
        few = few.where(F.col("before") < own).withColumn("room", room.cast("int"))
        found = rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(few), ["lang", "doc_id", "mark"])
        found = found.select("lang", "n", F.substring(F.col("text"), F.lit(1), F.col("room")).alias("text")).distinct().collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["n"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((k, "\n".join(v)) for k, v in texts.items())


class SuffixAutomaton:
    """Online construction over small integer symbols."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            current = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = current
                p = self.link[p]
            if p < 0:
                self.link[current] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[current] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[current] = clone
            last = current

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1


class Dense:
    """Transitions as a matrix of states and symbols; states count in its rows,
    so a state is the place where its row begins."""

    def __init__(self, edges: list[dict[int, int]], symbols: int):
        self.start = len(edges) * symbols
        again = np.full(symbols, self.start, np.int32)
        for c, to in edges[0].items():
            again[c] = to * symbols
        table = np.tile(~again, (len(edges) + 1, 1))
        for s, row in enumerate(edges):
            for c, to in row.items():
                table[s, c] = to * symbols
        self.table = table.ravel()

    def step(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.table[state + column]
        failed = to >> 31
        return to ^ failed, failed


class Displaced:
    """Transitions as rows of few edges, laid over each other in one array where
    they leave places free, so its size goes with the edges and not with the
    number of symbols. An edge is known by its owner."""

    def __init__(self, edges: list[dict[int, int]], symbols: int):
        self.start = len(edges)
        self.again = np.full(symbols, self.start, np.int32)
        self.again[list(edges[0])] = list(edges[0].values())
        room = 2 * sum(map(len, edges)) + 2 * symbols
        self.owner, self.to = np.full(room, -1, np.int32), np.zeros(room, np.int32)
        self.base = np.zeros(len(edges) + 1, np.int32)
        rng, order = np.random.default_rng(0), sorted(range(len(edges)), key=lambda s: -len(edges[s]))
        for s in order:
            if len(edges[s]) < 2:
                break
            self._lay(s, self._place(np.fromiter(edges[s], np.int64), rng, symbols), edges[s])
        ones = [s for s in order if len(edges[s]) == 1]
        for s, free in zip(ones, np.flatnonzero(self.owner[symbols:] < 0) + symbols):
            self._lay(s, int(free) - next(iter(edges[s])), edges[s])

    def _place(self, codes: np.ndarray, rng: np.random.Generator, symbols: int) -> int:
        """A random beginning whose places are all free; where none is found, the
        array is doubled."""
        while True:
            for _ in range(16):
                tried = rng.integers(0, len(self.owner) - symbols, 64)
                good = (self.owner[tried[:, None] + codes] < 0).all(axis=1)
                if good.any():
                    return int(tried[good.argmax()])
            self.owner = np.concatenate([self.owner, np.full(len(self.owner), -1, np.int32)])
            self.to = np.concatenate([self.to, np.zeros(len(self.to), np.int32)])

    def _lay(self, s: int, at: int, row: dict[int, int]) -> None:
        for c, to in row.items():
            self.owner[at + c], self.to[at + c] = s, to
        self.base[s] = at

    def step(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[state] + column
        good = self.owner[at] == state
        return np.where(good, self.to[at], self.again[column]), good.astype(np.int32) - 1


def transitions(edges: list[dict[int, int]], symbols: int, most: int = 1 << 22) -> Dense | Displaced:
    """Each state's edges as arrays that many texts step through at once. `step`
    gives the next states and -1 where a new phrase begins with the symbol. From
    `start` no symbol leads on: texts begin there, and unknown symbols lead
    there. A matrix of at most `most` entries (16 MB) is faster than rows laid
    over each other; both give the same states."""
    return (Dense if (len(edges) + 1) * symbols <= most else Displaced)(edges, symbols)


class Parser:
    """Phrase counts of texts for each language of a sample."""

    def __init__(self, learned: Sample):
        self.languages = [k for k, _ in learned]
        letters = sorted({c for _, t in learned for c in t.lower() if c.isalpha()})
        self.symbols = len(letters) + 2
        self.code = np.zeros(0x110000, np.uint16 if self.symbols < 1 << 16 else np.int32)
        for i in range(0x110000):
            if chr(i).isalpha():
                self.code[i] = self.symbols - 1
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.tables, self.bits = [], []
        for _, t in learned:
            codes = self.codes([t])[0]
            self.tables.append(transitions(SuffixAutomaton(codes.tolist()).next, self.symbols))
            self.bits.append(np.log2(max(2, len(codes))))
        self.foreign = np.full(len(learned), np.inf)
        if len(learned) > 1:
            counts, sizes = self.phrases([t for _, t in learned])
            h = counts * np.array(self.bits)[:, None] / sizes
            np.fill_diagonal(h, np.inf)
            self.foreign = h.min(axis=1)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts in a row, runs of other characters as one 0, and
        how many belong to each text."""
        lowered = [t.lower() + "\n" for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.code[points]
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        return codes[keep], np.bincount(owner[keep], minlength=len(texts))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (languages x texts), and characters of each text."""
        codes, sizes = self.codes(texts)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = np.repeat(np.cumsum(sizes) - sizes, lanes) + inside * LANE
        lengths = np.minimum(LANE, np.repeat(sizes, lanes) - inside * LANE)
        counts = np.zeros((len(self.tables), len(texts)))
        if not len(owner):
            return counts, sizes
        order = np.argsort(-lengths, kind="stable")
        live = np.searchsorted(-lengths[order], -np.arange(1, lengths[order[0]] + 1), "right").tolist()
        first = starts[order]
        state = np.empty((len(self.tables), len(owner)), np.int32)
        made = np.zeros((len(self.tables), len(owner)), np.int32)
        for k, table in enumerate(self.tables):
            state[k] = table.start
        for j, n in enumerate(live):
            column = codes[first[:n] + j]
            for k, table in enumerate(self.tables):
                state[k, :n], failed = table.step(state[k, :n], column)
                made[k, :n] -= failed
        back = np.argsort(order, kind="stable")
        for k, table in enumerate(self.tables):
            counts[k] = np.bincount(owner, carried(table, codes, inside, starts, lengths, state[k, back], made[k, back]), len(texts))
        return counts, sizes

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool]]:
        """(language, score, entropy, known) of each text; known: whether it is
        closer to the language than texts of other languages are."""
        counts, sizes = self.phrases(texts)
        out = []
        for i, t in enumerate(texts):
            if not self.tables or not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0, None, False))
                continue
            h = counts[:, i] * self.bits / sizes[i]
            first = int(np.argmin(h))
            second = float(np.delete(h, first).min()) if len(h) > 1 else None
            c = counts[first, i]
            known = (c - 2 * np.sqrt(c) - 1) * self.bits[first] / sizes[i] < self.foreign[first]
            out.append((self.languages[first], 1.0 if second is None else second / (h[first] + second), float(h[first]), bool(known)))
        return out


def carried(table: Dense | Displaced, codes: np.ndarray, inside: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane when the parse goes on from the lane before.
    made and ends are those of parses that begin anew with each lane. Both parses
    of a lane are followed until they are in one state. A lane where they never
    are (rare) ends in another state, so the lane after it is followed again."""
    ends, fixed = ends.copy(), made.copy()
    todo = np.flatnonzero(inside)
    while len(todo):
        lane, at = todo, starts[todo]
        own, anew = ends[lane - 1], np.full(len(lane), table.start, np.int32)
        fixed[lane] = made[lane]
        late = []
        for j in range(LANE):
            column = codes[at]
            own, failed = table.step(own, column)
            anew, lost = table.step(anew, column)
            fixed[lane] += lost - failed
            apart = own != anew
            over = apart & (lengths[lane] == j + 1)
            if over.any():
                changed = over & (ends[lane] != own)
                late.append(lane[changed])
                ends[lane[changed]] = own[changed]
                apart &= ~over
            lane, at, own, anew = lane[apart], at[apart] + 1, own[apart], anew[apart]
            if not len(lane):
                break
        after = np.concatenate(late) + 1 if late else np.zeros(0, np.int64)
        after = after[after < len(inside)]
        todo = after[inside[after] > 0]
    return fixed


@lru_cache(1)
def parser(learned: Sample) -> Parser:
    return Parser(learned)


def predict(docs: DataFrame, learned: Sample) -> DataFrame:
    """PREDICTED of every document. Each worker builds the automata of the small
    sample once."""
    ship(docs.sparkSession)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hold("languages", parser.cache_clear)
        model = parser(learned)
        for batch in batches:
            for part in slices(batch):
                rows = zip(*model.predict(part["text"].to_pylist()))
                columns = [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", "lang_pred", "score", "entropy", "known"])

    return documents(docs).mapInArrow(read, PREDICTED)


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> F.Column:
    """Whether a row is kept from learning, by the checksum of its id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and predict all: doc_id,
    held_out, lang_pred, score, entropy, known."""
    learned = sample(docs.where(~held_out()))
    return predict(docs, learned).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "entropy", "known")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows and columns of documents in a known language, lang being the one
    predicted. Rejected are texts without letters and texts that are no closer to
    the language predicted than the samples of other languages are, beyond what
    two standard deviations of the count of phrases and one phrase more may hide;
    so a text of few words is not rejected for its length. The model is learned
    from the table itself; held-out rows play no part in it."""
    ship(docs.sparkSession)
    learned = sample(docs.where(~held_out()))

    @F.pandas_udf("string")
    def language(column: pd.Series) -> pd.Series:
        hold("languages", parser.cache_clear)
        model, texts = parser(learned), column.fillna("").tolist()
        found = [p for lo, hi in ranges(list(map(len, texts))) for p in model.predict(texts[lo:hi])]
        return pd.Series([p[0] if p[3] else UNKNOWN for p in found], index=column.index, dtype=object)

    # Declared as not deterministic: the filter would else be pushed below the
    # column and every text parsed twice, in two Python workers to a task.
    predicted = language.asNondeterministic()(F.col("text").cast("string"))
    marked = docs.select("*", predicted.alias(MARK)).where(F.col(MARK) != UNKNOWN)
    return marked.select(*(F.col(MARK).cast(f.dataType).alias(f.name) if f.name == "lang" else F.col(f"`{f.name}`") for f in docs.schema))
