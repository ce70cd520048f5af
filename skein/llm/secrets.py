"""Secret scanning with one automaton for all rules.

The rules are compiled to one minimal deterministic automaton (see automaton.py)
of the reversed rules, which reads each byte of a document once, from its end,
and marks where matches begin. From a mark, the automaton of the rules gives the
longest match, which is the greedy one here. Both are built once on the driver
and broadcast.

Matches are leftmost and do not overlap within a rule. Least lengths are counted
after that, as lengths counted by several rules at once multiply the states: a
match of a base kind that fails is dropped with its characters; another rule that
fails is tried again from its next mark, as an expression with the length in it
would.

Defined results: a null or empty text has no spans; a null doc_id is kept;
repeated rows are scanned as rows of their own; an empty table gives no rows;
columns other than doc_id and text do not matter. Spans count code points, the
end is exclusive, and spans with one start follow the order of RULES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import automaton
from skein.llm.common import documents, hold, ranges, slices

VALUE = "[A-Za-z0-9+/_.=-]"


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """full: the rule as an expression; span: the same with open counts as +,
    what the automaton reads; valid: which matches count; hopeless: up to where in a
    match that does not count no other one that counts can begin."""

    kind: str
    full: str
    span: str
    valid: Callable[[str], bool] = lambda m: True
    hopeless: Callable[[str], int] = lambda m: 0


def value_of(match: str) -> str:
    """The value of an assignment: what follows the sign, spaces and a quote."""
    rest = match[min(i for i in map(match.find, ":=") if i >= 0) + 1 :].lstrip(" ")
    return rest[1:] if rest[0] in "\"'" else rest


def longer(prefix: int, least: int) -> Callable[[str], bool]:
    return lambda m: len(m) >= prefix + least


NAMES = "(?:" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
ASSIGN = NAMES + "[\"']?\\x20*[:=]\\x20*[\"']?"
#: The three base kinds, then well-known public credential formats.
RULES = [
    Rule("assign", f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE}+)", f"{ASSIGN}{VALUE}+", lambda m: len(value_of(m)) >= 12),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]+", longer(0, 18)),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]+", longer(0, 16)),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]+", longer(4, 36)),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]+", longer(5, 10)),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}", "AIza[A-Za-z0-9_-]+", longer(4, 35)),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", "[rs]k_live_[A-Za-z0-9]+", longer(8, 16)),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}(?:\\.[A-Za-z0-9_-]+)?", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)?", lambda m: min(map(len, m.split(".")[:2])) >= 11, lambda m: m.index(".") if len(m.split(".")[1]) < 11 else 0),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
BASE = 3
#: A run of hexadecimal digits is one match, so only those with enough to the
#: right need a mark; every other rule is marked as it is.
MARKED = {"hex": "[0-9a-f]{16}"}
NOTHING = hashlib.sha256(b"").hexdigest()
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@cache
def compiled() -> tuple[automaton.Automaton, automaton.Automaton]:
    """The automata that mark beginnings and that find ends."""
    return automaton.build([MARKED.get(r.kind, r.span) for r in RULES], backward=True), automaton.build([r.span for r in RULES], anchored=True)


class Scanner:
    """Spans of texts with given automata."""

    def __init__(self, back: automaton.Automaton, forward: automaton.Automaton):
        self.back, self.ends = back, automaton.Anchored(forward)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every text, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw) + b"\n"
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        begins = np.cumsum(lengths) - lengths
        places, masks = automaton.marks(self.back, np.frombuffer(data, np.uint8)[::-1])
        places = len(data) - 1 - places
        order = np.argsort(places, kind="stable")
        places, masks = places[order], masks[order]
        owner = np.searchsorted(begins, places, "right") - 1
        edges = np.flatnonzero(np.diff(owner, prepend=-1)).tolist() + [len(owner)]
        for lo, hi in zip(edges, edges[1:]):
            i = int(owner[lo])
            found = self._resolved(raw[i], (places[lo:hi] - begins[i]).tolist(), masks[lo:hi].tolist())
            if found and len(raw[i]) > len(texts[i]):
                character = np.append(0, np.cumsum((np.frombuffer(raw[i], np.uint8) & 0xC0) != 0x80))
                found = [(int(character[a]), n, int(character[b])) for a, n, b in found]
            out[i] = sorted(found)
        return out

    def _resolved(self, data: bytes, places: list[int], masks: list[int]) -> list[tuple[int, int, int]]:
        """Leftmost matches that do not overlap, rule by rule, in bytes."""
        found, after = [], [0] * len(RULES)
        for p, mask in zip(places, masks):
            while mask:
                n = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if p < after[n]:
                    continue
                end = self.ends.end(data, p, n)
                match = data[p:end].decode("ascii")
                good = RULES[n].valid(match)
                if good:
                    found.append((p, n, end))
                after[n] = end if good or n < BASE else p + RULES[n].hopeless(match)
        return found


_SCANNERS: dict[int, Scanner] = {}


def shared(spark: SparkSession) -> Callable[[], Scanner]:
    """The scanner in a worker, from automata that are built here and broadcast."""
    arrays = spark.sparkContext.broadcast(compiled())

    def scanner() -> Scanner:
        hold("secrets", _SCANNERS.clear)
        if not _SCANNERS:
            _SCANNERS[0] = Scanner(*arrays.value)
        return _SCANNERS[0]

    return scanner


def scan(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of each document."""
    scanner = shared(docs.sparkSession)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds, own = [r.kind for r in RULES], scanner()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for key, found in zip(part["doc_id"].to_pylist(), own.spans(part["text"].to_pylist())):
                    if not found:
                        rows.append((key, 0, 0, 0, NOTHING, ""))
                        continue
                    shown = [(n, f"{kinds[n]}:{a}:{b}") for a, n, b in found]
                    base = ",".join(s for n, s in shown if n < BASE)
                    counts = [sum(n == k for n, _ in shown) for k in range(BASE)]
                    rows.append((key, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in shown)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return documents(docs).mapInArrow(find, FOUND)


def redacted_text(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each run of touching spans becomes one mark that names its first kind."""
    out, at = [], 0
    for a, n, b in found:
        if a >= at:
            out.append(text[at:a] + f"[{RULES[n].kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:] if found else text


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span replaced; a null text stays
    null, and n_chars, where present, is counted anew."""
    documents(docs)
    scanner = shared(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        texts, own = column.fillna("").tolist(), scanner()
        out = [redacted_text(t, f) for lo, hi in ranges(list(map(len, texts))) for t, f in zip(texts[lo:hi], own.spans(texts[lo:hi]))]
        return pd.Series(out, index=column.index, dtype=object).where(column.notna(), None)

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
