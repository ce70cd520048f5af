"""Token counts of the sections or fields of a document.

A document is encoded once, as a whole, and the character spans of its tokens
are joined with the spans of its sections. A token that crosses a boundary goes
to the section that holds most of its characters, the earlier of equals; a token
without characters of its own (a later byte of one character) goes where that
character is. So the counts of a document's sections add up to its tokens.

Defined results: a null or empty text is one empty section without tokens; a
text that ends with a line end has no section after it; a null doc_id is kept;
repeated rows are counted as rows of their own; an empty table gives no rows;
other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import documents, ship, slices
from skein.llm.encoding import encoder

COUNTED = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long"


def line_starts(text: str) -> np.ndarray:
    """Sections are lines; a line end belongs to the line before it."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out)


def allot(starts: np.ndarray, stops: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and which tokens cross a boundary. sections: the
    sorted starts of the sections, the first 0."""
    home = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, np.maximum(stops, starts + 1) - 1, "right") - 1
    crossing = last > home
    bounds = np.append(sections, np.iinfo(np.int64).max)
    for i in np.flatnonzero(crossing):
        span = np.arange(home[i], last[i] + 1)
        held = np.minimum(stops[i], bounds[span + 1]) - np.maximum(starts[i], bounds[span])
        home[i] = span[int(np.argmax(held))]
    return home, crossing


def _counted(batches: Iterator, tokenizer: str, sections_of) -> Iterator:
    import pyarrow as pa

    enc = encoder(tokenizer)
    for batch in batches:
        names = batch.schema.names
        for piece in slices(batch):
            rows: list[list[np.ndarray]] = []
            keys: list[int | None] = []
            part = [c.to_pylist() for c in piece.columns]
            spans = enc.token_spans(part[names.index("text")])
            for (starts, stops), *row in zip(spans, *part):
                row = dict(zip(names, row))
                text = row["text"]
                sections = sections_of(row)
                home, crossing = allot(starts, stops, sections)
                n = len(sections)
                keys += [row["doc_id"]] * n
                rows.append([np.arange(n), sections, np.append(sections[1:], len(text)), np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n)])
            if not rows:
                continue
            made = [np.concatenate(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(made[0], pa.int32()), *(pa.array(c, pa.int64()) for c in made[1:])],
                ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"],
            )


def by_line(docs: DataFrame, tokenizer: str) -> DataFrame:
    """COUNTED for every line of every document."""
    return documents(docs).mapInArrow(lambda b: _counted(b, tokenizer, lambda r: line_starts(r["text"])), COUNTED)


def by_field(df: DataFrame, key: str, fields: list[str], tokenizer: str, glue: str = "\n") -> DataFrame:
    """COUNTED for every field of rows whose fields are joined to one text; a
    null field is empty, and the glue belongs to the field before it."""
    ship(df.sparkSession)
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    sizes = F.array(*(F.length(p).cast("long") + (len(glue) if i + 1 < len(fields) else 0) for i, p in enumerate(parts)))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.concat_ws(glue, *parts).alias("text"), sizes.alias("sizes"))
    return rows.mapInArrow(lambda b: _counted(b, tokenizer, lambda r: np.append(0, np.cumsum(r["sizes"])[:-1]).astype(np.int64)), COUNTED)
