"""Licence notices in texts: winnowed fingerprints find candidates, word alignment decides.

A notice is a sequence of words with gaps for what is filled in: `<>` stands for up to GAP
words. Words are runs of letters and digits in lower case, so case, spacing, line breaks and
punctuation do not matter. A text holds a notice where its words can be aligned with
at most as many inserted, deleted or replaced words as `edits` allows.

Fingerprints are hashes of GRAM words, of which the least in every WINDOW neighbours is
kept (Schleimer, Wilkerson, Aiken 2003): any GRAM + WINDOW - 1 words that a text has in
common with a notice give a common fingerprint. A notice is allowed no more edits than
leave such a run whole, so the inverted index of fingerprints misses no match.

Fingerprints are taken in SQL functions, and only texts that have one of the index, whose
size is that of the notices, go to Python for the alignment, which is run around their
places alone: the work is linear in the text.

Of overlapping matches of one notice the one with fewest edits is kept, then the first,
then the shortest. Defined results: a null text is empty; repeated rows are matched one by
one; rows without a match are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import ship

GRAM, WINDOW, GAP = 3, 3, 8
WORD = re.compile(r"[^\W_]+")

#: Notices as their licences state them; <> stands for what is filled in.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <> of the License, or (at your option) any later version.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-endorsement": "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "Copyright (c) <> All rights reserved. No part of this <> may be reproduced without permission",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


class Notice:
    """Words of a notice and, before each of them, whether a gap stands there."""

    def __init__(self, text: str):
        self.words: list[str] = []
        self.gaps: list[bool] = []
        for k, part in enumerate(text.split("<>")):
            own = WORD.findall(part.lower())
            self.gaps += [k > 0, *[False] * (len(own) - 1)]
            self.words += own
        if len(self.gaps) != len(self.words):
            raise ValueError("a gap stands between words, with words on both sides")
        ends = [i for i, g in enumerate(self.gaps) if g] + [len(self.words)]
        runs = [b - a for a, b in zip([0, *ends], ends)]
        #: So few edits leave a run of GRAM + WINDOW - 1 words whole.
        whole = sum(n // (GRAM + WINDOW - 1) for n in runs)
        if not whole:
            raise ValueError(f"a notice needs {GRAM + WINDOW - 1} words in a row: {text}")
        self.edits = min(len(self.words) // 12, whole - 1)
        self.slack = self.edits + GAP * sum(self.gaps)


@lru_cache(maxsize=8)
def prepared(notices: tuple[tuple[str, str], ...]) -> tuple[dict[str, Notice], dict[tuple, list[tuple[str, int]]]]:
    """Notices by name, and where each of their grams stands."""
    known, places = {k: Notice(v) for k, v in notices}, {}
    for name, notice in known.items():
        w, gaps = notice.words, notice.gaps
        for i in range(len(w) - GRAM + 1):
            if not any(gaps[i + 1 : i + GRAM]):
                places.setdefault(tuple(w[i : i + GRAM]), []).append((name, i))
    return known, places


def ends(notice: Notice, words: list[str]) -> list[tuple[int, int, int]]:
    """(edits, start, stop) for every stop at which the notice can end, with the fewest
    edits and, of these, the latest start; starts and stops count words."""
    n, most = len(notice.words), notice.edits
    far = most + 1
    # A row holds, for i words of the notice, the fewest edits and minus the start.
    row = [(min(i, far), 0) for i in range(n + 1)]
    waits: list[list[tuple[int, int]]] = [[row[i]] for i in range(n)]
    found = []
    for j, word in enumerate(words, 1):
        new = [(0, -j)]
        for i in range(1, n + 1):
            gap = notice.gaps[i - 1]
            before = min(waits[i - 1]) if gap else row[i - 1]
            here = (before[0] + (word != notice.words[i - 1]), before[1])
            here = min(here, (row[i][0] + 1, row[i][1]))
            # A word of the notice is missing: after a gap, as after the words before it.
            left = min([new[i - 1], *waits[i - 1][-GAP:]]) if gap else new[i - 1]
            here = min(here, (left[0] + 1, left[1]))
            new.append(here if here[0] <= most else (far, here[1]))
        for i in range(1, n):
            if notice.gaps[i]:
                waits[i].append(new[i])
                del waits[i][: -GAP - 1]
        row = new
        if row[n][0] <= most and -row[n][1] < j:
            found.append((row[n][0], -row[n][1], j))
    return found


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches that do not overlap: fewest edits first, then the first, the shortest."""
    kept: list[tuple[int, int, int]] = []
    for edits, start, stop in sorted(set(found)):
        at = bisect.bisect(kept, start, key=lambda m: m[1])
        if (not at or kept[at - 1][2] <= start) and (at == len(kept) or stop <= kept[at][1]):
            kept.insert(at, (edits, start, stop))
    return kept


def matches(text: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int]]:
    """(name, start, stop, edits) of the notices of a text, in code points."""
    known, places = prepared(notices)
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    near: dict[str, list[tuple[int, int]]] = {}
    for p in range(len(words) - GRAM + 1):
        for name, i in places.get(tuple(words[p : p + GRAM]), ()):
            notice = known[name]
            area = (max(0, p - i - notice.slack), min(len(words), p - i + len(notice.words) + notice.slack))
            mine = near.setdefault(name, [])
            if mine and area[0] <= mine[-1][1] and area[0] >= mine[-1][0]:
                mine[-1] = (mine[-1][0], max(area[1], mine[-1][1]))
            else:
                mine.append(area)
    out = []
    for name, areas in near.items():
        found = [(e, a + s, a + t) for a, b in merged(areas) for e, s, t in ends(known[name], words[a:b])]
        out += [(name, spans[s][0], spans[t - 1][1], e) for e, s, t in apart(found)]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def merged(areas: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(areas):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, key: str = "doc_id", column: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """key, licence, start, stop (code points, stop exclusive) and edits of each notice."""
    spark = ship(docs.sparkSession)
    stated = tuple((notices if notices is not None else NOTICES).items())
    known, _ = prepared(stated)
    runs = [" ".join(run) for notice in known.values() for run in segments(notice)]
    index = with_fingerprints(spark.createDataFrame([(r,) for r in runs], "text string"), "text").select(F.explode("prints").alias("p")).distinct()
    listed = [r["p"] for r in index.collect()]  # as many as the notices have words, at most
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    # One row for a text with a fingerprint of the index. A filter would be pushed below
    # the columns that it needs and make them again for each element.
    common = F.array_intersect("prints", F.array(*[F.lit(x) for x in listed]))
    candidates = with_fingerprints(rows, "text").select("key", "text", F.explode(F.slice(common, F.lit(1), F.lit(1))).alias("p")).select("key", "text")

    def aligned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                found = matches(b["text"][i].as_py(), stated)
                if found:
                    names, starts, stops, edits = zip(*found)
                    yield pa.RecordBatch.from_arrays([b["key"].take(pa.array([i] * len(found))), pa.array(names), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(edits, pa.int32())], [key, "licence", "start", "stop", "edits"])

    kind = rows.schema["key"].dataType.simpleString()
    return candidates.mapInArrow(aligned, f"`{key}` {kind}, licence string, start long, stop long, edits int")


def segments(notice: Notice) -> list[list[str]]:
    """Words between gaps, in runs that are long enough for a fingerprint."""
    out: list[list[str]] = [[]]
    for word, gap in zip(notice.words, notice.gaps):
        if gap:
            out.append([])
        out[-1].append(word)
    return [r for r in out if len(r) >= GRAM]


def with_fingerprints(df: DataFrame, column: str) -> DataFrame:
    """df with `prints`. Words and grams are columns of their own, so that they are made
    once and not again for each element that looks at its neighbours."""
    words = df.withColumn("words", F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    w, g = F.col("words"), F.col("grams")
    grams = words.withColumn("grams", F.slice(F.transform("words", lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, GRAM)])), F.lit(1), F.greatest(F.size("words") - (GRAM - 1), F.lit(0))))
    least = F.transform("grams", lambda x, i: F.least(x, *[F.coalesce(F.get(g, i + k), x) for k in range(1, WINDOW)]))
    return grams.withColumn("prints", F.array_distinct(least)).drop("words", "grams")
