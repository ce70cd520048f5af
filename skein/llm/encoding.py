"""Whole-text encoding with the tokenizers library, one call per distinct chunk.

A text is cut where the tokenizer's own splitting pattern always cuts, so that
chunks encoded apart give exactly the ids of the whole text; a worker keeps the
ids of the chunks it has met lately. Chunk rules, all sides of a cut being certain:

* a run of ASCII / Latin-1 letters, not followed by another non-ASCII character
  (which could be a letter or a combining mark);
* a run of ASCII punctuation without the apostrophe (contractions), followed by
  an ASCII letter, a digit, a space, a line end or the end of the text;
* a run of ASCII digits followed by an ASCII character or the end;
* otherwise everything up to the next white space.

Texts are first cut at the added tokens of the vocabulary (such as its end of
text), which the library takes out of a text before anything else; each is one id.
"""

from __future__ import annotations

import os
import re

import numpy as np

from skein.llm.common import hold

#: Unicode White_Space; Python's own \s has four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARK = "!-&(-/:-@\\[-`{-~"
RUNS = [
    f"[{LETTER}]++(?![^\\x00-\\x7f])",
    f"[{MARK}]++(?=[A-Za-z0-9 \\n]|\\Z)",
    "[0-9]++(?=[\\x00-\\x7f]|\\Z)",
    f"[^{SPACE}]+",
]
#: White space is dropped by the word vocabulary, and is part of the ids of the
#: byte vocabulary, where one space belongs to the run after it.
WORDS = re.compile("|".join(RUNS))
BYTES = re.compile("|".join(" ?" + r for r in RUNS) + f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SEPARATOR = "\x01"


class Encoder:
    """ids(texts): little-endian unsigned 32-bit ids of each text, as bytes."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        plain = [t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()]
        if any(plain):
            raise ValueError(f"{path}: added tokens that are not matched as they stand")
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.keeps_space = bool(self._ids(" "))
        self.chunks = (BYTES if self.keeps_space else WORDS).findall
        self.glue = "\n" if self.keeps_space else f" {SEPARATOR} "
        (self.glue_id,) = self._ids(f"a{self.glue}a")[1:-1]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = None
        if not self.keeps_space and any(t.endswith("</w>") for t in vocabulary):
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.widths: np.ndarray | None = None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        """Many chunks to a call, told apart in the ids by what joins them, or by
        the word-end ids where a chunk is one word of a vocabulary with such."""
        whole = [c for c in new if c.isalpha()] if self.ends is not None else []
        rest = set(new).difference(whole)
        plain = [c for c in rest if SEPARATOR not in c and not c.isspace()]
        for c in rest.difference(plain):
            self._learn_one(c)
        for chunks, glue in ((whole, " "), (plain, self.glue)):
            groups = [chunks[i : i + 64] for i in range(0, len(chunks), 64)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                if chunks is whole:
                    stops = np.flatnonzero(self.ends[ids]) + 1
                    starts = np.append(0, stops)[:-1]
                else:
                    at = np.flatnonzero(ids == self.glue_id)
                    starts, stops = np.append(0, at + 1), np.append(at, len(ids))
                if len(starts) != len(group):
                    for c in group:
                        self._learn_one(c)
                    continue
                raw = ids.tobytes()
                for c, a, b in zip(group, (4 * starts).tolist(), (4 * stops).tolist()):
                    self.known[c] = raw[a:b]

    def _learn_one(self, chunk: str) -> None:
        self.known[chunk] = np.array(self._ids(chunk), "<u4").tobytes()

    def _recall(self, new: set[str]) -> list[str]:
        """Take over what the generation before knows, so that common chunks stay
        and rare ones go; what is left has to be learned."""
        self.known.update((c, self.older[c]) for c in new if c in self.older)
        return [c for c in new if c not in self.older]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts with added tokens are encoded in segments."""
        mixed = [i for i, t in enumerate(texts) if any(map(t.__contains__, self.added))]
        if not mixed:
            return self._plain_ids(texts)
        segments = {i: self.cut_added(texts[i]) for i in mixed}
        plain = [t for i, t in enumerate(texts) if i not in segments] + [s for cut in segments.values() for s in cut[::2]]
        found = iter(self._plain_ids(plain))
        out = [b"" if i in segments else next(found) for i in range(len(texts))]
        for i, cut in segments.items():
            out[i] = b"".join(self.added[s] if n % 2 else next(found) for n, s in enumerate(cut))
        return out

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        cut = [self.chunks(t) for t in texts]
        found = [list(map(self.known.get, c)) for c in cut]
        missing = [[i for i, raw in enumerate(f) if raw is None] for f in found]
        new = self._recall({c[i] for c, at in zip(cut, missing) for i in at})
        if new:
            self._learn(new)
        for c, f, at in zip(cut, found, missing):
            for i in at:
                f[i] = self.known[c[i]]
        return list(map(b"".join, found))

    def token_spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Character start and end of each id of each text, for byte-level
        vocabularies: every id stands for a fixed number of bytes of the text,
        and a part of a character has the span of that character."""
        if self.widths is None:
            known = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(known.values()) + 1, np.int64)
            self.widths[list(known.values())] = list(map(len, known))
        out = []
        for text, raw in zip(texts, self.ids(texts)):
            ends = np.cumsum(self.widths[np.frombuffer(raw, "<u4")])
            starts = np.append(0, ends)[:-1]
            if not text.isascii():
                encoded = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                character = np.cumsum((encoded & 0xC0) != 0x80)
                starts, ends = character[starts] - 1, character[ends - 1]
            out.append((starts, ends))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file in a Python worker. A task has one
    core, so the library's own threads, each with memory of its own, are off."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    hold("encoding", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
