"""One deterministic automaton for many byte patterns.

Patterns use literals, escapes, classes, groups, ``|``, ``? * + {m} {m,}
{m,n}``. They are read into one nondeterministic automaton, made deterministic
by subset construction and minimised by partition refinement. The result is
plain arrays: byte -> class, (state, class) -> state, state -> bit mask of the
patterns that end there.

An automaton of reversed patterns that may begin at any byte, run from the end
of a text to its start, marks in one pass where matches of all patterns begin;
an anchored one of the patterns then gives the longest match from a mark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


class _Reader:
    """Recursive descent over a pattern; builds states with byte-set edges."""

    def __init__(self, edges: list[list[tuple[frozenset[int], int]]], free: list[list[int]], backward: bool):
        self.edges, self.free, self.backward = edges, free, backward

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def read(self, pattern: str, start: int) -> int:
        self.p, self.i = pattern, 0
        node = self._either()
        if self.i != len(pattern):
            raise ValueError(f"unexpected {pattern[self.i]!r} in {pattern!r}")
        return self._build(node, start)

    def _either(self):
        options = [self._sequence()]
        while self._next("|"):
            options.append(self._sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def _sequence(self):
        items = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            items.append(self._repeated())
        return ("seq", items)

    def _repeated(self):
        item = self._one()
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
                self.i = end + 1
            item = ("rep", item, low, high)
        return item

    def _one(self):
        if self._next("("):
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self._either()
            if not self._next(")"):
                raise ValueError("a group is not closed")
            return node
        if self._next("["):
            negated, found = self._next("^"), set()
            while not self._next("]"):
                a = self._byte()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    found.update(range(a, self._byte() + 1))
                else:
                    found.add(a)
            return ("set", ALL - found if negated else frozenset(found))
        return ("set", frozenset([self._byte()]))

    def _byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))
        return ord(c)

    def _next(self, c: str) -> bool:
        if self.p.startswith(c, self.i):
            self.i += 1
            return True
        return False

    def _build(self, node, at: int) -> int:
        kind = node[0]
        if kind == "set":
            to = self.state()
            self.edges[at].append((node[1], to))
            return to
        if kind == "seq":
            for x in reversed(node[1]) if self.backward else node[1]:
                at = self._build(x, at)
            return at
        if kind == "or":
            end = self.state()
            for x in node[1]:
                self.free[self._build(x, at)].append(end)
            return end
        _, item, low, high = node
        for _ in range(low):
            at = self._build(item, at)
        end = self.state()
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self._build(item, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[at].append(end)
            for _ in range(high - low):
                at = self._build(item, at)
                self.free[at].append(end)
        return end


@dataclass
class Automaton:
    """step[state * classes + byte class] is the next state times classes;
    states from `accepting` on end a pattern, and masks says which. first: the
    state to begin in, times classes; reset: the byte classes that lead every
    state to it."""

    byte_class: np.ndarray
    step: np.ndarray
    classes: int
    accepting: int
    masks: np.ndarray
    first: int
    reset: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step) // self.classes


def build(patterns: list[str], anchored: bool = False, backward: bool = False) -> Automaton:
    """anchored: matches begin at the first byte only; backward: of the patterns
    read from their end to their beginning."""
    edges: list[list[tuple[frozenset[int], int]]] = []
    free: list[list[int]] = []
    reader = _Reader(edges, free, backward)
    start = reader.state()
    ends: dict[int, int] = {}
    for bit, pattern in enumerate(patterns):
        first = reader.state()
        free[start].append(first)
        end = reader.read(pattern, first)
        ends[end] = ends.get(end, 0) | 1 << bit
    byte_class, samples = _classes(edges)
    closures = [_closure([s], free) for s in range(len(edges))]
    step, masks = _subsets(start, edges, closures, ends, samples, anchored)
    step, masks, first = _minimised(step, masks)
    return _arranged(step, masks, byte_class, first)


def _classes(edges) -> tuple[np.ndarray, list[int]]:
    """Bytes that no edge tells apart form a class; one sample byte of each."""
    sets = {s for out in edges for s, _ in out}
    seen: dict[tuple, int] = {}
    byte_class, samples = np.zeros(256, np.uint8), []
    for b in range(256):
        k = tuple(b in s for s in sets)
        if k not in seen:
            seen[k] = len(samples)
            samples.append(b)
        byte_class[b] = seen[k]
    return byte_class, samples


def _closure(states, free) -> frozenset[int]:
    found, todo = set(states), list(states)
    while todo:
        for t in free[todo.pop()]:
            if t not in found:
                found.add(t)
                todo.append(t)
    return frozenset(found)


def _subsets(start, edges, closures, ends, samples, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unless anchored, every set holds the start's closure, as a match may begin
    at any byte."""
    moves: list[dict[int, set[int]]] = []
    for out in edges:
        by: dict[int, set[int]] = {}
        for s, to in out:
            for k, b in enumerate(samples):
                if b in s:
                    by.setdefault(k, set()).update(closures[to])
        moves.append(by)
    root = closures[start]
    number, todo, rows = {root: 0}, [root], []
    for current in todo:
        nexts: list[set[int]] = [set() if anchored else set(root) for _ in samples]
        for s in current:
            for k, to in moves[s].items():
                nexts[k] |= to
        row = []
        for x in map(frozenset, nexts):
            if x not in number:
                number[x] = len(todo)
                todo.append(x)
            row.append(number[x])
        rows.append(row)
    masks = np.zeros(len(todo), np.int64)
    for i, x in enumerate(todo):
        for s in x:
            masks[i] |= ends.get(s, 0)
    return np.array(rows, np.int64), masks


def _minimised(step: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """States stay apart while their masks or the blocks they lead to differ."""
    block = np.unique(masks, return_inverse=True)[1]
    while True:
        _, first, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            return finer[step[first]], masks[first], int(finer[0])
        block = finer


def _arranged(step: np.ndarray, masks: np.ndarray, byte_class: np.ndarray, first: int) -> Automaton:
    """Number the states breadth first from the first one, the accepting last."""
    order, met = [first], {first}
    for s in order:
        for t in step[s].tolist():
            if t not in met:
                met.add(t)
                order.append(t)
    order.sort(key=lambda s: masks[s] != 0)
    place = np.zeros(len(step), np.int64)
    place[order] = np.arange(len(order))
    classes = step.shape[1]
    new = place[step[order]] * classes
    begin = int(place[first]) * classes
    reset = (new == begin).all(axis=0)
    return Automaton(byte_class, new.ravel().astype(np.int32), classes, int((masks[order] == 0).sum()), masks[order], begin, reset)


def marks(a: Automaton, data: np.ndarray, stride: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(place, bit mask) wherever patterns of an automaton that may begin at any
    byte end, in one pass over the bytes, many lanes at a time. Lanes are cut
    behind bytes that lead every state back to the first, so each is scanned as
    in the whole. Places are in no order."""
    classes = a.byte_class[data]
    cuts = np.flatnonzero(a.reset[classes]) + 1
    at = np.searchsorted(cuts, np.arange(stride, len(classes), stride), "right") - 1
    inner = cuts[at[at >= 0]]
    starts = np.unique(np.append(0, inner[inner < len(classes)]))
    sizes = np.diff(np.append(starts, len(classes)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    state = np.full(len(starts), a.first, np.int32)
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    edge = a.accepting * a.classes
    places, ends = [], []
    for j, n in enumerate(live.tolist()):
        if n <= 4 and sizes[0] - j > 64:
            break
        s = a.step[state[:n] + classes[starts[:n] + j]]
        state[:n] = s
        hit = np.flatnonzero(s >= edge)
        if len(hit):
            places.append(starts[hit] + j)
            ends.append(s[hit])
    else:
        j = sizes[0]
    step = a.step.tolist() if j < sizes[0] else []
    for i in range(int((sizes > j).sum())):  # the last few long lanes
        s, found, at = int(state[i]), [], []
        for p, c in enumerate(classes[starts[i] + j : starts[i] + sizes[i]].tolist(), int(starts[i]) + j):
            s = step[s + c]
            if s >= edge:
                at.append(p)
                found.append(s)
        places.append(np.array(at, np.int64))
        ends.append(np.array(found, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), a.masks[np.concatenate(ends) // a.classes]


class Anchored:
    """Longest matches from given places."""

    def __init__(self, a: Automaton):
        self.step, self.first, self.edge = a.step.tolist(), a.first, a.accepting * a.classes
        self.masks, self.classes, self.byte_class = a.masks.tolist(), a.classes, a.byte_class.tolist()
        self.dead = next((i * a.classes for i in range(a.states) if not a.masks[i] and (a.step[i * a.classes : (i + 1) * a.classes] == i * a.classes).all()), -1)

    def end(self, data: bytes, start: int, bit: int) -> int:
        """Where the longest match of a pattern from a place ends, -1 for none."""
        s, best, step, known = self.first, -1, self.step, self.byte_class
        for p in range(start, len(data)):
            s = step[s + known[data[p]]]
            if s == self.dead:
                break
            if s >= self.edge and self.masks[s // self.classes] >> bit & 1:
                best = p + 1
        return best
