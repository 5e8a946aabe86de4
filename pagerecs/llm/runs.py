"""Periodic runs of words by a suffix automaton with link-cut access.

Words are bytes other than space and \\t \\n \\v \\f \\r. A run is a stretch of
consecutive words with smallest period q, of at least ``max(6, 4 * q)`` words,
which neither neighbour extends. Each document is worked on by itself:

1. Words found fewer than four times in a stretch of the text are in no run of
   that stretch, as a run repeats each of its words four times. The text is cut
   at them, and the pieces likewise, until nothing more falls away.
2. A suffix automaton of a piece grows by one word at a time. Its suffix links
   form a tree of which every node is coloured with the last place its strings
   end at; nodes of one colour on one path are kept in one splay tree, as a
   link-cut tree keeps its preferred paths. A new word accesses the path from
   its state to the root: every path segment met there gives its colour (the
   previous end) and its deepest node's length on the path (how much of what
   precedes both ends is equal), and then takes the new colour.
3. An end at distance q before the new one with at least q equal words is a
   square, whose left extension the length gives; the last end with the same
   start and period is that of the run. By the theorem of Fine and Wilf a
   segment's distance is always the smallest period, and the smallest period of
   a run is met at each of its ends from the second repetition on.

Time is n log n in a piece's words, memory in proportion to a text's words.

Results for odd input: null, empty or blank text has no word, no run, four
nulls for the greatest run and the digests of the empty string; a null id is
never made periodic by ``periodic_copy``; repeated rows give a row each; very
long texts are whole; a word without a neighbour to repeat costs nothing.
Columns of the input that share a name with a result are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagerecs.llm.common import free_name, give_back

#: A run has at least so many words, and so many repetitions of its period.
LEAST_WORDS, LEAST_REPEATS = 6, 4
RESULT = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)

Run = tuple[int, int, int]  # start, length, period


def pieces(ids: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches in which every word occurs four times or
    more and which are long enough for a run."""
    at = np.arange(len(ids))
    stretch = np.zeros(len(ids), np.int64)
    word = ids.astype(np.int64)
    while len(at):
        _, which, count = np.unique(stretch * (len(ids) + 1) + word, return_inverse=True, return_counts=True)
        stays = count[which] >= LEAST_REPEATS
        whole = stays.all()
        at, word, old = at[stays], word[stays], stretch[stays]
        new = np.r_[True, (np.diff(at) != 1) | (np.diff(old) != 0)][: len(at)]
        stretch = np.cumsum(new) - 1
        size = np.bincount(stretch)
        long = size >= LEAST_WORDS
        if whole and long.all():
            first = np.flatnonzero(new)
            return list(zip(at[first].tolist(), (at[first] + size).tolist(), strict=True))
        kept = long[stretch]
        at, word, stretch = at[kept], word[kept], stretch[kept]
    return []


class LastEnds:
    """A growing suffix automaton whose link tree knows, for every state, the
    last place that its strings end at."""

    def __init__(self) -> None:
        self.length = [0]
        self.link = [-1]
        self.goes: list[dict[int, int]] = [{}]
        self.last = 0
        # splay trees of path segments: above[root of one] is the state over its top
        self.left, self.right, self.above = [-1], [-1], [-1]
        self.end = [-1]  # the colour, valid at a splay tree's root

    def _state(self, length: int, link: int, goes: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.goes.append(goes)
        self.left.append(-1)
        self.right.append(-1)
        self.above.append(link)
        self.end.append(-1)
        return len(self.length) - 1

    def _is_root(self, v: int) -> bool:
        p = self.above[v]
        return p < 0 or (self.left[p] != v and self.right[p] != v)

    def _turn(self, v: int) -> None:
        """Rotates ``v`` over its parent in the splay tree."""
        left, right, above = self.left, self.right, self.above
        p = above[v]
        up = above[p]
        if left[p] == v:
            moved = left[p] = right[v]
            right[v] = p
        else:
            moved = right[p] = left[v]
            left[v] = p
        if moved >= 0:
            above[moved] = p
        above[p], above[v] = v, up
        if up >= 0:
            if left[up] == p:
                left[up] = v
            elif right[up] == p:
                right[up] = v

    def _raise(self, v: int) -> None:
        """Makes ``v`` the root of its splay tree; the colour goes with the root."""
        left, above = self.left, self.above
        while not self._is_root(v):
            p = above[v]
            if self._is_root(p):
                self.end[v] = self.end[p]
            else:
                g = above[p]
                if self._is_root(g):
                    self.end[v] = self.end[g]
                self._turn(p if (left[g] == p) == (left[p] == v) else v)
            self._turn(v)

    def append(self, word: int) -> None:
        """One more word: a new state, and perhaps a copy of an old one."""
        length, link, goes = self.length, self.link, self.goes
        at = self.last
        size = length[at] + 1
        new = self._state(size, 0, {})
        while at >= 0 and word not in goes[at]:
            goes[at][word] = new
            at = link[at]
        if at >= 0:
            old = goes[at][word]
            if length[old] != length[at] + 1:
                old = self._between(old, length[at] + 1)
                link[old], over = link[goes[at][word]], goes[at][word]
                link[over] = old
                while at >= 0 and goes[at].get(word) == over:
                    goes[at][word] = old
                    at = link[at]
            link[new] = old
            self.above[new] = old
        self.last = new

    def _between(self, state: int, length: int) -> int:
        """A copy of ``state`` for its shorter strings, put above it on the same
        path: until now they ended where the state's did."""
        copy = self._state(length, -1, dict(self.goes[state]))
        self._raise(state)
        top = self.left[state]
        self.left[copy], self.above[copy] = top, state
        if top >= 0:
            self.above[top] = copy
        self.left[state] = copy
        return copy

    def access(self, end: int) -> list[tuple[int, int]]:
        """Colours the newest state's path with ``end``. Returns, deepest first,
        (previous end, equal words before both) of each segment that it met."""
        left, right, above, colour = self.left, self.right, self.above, self.end
        below, v, found = -1, self.last, []
        while v >= 0:
            self._raise(v)
            was, deeper = colour[v], right[v]
            if was >= 0 and self.length[v]:
                found.append((was, self.length[v]))
            if deeper >= 0:
                colour[deeper] = was  # the rest of that path keeps its colour
            right[v] = below
            if below >= 0:
                above[below] = v
            below, v = v, above[v]
        colour[below] = end
        return found


def runs_of(words: list[int]) -> list[Run]:
    """All runs of one piece, by start and period."""
    tree, ends = LastEnds(), {}
    for end, word in enumerate(words):
        tree.append(word)
        for before, equal in tree.access(end):
            period = end - before
            if equal >= (LEAST_REPEATS - 1) * period and equal + period >= LEAST_WORDS:
                ends[before - equal + 1, period] = end
    return sorted((start, end + 1 - start, period) for (start, period), end in ends.items())


def document_runs(words: list[bytes]) -> list[Run]:
    """All runs of a document's words, by start and period."""
    if len(words) < LEAST_WORDS:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = []
    for begin, end in pieces(ids):
        found += [(begin + start, length, period) for start, length, period in runs_of(ids[begin:end].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def summary(words: list[bytes]) -> tuple:
    """The values of ``RESULT`` for a document's words."""
    runs = document_runs(words)
    listed = b"".join(b"%d,%d,%d\n" % run for run in runs)
    greatest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*greatest, 1000 * greatest[1] // greatest[2]) if greatest else (None,) * 4
    return (len(runs), *best, _digest(listed), _digest(b" ".join(collapsed(words, runs))))


def periodic_copy(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """For a tenth of the ids (by crc32) the words from some place on are those
    of one period, repeated; other documents are as they are."""
    n, digest = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if not n or digest % 10:
        return words
    part = digest // 10
    begin = part % n
    period = 1 + (n - begin) // (3 + part % 8)
    once = words[begin : begin + period]
    return words[:begin] + (once * -(-(n - begin) // period))[: n - begin]


def find_runs(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    altered: Callable[[list[bytes], int | None], list[bytes]] | None = None,
) -> DataFrame:
    """``docs`` without its text, with the runs of each text (``RESULT``).
    ``altered`` may change a document's words first, given its id."""
    results = [part.split()[0] for part in RESULT.split(", ")]
    names = [c for c in docs.columns if c != text and c.lower() not in results]
    schema = docs.select(*names).schema
    for part in RESULT.split(", "):
        schema = schema.add(*part.split())
    body_name, id_name = free_name(docs, "body"), free_name(docs, "of_id")
    given = docs.select(*names, docs[text].cast("binary").alias(body_name), docs[doc_id].alias(id_name))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, name in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                body = body.as_buffer()
                words = body.to_pybytes().split() if body is not None else []
                rows.append(summary(altered(words, name.as_py()) if altered else words))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(results)
            kinds = [pa.string() if r.endswith("sha256") else pa.int64() for r in results]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, *results])
        give_back()

    return given.mapInArrow(found, schema)
