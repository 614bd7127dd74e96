"""Periodic runs of words, by partition refinement.

Every document is a row of numbers, one for each word. Positions stand in classes of equal factors (stretches of k words),
first for k = 1. From k to k + 1 a position's class splits by the class of the position after it. Of the parts that a class
falls into, the largest is left out of the next step (smaller-half strategy): what stood before it stays together anyway, so
a position is looked at once for each time its class at least halves, O(n log n) in all. Every position knows its neighbours
in its class. Two neighbours at distance k in a class of factors of length k are a square with a primitive root: period k.
Neighbouring squares of a period are one run. Many documents are refined side by side in numpy, each with an end mark of
its own, so that no class has members of two documents; nothing is shuffled, as a document is one row.

Defined results
---------------
* Words are what stands between `[\\x20\\x09-\\x0D]`; a null, empty or blank text has none: no runs, four nulls and no
  bytes. Texts are taken whole, however long.
* Each row stands for itself, whatever its id. With :func:`repeated_tails` a null id repeats nothing.
* Runs that tie in exponent are told apart by the smallest start, then the smallest period.
* Extra columns are left out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import forget_state, slices

#: Words that are refined side by side; longer documents are refined alone.
BATCH_WORDS = 1 << 20
NONE = np.iinfo(np.int32).max


class Numbers(dict):
    """A number for each word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same for starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _heads(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.empty(len(values), bool)
    out[:1] = True
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _counts(starts: np.ndarray, end: int) -> np.ndarray:
    """How long the stretches are that begin at ``starts``, the last one up to ``end``."""
    out = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = end - starts[-1:]
    return out


class Refinement:
    """Classes of equal factors over some documents, from one length to the next."""

    def __init__(self, documents: list[np.ndarray], exponent: int):
        sizes = np.array([len(d) for d in documents], np.int64)
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        n = int(sizes.sum()) + len(documents)
        doc = np.repeat(np.arange(len(documents)), sizes + 1)
        inner = np.ones(n, bool)
        inner[self.first + sizes] = False
        keys = doc << 32
        keys[inner] += np.concatenate(documents) + 1  # an end mark is number 0
        self.longest = sizes // exponent  # the longest period a document can have
        self.doc = doc.astype(np.int32)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        new = _heads(keys[order])
        begin = np.flatnonzero(new)
        # classes: where each one's members stand in ``order``, and how many there are
        self.classes = len(begin)
        self.begin = np.zeros(2 * len(begin), np.int32)
        self.size = np.zeros(2 * len(begin), np.int32)
        self.begin[: len(begin)] = begin
        self.size[: len(begin)] = _counts(begin, n)
        self.order = order
        self.place = np.empty(n, np.int32)
        self.place[order] = np.arange(n, dtype=np.int32)
        self.cls = np.empty(n, np.int32)
        self.cls[order] = np.cumsum(new, dtype=np.int32) - 1
        # neighbours in the class, in order of position
        self.next = np.full(n, NONE, np.int32)
        self.prev = np.full(n, -1, np.int32)
        same = ~new[1:]
        self.next[order[:-1][same]] = order[1:][same]
        self.prev[order[1:][same]] = order[:-1][same]
        self.moved = np.zeros(n + 1, bool)
        self.k = 1
        # a document's positions fall into classes of words: the largest of each is left out
        of = self.doc[order[begin]]
        largest = np.lexsort((-self.size[: len(begin)], of))
        small = np.ones(len(begin), bool)
        small[largest[_heads(of[largest])]] = False
        self.small = np.flatnonzero(small)
        self.gaps: dict[int, list[np.ndarray]] = {}
        self._note(np.flatnonzero(self.next < NONE))

    def _note(self, at: np.ndarray) -> None:
        """Keeps positions by the distance to their next neighbour, where it can still be a period."""
        gap = self.next[at] - at
        use = (gap >= self.k) & (gap <= self.longest[self.doc[at]])
        at, gap = at[use], gap[use]
        if not len(at):
            return
        by = np.argsort(gap, kind="stable")
        at, gap = at[by], gap[by]
        cuts = np.flatnonzero(_heads(gap))
        bounds = [*cuts.tolist(), len(at)]
        for g, a, b in zip(gap[cuts].tolist(), bounds, bounds[1:]):
            self.gaps.setdefault(g, []).append(at[a:b])

    def squares(self) -> np.ndarray:
        """Positions where a square with a root of the present length begins, in order."""
        found = self.gaps.pop(self.k, None)
        if found is None:
            return np.empty(0, np.int64)
        at = np.concatenate(found)
        at = np.sort(at[self.next[at] - at == self.k])
        return at[_heads(at)]

    def refine(self) -> None:
        """From factors of k words to factors of k + 1."""
        at = self.order[_spans(self.begin[self.small], self.size[self.small])]
        at = at[at > 0] - 1
        at = at[self.size[self.cls[at]] > 1]  # a single member stays alone; the end mark of the document before is one
        self.k += 1
        if not len(at):
            self.small = at
            return
        at.sort()
        old = self.cls[at]
        by_class = np.argsort(old, kind="stable")
        together = at[by_class]  # by class and position
        key = old.astype(np.int64) * self.classes + self.cls[at + 1]
        by = np.argsort(key, kind="stable")
        at, old, part = at[by], old[by], _heads(key[by])
        heads = np.flatnonzero(part)
        counts = _counts(heads, len(at))
        first_of = np.flatnonzero(_heads(old[heads]))
        parents = old[heads[first_of]]
        gone = np.add.reduceat(counts, first_of)
        left = self.size[parents] - gone

        # what moves stands at the end of its class's members afterwards; what stood there takes the places set free
        self.moved[at] = True
        tails = self.begin[parents] + left
        slots = _spans(tails, gone)
        stays = slots[~self.moved[self.order[slots]]]
        if len(stays):
            stays.sort()
            vacated = self.place[at]
            vacated = np.sort(vacated[vacated < np.repeat(tails, gone)])
            kept = self.order[stays]
            self.order[vacated], self.place[kept] = kept, vacated
        self.order[slots], self.place[at] = at, slots

        # chains of members that go together are taken out of their classes
        before, behind = self.prev[together], self.next[together]
        a = before[(before < 0) | ~self.moved[before]]
        b = behind[(behind == NONE) | ~self.moved[np.minimum(behind, len(self.moved) - 1)]]
        a_in, b_in = a >= 0, b < NONE
        joined = a[a_in]
        self.next[joined] = b[a_in]
        self.prev[b[b_in]] = a[b_in]
        # and put in order into new ones
        self.moved[at] = False
        self.next[at] = NONE
        self.prev[at] = -1
        same = np.flatnonzero(~part[1:])
        lead = at[same]
        self.next[lead] = at[same + 1]
        self.prev[at[same + 1]] = lead

        made = np.arange(self.classes, self.classes + len(heads), dtype=np.int32)
        self.classes += len(heads)
        while self.classes > len(self.size):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.cls[at] = np.repeat(made, counts)
        self.size[parents] = left
        self.begin[made] = slots[heads]
        self.size[made] = counts
        # the largest part of each class is left out of the next step
        most = np.maximum.reduceat(counts, first_of)
        rest_is_small = left < most
        owner = np.repeat(np.arange(len(parents)), _counts(first_of, len(heads)))
        top = np.flatnonzero((counts == most[owner]) & rest_is_small[owner])
        top = top[_heads(owner[top])]
        small = np.ones(len(heads), bool)
        small[top] = False
        self.small = np.concatenate([made[small], parents[rest_is_small & (left > 0)]])
        self._note(np.concatenate([joined[b_in[a_in]], lead]))


def runs(documents: list[np.ndarray], least: int = 24, exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs of at least ``least`` words and ``exponent`` periods (two or more),
    by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    which = [i for i, d in enumerate(documents) if len(d) >= max(least, exponent)]
    if not which:
        return out
    state = Refinement([documents[i] for i in which], exponent)
    end = int(state.longest.max())
    while state.k <= end:
        at = state.squares()
        if len(at):
            cut = np.flatnonzero(_heads(at - np.arange(len(at))))
            last = cut + _counts(cut, len(at)) - 1
            length = at[last] - at[cut] + 2 * state.k
            use = length >= max(least, exponent * state.k)
            start, length = at[cut][use], length[use]
            doc = state.doc[start]
            for d, s, n in zip(doc.tolist(), (start - state.first[doc]).tolist(), length.tolist()):
                out[which[d]].append((s, n, state.k))
        if not len(state.small) and not state.gaps:
            break
        state.refine()
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period; ties: smallest start, then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: no run has it behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def repeated_tails(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place when every tenth document, by the checksum of its id, repeats its end; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_TYPES = [pa.int64()] * 7 + [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.binary()]
_NAMES = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Callable[[int | None, int], np.ndarray | None] | None = None, least: int = 24, exponent: int = 3
) -> DataFrame:
    """``SCHEMA`` for every row: all runs, the strongest one, and the text without what runs repeat.

    ``arrange(id, n)`` may give the word that stands at each of a document's n places instead of its own.
    """

    def rows(pending):
        documents = [numbers for *_, numbers in pending]
        for (i, words, numbers), found in zip(pending, runs(documents, least, exponent)):
            best = strongest(found)
            if found:
                words = list(map(words.__getitem__, np.flatnonzero(kept_words(len(words), found)).tolist()))
            top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            yield (i, len(numbers), len(found), *top, [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(words))

    def run(batches):
        forget_state()
        for part in chain.from_iterable(map(slices, batches)):
            pending, held, numbers = [], 0, Numbers()
            texts = part.column(1).cast(pa.binary())
            for i, text in zip(part.column(0).to_pylist(), texts):
                words = (text.as_py() or b"").split()  # bytes split at exactly this white space
                ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                at = arrange(i, len(words)) if arrange else None
                if at is not None:
                    ids, words = ids[at], list(map(words.__getitem__, at.tolist()))
                pending.append((i, words, ids))
                held += len(words)
                if held >= BATCH_WORDS:
                    yield _batch(rows(pending))
                    pending, held, numbers = [], 0, Numbers()
            if pending:
                yield _batch(rows(pending))

    source = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

