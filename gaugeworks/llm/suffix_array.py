"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard.

Over bytes every bucket is induced in waves of numpy operations: a wave holds the suffixes of the bucket that
are known so far, and what they induce in the same bucket is the next wave. Leftmost-smaller (LMS) substrings
are sorted by inducing once, named, and sorted by recursion where names repeat. The names' alphabet is large
and its buckets are small, so deeper levels induce one suffix at a time.
"""

from __future__ import annotations

import numpy as np

#: Larger alphabets have too many small buckets for waves: they are induced one suffix at a time.
WAVE_ALPHABET = 300


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last, a unique smallest symbol, is."""
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(text), bool)
    out[:-1] = np.append(step, 1)[following] > 0
    return out


def _places(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each sorted element among those with its symbol."""
    counts = np.bincount(symbols)
    return np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """A stable order; short integers are sorted by radix."""
    return np.argsort(symbols.astype(np.uint16) if len(symbols) and symbols.max() < 1 << 16 else symbols, kind="stable")


def _induce(text: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes in order (or by their first symbols alone)."""
    n, ends = len(text), np.cumsum(sizes)
    starts = ends - sizes
    array = np.full(n, -1, np.int32)
    symbols = text[lms]
    order = _by_symbol(symbols)
    counts = np.bincount(symbols, minlength=len(sizes))
    array[ends[symbols[order]] - counts[symbols[order]] + _places(symbols, order)] = lms[order]
    head, tail = starts.copy(), ends - counts

    def larger_before(known: np.ndarray) -> None:
        before = known[known > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            symbols = text[before]
            order = _by_symbol(symbols)
            array[head[symbols[order]] + _places(symbols, order)] = before[order]
            head[:] += np.bincount(symbols, minlength=len(head))

    used = np.flatnonzero(sizes)
    for c in used:
        at = starts[c]
        while at < head[c]:
            wave = array[at : head[c]]
            at = head[c]
            larger_before(wave)
        larger_before(array[tail[c] : ends[c]])
    larger_ends, tail = head, ends.copy()

    def smaller_before(known: np.ndarray) -> None:
        before = known[known > 0] - 1
        before = before[smaller[before]]
        if len(before):
            symbols = text[before]
            order = _by_symbol(symbols)
            array[tail[symbols[order]] - 1 - _places(symbols, order)] = before[order]
            tail[:] -= np.bincount(symbols, minlength=len(tail))

    last = len(text) - 1
    for c in used[::-1]:
        at = ends[c]
        if c == text[last]:  # the sentinel has no smaller suffix to induce it
            tail[c] -= 1
            array[tail[c]] = last
        while at > tail[c]:
            wave = array[tail[c] : at][::-1]
            at = tail[c]
            smaller_before(wave)
        smaller_before(array[starts[c] : larger_ends[c]][::-1])
    return array


def _induce_singly(text: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As :func:`_induce`, suffix by suffix."""
    n = len(text)
    # the symbol of the suffix that each suffix induces in a pass, or -1; the last entry stands for "unknown"
    induces_larger, induces_smaller = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    induces_larger[1:n] = np.where(smaller[:-1], -1, text[:-1])
    induces_smaller[1:n] = np.where(smaller[:-1], text[:-1], -1)
    symbols, ends = text[lms], np.cumsum(sizes)
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=len(sizes))
    array = np.full(n, -1, np.int64)
    array[ends[symbols[order]] - counts[symbols[order]] + _places(symbols, order)] = lms[order]
    array, head, tail = array.tolist(), (ends - sizes).tolist(), ends.tolist()
    symbol = induces_larger.tolist()
    for i in array:  # grows ahead of the loop
        c = symbol[i]
        if c >= 0:
            at = head[c]
            array[at] = i - 1
            head[c] = at + 1
    tail[text[-1]] -= 1
    array[tail[text[-1]]] = n - 1
    symbol = induces_smaller.tolist()
    for i in reversed(array):
        c = symbol[i]
        if c >= 0:
            at = tail[c] - 1
            array[at] = i - 1
            tail[c] = at
    return np.array(array, np.int32)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each LMS substring in text order: equal for equal ones, ordered as they are."""
    length = np.zeros(len(text), np.int64)
    length[lms] = np.diff(lms, append=len(text) - 1) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[length[a[live]] > k]
    name = np.concatenate([[0], np.cumsum(~same)])
    by_place = np.zeros(len(text), np.int64)
    by_place[ordered] = name
    return by_place[lms], int(name[-1]) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of non-negative integers that end in a unique smallest one."""
    text = text.astype(np.int32)
    if len(text) == 1:
        return np.zeros(1, np.int32)
    sizes = np.bincount(text)
    induce = _induce if len(sizes) <= WAVE_ALPHABET else _induce_singly
    smaller = _smaller(text)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    roughly = induce(text, smaller, sizes, lms)
    ordered = roughly[is_lms[roughly]]
    names, distinct = _names(text, lms, ordered)
    if distinct < len(lms):
        ordered = lms[suffix_array(names)]
    return induce(text, smaller, sizes, ordered)


def permuted_prefixes(text: np.ndarray, array: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For each position, in text order, the common prefix with the suffix before it in ``array``, up to ``most``.

    A prefix is at most one shorter than that of the position before it, so each part of the text (from
    ``starts``) is walked along with what is left of the last prefix; all parts walk side by side.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[array[1:]], before[array[0]] = array[:-1], n - 1
    padded = np.concatenate([text, np.full(most + 1, -1, text.dtype)])
    out = np.zeros(n, np.int16)
    lengths = np.diff(starts, append=n)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    prefix = np.zeros(len(starts), np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        lanes = int(np.searchsorted(-lengths, -step, side="left"))
        at = starts[:lanes] + step
        other = before[at]
        prefix = np.maximum(prefix[:lanes] - 1, 0)
        live = np.flatnonzero((prefix < most) & (at != other))
        while len(live):
            live = live[padded[at[live] + prefix[live]] == padded[np.minimum(other[live] + prefix[live], n)]]
            prefix[live] += 1
            live = live[prefix[live] < most]
        out[at] = prefix
    return out
