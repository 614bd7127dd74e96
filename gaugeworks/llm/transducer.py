"""A lexicon as a minimal acyclic transducer: words to sequences of numbers.

Words are put in order, then taken in one by one. The states of the newest word's path stay open; what the next word
doesn't share is frozen: a state that equals a frozen one (same arcs, targets and outputs) becomes that state, so equal
endings exist once. Outputs stand as near to the root as they can: an arc carries what all words behind it have in common, which leaves the endings without
outputs and lets them be shared. Every word ends with a mark, so none is the beginning of another and there is one
final state. The finished automaton is one block of bytes: sorted arcs, their targets and outputs. Readers map the block
into memory and look up many words side by side, one letter of each at a time.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable, Sequence

import numpy as np

#: Ends every word; no byte of UTF-8.
MARK = 0xFF
_MAGIC = 0x4C455831


def _common(a: Sequence[int], b: Sequence[int]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The automaton of (word, numbers) entries with distinct words."""
    frozen: dict[tuple, int] = {(): 0}
    arcs: list[tuple] = [()]  # of each frozen state: (letter, target, output), ...
    path: list[dict[int, list]] = [{}]  # open states: letter -> [target once frozen, output]
    before = b""

    def freeze(keep: int) -> None:
        while len(path) > keep:
            state = tuple((letter, target, output) for letter, (target, output) in path.pop().items())
            number = frozen.get(state)
            if number is None:
                number = frozen[state] = len(arcs)
                arcs.append(state)
            path[-1][before[len(path) - 1]][0] = number

    for word, output in sorted((word + bytes([MARK]), output) for word, output in entries):
        if word == before:
            raise ValueError("words must be distinct")
        shared = _common(word, before)
        freeze(shared + 1)
        for depth in range(shared):
            arc = path[depth][word[depth]]
            n = _common(arc[1], output)
            if n < len(arc[1]):  # what isn't common moves to the arcs behind
                rest, arc[1] = arc[1][n:], arc[1][:n]
                for behind in path[depth + 1].values():
                    behind[1] = rest + behind[1]
            output = output[n:]
        for depth in range(shared, len(word)):
            path[depth][word[depth]] = [0, output]
            output = ()
            if depth + 1 < len(word):
                path.append({})
        before = word
    # the mark's target is the final state, number 0, which has no arcs
    freeze(1)
    root = tuple((letter, target, output) for letter, (target, output) in path[0].items())
    arcs.append(root)

    keys, targets, places, flat = [], [], [0], []
    for number, state in enumerate(arcs):
        for letter, target, output in state:
            keys.append(number << 8 | letter)
            targets.append(target)
            flat.extend(output)
            places.append(len(flat))
    head = np.array([_MAGIC, len(arcs) - 1, len(keys), len(flat)], np.int64)
    return b"".join(a.tobytes() for a in (head, np.array(keys, np.int64), np.array(places, np.int64), np.array(targets, np.int32), np.array(flat, np.int32)))


class Lexicon:
    """A compiled lexicon, mapped from its file or over its bytes."""

    def __init__(self, block: bytes | mmap.mmap):
        magic, self.root, n_arcs, n_flat = np.frombuffer(block, np.int64, 4).tolist()
        if magic != _MAGIC:
            raise ValueError("not a lexicon")
        at = 32
        self.keys = np.frombuffer(block, np.int64, n_arcs, at)
        self.places = np.frombuffer(block, np.int64, n_arcs + 1, at := at + 8 * n_arcs)
        self.targets = np.frombuffer(block, np.int32, n_arcs, at := at + 8 * (n_arcs + 1))
        self.flat = np.frombuffer(block, np.int32, n_flat, at + 4 * n_arcs)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The lexicon in a file; its pages are read when they are needed and shared by all who map it."""
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, numbers, bounds): whether the lexicon has each word, and its numbers between bounds[i] and bounds[i + 1]."""
        if not words or not len(self.keys):
            return np.zeros(len(words), bool), np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        ended = bytes([MARK])
        letters = np.frombuffer(ended.join(words) + ended, np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes) - sizes
        who, state = np.arange(len(words)), np.full(len(words), self.root, np.int64)
        # a word that holds the mark itself is in no lexicon; it fails on the way, or has letters left
        found = np.zeros(len(words), bool)
        said_by, said = [], []
        step = 0
        while len(who):
            key = state << 8 | letters[starts[who] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            who, arc = who[hit], arc[hit]
            speaks = self.places[arc + 1] > self.places[arc]
            said_by.append(who[speaks])
            said.append(arc[speaks])
            step += 1
            over = sizes[who] == step
            found[who[over]] = self.targets[arc[over]] == 0
            who, state = who[~over], self.targets[arc[~over]].astype(np.int64)
        by = np.concatenate(said_by)
        order = np.argsort(by, kind="stable")  # by word, in the order of its letters
        by, arc = by[order], np.concatenate(said)[order]
        keep = found[by]  # what was said on a way that failed doesn't count
        by, arc = by[keep], arc[keep]
        count = self.places[arc + 1] - self.places[arc]
        ends = np.cumsum(count)
        numbers = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.places[arc] - (ends - count), count)]
        return found, numbers, np.concatenate([[0], ends])[np.searchsorted(by, np.arange(len(words) + 1))]
