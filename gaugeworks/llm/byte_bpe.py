"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are joined into one array of code points and each code point is mapped to a class. Every class is
a transition function over ten states ("in a letter run", "after an apostrophe", ...). Composition of such
functions is associative, so states are found by a scan: each block's function, a prefix scan over blocks,
then the states inside all blocks side by side. A boundary depends on two neighbouring states only; no
regular expression looks at the text. The slices go through a cache of merged pieces; pieces that are not
cached are merged together, one lowest-ranked pair of every piece at a time. The byte offset of every token is kept
beside its id: decoding puts each token's bytes at its offset, all tokens of a text at once.

Defined results
---------------
* A null text is the empty text: no ids. Special tokens are ordinary text.
* Each row is encoded on its own, whatever its id; ties between equal ranks go to the leftmost pair.
* Very long texts are taken whole; long pieces without a boundary are merged with a heap.
* Decoding gives back the text's UTF-8 bytes. Null ids decode to no bytes, ids that are no token to null.
* Extra columns are left out of :func:`encode`; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import slices, worker_state

#: Classes of code points. Fixed by the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
OTHER, LETTER, NUMBER, SPACE, WHITE, QUOTE, ONE, LET_R, LET_V, LET_L, LET_E, END = range(12)
#: States: a token is complete; in letters, in numbers, in others; after a quote that began a token, and
#: then after its r, v or l; in white space that ends in a space, and in other white space.
DONE, IN_L, IN_N, IN_O, Q, Q_R, Q_V, Q_L, SP, WS = range(10)
_LETTERS = (LETTER, ONE, LET_R, LET_V, LET_L, LET_E)
CHUNK_CHARS = 1 << 20
BLOCK = 128
#: Cached pieces of a task; the cache starts anew when it is full.
CACHE_PIECES = 200_000
#: Longer pieces are merged with a heap.
LONG_PIECE = 64


def _transitions() -> np.ndarray:
    table = np.zeros((12, 10), np.uint8)
    for state in range(10):
        for cls in _LETTERS:
            table[cls, state] = IN_L
        table[NUMBER, state] = IN_N
        table[OTHER, state] = IN_O
        table[QUOTE, state] = IN_O if state in (IN_O, Q, SP) else Q
        table[SPACE, state] = SP
        table[WHITE, state] = WS
        table[END, state] = DONE
    table[ONE, Q] = DONE
    table[LET_R, Q], table[LET_V, Q], table[LET_L, Q] = Q_R, Q_V, Q_L
    table[LET_E, Q_R] = table[LET_E, Q_V] = table[LET_L, Q_L] = DONE
    return table


def _starts() -> np.ndarray:
    """starts[class, state before]: whether a token starts at a code point, but for what is found later."""
    table = np.ones((12, 10), bool)
    for cls in _LETTERS:
        table[cls, [IN_L, SP, Q_R, Q_V, Q_L]] = False
    table[[ONE, LET_R, LET_V, LET_L], Q] = False
    table[NUMBER, [IN_N, SP]] = False
    table[OTHER, [IN_O, Q, SP]] = False
    table[QUOTE, [IN_O, Q, SP]] = False
    table[[SPACE, WHITE], SP] = False
    table[[SPACE, WHITE], WS] = False
    return table


TRANSITIONS, STARTS = _transitions(), _starts()


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        classes[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = cls
    for chars, cls in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("r", LET_R), ("v", LET_V), ("l", LET_L), ("e", LET_E)):
        for c in chars:
            classes[ord(c)] = cls
    return classes


def scan_states(classes: np.ndarray) -> np.ndarray:
    """The state after each element, starting from DONE: an associative scan over transition functions."""
    n = len(classes)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, END, np.intp)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * 10
    flat = TRANSITIONS.ravel()
    whole = np.tile(np.arange(10, dtype=np.uint8), (blocks, 1))
    for row in grid:  # the function of each block
        whole = flat[row[:, None] + whole]
    step = 1
    while step < blocks:  # inclusive prefix scan of the blocks' functions
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)
        step *= 2
    state = np.concatenate([np.array([DONE], np.uint8), whole[:-1, DONE]])
    out = np.empty((BLOCK, blocks), np.uint8)
    for j, row in enumerate(grid):
        state = flat[row + state]
        out[j] = state
    return np.ascontiguousarray(out.T).ravel()[:n]


def token_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a token starts at each element. END elements stand between texts."""
    after = scan_states(classes)
    before = np.concatenate([np.array([DONE], np.uint8), after[:-1]])
    starts = STARTS[classes, before]
    # known one element later: a quote's r, v or l that made no contraction, and the last of some white space
    open_quote = (before >= Q_R) & (before <= Q_L) & (after != DONE) | (before >= Q_R) & (before <= Q_L) & (classes == END)
    white_ends = ((before == SP) | (before == WS)) & (classes != SPACE) & (classes != WHITE) & (classes != END)
    starts[np.flatnonzero(open_quote | white_ends) - 1] = True
    return starts


def split_texts(texts: list[str]) -> tuple[list[str], list[int]]:
    """The tokens of all texts, and after how many of them each text ends."""
    if not texts:
        return [], []
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    classes = code_point_classes()[points]
    classes[ends] = END
    starts = np.flatnonzero(token_starts(classes))
    bounds = starts.tolist()
    pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
    pieces.append("\n")
    # each END is a piece of its own; it is taken out by place
    return pieces, np.searchsorted(starts, ends).tolist()


class Vocabulary:
    """Ranks of a byte-level vocabulary, as in a ``.tiktoken`` file, and merging by them."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.texts = list(map(str, range(len(self.tokens))))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array(list(map(len, self.tokens)), np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        """Rank of each pair's merge, or ``none``."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], none)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece; in every round each piece merges its leftmost pair of lowest rank."""
        sizes = np.array([len(p) for p in pieces])
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        none = np.int64(1) << 30
        rank = np.full(len(ids), none)  # of each element's merge with the next one
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pair_rank(ids[inner], ids[inner + 1], none)
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            going = best >> 32 < none
            counts = np.diff(first, append=len(ids))
            stay = np.repeat(~going, counts)
            done_ids.append(ids[stay])
            done_owner.append(owner[stay])
            merged = best[going] & 0xFFFFFFFF
            ids[merged] = rank[merged]
            keep = ~stay
            keep[merged + 1] = False
            place = np.cumsum(keep) - 1
            merged = place[merged]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            left = merged[merged > 0] - 1
            at = np.concatenate([left, merged[merged + 1 < len(ids)]])
            rank[merged] = none
            inside = owner[at] == owner[at + 1]
            rank[at] = none
            at = at[inside]
            rank[at] = self.pair_rank(ids[at], ids[at + 1], none)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat = ids[order].tolist()
        bounds = np.searchsorted(owner[order], np.arange(len(pieces) + 1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip(bounds, bounds[1:])]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one long piece, with a heap of (rank, place)."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, tokens = len(ids), self.ranks, self.tokens
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (again := rank(k)) is not None:
                    heapq.heappush(heap, (again, k))
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """The cache, holding every piece."""
        if len(self.cache) > CACHE_PIECES:
            self.cache = {}
        missing = list(set(pieces).difference(self.cache))
        short, short_bytes = [], []
        for piece in missing:
            raw = piece.encode("utf-8", "surrogatepass")
            if (known := self.ranks.get(raw)) is not None:
                self.cache[piece] = (known,)
            elif len(raw) > LONG_PIECE:
                self.cache[piece] = self.merge_long(raw)
            else:
                short.append(piece)
                short_bytes.append(raw)
        if short:
            self.cache.update(zip(short, self.merge_many(short_bytes)))
        return self.cache

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces, ends = split_texts(texts)
        cached, out, at = self.encode_pieces(pieces), [], 0
        for end in ends:
            out.append(list(chain.from_iterable(map(cached.__getitem__, pieces[at:end]))))
            at = end + 1
        return out

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token begins in the bytes of its text."""
        sizes = self.sizes[np.array(ids, np.intp)]
        return np.cumsum(sizes) - sizes

    def decode(self, ids, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of a text, each token's at its offset."""
        if not len(ids):
            return b""
        ids = np.asarray(ids, np.intp)
        if offsets is None:
            offsets = self.offsets(ids)
        sizes = self.sizes[ids]
        return self.bytes[np.repeat(self.places[ids] - offsets, sizes) + np.arange(offsets[-1] + sizes[-1])].tobytes()


def chunks(texts: list[str], chars: int = CHUNK_CHARS):
    """(start, end) of runs of texts with about so many characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, vocabulary_file: bytes, per_text, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, and what ``per_text(vocabulary, ids, offsets)`` gives, by ``schema``) of every row of ``docs``."""
    file = docs.sparkSession.sparkContext.broadcast(vocabulary_file)  # the vocabulary's size doesn't depend on the input

    def run(batches):
        words = worker_state(token, lambda: Vocabulary(file.value))
        gc.disable()  # no cycles are made, and each collection would walk the cache
        for part in chain.from_iterable(map(slices, batches)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for a, b in chunks(texts):
                rows = [per_text(words, ids, words.offsets(ids)) for ids in words.encode(texts[a:b])]
                columns = [part.column(0).slice(a, b - a), *map(pa.array, zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    token = f"bpe {hashlib.blake2b(vocabulary_file).hexdigest()}"
    shape = to_arrow_schema(StructType.fromDDL(schema))
    names, kinds = ["doc_id", *shape.names], shape.types
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def with_ids(docs: DataFrame, vocabulary_file: bytes, **columns: str) -> DataFrame:
    """(doc_id, ids, offsets): the ids of every whole text and where their bytes begin in it."""
    return encode(docs, vocabulary_file, lambda _, ids, offsets: (ids, offsets), "ids array<int>, offsets array<long>", **columns)


def decode(tokens: DataFrame, vocabulary_file: bytes, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """(doc_id, bytes): the bytes of every row of ``tokens``, such as :func:`with_ids` gives."""
    file = tokens.sparkSession.sparkContext.broadcast(vocabulary_file)
    token = f"bpe {hashlib.blake2b(vocabulary_file).hexdigest()}"

    def run(batches):
        words = worker_state(token, lambda: Vocabulary(file.value))

        def text(ids, offsets) -> bytes | None:
            if ids is None or not len(ids):
                return b""
            known = 0 <= min(ids) and max(ids) < len(words.tokens)
            return words.decode(ids, np.array(offsets, np.int64)) if known else None

        for part in chain.from_iterable(map(slices, batches)):
            found = [text(ids.values and ids.values.to_numpy(), offsets.values and offsets.values.to_numpy()) for ids, offsets in zip(part.column(1), part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    rows = tokens.select(tokens[f"`{id_col}`"].cast("long").alias("doc_id"), tokens[f"`{ids_col}`"].cast("array<long>"), tokens[f"`{offsets_col}`"].cast("array<long>"))
    return rows.mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary_file: bytes, **columns: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def digest(words: Vocabulary, ids: list[int], offsets: np.ndarray):
        from hashlib import sha256

        text = " ".join(map(words.texts.__getitem__, ids))
        return len(ids), sha256(text.encode()).hexdigest(), sha256(words.decode(ids, offsets)).hexdigest()

    return encode(docs, vocabulary_file, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", **columns)
