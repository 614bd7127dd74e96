"""Alignment of two tokenizers' tokens, by a sweep over their ends.

1. Every text is encoded by both. Where a token ends is an event: (document, byte offset, side, id). The events of one side
   that lie in one window of 32 KiB travel as one row.
2. Both sides' rows are brought together by document and sorted by offset within partitions.
3. A state machine walks the stream. Where both sides end at the same byte, a group ends; what it holds between rows is one
   open group, a few counts and a hash. It emits groups and each document's links: pairs of ids within a group and how often.
4. How many documents hold a pair is counted over all of them, and the highest count of each id of the first tokenizer. Frequent pairs
   (``BROADCAST_PAIRS`` at most, the threshold comes from a histogram of counts) are looked up where the documents
   lie; rows of rarer pairs, each of which few documents hold, meet their counts in a join.

Texts are cut where a space follows something else than white space: no token of either tokenizer reaches over such a
place (that is checked in the second one's pieces; the first one's pattern says it), so equal parts are encoded once.

Defined results
---------------
* Null and empty texts, and texts whose tokens don't spell them (a space first), have no tokens: zeros, and the empty string for
  the hash. They hold no pair.
* Rows stand for themselves, whatever their ids; rows that repeat an id and a text count as documents of their own.
* Texts are taken whole, however long; a group may be as long as a text. Ties for the highest count all count as best.
* Extra columns are left out; an empty table gives an empty result.
* Rows are told apart by their numbers in the input, which must come again in the same order when a task is repeated, as a
  table's do.
"""

from __future__ import annotations

import gc
import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import chunks
from .common import slices, worker_state, written

#: Bytes of a text whose events travel as one row.
WINDOW = 1 << 15
#: Characters that are encoded together.
CHUNK_CHARS = 1 << 22
#: Parts and tokens a task remembers; it starts anew when they are more.
KNOWN_PARTS, KNOWN_TOKENS = 300_000, 8_000_000
#: Pairs whose counts are broadcast, at most (16 bytes each).
BROADCAST_PAIRS = 1 << 20
#: Pairs of a group above which its equal ids are counted before they are paired.
LARGE_GROUP = 1 << 16
#: Pairs that a task holds before it puts equal ones together or hands rows on.
HELD_PAIRS = 1 << 21
_SPACED = regex.compile(r"(?<=\S)(?= )")
_AFTER_WHITE = regex.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Sides:
    """Both tokenizers, and the bytes of each one's tokens."""

    def __init__(self, file_a: bytes, file_b: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        vocabulary = json.loads(file_a)["model"]["vocab"]
        ranks = {bytes(map(letters.__getitem__, token)): number for token, number in vocabulary.items()}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.bytes_a[number] = token
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        pieces = list(map(b.id_to_piece, range(b.get_piece_size())))
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that go on after a space aren't supported")
        self.space = b.piece_to_id("▁")
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        # a group's text: each id followed by a comma or, where it is a side's last one, by the side's end mark
        self.names = [np.array([f"{i}{end}" for end in (",", mark) for i in range(len(x))], object) for x, mark in ((self.bytes_a, "|"), (self.bytes_b, ";"))]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = [[0], [0]]
        self.flat = [np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.uint32)]
        self.spelled: list[bool] = []

    def parts(self, text: str) -> list[str]:
        """Parts of a space and the text, each beginning with a space."""
        spaced = " " + text
        if _AFTER_WHITE.search(spaced):
            return _SPACED.split(spaced)
        return [" " + p for p in text.split(" ")]

    def _learn(self, parts: list[str]) -> None:
        for part in parts:
            self.known[part] = len(self.known)
        encoded = [self.a.encode_ordinary(p) for p in parts], self.b.encode([p[1:] for p in parts], num_threads=1)
        for i, part in enumerate(parts):
            raw = part.encode()
            ids_a, ids_b = encoded[0][i], encoded[1][i]
            if part == " ":  # the tokenizer's own space is all there is
                ids_b = encoded[1][i] = [self.space]
            self.spelled.append(
                b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw
            )
        for side in (0, 1):
            starts, new = self.starts[side], list(chain.from_iterable(encoded[side]))
            at = starts[-1]
            for ids in encoded[side]:
                at += len(ids)
                starts.append(at)
            while at > len(self.flat[side]):
                self.flat[side] = np.concatenate([self.flat[side], np.empty_like(self.flat[side])])
            self.flat[side][at - len(new) : at] = new

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both sides' ids of each text; None for a text without tokens."""
        if len(self.known) > KNOWN_PARTS or max(len(f) for f in self.flat) > KNOWN_TOKENS:
            self._forget()
        parts = [self.parts(t) if t else [] for t in texts]
        self._learn(list(set(chain.from_iterable(parts)).difference(self.known)))
        starts = [np.array(s, np.int64) for s in self.starts]
        spelled = np.array(self.spelled, bool)
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for p in parts:
            numbers = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
            if not len(p) or not spelled[numbers].all():
                out.append(None)
                continue
            ids = []
            for side in (0, 1):
                first = starts[side][numbers]
                ids.append(self.flat[side][_spans(first, starts[side][numbers + 1] - first)])
            out.append((ids[0], ids[1]))
        return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same for starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def pack(ids: np.ndarray) -> bytes:
    """Ids as bytes: all lowest bytes, then all second ones, and so on; compressed."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def put_together(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each stands there."""
    if times is None:
        return np.unique(pairs, return_counts=True)
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return pairs[at], np.add.reduceat(times[order], at) if len(at) else times


class Sweep:
    """The machine that walks one document's events in order of their offsets."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.open = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.at = [0, 0]  # where each side's last group ended
        self.n = [0, 0]
        self.n_groups = self.n_links = 0
        self.hash = hashlib.sha256()
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def events(self, new_a: np.ndarray, new_b: np.ndarray) -> None:
        """The next tokens of both sides."""
        self.n[0] += len(new_a)
        self.n[1] += len(new_b)
        a, b = (np.concatenate([o, n]) if len(o) else n for o, n in zip(self.open, (new_a, new_b)))
        ends_a, ends_b = self.at[0] + np.cumsum(self.sides.sizes[0][a]), self.at[1] + np.cumsum(self.sides.sizes[1][b])
        if len(a) and len(b):
            at = np.searchsorted(ends_b, ends_a)
            cut = np.flatnonzero(ends_b[np.minimum(at, len(b) - 1)] == ends_a)
            if len(cut):
                last_a, last_b = cut, at[cut]
                self.at = [int(ends_a[last_a[-1]]), int(ends_b[last_b[-1]])]
                self._groups(a[: last_a[-1] + 1], b[: last_b[-1] + 1], last_a, last_b)
                a, b = a[last_a[-1] + 1 :], b[last_b[-1] + 1 :]
        self.open = [a, b]

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        first_a, first_b = last_a + 1 - n_a, last_b + 1 - n_b
        links = n_a * n_b
        # the text of the groups: a's ids of a group, then b's
        text = np.empty(len(a) + len(b), object)
        ends = [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)]
        ends[0][last_a], ends[1][last_b] = len(self.sides.sizes[0]), len(self.sides.sizes[1])
        text[np.arange(len(a)) + np.repeat(first_b, n_a)] = self.sides.names[0][a + ends[0]]
        text[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = self.sides.names[1][b + ends[1]]
        if self.n_groups:
            self.hash.update(b";")
        self.hash.update("".join(text.tolist())[:-1].encode())
        self.n_groups += len(links)
        self.n_links += int(links.sum())
        large = links > LARGE_GROUP
        for g in np.flatnonzero(large).tolist():
            self._large(a[first_a[g] : last_a[g] + 1], b[first_b[g] : last_b[g] + 1])
        if large.any():
            n_b = np.where(large, 0, n_b)
        per_token = np.repeat(n_b, n_a)
        pairs = np.repeat(a, per_token).astype(np.int64) << 32 | b[_spans(np.repeat(first_b, n_a), per_token)]
        self._hold(*put_together(pairs))

    def _large(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of a large group, by distinct ids."""
        (a, times_a), (b, times_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        rows = max(1, HELD_PAIRS // len(b))
        for i in range(0, len(a), rows):
            pairs = (a[i : i + rows, None].astype(np.int64) << 32 | b).ravel()
            self._hold(pairs, (times_a[i : i + rows, None] * times_b).ravel())

    def _hold(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.times.append(times)
        self.held += len(pairs)
        if self.held > HELD_PAIRS and len(self.pairs) > 1:
            self.links()
            self.held = 0  # again after as many new ones

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The document's distinct pairs so far, and how often each is linked."""
        if len(self.pairs) > 1:
            pairs, times = put_together(np.concatenate(self.pairs), np.concatenate(self.times))
            self.pairs, self.times = [pairs], [times]
        return (self.pairs[0], self.times[0]) if self.pairs else (np.empty(0, np.int64), np.empty(0, np.int64))


_EVENTS = "row long, doc_id long, offset long, side int, ids binary"
_SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_FOUND = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _sides(token: str, files) -> Sides:
    gc.disable()  # no cycles are made, and each collection would walk what is remembered
    return worker_state(token, lambda: Sides(*files.value))


def events(docs: DataFrame, files, token: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, offset, side, ids): both sides' events, those of a window in one row. A row without tokens has one
    event without ids."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        sides = _sides(token, files)
        for part in chain.from_iterable(map(lambda b: slices(b, 2048), batches)):
            rows, ids, texts = (c.to_pylist() for c in part.columns)
            for x, y in chunks([t or "" for t in texts], CHUNK_CHARS):
                out = []
                for row, doc_id, found in zip(rows[x:y], ids[x:y], sides.encode(texts[x:y])):
                    if found is None:
                        out.append((row, doc_id, 0, 0, None))
                        continue
                    for side in (0, 1):
                        window = (np.cumsum(sides.sizes[side][found[side]]) - 1) // WINDOW
                        for w in np.unique(window).tolist() if len(window) and window[-1] else [0]:
                            a, b = np.searchsorted(window, (w, w + 1))
                            out.append((row, doc_id, w * WINDOW, side, pack(found[side][a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "doc_id", "offset", "side", "ids"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return source.mapInArrow(run, _EVENTS)


def sweep(found: DataFrame, files, token: str) -> DataFrame:
    """``_SWEPT`` of every document, from its events in order."""
    whole = pa.list_(pa.int64())
    kinds = [*[pa.int64()] * 6, pa.string(), whole, whole]
    names = [f.split()[0] for f in _SWEPT.split(", ")]

    def run(batches):
        sides = _sides(token, files)
        nothing = np.empty(0, np.int64)
        done, held = [], 0
        row = doc_id = machine = offset = None
        window = [nothing, nothing]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

        def close():
            machine.events(*window)
            pairs, times = machine.links()
            digest = machine.hash.hexdigest() if machine.n_groups else ""
            done.append((row, doc_id, *machine.n, machine.n_groups, machine.n_links, digest, pairs, times))
            return len(pairs) + 64

        for part in batches:
            for r, d, o, side, ids in zip(*(c.to_pylist() for c in part.columns)):
                if r != row:
                    if row is not None:
                        held += close()
                        if held > HELD_PAIRS:
                            yield batch()
                            done, held = [], 0
                    row, doc_id, offset, machine, window = r, d, o, Sweep(sides), [nothing, nothing]
                elif o != offset:
                    machine.events(*window)
                    offset, window = o, [nothing, nothing]
                if ids is not None:
                    window[side] = unpack(ids).astype(np.int64)
        if row is not None:
            close()
            yield batch()

    return found.repartition("row").sortWithinPartitions("row", "offset", "side").mapInArrow(run, _SWEPT)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether no pair of its first id is held by more."""

    def run(batches):
        held, size = [], 0
        for part in batches:
            for piece in slices(part, 1024):
                pairs = piece.column(0).flatten().to_numpy()
                held.append(put_together(pairs))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held, size = [put_together(*map(np.concatenate, zip(*held)))], 0
                    if len(held[0][0]) > HELD_PAIRS:
                        yield counted(held)
                        held = []
        if held:
            yield counted(held)

    def counted(held):
        pairs, times = put_together(*map(np.concatenate, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], ["pair", "n"])

    counts = written(swept.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32).alias("first")
    highest = counts.groupBy(first).agg(F.max("n").alias("highest"))  # one row for each id of the vocabulary at most
    return counts.join(F.broadcast(highest), F.shiftright(counts["pair"], 32) == highest["first"]).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def frequent_from(counts: DataFrame, most: int = BROADCAST_PAIRS) -> int:
    """The least power of two that at most ``most`` pairs' counts reach."""
    power = (F.length(F.bin("n")) - 1).alias("power")
    left, at = most, 62
    for r in counts.groupBy(power).count().orderBy(F.desc("power")).collect():  # 63 rows at most
        if r["count"] > left:
            break
        left, at = left - r["count"], r.power
    return 1 << at


def align(docs: DataFrame, file_a: bytes, file_b: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    files, token = _shared(docs, file_a, file_b, pattern)
    swept = written(sweep(events(docs, files, token, id_col, text_col), files, token), "swept")
    counts = written(pair_counts(swept), "pair-best")
    at = frequent_from(counts, broadcast_pairs)
    frequent = counts.where(F.col("n") >= at).toArrow().sort_by("pair")  # bounded by ``broadcast_pairs``
    looked = docs.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in frequent.columns))
    rare = counts.where(F.col("n") < at)

    def known(pairs: np.ndarray):
        """Where each pair stands among the frequent ones, and whether it does."""
        keys = looked.value[0]
        if not len(keys):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        place = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return place, keys[place] == pairs

    def sums(batches):
        _, n, best = looked.value
        for part in chain.from_iterable(map(lambda b: slices(b, 1024), batches)):
            lists, times = part.column("pairs"), part.column("times").flatten().to_numpy()
            place, hit = known(lists.flatten().to_numpy())
            per_pair = np.zeros((2, len(place) + 1), np.int64)
            if hit.any():
                per_pair[0, 1:][hit] = times[hit] * best[place[hit]]
                per_pair[1, 1:][hit] = times[hit] * n[place[hit]]
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            totals = np.diff(np.cumsum(per_pair, axis=1)[:, bounds], axis=1)
            thin = [part.column(c) for c in ("row", *_FOUND)]
            yield pa.RecordBatch.from_arrays([*thin, pa.array(totals[0]), pa.array(totals[1])], ["row", *_FOUND, "n_best", "count_sum"])

    def others(batches):
        for part in chain.from_iterable(map(lambda b: slices(b, 1024), batches)):
            lists, pairs, times = part.column(1), part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
            rows = np.repeat(part.column(0).to_numpy(), pc.list_value_length(lists).to_numpy())
            miss = ~known(pairs)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x[miss]) for x in (rows, pairs, times)], ["row", "pair", "times"])

    thin = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = swept.mapInArrow(sums, thin)
    if not rare.isEmpty():
        links = swept.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long")
        more = links.join(rare, "pair").select(
            "row", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in thin.split(", ")[1:7])],
            F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"),
        )
        firsts = [F.max(c).alias(c) for c in _FOUND]  # all but one row of each are null
        out = out.unionByName(more).groupBy("row").agg(*firsts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _shared(docs: DataFrame, *files):
    """The tokenizers' files, whose size doesn't depend on the input, for all tasks; and their name."""
    name = hashlib.blake2b(b"".join(f.encode() if isinstance(f, str) else f for f in files)).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(files), f"alignment {name}"


def links(docs: DataFrame, file_a: bytes, file_b: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, times): which ids are linked in each row, and how often."""
    files, token = _shared(docs, file_a, file_b, pattern)
    swept = sweep(events(docs, files, token, id_col, text_col), files, token)
    each = swept.select("doc_id", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return each.select("doc_id", F.shiftright("x.pairs", 32).cast("int").alias("a"), F.col("x.pairs").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), F.col("x.times").alias("times"))
