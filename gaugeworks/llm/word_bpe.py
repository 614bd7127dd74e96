"""BPE encoding and decoding of words with a lexicon automaton.

All texts are counted first: words (pieces of the pre-tokeniser, in lower case) by how often they stand anywhere. The most
frequent ones, ``LEXICON_WORDS`` at most, are merged on the driver and compiled into a minimal acyclic transducer
(:mod:`.transducer`) whose outputs are the ids. It lies in the shared folder, is brought to every executor as a file and
mapped into memory there. Encoding looks up the distinct words of some texts side by side; words that the lexicon hasn't
got are merged exactly, pair by pair. What the lexicon holds changes the time only, never the ids.

White space is in no piece and no special token, so texts fall at white space into parts that have their ids on their own.

Defined results
---------------
* A null text is the empty text: no ids, and decoded the empty text.
* As in the library, the strings of special tokens within a text become those tokens.
* Each row is encoded on its own, whatever its id. Texts and words are taken whole, however long. Pairs of equal rank
  merge from the left; words of about equal frequency enter the lexicon together or not at all.
* Decoding joins the tokens' strings by one space. Null ids decode to the empty text, ids that are no token to null.
* Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .byte_bpe import chunks
from .common import shared_folder, slices, worker_state, written
from .token_alignment import byte_letters
from .transducer import Lexicon, compile_lexicon

#: Words in the lexicon at most, which bounds what the driver compiles and every executor holds.
LEXICON_WORDS = 1 << 17
#: Distinct parts a task counts before it hands them on.
COUNTED_PARTS = 200_000
#: Characters that are encoded together.
CHUNK_CHARS = 1 << 23
#: Unseen words whose ids a task keeps; it starts anew when they are more.
UNSEEN_WORDS = 300_000
#: Longer words are merged one by one with a heap, the others together.
LONG_WORD = 48
#: Pieces of printable ASCII, and of Latin letters with marks, which composing leaves as they are; the file's own
#: pre-tokeniser takes all else.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\u024f]+")
_SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Python takes these for white space, Unicode and the library don't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def split_parts(text: str) -> list[str]:
    """What stands between white space."""
    if text.isascii() and text.isprintable() or not any(c in text for c in _SEPARATORS):
        return text.split()
    return regex.findall(r"\S+", text)


class WordBpe:
    """A BPE of words with an end mark, from the JSON file of a tokenizer."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        special = spec["added_tokens"]
        if model["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in special):
            raise ValueError("a BPE whose special tokens stand for themselves is needed")
        self.suffix, self.vocabulary = suffix, vocabulary
        self.special = {t["content"]: t["id"] for t in special}
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.special_mark = os.path.commonprefix(list(self.special))
        self.tokens: list[str | None] = [None] * (max(chain(vocabulary.values(), self.special.values())) + 1)
        for token, number in chain(vocabulary.items(), self.special.items()):
            self.tokens[number] = token
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {}  # of each pair of ids that can merge
        merged = []  # what the merge of each rank gives
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocabulary[a] << 32 | vocabulary[b]] = rank
            merged.append(vocabulary[a + b])
        self.merged = np.array(merged, np.int64)
        keys = np.array(list(self.ranks), np.int64)
        self.by_key = np.argsort(keys)  # ranks by their pairs
        self.keys = keys[self.by_key]
        points = max((ord(t) for t in vocabulary if len(t) == 1), default=0) + 1
        self.letter, self.last = (np.array([vocabulary.get(chr(c) + end, -1) for c in range(points)], np.int64) for end in ("", suffix))
        theirs = Tokenizer.from_str(file.decode())
        self.normalizer, self.pre_tokenizer = theirs.normalizer, theirs.pre_tokenizer
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.known_split = split["pattern"].get("Regex") == _SPLITS
        self.pieces = regex.compile(_SPLITS)
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.unseen: dict[str, bytes] = {}

    def words(self, part: str) -> list[str | int]:
        """The words of a part, spelled in the vocabulary's letters; a special token is its id."""
        if part.isascii() and part.isalpha() and self.known_split:
            return [part.lower()]
        if self.special_mark in part and self.special_split.search(part):
            out: list[str | int] = []
            at = 0
            for found in self.special_split.finditer(part):
                out += self.words(part[at : found.start()]) if found.start() > at else []
                out.append(self.special[found.group()])
                at = found.end()
            return out + (self.words(part[at:]) if at < len(part) else [])
        if self.known_split and part.isascii() and part.isprintable():
            return _PIECES.findall(part.lower())
        if self.known_split and _LATIN.fullmatch(part):
            return [w.encode().decode("latin-1").translate(self.letters) for w in self.pieces.findall(part.lower())]
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word: its pair of lowest rank merges, the leftmost of several, until no pair can."""
        out = dict.fromkeys(words)
        short = [w for w in out if len(w) <= LONG_WORD]
        ids, bounds = self._merge_short(short)
        raw, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        for word, a, b in zip(short, bounds, bounds[1:]):
            out[word] = raw[a:b]
        for word, ids in out.items():
            if ids is None:
                letters = [*word[:-1], word[-1] + self.suffix]
                out[word] = np.array(self._merge_long(list(map(self.vocabulary.__getitem__, letters))), "<u4").tobytes()
        return list(out.values())

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; that of no merge is larger than all."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], len(self.keys))

    def _merge_short(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words; in every round each word that still can merges one pair."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ids = self.letter[points]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[points[ends]]
        if len(ids) and ids.min() < 0:
            raise ValueError("a letter is in no token")
        owner, none = np.repeat(np.arange(len(words)), sizes), len(self.keys)
        rank = np.full(len(ids), none)  # of each element's merge with the next one
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        done = []
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            going = best >> 32 < none
            stay = np.repeat(~going, np.diff(first, append=len(ids)))
            done.append((owner[stay], ids[stay]))
            left = best[going] & 0xFFFFFFFF
            ids[left] = self.merged[rank[left]]
            keep = ~stay
            keep[left + 1] = False
            place = np.cumsum(keep) - 1
            left = place[left]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            # the merged element's pairs with its neighbours are new
            at = np.concatenate([left[left > 0] - 1, left])
            rank[at] = none
            at = at[at + 1 < len(ids)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self._rank(ids[at], ids[at + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done)) if done else (ids, ids)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same of one word with a heap of (rank, place)."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get(ids[k] << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def word_ids(self, words: list[str], lexicon: Lexicon | None) -> dict[str, bytes]:
        """The ids of distinct words."""
        if len(self.unseen) > UNSEEN_WORDS:
            self.unseen = {}
        out = {}
        if lexicon:
            found, numbers, bounds = lexicon.look_up([w.encode() for w in words])
            raw, bounds = numbers.astype("<u4").tobytes(), (4 * bounds).tolist()
            for word, ok, a, b in zip(words, found.tolist(), bounds, bounds[1:]):
                if ok:
                    out[word] = raw[a:b]
        missing = [w for w in words if w not in out]
        new = [w for w in missing if w not in self.unseen]
        self.unseen.update(zip(new, self.merge(new)))
        out.update(zip(missing, map(self.unseen.__getitem__, missing)))
        return out

    def encode(self, texts: list[str], lexicon: Lexicon | None = None) -> list[np.ndarray]:
        """The ids of every text."""
        parts = [split_parts(t) for t in texts]
        words = {part: self.words(part) for part in set(chain.from_iterable(parts))}
        known: dict[str | int, bytes] = {i: i.to_bytes(4, "little") for i in self.special.values()}
        known.update(self.word_ids(list({w for ws in words.values() for w in ws if isinstance(w, str)}), lexicon))
        raw = {part: known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws)) for part, ws in words.items()}
        return [np.frombuffer(b"".join(map(raw.__getitem__, p)), "<u4") for p in parts]

    def decode(self, ids) -> str | None:
        """The tokens' strings joined by a space; None where an id is no token."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if ids and not 0 <= min(ids) <= max(ids) < len(self.tokens):
            return None
        tokens = list(map(self.tokens.__getitem__, ids))
        return None if None in tokens else " ".join(tokens)


def _token(kind: str, file: bytes) -> str:
    return f"{kind} {hashlib.blake2b(file).hexdigest()}"


def word_counts(docs: DataFrame, file: bytes, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word stands in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(file)  # its size doesn't depend on the input
    token = _token("word bpe", file)

    def counted(bpe: WordBpe, parts: Counter) -> pa.RecordBatch:
        words: Counter = Counter()
        for part, n in parts.items():
            for word in bpe.words(part):
                if isinstance(word, str):
                    words[word] += n
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

    def run(batches):
        bpe = worker_state(token, lambda: WordBpe(shared.value))
        gc.disable()
        parts: Counter = Counter()
        for part in chain.from_iterable(map(slices, batches)):
            parts.update(chain.from_iterable(split_parts(t or "") for t in part.column(0).to_pylist()))
            if len(parts) > COUNTED_PARTS:
                yield counted(bpe, parts)
                parts = Counter()
        yield counted(bpe, parts)

    found = docs.select(docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_block(docs: DataFrame, file: bytes, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words of ``docs``.

    Words are put into classes of about equal frequency, eight to a doubling; the most frequent classes that have no more
    than ``words`` words together are taken, so no more than these reach the driver, from however many tasks.
    """
    counts = written(word_counts(docs, file, text_col), "word-counts")
    level = F.floor(F.log2("n") * 8)
    room, least = words, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 512 rows at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r.level
    found = [] if least is None else [r.word for r in counts.where(level >= least).select("word").collect()]
    return compile_lexicon((w.encode(), tuple(np.frombuffer(ids, "<u4").tolist())) for w, ids in zip(found, WordBpe(file).merge(found)))


def share_file(spark: SparkSession, name: str, block: bytes) -> str:
    """Writes a file of bounded size into the shared folder and has every executor fetch it; gives its name there."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(block))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(docs: DataFrame, file: bytes, per_text, schema: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, and what ``per_text(bpe, ids)`` gives, by ``schema``) of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(file)
    lexicon = share_file(spark, "lexicon", lexicon_block(docs, file, text_col, words))
    token = _token("word bpe", file)

    def run(batches):
        bpe, mapped = worker_state(f"{token} {lexicon}", lambda: (WordBpe(shared.value), Lexicon.mapped(SparkFiles.get(lexicon))))
        gc.disable()  # no cycles are made, and each collection would walk what is held
        for part in chain.from_iterable(map(lambda b: slices(b, 4096), batches)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for a, b in chunks(texts, CHUNK_CHARS):
                rows = [per_text(bpe, ids) for ids in bpe.encode(texts[a:b], mapped)]
                columns = [part.column(0).slice(a, b - a), *map(pa.array, zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = to_arrow_schema(StructType.fromDDL(schema))
    names, kinds = ["doc_id", *shape.names], shape.types
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def with_ids(docs: DataFrame, file: bytes, **options) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    return encode(docs, file, lambda _, ids: (ids,), "ids array<long>", **options)


def decode(tokens: DataFrame, file: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the decoded text of every row of ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(file)
    token = _token("word bpe", file)

    def run(batches):
        bpe = worker_state(token, lambda: WordBpe(shared.value))
        for part in chain.from_iterable(map(slices, batches)):
            texts = [bpe.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select(tokens[f"`{id_col}`"].cast("long").alias("doc_id"), tokens[f"`{ids_col}`"].cast("array<long>"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, file: bytes, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def digest(bpe: WordBpe, ids: np.ndarray):
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return encode(docs, file, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", **options)
