"""Removing repeated byte strings with suffix arrays of shards.

A byte goes when a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller doc_id.

Shards are made so that equal strings meet. In every string of ``LENGTH`` bytes the 16 bytes with the least
hash (leftmost on ties) are its anchor, which depends on the string alone. Neighbouring strings share an
anchor; together they are a passage. Documents are packed into chunks; the anchors of each chunk are shuffled
by hash, and those that stand in one document only are dropped. The passages of the others are told apart by
their hashes, with the smallest doc_id that holds each: larger ids lose a passage whole. Where passages of an anchor
agree on enough bytes around it to share a string, one copy of each is dealt out by anchor, and each shard sorts the
suffixes of its passages by induced sorting: runs with permuted common prefixes of ``LENGTH`` or more are equal strings,
and the smallest doc_id of a run decides. The decisions go back to the chunks, which remove what they cover.

No shard has to hold an anchor: its passages are dealt into parts of about ``PART_PASSAGES``, each part is sorted on
its own, and the parts of one anchor are merged as sorted runs are: the strings that no other of their part precedes
meet by hash, and the smallest id of all parts decides. An anchor that stands in more than ``HOT_DOCS`` documents is
dealt out by passage before anything is done with its rows. Only the first exchange is by bare anchor; it has one row
for each chunk (``CHUNK_BYTES`` of text) and anchor.

Defined results
---------------
* A null text is the empty text. Matches never cross documents, and rows with one doc_id don't match each
  other (no doc_id is smaller). A null doc_id is smaller than any other.
* Strings are judged on the input. Texts shorter than ``LENGTH`` bytes keep everything.
* Each row gives one row, extra columns are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, forget_state, ordered_id, shared_folder, slices, written
from .minhash_dedup import mix64
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 50
ANCHOR = 16
#: A string is its anchor and 34 bytes more. However they are split, it holds one of these (bytes before, bytes after).
AROUND = ((0, 23), (12, 11), (23, 0))
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 1 << 18
#: At most some 85 bytes each, so a part has 2 MB.
PART_PASSAGES = 20_000
HOT_DOCS, HOT_PARTS = 200_000, 1024
#: Strings that are looked at together.
BLOCK = 1 << 16
#: 48 bits of an anchor's hash are shuffled; passages that share them by chance are told apart later.
_SHORT = np.uint64(16)
_PRIME = np.uint64(0x100000001B3)
_LOW, _SEED = np.uint32((1 << 17) - 1), np.uint64(0x9E3779B97F4A7C15)


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``LENGTH`` bytes of the data its anchor's place (in the low bits); for each place a hash."""
    word = data.astype(np.uint64)
    for width in (1, 2, 4):  # eight bytes from each place on
        word = word[:-width] | word[width:] << np.uint64(8 * width)
    hashes = mix64(word[:-8] * _PRIME ^ word[8:] * _SEED)
    # 15 bits of the hash, then the place, which is below 2**17 in a block
    least = (hashes >> np.uint64(49)).astype(np.uint32) << np.uint32(17) | np.arange(len(hashes), dtype=np.uint32)
    width, done = LENGTH - ANCHOR + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least, hashes


def passages(data: np.ndarray, bounds: np.ndarray):
    """(document, first string, last string, anchor, its place) of every passage of texts that lie end to end.

    The data are walked in blocks that fit the processor's cache. A passage may be cut at a block's end; its
    strings still have the same anchor.
    """
    none = np.zeros(0, np.int64)
    found = [(none,) * 5]
    edges = np.unique(np.concatenate([bounds, bounds - LENGTH + 1]))
    for start in range(0, len(data) - LENGTH + 1, BLOCK):
        least, hashes = _anchors(data[start : start + BLOCK + LENGTH - 1])
        inside = edges[np.searchsorted(edges, start + 1) : np.searchsorted(edges, start + len(least))] - start
        change = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=change[1:])
        change[inside] = True
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(least)) - 1
        doc = np.searchsorted(bounds, first + start, side="right") - 1
        whole = first + start + LENGTH <= bounds[doc + 1]
        doc, first, last = doc[whole], first[whole], last[whole]
        at = (least[first] & _LOW).astype(np.int64)
        found.append((doc, first + start, last + start, (hashes[at] >> _SHORT).astype(np.int64), at + start))
    return tuple(map(np.concatenate, zip(*found)))


def _pack(ids: list[int], texts: list[bytes], number: int):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = b"".join(texts)
    doc, _, _, anchors, _ = passages(np.frombuffer(raw, np.uint8), bounds)
    if len(ids) < 1 << 15:
        both = np.sort(anchors << 15 | doc)
        anchors, doc = both >> 15, both & 0x7FFF
    else:
        order = np.lexsort((doc, anchors))
        anchors, doc = anchors[order], doc[order]
    first = np.flatnonzero(np.diff(anchors, prepend=-1) != 0)
    twice = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    found = anchors[first]
    # an upper bound of the documents that hold each
    held = np.minimum(np.diff(first, append=len(anchors)), _MOST_DOCS)[twice]
    chunk = (TaskContext.get().partitionId() << 20) + number
    several = [{"anchor": a, "docs": n} for a, n in zip(found[twice].tolist(), held.tolist())]
    return chunk, ids, bounds.astype(np.int64), zstandard.ZstdCompressor(2).compress(raw), found[~twice], several


_CHUNK = "chunk long, ids array<long>, bounds array<long>, data binary, once array<long>, twice array<struct<anchor:long,docs:int>>"
_MOST_DOCS, _SIDE_BITS = (1 << 15) - 1, 21


def chunked(rows: DataFrame) -> DataFrame:
    """(id, text) rows packed into chunks, with their anchors."""

    def run(batches):
        ids, texts, size, number = [], [], 0, 0

        def out():
            values = _pack(ids, texts, number)
            longs = pa.list_(pa.int64())
            types = (pa.int64(), longs, longs, pa.binary(), longs, pa.list_(pa.struct([("anchor", pa.int64()), ("docs", pa.int32())])))
            arrays = [pa.array([v], t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "bounds", "data", "once", "twice"])

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(id_)
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield out()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield out()

    return rows.select("id", "text").mapInArrow(run, _CHUNK)


def _opened(batch: pa.RecordBatch):
    """Each chunk's ids, bounds, bytes and last column."""
    for i in range(batch.num_rows):
        ids, bounds = (batch.column(j)[i].values.to_numpy() for j in (1, 2))
        yield batch.column(0)[i].as_py(), ids, bounds, zstandard.ZstdDecompressor().decompress(batch.column(3)[i].as_py()), batch.column(4)[i]


def _sid(passage: bytes) -> int:
    """With the anchor, 128 bits that stand for a passage."""
    return int.from_bytes(hashlib.blake2b(passage, digest_size=8).digest(), "little", signed=True)


def _context(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A number below 2**21 for the ``size`` bytes from each place on, never 0 (of no use where they aren't all in the data)."""
    padded = np.zeros((len(start), -(-size // 8) * 8), np.uint8)
    if len(data) >= size:
        padded[:, :size] = np.lib.stride_tricks.sliding_window_view(data, size)[np.clip(start, 0, len(data) - size)]
    out = np.full(len(start), size, np.uint64)
    for word in padded.view(np.uint64).T:
        out = mix64(out * _SEED ^ word)
    return (out >> np.uint64(64 - _SIDE_BITS)).astype(np.int64) | 1


def located(chunks: DataFrame) -> DataFrame:
    """(anchor, salt, sid, chunk, least, most, place, around): each chunk's passages at anchors that repeat (its
    last column), with the smallest and the largest id that holds them there and where one of them starts (and its
    length). ``salt`` is 0, or at a hot anchor a number from 1 on that the passage decides.

    ``around`` has 21 bits for each of ``AROUND``: a hash of these bytes if the passage holds them, else 0.
    Passages that share a string agree on one of the hashes.
    """
    names = ["anchor", "salt", "sid", "chunk", "least", "most", "place", "around"]

    def run(batches):
        forget_state()
        for batch in batches:
            for chunk, ids, bounds, raw, repeated in _opened(batch):
                data = np.frombuffer(raw, np.uint8)
                doc, first, last, anchors, places = passages(data, bounds)
                known = repeated.values.field("anchor").to_numpy()
                at = np.flatnonzero(np.isin(anchors, known))
                hot = np.isin(anchors, known[repeated.values.field("hot").to_numpy(zero_copy_only=False)])
                found: dict[bytes, list] = {}
                rows = zip(at.tolist(), first[at].tolist(), (last[at] + LENGTH).tolist(), ids[doc[at]].tolist())
                for i, a, b, id_ in rows:
                    passage = raw[a:b]
                    seen = found.get(passage)
                    if seen is None:
                        found[passage] = [i, id_, id_]
                    elif id_ < seen[1]:
                        seen[1] = id_
                    elif id_ > seen[2]:
                        seen[2] = id_
                at, least, most = (np.array(x, np.int64) for x in zip(*found.values())) if found else (np.zeros(0, np.int64),) * 3
                place, sids = places[at], np.array(list(map(_sid, found)), np.int64)
                around = np.zeros(len(at), np.int64)
                for k, (before, after) in enumerate(AROUND):
                    whole = (first[at] <= place - before) & (place + ANCHOR + after <= last[at] + LENGTH)
                    around |= np.where(whole, _context(data, place - before, before + ANCHOR + after), 0) << _SIDE_BITS * k
                salt = np.where(hot[at], 1 + sids % HOT_PARTS, 0)
                columns = [anchors[at], salt, sids, np.full(len(at), chunk), least, most, first[at] << 8 | (last - first)[at] + LENGTH]
                columns.append(around)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return chunks.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def quoted(chunks: DataFrame) -> DataFrame:
    """(anchor, salt, part, several, sid, passage, least): the bytes of the passages that the last column asks for."""
    same = ["anchor", "salt", "part", "several", "sid"]

    def run(batches):
        for batch in batches:
            for _, _, _, raw, asked in _opened(batch):
                texts = [raw[p >> 8 : (p >> 8) + (p & 0xFF)] for p in asked.values.field("place").to_pylist()]
                values = [*map(asked.values.field, same), pa.array(texts, pa.binary()), asked.values.field("least")]
                yield pa.RecordBatch.from_arrays(values, [*same, "passage", "least"])

    return chunks.mapInArrow(run, "anchor long, salt long, part long, several boolean, sid long, passage binary, least long")


def _decisions(values) -> dict[tuple[int, int], tuple[int, int]]:
    """(least, mask) by (anchor, sid); the rows of a passage have its mask between them."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for h, sid, least, mask in zip(*(values.field(x).to_numpy().tolist() for x in ("anchor", "sid", "least", "mask"))):
        out[h, sid] = least, mask | out.get((h, sid), (0, 0))[1]
    return out


def shard_strings(texts: list[bytes], least: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """For each passage of a shard, bit i: its i-th string also stands in a passage of a smaller id. And the
    (passage, i) of the strings of which that is not so."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 2
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    data[starts + sizes] = 1
    data = np.append(data, 0)
    array = suffix_array(data)
    prefix = permuted_prefixes(data, array, starts, LENGTH)[array]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    runs = np.flatnonzero(prefix < LENGTH)
    in_text = array < len(data) - 1
    ids = np.where(in_text, least[owner[np.minimum(array, len(owner) - 1)]], np.iinfo(np.int64).max)
    smallest = np.repeat(np.minimum.reduceat(ids, runs), np.diff(runs, append=len(array)))

    def strings(hit):
        place = hit - starts[owner[hit]]
        fits = place <= sizes[owner[hit]] - LENGTH
        return zip(owner[hit[fits]].tolist(), place[fits].tolist())

    masks = [0] * len(texts)
    for i, j in strings(array[smallest < ids]):
        masks[i] |= 1 << j
    return masks, strings(array[(smallest == ids) & in_text])


_GROUP = ["anchor", "salt", "part"]


def sorted_shards(rows: DataFrame) -> DataFrame:
    """(anchor, sid, least, mask, string, place) of :func:`quoted` rows whose groups lie together. ``mask``: the strings
    of a passage that also stand in one of a smaller id. Where an anchor has several parts, also a row without a mask
    for each string that no other precedes: its hash and its place in the passage."""

    def run(batches):
        def sort(part):
            masks, heads = shard_strings([r[5] for r in part], np.array([r[6] for r in part], np.int64))
            out = [(r[0], r[4], r[6], m, None, None) for r, m in zip(part, masks) if m]
            for i, j in heads:
                r = part[i]
                if r[3]:
                    out.append((r[0], r[4], r[6], None, _sid(r[5][j : j + LENGTH]), j))
            columns = [pa.array(v, pa.int64()) for v in zip(*out)] or [pa.array([], pa.int64())] * 6
            return pa.RecordBatch.from_arrays(columns, ["anchor", "sid", "least", "mask", "string", "place"])

        part, size = [], 0
        for batch in chain.from_iterable(map(slices, batches)):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[:3] != part[-1][:3]:
                    yield sort(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[5])
        if part:
            yield sort(part)

    columns = [*_GROUP, "several", "sid", "passage", "least"]
    return rows.select(columns).mapInArrow(run, "anchor long, sid long, least long, mask long, string long, place long")


def merged_parts(heads: DataFrame) -> DataFrame:
    """(anchor, sid, mask) of the strings of which another part of their anchor holds a smaller id."""
    string = ["anchor", "string"]
    smallest = heads.groupBy(*string).agg(F.min("least").alias("smallest"), F.max("least").alias("largest")).where("smallest < largest")
    hit = heads.join(smallest.hint("merge"), string).where("smallest < least")
    return hit.groupBy("anchor", "sid").agg(F.expr("bit_or(shiftleft(1L, cast(place as int)))").alias("mask"))


def removed(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every text of the chunks, by the decisions in the last column."""

    def run(batches):
        for batch in batches:
            for _, ids, bounds, raw, decisions in _opened(batch):
                data = np.frombuffer(raw, np.uint8)
                cover = np.zeros(len(data) + 1, np.int32)
                values = decisions.values
                if values is not None and len(values):
                    known = _decisions(values)
                    doc, first, last, anchors, _ = passages(data, bounds)
                    at = np.flatnonzero(np.isin(anchors, values.field("anchor").to_numpy()))
                    starts, ends = [], []
                    for a, b, id_, h in zip(first[at].tolist(), last[at].tolist(), ids[doc[at]].tolist(), anchors[at].tolist()):
                        decision = known.get((h, _sid(raw[a : b + LENGTH])))
                        if decision is None:
                            continue
                        if id_ > decision[0]:
                            starts.append(a)
                            ends.append(b + LENGTH)
                        elif decision[1]:
                            hits = [a + i for i in range(b - a + 1) if decision[1] >> i & 1]
                            starts += hits
                            ends += [h + LENGTH for h in hits]
                    np.add.at(cover, np.array(starts, np.int64), 1)
                    np.add.at(cover, np.array(ends, np.int64), -1)
                gone = np.cumsum(cover)[:-1] > 0
                out = defaultdict(list)
                for i, id_ in enumerate(ids.tolist()):
                    here = gone[bounds[i] : bounds[i + 1]]
                    out["doc_id"].append(None if id_ == NO_ID else id_)
                    out["n_bytes"].append(len(here))
                    out["n_removed"].append(int(here.sum()))
                    out["n_spans"].append(int((np.diff(here.astype(np.int8), prepend=0) == 1).sum()))
                    out["kept"].append(data[bounds[i] : bounds[i + 1]][~here].tobytes())
                types = {"kept": pa.binary()}
                for a in range(0, len(ids), 512):
                    columns = [pa.array(v[a : a + 512], types.get(k, pa.int64())) for k, v in out.items()]
                    yield pa.RecordBatch.from_arrays(columns, list(out))

    return chunks.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_passages: int = PART_PASSAGES, hot_docs: int = HOT_DOCS
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of ``docs``; ``kept`` is what stays, as bytes."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"chunks_{uuid.uuid4().hex}"
    packed = chunked(docs.select(ordered_id(id_col).alias("id"), F.col(text_col).alias("text")))
    # bucketed by chunk where they are made: both joins by chunk leave these bytes where they lie
    packed.write.bucketBy(partitions, "chunk").sortBy("chunk").option("compression", "zstd").option(
        "path", f"{shared_folder(spark)}/{name}"
    ).saveAsTable(name)
    chunks = spark.table(name)
    # the chunk and, in the low 15 bits, how many of its documents hold the anchor
    held = chunks.select(F.explode("once").alias("anchor"), (F.shiftleft("chunk", 15) + 1).alias("tag")).unionByName(
        chunks.select(F.explode("twice").alias("t"), "chunk").select("t.anchor", (F.shiftleft("chunk", 15) + F.col("t.docs")).alias("tag"))
    )
    # one row for each chunk and anchor, so a window holds no more rows than there are chunks
    docs_of = F.sum(F.col("tag").bitwiseAND(F.lit(_MOST_DOCS))).over(Window.partitionBy("anchor"))
    per_chunk = (
        held.withColumn("docs", docs_of)
        .where("docs > 1")
        .groupBy(F.shiftright("tag", 15).alias("chunk"))
        .agg(F.collect_list(F.struct("anchor", (F.col("docs") > hot_docs).alias("hot"))).alias("repeated"))
    )
    data = chunks.select("chunk", "ids", "bounds", "data")
    at = located(data.join(per_chunk.hint("merge"), "chunk")).repartition(partitions, "anchor", "salt")
    group, same = ["anchor", "salt"], Window.partitionBy("anchor", "salt", "sid")
    # the passages of a hot anchor are in several groups and count as near
    near = F.col("salt") > 0
    for k in range(len(AROUND)):
        side = F.shiftright("around", _SIDE_BITS * k).bitwiseAND(F.lit((1 << _SIDE_BITS) - 1))
        beside = Window.partitionBy(*group, side)
        near = near | ((side > 0) & (F.min("sid").over(beside) != F.max("sid").over(beside)))
    # each passage is quoted by one chunk: the first that holds its least id
    home, is_home = F.col("home"), F.col("chunk") == F.col("home.chunk")
    found = (
        at.withColumn("near", near)
        .withColumn("most", F.max("most").over(same))
        .withColumn("home", F.min(F.struct("least", "chunk")).over(same))
        .where("near or most > home.least")
        .withColumn("n", F.sum((is_home & F.col("near")).cast("long")).over(Window.partitionBy(*group)))
        .select(
            "anchor", "sid", "chunk", home["least"].alias("least"),
            (F.col("most") > home["least"]).alias("later"),
            (F.col("near") & (F.col("least") == home["least"])).alias("at_least"),
            F.when(F.col("near") & is_home, F.struct("salt", "place", "n")).alias("quote"),
        )
    )
    found = written(found, "passages")
    parts = F.ceil(F.col("n") / part_passages)
    part = F.pmod(F.xxhash64("sid"), parts).alias("part")
    several = ((F.col("salt") > 0) | (parts > 1)).alias("several")
    asked = found.where("quote is not null").select("chunk", "anchor", "sid", "least", "quote.*")
    asked = asked.select("chunk", F.struct(*group, part, several, "sid", "least", "place").alias("q"))
    asked = asked.groupBy("chunk").agg(F.collect_list("q").alias("asked"))
    quotes = quoted(data.join(asked.hint("merge"), "chunk"))
    shards = written(sorted_shards(quotes.repartition(partitions, *_GROUP).sortWithinPartitions(*_GROUP)), "masks")
    masks = shards.where("mask is not null").select("anchor", "sid", "mask").unionByName(merged_parts(shards.where("string is not null")))
    # a mask concerns rows of the least id only, so it goes to the chunks that hold that id
    marked = found.where("at_least").select("anchor", "sid", "chunk", "least").join(masks.hint("merge"), ["anchor", "sid"])
    whole = found.where("later").select("anchor", "sid", "chunk", "least", F.lit(0).cast("long").alias("mask"))
    back = (
        whole.unionByName(marked.select(*whole.columns))
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("anchor", "sid", "least", "mask")).alias("decisions"))
    )
    return removed(data.join(back.hint("merge"), "chunk", "left"))
