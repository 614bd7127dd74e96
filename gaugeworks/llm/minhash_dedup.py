"""Near-dedup by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Shingles are runs of five words (lower case, split at white space), hashed to 64 bits. A shingle's weight
is its count in the document times its IDF; document frequencies are counted over all documents in
``DF_BUCKETS`` hash buckets, so that table has a fixed size. ICWS draws ``BANDS * ROWS`` samples whose
chance to agree is the weighted Jaccard similarity; each band of samples is a bucket key.

Documents with the same shingles and counts (copies) are taken together first: one stands for all. Within a
bucket of at most ``ALL_PAIRS`` stand-ins every pair is a candidate; in a larger one each is paired with the
bucket's leader and with its neighbour when sorted by the next band, so pairs grow with the bucket, not with
its square. A bucket that holds a thousandth of all rows is dealt out to several tasks, each of which pairs
its members with the leader of all and with neighbours. Candidates are verified by exact weighted Jaccard
similarity. Classes are the connected components of verified pairs, found by minimum labels over links and
shortcuts through labels, by digests that have links only; links found later join classes, not documents; minima are partly taken before a shuffle, and the joins by label and by linked document have
one row on one side, so adaptive execution can split a large class or a document with many links. Then larger buckets that still span several classes are looked at again: ``ROUNDS``
times neighbours of different classes are verified, which is cheap and joins most; at last every pair of members
of different classes is, block by block (:func:`open_links`), so no link within a bucket is missed.

Defined results
---------------
* A text of one to four words is one shingle; texts without words (null or empty) are alike to none and
  each is a class of its own.
* Two documents are linked when their similarity is ``THRESHOLD`` or more. The class id is the smallest
  doc_id of the class; a null doc_id is smaller than any other (its class id is null).
* An empty table gives an empty result.
* Repeated rows are copies of each other. Ties between samples go to the smallest shingle hash.
* Whole texts are used, however long. Extra columns are left out of :func:`near_dedup`.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, SPACES, forget_state, ordered_id, slices, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
DF_BUCKETS = 1 << 17
#: How much more a rare shingle weighs than one in every document, and from which share of the documents on it is rare.
IDF_RANGE, RARE_SHARE = 0.5, 1e-3
#: Largest bucket in which every pair of stand-ins is a candidate.
ALL_PAIRS = 16
#: A bucket of so many stand-ins, or of a thousandth of all rows if that is more, is dealt out to several tasks.
HEAVY_ROWS = 128
#: Later looks at neighbours in buckets that span several classes, before all their pairs are compared.
ROUNDS = 2
#: Neighbours of another class that a later look pairs each member with.
REACH = 3
#: Members of a block where all pairs of a bucket are compared, and shingles of it compared at once.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 4096
SEED = 7
CHUNK_BYTES = 1 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and how many each text has."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(np.diff(blank, prepend=True))  # a word's first byte, the byte after its last, ...
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.array([len(p) + 1 for p in parts])
    doc_ends = np.cumsum(lengths)
    doc = np.searchsorted(doc_ends, starts, side="right")
    size = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    word = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    per_doc = np.bincount(doc, minlength=len(texts))
    count = np.where(per_doc > 0, np.maximum(per_doc - words + 1, 1), 0)
    first = np.repeat(np.cumsum(per_doc) - per_doc, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    last = np.repeat(np.cumsum(per_doc), count)
    out = np.zeros(len(first), np.uint64)
    for j in range(words):
        at = np.minimum(first + j, len(word) - 1)
        out += np.where(first + j < last, mix64(word[at] + np.uint64((j + 1) * int(_BASE) % 2**64)), np.uint64(0))
    return mix64(out), count


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, their counts, and how many distinct ones each text has."""
    hashes, count = shingles(texts)
    doc = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(at, append=len(hashes)), np.bincount(doc[at], minlength=len(texts))


def text_chunks(texts: list[str], limit: int = CHUNK_BYTES):
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@lru_cache(1)
def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) variates and their logarithms at 65,536 quantiles: the inverse of 1 - (1 + x) exp(-x)."""
    u = (np.arange(65536) + 0.5) / 65536
    x = np.maximum(np.sqrt(2 * u), 1e-6)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def icws(hashes: np.ndarray, log_weights: np.ndarray, sizes: np.ndarray, samples: int, seed: int = SEED) -> np.ndarray:
    """(texts with shingles, samples) of 64-bit samples. Equal samples: the same shingle at the same level."""
    gamma, log_gamma = _gamma_tables()
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    of = np.repeat(np.arange(len(starts)), sizes[sizes > 0])
    log_weights = log_weights.astype(np.float32)
    out = np.empty((len(starts), samples), np.uint64)
    for k in range(samples):
        bits = mix64(hashes + np.uint64((seed * 1000 + k + 1) * int(_BASE) % 2**64))
        r = gamma[(bits & np.uint64(0xFFFF)).astype(np.intp)]
        log_c = log_gamma[((bits >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)]
        beta = ((bits >> np.uint64(40)).astype(np.float32)) * np.float32(2.0**-24)
        level = np.floor(log_weights / r + beta)
        log_a = log_c - r * (level - beta) - r
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == least[of])
        first = at[np.flatnonzero(np.diff(of[at], prepend=-1))]
        out[:, k] = mix64(hashes[first] + level[first].astype(np.int64).astype(np.uint64) * _MIX1)
    return out


def idf_table(counts: np.ndarray, total: int) -> np.ndarray:
    """IDF by bucket of document frequency: 1 for a shingle that stands everywhere, rising with the logarithm to
    ``1 + IDF_RANGE`` for those in ``RARE_SHARE`` of the documents or fewer.

    What rare shingles put into every bucket alike is taken off, so weights don't depend on the size of the table. The
    range has an end so that near copies stay similar however many of them there are: what they share becomes frequent."""
    frequent = np.maximum(counts - np.median(counts), max(1.0, RARE_SHARE * total))
    return 1 + IDF_RANGE * np.clip(np.log(max(total, 1) / frequent) / -np.log(RARE_SHARE), 0, 1)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many (document, shingle) pairs each of the buckets has, and the number of documents with words."""

    def run(batches):
        forget_state()
        counts, total = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in chain.from_iterable(map(slices, batches)):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in text_chunks(texts):
                hashes, _, sizes = bags(texts[a:b])
                counts += np.bincount((hashes % np.uint64(DF_BUCKETS)).astype(np.intp), minlength=DF_BUCKETS)
                total += int((sizes > 0).sum())
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, DF_BUCKETS), pa.int32()), pa.array(np.append(counts[at], total), pa.int64())], ["bucket", "n"]
        )

    summed = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(DF_BUCKETS), 0
    for bucket, n in summed.toPandas().itertuples(index=False):  # DF_BUCKETS + 1 rows at most
        if bucket == DF_BUCKETS:
            total = int(n)
        else:
            counts[bucket] = n
    return counts, total


def signatures(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, th, digest, bands) of (id, th, text) rows; ``digest`` is equal for equal bags, null without words."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)  # DF_BUCKETS numbers

    def run(batches):
        table = np.log(shared.value)
        for batch in chain.from_iterable(map(slices, batches)):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in text_chunks(texts):
                hashes, counts, sizes = bags(texts[a:b])
                weights = np.log(counts) + table[(hashes % np.uint64(DF_BUCKETS)).astype(np.intp)]
                samples = icws(hashes, weights, sizes, BANDS * ROWS)
                keys = np.zeros((len(samples), BANDS), np.uint64)
                for j in range(ROWS):
                    keys = mix64(keys + samples[:, j::ROWS]) + np.arange(BANDS, dtype=np.uint64)
                keys, at = iter(keys.astype(np.int64)), np.concatenate([[0], np.cumsum(sizes)]).tolist()
                digests, bands, counts = [], [], counts.astype(np.int32)
                for i, j in zip(at, at[1:]):
                    digests.append(hashlib.blake2b(hashes[i:j].tobytes() + counts[i:j].tobytes(), digest_size=16).digest() if j > i else None)
                    bands.append(next(keys) if j > i else None)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)]
                columns += [pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "digest", "bands"])

    return rows.select("id", "th", "text").mapInArrow(run, "id long, th long, digest binary, bands array<long>")


def _similarities(left: list[str], right: list[str], idf: np.ndarray) -> list[float]:
    """Weighted Jaccard similarity of each pair of texts."""
    hashes, counts, sizes = bags(left + right)
    weights = counts * idf[(hashes % np.uint64(DF_BUCKETS)).astype(np.intp)]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    out, n = [], len(left)
    for i in range(n):
        a, b = slice(bounds[i], bounds[i + 1]), slice(bounds[n + i], bounds[n + i + 1])
        out.append(_similarity(hashes[a], weights[a], hashes[b], weights[b]))
    return out


def _similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    low = float(np.minimum(wa[both], wb[at[both]]).sum())
    return low / (float(wa.sum()) + float(wb.sum()) - low)


def block_links(texts: list[str], labels: list, split: int, idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different labels, enough to join all labels that any link joins. ``split``: texts before
    it are compared with those from it on; 0: every text with every other.

    The k-th time a shingle occurs counts as a token of its own with the shingle's IDF, so that what two texts share is
    a product of 0/1 rows; pairs near the threshold or above are then verified as elsewhere."""
    hashes, counts, sizes = bags(texts)
    idfs = idf[(hashes % np.uint64(DF_BUCKETS)).astype(np.intp)]
    weights = counts * idfs
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.repeat(np.arange(len(texts)), sizes), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    nth = (np.arange(len(of)) - first).astype(np.uint64)
    tokens, token_idf = np.repeat(hashes, counts), np.repeat(idfs, counts)
    order = np.lexsort((nth, tokens))
    tokens, nth, of, token_idf = tokens[order], nth[order], of[order], token_idf[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nth[1:] != nth[:-1])
    token = np.cumsum(new) - 1
    left, right = (np.arange(split), np.arange(split, len(texts))) if split else (np.arange(len(texts)),) * 2
    have = np.bincount(token, minlength=new.sum())
    if split:
        on_left = np.bincount(token[of < split], minlength=len(have))
        useful = (on_left > 0) & (have > on_left)
    else:
        useful = have > 1
    keep = useful[token]
    token, of, token_idf = (np.cumsum(useful) - 1)[token[keep]], of[keep], token_idf[keep]
    shared = np.zeros((len(left), len(right)))
    for low in range(0, int(useful.sum()), BLOCK_SHINGLES):
        a, b = np.searchsorted(token, (low, low + BLOCK_SHINGLES))
        x, y = np.zeros((len(texts), BLOCK_SHINGLES)), np.zeros((len(texts), BLOCK_SHINGLES))
        x[of[a:b], token[a:b] - low] = 1
        y[of[a:b], token[a:b] - low] = token_idf[a:b]
        shared += x[left] @ y[right].T
    sums = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights, minlength=len(texts))
    likely = shared >= (threshold - 1e-9) * (sums[left][:, None] + sums[right][None, :] - shared)
    found, group = [], {}

    def top(label):
        while (up := group.get(label, label)) != label:
            label = up
        return label

    for i, j in zip(*np.nonzero(likely)):
        i, j = int(left[i]), int(right[j])
        if i == j or not sizes[i] or not sizes[j] or (not split and i > j) or (a := top(labels[i])) == (b := top(labels[j])):
            continue
        p, q = slice(bounds[i], bounds[i + 1]), slice(bounds[j], bounds[j + 1])
        if _similarity(hashes[p], weights[p], hashes[q], weights[q]) >= threshold:
            group[a] = b
            found.append((i, j))
    return found


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts are similar enough. ``texts``: (digest, text)."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in chain.from_iterable(map(slices, batches)):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for i, j in text_chunks([x + y for x, y in zip(left, right)]):
                good += [s >= threshold for s in _similarities(left[i:j], right[i:j], shared.value)]
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    left = texts.select(F.col("digest").alias("a"), F.col("text").alias("t1"))
    right = texts.select(F.col("digest").alias("b"), F.col("text").alias("t2"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return joined.select("a", "b", "t1", "t2").mapInArrow(run, "a binary, b binary")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _members(nodes: DataFrame, total: int) -> DataFrame:
    """(key, part, leader, order, digest): each stand-in once for each band that it shares with another."""
    at = F.posexplode("bands").alias("band", "key")
    every = nodes.select("digest", "bands", at).select(
        F.xxhash64("band", "key").alias("key"), "digest", F.element_at("bands", (F.col("band") + 1) % BANDS + 1).alias("order")
    )
    groups = every.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("digest").alias("leader")).where("m > 1")
    groups = written(groups, "near-groups")
    most = max(HEAVY_ROWS, total // 1000)
    # at most 1,000 buckets of each band hold a thousandth of all rows, so that side has a bound
    large = F.broadcast(groups.where(F.col("m") >= most).withColumn("parts", F.ceil(F.col("m") / most)))
    in_large = every.join(large, "key").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    in_small = every.join(F.broadcast(groups.where(F.col("m") >= most).select("key")), "key", "left_anti")
    in_small = in_small.join(groups.where(F.col("m") < most).hint("merge"), "key").withColumn("part", F.lit(0).cast("long"))
    columns = ["key", "part", "m", "leader", "order", "digest"]
    return written(in_large.select(columns).unionByName(in_small.select(columns)), "near-members")


def first_pairs(members: DataFrame) -> DataFrame:
    """(a, b): all pairs of small buckets; in larger ones each member with the leader and with its neighbour."""
    w = Window.partitionBy("key", "part").orderBy("order", "digest")
    before = F.array(*(F.lag("digest", k).over(w) for k in range(1, ALL_PAIRS)))
    near = F.when(F.col("m") <= ALL_PAIRS, before).otherwise(F.array(F.lag("digest", 1).over(w), F.col("leader")))
    return (
        members.select("digest", near.alias("near"))
        .select("digest", F.explode("near").alias("other"))
        .where("other is not null and other <> digest")
        .select(*_ordered(F.col("digest"), F.col("other")))
        .distinct()
    )


def later_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): neighbours of different classes in the buckets that are too large for all pairs."""
    w = Window.partitionBy("key", "part").orderBy("order", "digest")
    large = members.where(F.col("m") > ALL_PAIRS).join(labels.hint("merge"), "digest")
    earlier = F.array(*(F.struct(F.lag("digest", k).over(w).alias("d"), F.lag("label", k).over(w).alias("l")) for k in range(1, REACH + 1)))
    return (
        large.select("digest", "label", earlier.alias("earlier"))
        .select("digest", "label", F.explode("earlier").alias("o"))
        .where("o.d is not null and o.l <> label")
        .select(*_ordered(F.col("digest"), F.col("o.d")))
        .distinct()
    )


def open_links(members: DataFrame, labels: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows (a, b) that join the classes of every bucket too large for :func:`first_pairs`: each pair of members of
    different classes is compared. A bucket is dealt into blocks of about ``block_rows``; a class with more members has
    blocks of its own, which aren't compared with each other."""
    large = members.where(F.col("m") > ALL_PAIRS).select("key", "digest").join(labels.hint("merge"), "digest")
    per_class = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.min("digest").alias("d"))
    per_class = written(per_class, "near-open")
    # buckets with the same members need one look
    open_keys = (
        per_class.groupBy("key")
        .agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("m"), F.sum(F.when(F.col("n") < block_rows, F.col("n")).otherwise(0)).alias("few"), F.bit_xor("x").alias("x"), F.min("d").alias("d"))
        .where("classes > 1")
        .groupBy("m", "x", "d", "classes")
        .agg(F.min(F.struct("key", "few")).alias("k"))
        .select("k.key", "k.few")
    )
    plan = written(
        per_class.join(open_keys.hint("merge"), "key").select(
            "key", "label", (F.col("n") >= block_rows).alias("solid"),
            F.when(F.col("n") >= block_rows, F.ceil(F.col("n") / block_rows)).otherwise(F.ceil(F.col("few") / block_rows)).alias("parts"),
        ),
        "near-open",
    )
    part = F.pmod(F.xxhash64("digest"), F.col("parts"))
    own = F.when(F.col("solid"), F.col("label"))
    dealt = written(large.join(plan.hint("merge"), ["key", "label"]).select("key", "digest", "label", own.alias("own"), part.alias("part")), "near-dealt")
    blocks = dealt.select("key", "own", "part").distinct().withColumn("block", F.xxhash64("key", "own", "part"))
    blocks = written(blocks, "near-blocks")
    other = blocks.select("key", F.col("own").alias("own2"), F.col("block").alias("block2"))
    met = blocks.join(other.hint("merge"), "key").where("block <= block2 and (own is null or not own <=> own2)")
    sides = F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("side")), F.when(F.col("block") != F.col("block2"), F.struct(F.col("block2").alias("b"), F.lit(1).alias("side"))))
    met = met.select(F.xxhash64("block", "block2").alias("task"), F.explode(sides).alias("s")).where("s is not null").select("task", "s.side", F.col("s.b").alias("block"))
    rows = dealt.withColumn("block", F.xxhash64("key", "own", "part")).select("block", "digest", "label")
    rows = rows.join(met.hint("merge"), "block").join(texts.hint("merge"), "digest")
    shared = members.sparkSession.sparkContext.broadcast(idf)  # DF_BUCKETS numbers

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("digest", "ascending")])
        digests, words = table["digest"].to_pylist(), table["text"].to_pylist()
        split = table["side"].to_pylist().count(0) if len(set(table["side"].to_pylist())) > 1 else 0
        found = block_links(words, table["label"].to_pylist(), split, shared.value, threshold)
        pairs = [sorted((digests[i], digests[j])) for i, j in found]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return rows.select("task", "side", "digest", "label", "text").groupBy("task").applyInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(digest, label): the smallest digest of each connected component, for every digest of ``links``."""
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-links")
    told = both.select(F.col("a").alias("digest"), F.least("a", "b").alias("label"), F.col("a").alias("old"))
    while True:
        lower = written(told.groupBy("digest").agg(F.min("label").alias("label"), F.max("old").alias("old")), "near-labels")
        parent = lower.select(F.col("digest").alias("label"), F.col("label").alias("up"))
        labels = written(lower.join(parent, "label").select("digest", F.col("up").alias("label"), (F.col("up") != F.col("old")).alias("moved")), "near-labels")
        if not labels.where("moved").head(1):
            return labels.select("digest", "label")
        own = labels.select("digest", "label", F.col("label").alias("old"))
        heard = both.join(labels.select(F.col("digest").alias("b"), "label"), "b")
        told = own.unionByName(heard.select(F.col("a").alias("digest"), "label"), allowMissingColumns=True)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (digest, label) after more ``links``: only the classes that these join are worked out anew."""
    ends = links.select("a", "b")
    for side in "ab":
        ends = ends.join(labels.select(F.col("digest").alias(side), F.col("label").alias(f"{side}_label")), side)
    return _renamed(labels, components(ends.where("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()))


def _renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    up = names.select(F.col("digest").alias("label"), F.col("label").alias("up"))
    return written(labels.join(up, "label", "left").select("digest", F.coalesce("up", "label").alias("label")), "near-labels")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, th, digest) of every row, and (digest, first) of every class member: ``first`` is the (id, th) that stays."""
    rows = docs.select(ordered_id(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    counts, total = document_frequencies(rows)
    idf = idf_table(counts, total)
    signed = written(signatures(rows, idf), "near-signed")
    nodes = written(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("id", "th")).alias("first"), F.first("bands").alias("bands")),
        "near-nodes",
    )
    members = _members(nodes, total)
    pairs = written(first_pairs(members), "near-pairs")
    used = members.select("digest").distinct().join(nodes.select("digest", "first.id", "first.th"), "digest")
    texts = written(
        rows.join(used.hint("merge"), ["id", "th"]).select("digest", "text").dropDuplicates(["digest"]), "near-texts"
    )
    links = written(verified(pairs, texts, idf, threshold), "near-links")
    labels = _renamed(nodes.select("digest", F.col("digest").alias("label")), components(links))
    for _ in range(ROUNDS):
        more = written(later_pairs(members, labels).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
        if not more.head(1):
            break
        found = written(verified(more, texts, idf, threshold), "near-links")
        pairs = pairs.unionByName(more)
        if not found.head(1):
            break
        labels = joined(labels, found)
    found = written(open_links(members, labels, texts, idf, threshold), "near-links")
    if found.head(1):
        labels = joined(labels, found)
    firsts = nodes.join(labels, "digest").select("digest", "label", "first")
    least = written(firsts.groupBy("label").agg(F.min("first").alias("first")), "near-firsts")
    return signed.select("id", "th", "digest"), written(firsts.select("digest", "label").join(least, "label").select("digest", "first"), "near-classes")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs``."""
    signed, classes = near_classes(docs, id_col, text_col, threshold)

    def shown(value):
        return F.when(value != NO_ID, value)

    return signed.join(classes.hint("merge"), "digest", "left").select(
        shown(F.col("id")).alias("doc_id"), shown(F.coalesce(F.col("first.id"), F.col("id"))).alias("class_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` of each class, with all its columns; rows without words all stay."""
    signed, classes = near_classes(docs, id_col, text_col, threshold)
    stay = classes.select("first.id", "first.th").distinct()
    packed = docs.select(
        ordered_id(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("th"),
        F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACES)) == "",
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    ).toDF("id", "th", "blank", "row")
    kept = packed.where("not blank").join(stay.hint("merge"), ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    return kept.select("row").unionByName(packed.where("blank").select("row")).select("row.*")
