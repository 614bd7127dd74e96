"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of ``BOOKS`` codebooks over all dimensions.
Codebooks are trained as residual k-means on a sample of ``SAMPLE`` vectors at most (the smallest hashes of
their ids) and then refitted together by least squares; encoding keeps the ``BEAM`` best partial sums of each
vector. The norm of the vector over that of its approximation is stored with the code, and corrects the length
that quantisation loses. All that is quantised are directions: a vector is scaled to length one in double precision first, so
components of any size take part alike, and its length is kept as a number and a power of two. A search scores every code by lookup tables (a query's products with all codewords), keeps
the best of each block of codes and of these the ``RERANK`` best of all blocks, and scores those exactly, in double
precision, by a join with the vectors. Rows are dealt to blocks by hash, so of the ``RERANK`` best each of B blocks has
m = ``RERANK`` / B give or take; it hands on m + 6 sqrt(m) + 10, which is too few once in a billion times.

The index is dealt out in blocks of ``BLOCK`` codes at most by a hash of the row, and queries in groups of
``QUERIES`` rows, so every task holds one block and one group, however many vectors are alike. What goes to every
group is a code and a norm, of about 50 bytes a vector; vectors move only where they are reranked, ``RERANK`` for each
query.

Defined results
---------------
* Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
  null id or with another length than most vectors have.
* A query's own row is left out, and only that: rows that repeat an id are queries and candidates of their own.
* Ties go to the smaller id. With no more than ``k`` candidates a query gets them all.
* Components may be as large or small as doubles are. A score is the sum of products in double precision, be it infinite.
* Very long vectors are taken whole. An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BOOKS = 24
WORDS = 256
BEAM = 4
SAMPLE = 8192
BLOCK = 32_768
QUERIES = 1024
RERANK = 256
K = 20
_DTYPE = np.float32


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, v) of the vectors that take part; written, so that ``row`` stays the same."""
    v = F.col("v")
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return written(rows.where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)), "aq-vectors")


def directions(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, lengths, powers): each vector (not zero) is its direction times its length times two to its power."""
    _, power = np.frexp(np.abs(points).max(1))
    scaled = np.ldexp(points, -power[:, None])
    length = np.linalg.norm(scaled, axis=1)
    return scaled / length[:, None], length, power


def _kmeans(points: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), words, replace=len(points) < words)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=words)
        empty = counts == 0
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = points[rng.integers(0, len(points), empty.sum())]
    return centres.astype(_DTYPE)


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """(books, words, dimensions) codebooks."""
    rng = np.random.default_rng(seed)
    points = sample.astype(_DTYPE)
    rest, found = points.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, words, rng)
        rest -= centres[np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, 1)]
        found.append(centres)
    found = np.array(found)
    for _ in range(2):  # each book in turn to the means of what the others leave over
        codes = encode(points, found)
        whole = found[np.arange(books), codes].sum(1)
        for b in range(books):
            left = points - whole + found[b][codes[:, b]]
            counts = np.bincount(codes[:, b], minlength=words)
            sums = np.zeros_like(found[b])
            np.add.at(sums, codes[:, b], left)
            fresh = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found[b])
            whole += fresh[codes[:, b]] - found[b][codes[:, b]]
            found[b] = fresh
    return found


def encode(points: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(vectors, books) codes by beam search over the sum of all books' codewords."""
    n, words = len(points), books.shape[1]
    rest, codes = points[:, None, :].astype(_DTYPE), np.zeros((n, 1, 0), np.int64)
    for book in books:
        # what is left after each word: |r|^2 - 2 r.c + |c|^2
        error = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(1)
        flat = error.reshape(n, -1)
        best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
        row, word = best // words, best % words
        rest = np.take_along_axis(rest, row[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None]], 2)
    least = np.argmin((rest**2).sum(2), 1)
    return codes[np.arange(n), least]


def build_index(rows: DataFrame, sample_size: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """(row, id, v, code, norm, power) of every row of (row, id, v), and the codebooks. Only the sample reaches the driver."""
    spark = rows.sparkSession
    sample = rows.select("v").orderBy(F.xxhash64("row"), "row").limit(sample_size).toPandas()["v"]
    lengths = sample.map(len)
    width = int(lengths.mode().iloc[0]) if len(sample) else 0
    rows = rows.where(F.size("v") == width)
    points = np.array([v for v in sample if len(v) == width], np.float64).reshape(-1, width) if width else np.zeros((0, 0))
    books = train(directions(points)[0], words=min(WORDS, max(1, len(points) // 2))) if len(points) else np.zeros((1, 1, width), _DTYPE)
    shared = spark.sparkContext.broadcast(books)  # books x words x dimensions

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                points, length, power = directions(np.array(part["v"].tolist(), np.float64))
                codes = encode(points, shared.value)
                sums = shared.value[np.arange(len(shared.value)), codes].sum(1)
                norm = length / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
                yield pd.DataFrame({"row": part["row"], "id": part["id"], "v": part["v"], "code": [c.astype(np.uint8).tobytes() for c in codes], "norm": norm, "power": power})

    return written(rows.mapInPandas(run, "row long, id long, v array<double>, code binary, norm double, power int"), "aq-index"), books


def _search(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, codes: np.ndarray, norm: np.ndarray, books: np.ndarray, rerank: int):
    """(query, place, rough score) of the best of a block, by lookup tables. Rows are in order of their ids, to which
    ties go; ``own``: the queries' own rows."""
    rough = np.zeros((len(queries), len(rows)), _DTYPE)
    for b, book in enumerate(books):
        rough += np.take(queries @ book.T, codes[:, b], axis=1)
    rough = rough * norm
    rough[own[:, None] == rows] = -np.inf
    keep = min(rerank, len(rows))
    edge = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1 : keep]
    above, at_edge = rough > edge, rough == edge
    room = keep - above.sum(1, keepdims=True)
    query, place = np.nonzero((above | (at_edge & (np.cumsum(at_edge, 1) <= room))) & np.isfinite(rough))
    return query, place, rough[query, place]


def search(index: DataFrame, books: np.ndarray, queries: DataFrame, k: int = K, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` found nearest of each row of ``queries`` (row, id, v) by inner product;
    a query with a row of the index leaves that row out."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(books)
    queries = queries.where(F.size("v") == books.shape[2])
    blocks = max(1, -(-index.count() // (BLOCK * 3 // 4)))
    groups = max(1, -(-queries.count() // (QUERIES * 3 // 4)))
    mean = rerank / blocks
    of_block = min(rerank, math.ceil(mean + 6 * math.sqrt(mean) + 10))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    largest = index.agg(F.max("power")).first()[0] or 0  # lengths are taken relative to the longest one's power
    norm = F.col("norm") * F.pow(F.lit(2.0), F.col("power") - largest)
    stored = index.select("row", "id", "code", norm.alias("norm"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"), every_group)
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    asked = queries.select("row", F.transform("v", lambda x: x / top).cast("array<float>").alias("v"), F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(groups)).cast("int").alias("g"), every_block)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"q": [], "row": [], "id": [], "rough": []}).astype({"q": "int64", "row": "int64", "id": "int64", "rough": "float64"})]
        if len(left) and len(right):
            left, right = left.sort_values(["id", "row"]), right.sort_values("row")
            rows, ids = left["row"].to_numpy(), left["id"].to_numpy()
            codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
            for at in range(0, len(right), 128):
                some = right.iloc[at : at + 128]
                own = some["row"].to_numpy()
                q, place, rough = _search(np.array(some["v"].tolist(), _DTYPE), own, rows, codes, left["norm"].to_numpy(), shared.value, of_block)
                parts.append(pd.DataFrame({"q": own[q], "row": rows[place], "id": ids[place], "rough": rough}))
        return pd.concat(parts)

    rough = (
        stored.groupBy("b", "g")
        .cogroup(asked.groupBy("b", "g"))
        .applyInPandas(block, "q long, row long, id long, rough double")
    )
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rough"), "id", "row"))
    chosen = rough.withColumn("place", place).where(F.col("place") <= rerank).select("q", "row", "id")
    vectors = index.select("row", "v").hint("merge")
    mine = queries.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("w")).hint("merge")
    products = F.zip_with("v", "w", lambda x, y: x * y)
    score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    exact = chosen.join(vectors, "row").join(mine, "q").select("q", "query_id", "id", "row", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "row"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def nearest(vectors: DataFrame, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """Searches with the rows whose id is divisible by ``every`` against all rows."""
    index, books = build_index(usable(vectors, id_col, vector_col))
    return search(index, books, index.where(F.col("id") % every == 0).select("row", "id", "v"), k)
