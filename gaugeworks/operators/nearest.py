"""Exact nearest vectors by inner product, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

#: Rows of a block and queries of a group, which meet in one task; and queries that are multiplied at a time.
BLOCK, GROUP, AT_ONCE = 16_384, 2_048, 128


def _vectors(table: pa.Table, column: str) -> tuple[np.ndarray, list]:
    """The length of each vector, -1 for one that is null or holds a null, and the vectors as arrays."""
    values = table[column].to_pylist() if table[column].null_count else None
    lists = table[column].combine_chunks()
    if values is None and not lists.values.null_count:
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return np.diff(ends, prepend=0), np.split(flat, ends[:-1])
    values = lists.to_pylist() if values is None else values
    held = [None if v is None or None in v else np.array(v, np.float64) for v in values]
    return np.array([-1 if v is None else len(v) for v in held], np.int64), held


def _best(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """For each query (place, rows, scores): its ``k`` best rows and those of equal score. Products by blocks find what may be of
    them, within the error of such sums; scores are then added up one component after the other."""
    with np.errstate(all="ignore"):
        error = 8 * (q.shape[1] + 1) * np.finfo(np.float64).eps
        longest = np.sqrt((v * v).sum(axis=1)).max(initial=0.0)
        for start in range(0, len(q), AT_ONCE):
            part = q[start : start + AT_ONCE]
            rough = part @ v.T
            odd = ~np.isfinite(rough)
            rough[odd] = np.inf
            own = asked[start : start + AT_ONCE, None] == ids[None, :]
            rough[own] = -np.inf
            least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(part), -np.inf)
            margin = error * np.sqrt((part * part).sum(axis=1)) * longest + 1e-300
            low = np.where(np.isfinite(least) & np.isfinite(margin), least - 2 * margin, -np.inf)
            low = np.where(least == np.inf, -np.inf, low)
            for i in range(len(part)):
                rows = np.flatnonzero((rough[i] >= low[i]) & ~own[i])
                terms = np.zeros((len(rows), q.shape[1] + 1))
                terms[:, 1:] = part[i] * v[rows]
                yield start + i, rows, np.cumsum(terms, axis=1)[:, -1]


def _placed(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` places by score, largest first (NaN before all), then by id."""
    nan = np.isnan(scores)
    return np.lexsort((ids, -np.where(nan, 0.0, scores), ~nan))[:k]


def inner_products(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, vec_id, place, score): for each query (query_id, v) the ``k`` rows (vec_id, v) of largest inner product in
    double precision, ties to the smaller vec_id; rows of the query's own id are left out.

    Rows are dealt out in blocks and queries in groups, and each block meets each group in a task of its own as matrices, so
    that memory is bounded and all products are made. A null vector, one that holds null, or one of another length than the
    query's has a null score and comes last.
    """
    blocks, groups = (max(1, -(-df.count() // n)) for df, n in ((rows, block), (queries, group)))

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    double = F.col("v").cast("array<double>").alias("v")
    v = rows.where("vec_id is not null").select("vec_id", double, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("_b"), numbers(groups).alias("_g"))
    q = queries.where("query_id is not null").select(
        "query_id", double, numbers(blocks).alias("_b"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("_g")
    )

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and held.num_rows:
            ids, query_ids = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            (sizes, vectors), (wanted, given) = _vectors(held, "v"), _vectors(asked, "v")
            for size in np.unique(wanted):
                mine = np.flatnonzero(wanted == size)
                fit = np.flatnonzero(sizes == size) if size >= 0 else np.empty(0, np.int64)
                rest = np.setdiff1d(np.arange(len(ids)), fit)
                rest = rest[np.argsort(ids[rest], kind="stable")]
                if len(fit):
                    matrix = np.array([vectors[i] for i in fit], np.float64).reshape(len(fit), size)
                    found = _best(query_ids[mine], np.array([given[i] for i in mine], np.float64).reshape(len(mine), size), ids[fit], matrix, k + 1)
                    for i, at, scores in found:
                        first = _placed(ids[fit[at]], scores, k)
                        out[0] += [int(query_ids[mine[i]])] * len(first)
                        out[1] += ids[fit[at[first]]].tolist()
                        out[2] += scores[first].tolist()
                for query in query_ids[mine].tolist() if len(rest) else ():
                    last = [x for x in ids[rest].tolist() if x != query][:k]
                    out[0] += [query] * len(last)
                    out[1] += last
                    out[2] += [None] * len(last)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    # as many tasks as pairs of a block and a group, which adaptive execution would merge for their few bytes
    both = (q.repartition(blocks * groups, "_b", "_g").groupBy("_b", "_g"), v.repartition(blocks * groups, "_b", "_g").groupBy("_b", "_g"))
    found = both[0].cogroup(both[1]).applyInArrow(meet, "query_id long, vec_id long, score double")
    return ordinal.top_k(found, ["query_id"], [F.desc_nulls_last("score"), F.asc("vec_id")], k).select("query_id", "vec_id", "place", "score")
