"""Mixing sources to target weights by fitting each source's word budget exactly.

Documents are counted by exact length within each source. A source's budget is its target less the whole
passes over it. Most of the budget is spent evenly over the lengths; what is left, ``DP_BUDGET`` words at
most, is fitted by a bounded-knapsack dynamic programme over lengths and how many documents of each are
free. Then that many documents of each length are picked in the order of a seeded hash.

Picking is a radix selection: documents of one source and length are counted in 64 hash buckets, whole
buckets are in or out, and only the bucket at the edge is looked at again (split into 64 once more while it
is large). Rows that share an id are parted by a hash of their own, so no group is ever gathered in one task.

Defined results
---------------
* The size of a text is its number of runs outside ``[\\x20\\x09-\\x0D]``; a null text has 0.
* Sources are ordered by code point, a null source last; it is a source like any other.
* Targets: see :func:`source_plan`. A source of size 0 has target 0.
* A document is taken whole, 0, 1 or 2 times. A source that can't reach its target exactly stays below it.
* Rows that repeat a doc_id are documents of their own. Empty tables give empty results; extra columns
  are kept by :func:`mixed` and left out by :func:`mix`.

The driver holds sums over sources, not the sources themselves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
DP_BUDGET = 1 << 16
SEED = 20_25
#: A bucket at the edge of a selection is sorted by one task when it has no more rows.
EDGE_ROWS = 20_000
#: The plan has one row for each source, of some 100 bytes; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 50_000
_DIGITS = 6
_DEPTHS = 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_plan(hist: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> tuple[DataFrame, int]:
    """(skey, source_size, target, whole, budget) of each source of ``hist`` (skey, source, size, n), and how many
    there are. The driver sees sums over sources only.

    Targets are ``unit * weight`` but for the sources that this takes above ``most`` sizes, which stop there; their
    excess raises the unit of the others, until no further source stops.
    """
    spark = hist.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    sums = hist.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    placed = written(sums.repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "mix-sources")
    before, at = [], 0
    for p, n in sorted(placed.groupBy("p").count().collect()):  # one row for each partition
        before.append((p, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(before, "p int, before long"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = written(placed.join(starts, "p").select("skey", F.col("words").alias("source_size"), weight.alias("weight")), "mix-sources")
    limit, stopped, unit = most * F.col("source_size"), None, 0.0
    while True:
        stops = F.lit(stopped is not None) & (F.lit(unit) * F.col("weight") > limit)
        now = sources.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(stops, limit).otherwise(0)).alias("used"),
            F.sum(F.when(~stops, F.col("weight")).otherwise(0)).alias("open"), F.count_if(stops).alias("stopped"),
        ).first()
        if now.stopped == stopped:
            break
        stopped = now.stopped
        if not now.open:
            break
        unit = (share * now.words - now.used) / now.open
    target = F.least(F.lit(unit) * F.col("weight"), limit.cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    plan = sources.select("skey", "source_size", target.alias("target"), whole.cast("int").alias("whole"))
    return plan.withColumn("budget", F.rint("target").cast("long") - F.col("whole") * F.col("source_size")), at


def fit_budget(lengths: list[int], counts: list[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """How many documents of each length to take, of ``counts`` each, so that the words come to ``budget``
    or as near below it as is found."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    ahead = max(0, budget - dp_budget // 2)
    take = [c * ahead // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i] * 2654435761 % 2**32, lengths[i]))
    for i in order:  # what rounding down has left over
        if rest <= dp_budget:
            break
        more = min(counts[i] - take[i], 1 + (rest - dp_budget) // (2 * lengths[i]), rest // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    while rest > dp_budget:
        before = rest
        for i in order:
            more = min(counts[i] - take[i], max(0, rest - dp_budget // 2) // lengths[i])
            take[i] += more
            rest -= more * lengths[i]
        if rest == before:
            break
    # bounded knapsack: reached[j] has bit w set if j parts can make w words
    cap = min(rest, 4 * dp_budget)
    mask, reached, parts = (1 << (cap + 1)) - 1, [1], []
    for i in order:
        free, batch = min(counts[i] - take[i], cap // lengths[i]), 1
        while free > 0 and not reached[-1] >> rest & 1:
            n = min(batch, free)
            parts.append((i, n))
            reached.append((reached[-1] | reached[-1] << (n * lengths[i])) & mask)
            free -= n
            batch *= 2
        if reached[-1] >> rest & 1:
            break
    words = reached[-1].bit_length() - 1
    for j in range(len(parts), 0, -1):
        if not reached[j - 1] >> words & 1:
            i, n = parts[j - 1]
            take[i] += n
            words -= n * lengths[i]
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    rows["extra"] = fit_budget(rows["size"].tolist(), rows["n"].tolist(), int(rows["budget"].iloc[0]))
    return rows[["skey", "size", "n", "extra"]]


def choose(rows: DataFrame, quota: DataFrame, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """``rows`` (doc_id, skey, size, r, row) with ``pick``, 1 for the ``extra`` rows of each group of ``quota``
    (skey, size, extra) that come first by (r, hash of row, row). Every row comes out once."""
    columns = ["row", "doc_id", "source", "skey", "size", "pick"]
    keys, need = ["skey", "size"], quota.select("skey", "size", F.col("extra").alias("need"))
    pending = rows.withColumn("r2", F.xxhash64("row"))
    depth, depths, done = 0, [(h, d) for h in ("r", "r2") for d in range(_DEPTHS)], []
    while True:
        (name, place), digit = depths[depth], f"b{depth}"
        pending = pending.withColumn(digit, F.shiftrightunsigned(name, 64 - _DIGITS * (place + 1)) % (1 << _DIGITS))
        finer = [*keys, digit]
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(digit))
        counts = pending.groupBy(*finer).agg(F.count(F.lit(1)).alias("c"), (F.min("r") < F.max("r")).alias("differ")).join(need.hint("merge"), keys)
        decided = written(
            counts.withColumn("upto", upto).select(
                *finer,
                "c",
                "differ",
                F.when(F.col("upto") <= F.col("need"), 1).when(F.col("upto") - F.col("c") >= F.col("need"), 0).alias("pick"),
                (F.col("need") - F.col("upto") + F.col("c")).alias("need"),
            ),
            "mix-buckets",
        )
        found = pending.join(decided.select(*finer, "pick", "need", "c").hint("merge"), finer)
        done.append(found.where("pick is not null").select(*columns))
        large = F.lit(False) if depth + 1 == len(depths) else F.col("c") > edge_rows
        first = F.row_number().over(Window.partitionBy(*finer).orderBy("r", "r2", "row"))
        edge = found.where(F.col("pick").isNull() & ~large).withColumn("pick", (first <= F.col("need")).cast("int"))
        done.append(edge.select(*columns))
        left = decided.where(F.col("pick").isNull() & large)
        most = left.agg(F.max("differ").alias("differ")).first().differ
        if most is None:
            break
        need = left.select(*finer, "need")
        pending = written(found.where(F.col("pick").isNull() & large).drop("pick", "need", "c"), "mix-pending")
        keys = finer
        # rows of one id have one r: only their own hash parts them
        depth = depth + 1 if most or name == "r2" else _DEPTHS
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _mix(rows: DataFrame, weights, share, most, seed) -> DataFrame:
    """``rows`` (row, doc_id, source, size) with source_size, target and times."""
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn(
        "r", F.xxhash64(F.lit(seed), "doc_id")
    )
    hist = written(rows.groupBy("skey", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    plan, sources = source_plan(hist, weights, share, most)
    plan = written(plan, "mix-plan")
    plan = F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan.hint("merge")
    quota = written(
        hist.where("size > 0")
        .join(plan, "skey")
        .select("skey", "size", "n", "budget")
        .groupBy("skey")
        .applyInPandas(_fit_source, "skey string, size long, n long, extra long"),
        "mix-quota",
    )
    empty = rows.where("size = 0").select("row", "doc_id", "source", "skey", "size", F.lit(0).alias("pick"))
    return (
        choose(rows.where("size > 0"), quota)
        .unionByName(empty)
        .join(plan, "skey")
        .select("row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("pick")).alias("times"))
    )


def _mix_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    """(row, doc_id, source, size) and ``more`` of every row; written, so that ``row`` stays the same."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            *more,
        ),
        "mix-rows",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST_PASSES,
    seed: int = SEED,
    keep_source: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, times."""
    rows = _mix_rows(docs, id_col, text_col, source_col)
    found = _mix(rows, weights, share, most, seed)
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"]
    return found.select(*columns, *(["source"] if keep_source else []))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST_PASSES,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken."""
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("packed")
    rows = _mix_rows(docs, id_col, text_col, source_col, packed)
    found = _mix(rows.drop("packed"), weights, share, most, seed).where("times > 0").select("row", "times")
    return (
        rows.select("row", "packed")
        .join(found.hint("merge"), "row")
        .select("packed", F.explode(F.sequence(F.lit(1), "times")).alias("pass"))
        .select("packed.*")
    )
