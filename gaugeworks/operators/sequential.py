"""Operators that depend on the order of rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import few, many, written

_BOX = ["min_x", "min_y", "max_x", "max_y"]
#: Boxes of a group that are all compared with each other.
SMALL_GROUP = 32


def box_iou(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Intersection over union of two boxes; 0 unless they share an area."""
    w = F.least(a("max_x"), b("max_x")) - F.greatest(a("min_x"), b("min_x"))
    h = F.least(a("max_y"), b("max_y")) - F.greatest(a("min_y"), b("min_y"))

    def area(x):
        return (x("max_x") - x("min_x")) * (x("max_y") - x("min_y"))

    return F.when((w > 0) & (h > 0), w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0))).otherwise(0.0)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(a, b, iou): ids of boxes (keys, id, min_x .. max_y) of one group with an IoU of ``threshold`` (0.5 or more).

    Such boxes differ by less than a factor of two in size. In groups of up to ``SMALL_GROUP`` boxes on the right all meet. In
    others each box is put into the cells it covers of two grids, of two and four times its size rounded to powers of two; so it
    has 16 cells at most, however large it is, and boxes meet on equal cells of the larger one's grid. A pair is taken from the
    cell with the first corner of what they share.
    """
    large = written(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL_GROUP).select(*keys), "large-groups")
    large = few(large.withColumn("_large", F.lit(True)))

    def place(level: Column, x: Column, y: Column) -> Column:
        """A cell's number; 0 is that of a small group."""
        return F.xxhash64(level, x, y).bitwiseOR(F.lit(1))

    def level(box: Callable[[str], Column]) -> Column:
        size = F.greatest(box("max_x") - box("min_x"), box("max_y") - box("min_y"))
        return F.ceil(F.log2(F.greatest(size, F.lit(1e-6))))

    def put(df: DataFrame, name: str) -> DataFrame:
        df = df.where((F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y"))).select(*keys, "id", *_BOX).join(large, keys, "left")

        def cells(at: Column) -> Column:
            cell = F.pow(F.lit(2.0), at)
            x, y = (F.sequence(F.floor(F.col(f"min_{axis}") / cell), F.floor(F.col(f"max_{axis}") / cell)) for axis in ("x", "y"))
            return F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: place(at, i, j))))

        own = level(F.col)
        at = F.when(F.col("_large"), F.concat(cells(own), cells(own + 1))).otherwise(F.array(F.lit(0).cast("long")))
        return df.select(*keys, F.explode(at).alias("_at"), F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in _BOX))

    both = put(left, "a").join(put(right, "b"), [*keys, "_at"])
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    larger = F.greatest(level(a), level(b))
    first = [F.floor(F.greatest(a(f"min_{x}"), b(f"min_{x}")) / F.pow(F.lit(2.0), larger)) for x in ("x", "y")]
    once = (F.col("_at") == 0) | (F.col("_at") == place(larger, *first))
    return both.where(once).select("a", "b", box_iou(a, b).alias("iou")).where(F.col("iou") >= threshold)


def greedy_boxes(rows: DataFrame, keys: list[str], order: list[str], threshold: float = 0.55, existing: DataFrame | None = None) -> DataFrame:
    """Rows (min_x .. max_y) in order, each kept unless it overlaps a kept one of its group by ``threshold`` or more.
    ``existing`` rows come before all and stay, but are not returned.

    Only pairs that overlap are looked at. In each round the rows without an earlier undecided neighbour are kept, and
    their later neighbours go; so no group is ever gathered, and there are as many rounds as a chain of overlaps is long.
    """
    at = F.struct(*order)
    rows = written(rows.withColumn("id", F.struct(at.alias("at"), F.monotonically_increasing_id().alias("row"))), "boxes")
    if existing is not None:
        old = existing.select(*keys, *_BOX, F.monotonically_increasing_id().alias("id"))
        taken = overlapping(old, rows, keys, threshold).select(F.col("b").alias("id")).distinct()
        rows = written(rows.join(taken, "id", "left_anti"), "boxes")
    return greedy_kept(rows, overlapping(rows, rows, keys, threshold))


def greedy_kept(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` without ``id``, in the order of their ids, each kept unless a kept one stands with it in ``pairs`` (a, b).

    What goes in a round is a table of its own, and all of them are taken off at once at the end, so plans stay flat however
    many rounds there are.
    """
    pairs = written(pairs.where("a < b").select("a", "b"), "box-pairs")
    gone = None
    while pairs.head(1):
        decided = pairs.join(many(pairs.select(F.col("b").alias("a")).distinct()), "a", "left_anti")
        now = written(decided.select("b").distinct(), "boxes-gone")
        gone = now if gone is None else gone.unionByName(now)
        pairs = written(pairs.join(many(now), "b", "left_anti").join(many(now.withColumnRenamed("b", "a")), "a", "left_anti"), "box-pairs")
    kept = rows if gone is None else rows.join(many(gone.withColumnRenamed("b", "id")), "id", "left_anti")
    return kept.drop("id")


def greedy_shapes(rows: DataFrame, keys: list[str], order: list[str], threshold: float = 0.55) -> DataFrame:
    """Rows with ``rings`` in order, each kept unless the pixels that its rings cover overlap those of a kept one of its group
    by ``threshold`` or more (intersection over union)."""
    from .masks import run_overlaps, shape_runs

    id_ = F.struct(F.struct(*order).alias("at"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("id", id_), "shapes")
    runs = written(shape_runs(rows, [*keys, "id"]), "shape-runs")
    return greedy_kept(rows, run_overlaps(runs, runs, keys).where(F.col("iou") >= threshold))


def greedy_spacing(rows: DataFrame, keys: list[str], order: list[str], least: float, most: int) -> DataFrame:
    """Points (x, y) in order, each kept unless a kept one is nearer than ``least``; at most ``most`` of each group.

    Rows of a group stream by in order; only the kept points, ``most`` at most, are remembered.
    """

    def decide(state, row):
        kept = state or []
        if len(kept) < most and all(math.dist(row, k) >= least for k in kept):
            return [*kept, row], True
        return kept, False

    return in_order(rows, keys, order, ["x", "y"], decide)


def folded(rows: DataFrame, keys: list[str], order: list[str], values: list[str], step, schema: str) -> DataFrame:
    """``rows`` with what ``step(state, values)`` -> (state, new values) gives for each, group by group in order, from
    the state None. ``schema`` names the new columns.

    Rows are sorted within partitions and stream through; what is held is one group's state, however long a group is.
    """
    columns = StructType.fromDDL(schema)
    group = [rows.columns.index(k) for k in keys]

    def run(batches):
        known, state = None, None
        for pdf in batches:
            out = []
            for key, row in zip(zip(*(pdf.iloc[:, i].tolist() for i in group)), zip(*(pdf[v].tolist() for v in values))):
                if key != known:
                    known, state = key, None
                state, new = step(state, row)
                out.append(new)
            yield pd.concat([pdf, pd.DataFrame(out, columns=columns.names, index=pdf.index)], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, StructType([*rows.schema, *columns]))


def in_order(rows: DataFrame, keys: list[str], order: list[str], values: list[str], decide) -> DataFrame:
    """The rows that ``decide(state, values)`` -> (state, keep) keeps; see :func:`folded`."""

    def step(state, row):
        state, keep = decide(state, row)
        return state, (keep,)

    return folded(rows, keys, order, values, step, "_keep boolean").where("_keep").drop("_keep")


def last_accepted_filter(rows: DataFrame, key: str, order: list[str], value: str, least: float) -> DataFrame:
    """Rows in order, each kept unless its value is nearer than ``least`` to that of the last kept row."""

    def decide(last, row):
        return (last, False) if last is not None and abs(row[0] - last) < least else (row[0], True)

    return in_order(rows, [key], order, [value], decide)


def thinned_path(rows: DataFrame, key: str, order: list[str], least_time: float, least_distance: float) -> DataFrame:
    """Points (x, y, t) of each path, each kept unless it is nearer in time or space to the last kept point."""

    def decide(last, row):
        near = last is not None and (row[2] - last[2] < least_time or math.dist(row[:2], last[:2]) < least_distance)
        return (last, False) if near else (row, True)

    return in_order(rows, [key], order, ["x", "y", "t"], decide)
