"""Running numbers, first rows and ordered distinct labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_number(rows: DataFrame, keys: list[str], block: str, order: list, name: str) -> DataFrame:
    """Numbers rows from 1 for each key, through all blocks (images) in order.

    A few keys may hold all rows, so rows are numbered within (key, block), and each block starts after the
    rows that earlier blocks have: only counts of blocks are ordered as a whole. Null keys are keys.
    """
    keyed = [F.coalesce(F.to_json(F.struct(F.col(k))), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    marks = [f"_k{i}" for i in range(len(keys))]
    marked = rows.select("*", *keyed)
    counts = marked.groupBy(*marks, block).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*marks).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*marks, block, F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*marks, block).orderBy(*order))
    numbered = marked.withColumn("_local", local).join(offsets, [*marks, block])
    return numbered.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop(*marks, "_before", "_local")


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def first_value_per_key(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """As :func:`first_per_key`, by an aggregate that is partly made before the shuffle; ``order`` has no ties."""
    least = F.min_by(F.struct(*columns), order).alias("_row")
    return rows.groupBy(key).agg(least, F.min(order).alias("_order")).select(key, "_order", *(F.col(f"_row.{c}").alias(c) for c in columns))


def top_k(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """(rows, place): the first ``k`` rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)


def ordered_labels(categories: DataFrame, label: str, order: Column, rows: DataFrame | None = None) -> DataFrame:
    """(label, first): distinct labels with where each appears first."""
    found = categories.groupBy(label).agg(F.min(order).alias("first"))
    return found if rows is None else found.join(rows.select(label).distinct(), label, "left_semi")


def renumber(categories: DataFrame, image: str = "image_id", order: list = ("number",), priority: Column | None = None) -> DataFrame:
    """Numbers categories 1..n in each image: those with a priority first, by it, then the rest in order."""
    by = [priority.asc_nulls_last(), *order] if priority is not None else list(order)
    return categories.withColumn("number", F.row_number().over(Window.partitionBy(image).orderBy(*by)))


def free_numbers(rows: DataFrame, taken: DataFrame, keys: list[str], order: list[str], number: str = "number") -> DataFrame:
    """``rows`` with ``number``: in order, the numbers from 1 that no row of ``taken`` (keys, number) has in their group.

    The k-th smallest taken number t has t - k free ones before it, so the i-th row goes past those with t - k < i.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    known = taken.where(F.col(number) >= 1).groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(number).cast("long"))).alias("_taken"))
    before = known.select(*keys, F.transform("_taken", lambda t, k: t - k - 1).alias("_free_before"))
    passed = F.size(F.filter("_free_before", lambda f: f < F.col("_place")))
    found = rows.withColumn("_place", place).join(before, keys, "left")
    return found.withColumn(number, F.col("_place") + F.coalesce(passed, F.lit(0))).drop("_place", "_free_before")
