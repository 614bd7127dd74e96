"""Grouped statistics of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import UNCATEGORIZED, trimmed


def _line_stats(value: Column, when: Column) -> list[Column]:
    """Mean, least, most and population deviation of the values where ``when`` holds; null without any."""
    some = F.when(when, value)
    return [F.avg(some).alias("mean"), F.min(some).alias("min"), F.max(some).alias("max"), F.stddev_pop(some).alias("stddev")]


def image_summary(images: DataFrame, measurements: DataFrame, key: str = "image_id") -> DataFrame:
    """One row for each image: counts of all, line and area measurements, and diameter statistics of lines.

    Polylines have diameters but don't count in the statistics. Images without measurements stay.
    """
    kind = F.col("measurement_kind")
    per_image = measurements.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(kind == "line").alias("n_line"),
        F.count_if(kind == "area").alias("n_area"),
        *_line_stats(F.col("diameter_unit"), kind == "line"),
    )
    zero = F.lit(0).cast("long")
    return images.join(per_image, key, "left").withColumns({c: F.coalesce(c, zero) for c in ("n", "n_line", "n_area")})


def category_summary(categories: DataFrame, measurements: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each category: how many measurements of all kinds, and statistics of lines. Empty ones stay."""
    per = measurements.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *_line_stats(F.col("diameter_unit"), F.col("measurement_kind") == "line")
    )
    return categories.join(per, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def label_counts(measurements: DataFrame, label: str = "label") -> DataFrame:
    """How many measurements each trimmed label has; blank labels are pooled."""
    return measurements.groupBy(trimmed(F.col(label)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def used_labels(measurements: DataFrame, order: Column, label: str = "label") -> DataFrame:
    """(position, label): labels that have measurements by first appearance, uncategorized last."""
    first = measurements.groupBy(F.coalesce(F.col(label), F.lit(UNCATEGORIZED)).alias("label"), F.col(label).isNull().alias("none")).agg(F.min(order).alias("first"))
    return first


def outcome_counts(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def coefficient_of_variation(values: DataFrame, key: str, value: str) -> DataFrame:
    """Population deviation over the mean; 1 when the mean is not above 1e-6."""
    found = values.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return found.select(key, F.when(F.col("m").isNull() | (F.col("m") <= 1e-6), F.lit(1.0)).otherwise(F.col("s") / F.nullif("m", F.lit(0.0))).alias("cv"))


def class_areas(classes: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel area of every class, 0 for classes without detections."""
    per = detections.groupBy(*keys).agg(F.sum("area_px").alias("area_px"))
    return classes.join(per, keys, "left").withColumn("area_px", F.coalesce("area_px", F.lit(0.0)))


def histogram(values: DataFrame, key: str, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(key, bin, weight): counts of equal bins as a vector of unit length; values outside are left out."""
    at = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int")
    inside = values.withColumn("bin", F.when(F.col(value) == high, bins).otherwise(at) - 1).where(f"bin between 0 and {bins - 1}")
    counts = inside.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    return counts.join(norm, key).select(key, "bin", (F.col("n") / F.col("norm")).alias("weight"))


def median_band(values: DataFrame, key: str, width: str, score: str, least: float = 2.0, share: float = 0.18, least_score: float = 0.22, ties: list[str] = ()) -> DataFrame:
    """The best candidate of each key: of those within max(least, share * median) of the median width, the one
    nearest to the median, then with the highest score. Scores below ``least_score`` are rejected."""
    from pyspark.sql import Window

    median = values.groupBy(key).agg(F.percentile(width, F.lit(0.5)).alias("median"))
    off = F.abs(F.col(width) - F.col("median"))
    near = values.join(median, key).where((off <= F.greatest(F.lit(least), F.col("median") * share)) & (F.col(score) >= least_score))
    first = F.row_number().over(Window.partitionBy(key).orderBy(off, F.desc(score), *ties))
    return near.withColumn("place", first).where("place = 1").drop("place")


def values_in_order(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, values): the values of each group in the order of its rows. A group's values become one array, so groups
    must be lists that somebody reads (a category of one image), not tables."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return rows.groupBy(*keys).agg(F.transform(listed, lambda r: r["_value"]).alias("values"))
