"""Edits as transformations of one table version into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import trimmed
from .ordinal import renumber


def delete_rows(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among ``gone``; null keys never match."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def delete_category(measurements: DataFrame, categories: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measurements, categories) without the categories ``gone`` (image_id, category_id): their measurements
    are uncategorized and the rest is renumbered from 1."""
    keys = ["image_id", "category_id"]
    marked = measurements.join(gone.select(*keys, F.lit(True).alias("_gone")).distinct(), keys, "left")
    freed = marked.withColumn("category_id", F.when(F.col("_gone").isNull(), F.col("category_id"))).drop("_gone")
    return freed.select(*measurements.columns), renumber(categories.join(gone, keys, "left_anti"))


def merge_same_labels(categories: DataFrame) -> DataFrame:
    """(image_id, category_id, kept_id): categories of one trimmed label go to the first of them by number."""
    w = Window.partitionBy("image_id", trimmed(F.col("label"))).orderBy("number", "category_id")
    return categories.select("image_id", "category_id", F.first("category_id").over(w).alias("kept_id"))


def remap_categories(measurements: DataFrame, mapping: DataFrame) -> DataFrame:
    moved = measurements.join(mapping, ["image_id", "category_id"], "left")
    return moved.withColumn("category_id", F.coalesce("kept_id", "category_id")).select(*measurements.columns)


def replace_detections(measurements: DataFrame, detections: DataFrame) -> DataFrame:
    """Automatic areas of the images that were detected anew make way for the new rows; all else stays."""
    seen = detections.select("image_id").distinct().withColumn("_seen", F.lit(True))
    automatic = (F.col("measurement_kind") == "area") & (F.col("mode") == "auto_instance")
    kept = measurements.join(seen, "image_id", "left").where(F.col("_seen").isNull() | ~automatic).drop("_seen")
    return kept.unionByName(detections, allowMissingColumns=True)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed rows between two versions."""
    values = [c for c in after.columns if c not in keys]

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in values)).alias(name))

    both = digest(before, "_b").join(digest(after, "_a"), keys, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def upsert(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Edits replace rows of the same keys and are added where there are none."""
    return rows.join(edits.select(*keys), keys, "left_anti").unionByName(edits, allowMissingColumns=True)


def suppress(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds labels (image_id, label) to the images' suppressed ones: trimmed, distinct and sorted."""
    new = labels.groupBy("image_id").agg(F.collect_set(trimmed(F.col("label"))).alias("_new"))
    none = F.array().cast("array<string>")
    every = F.transform(F.concat(F.coalesce("suppressed_labels", none), F.coalesce("_new", none)), trimmed)
    clean = F.array_sort(F.array_distinct(F.filter(every, lambda x: x != "")))
    return images.join(new, "image_id", "left").withColumn("suppressed_labels", clean).drop("_new")


def ensure_categories(categories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Categories (image_id, label, number) with the wanted labels (image_id, label) that an image has not yet,
    numbered after its largest number in the order of their labels."""
    clean = wanted.select("image_id", trimmed(F.col("label")).alias("label")).where("label <> ''").distinct()
    new = clean.join(categories.select("image_id", trimmed(F.col("label")).alias("label")), ["image_id", "label"], "left_anti")
    most = categories.groupBy("image_id").agg(F.max("number").alias("_most"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("label"))
    numbered = new.join(most, "image_id", "left").withColumn("number", (F.coalesce("_most", F.lit(0)) + place).cast("int")).drop("_most")
    return categories.select("image_id", "label", "number").unionByName(numbered)


def restore_active(images: DataFrame, categories: DataFrame) -> DataFrame:
    """Images whose active category no longer exists have none."""
    known = categories.select("image_id", F.col("category_id").alias("active_category_id"), F.lit(True).alias("_known")).distinct()
    found = images.join(known, ["image_id", "active_category_id"], "left")
    return found.withColumn("active_category_id", F.when(F.col("_known"), F.col("active_category_id"))).drop("_known")


def unsuppress(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Takes labels (image_id, label) from the images' suppressed ones."""
    gone = labels.groupBy("image_id").agg(F.collect_set(trimmed(F.col("label"))).alias("_gone"))
    none = F.array().cast("array<string>")
    left = F.array_except(F.coalesce("suppressed_labels", none), F.coalesce("_gone", none))
    return images.join(gone, "image_id", "left").withColumn("suppressed_labels", left).drop("_gone")


def memberships(measurements: DataFrame, categories: DataFrame) -> DataFrame:
    """(image_id, category_id, n, first, last): what each category holds, derived anew from the measurements; empty
    categories stay, dangling ids count nowhere."""
    keys = ["image_id", "category_id"]
    held = measurements.groupBy(*keys).agg(
        F.count_distinct("measurement_id").alias("n"), F.min("measurement_id").alias("first"), F.max("measurement_id").alias("last")
    )
    return categories.select(*keys).join(held, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merge_into(measurements: DataFrame, categories: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measurements, categories) after ``merges`` (image_id, source, target): measurements move to the target, the
    source goes, the rest is renumbered. A merge whose source or target is missing, or that has just one, does nothing."""
    known = categories.select("image_id", F.col("category_id").alias("source"))
    real = merges.where("source <> target").join(known, ["image_id", "source"], "left_semi")
    real = real.join(known.withColumnRenamed("source", "target"), ["image_id", "target"], "left_semi")
    mapping = real.select("image_id", F.col("source").alias("category_id"), F.col("target").alias("kept_id"))
    return remap_categories(measurements, mapping), renumber(categories.join(mapping.select("image_id", "category_id"), ["image_id", "category_id"], "left_anti"))


def edit_template(images: DataFrame, categories: DataFrame, original: str, target: str, color: str) -> tuple[DataFrame, DataFrame]:
    """(categories, moves): the categories of all images after a project template was renamed from ``original`` to
    ``target`` and recoloured. ``images``: image_id; ``categories``: image_id, category_id, number, label, color.

    Where an image has both labels the original one is merged into the target (``moves``: image_id, category_id,
    kept_id); where it has the original only, that is renamed; where it has neither, the target is added with the next
    number and an id made of the image and the label.
    """
    label = trimmed(F.col("label"))
    first = categories.where(label.isin(original, target)).groupBy("image_id").agg(
        F.min_by("category_id", F.when(label == target, F.col("number"))).alias("_target"), F.min_by("category_id", F.when(label == original, F.col("number"))).alias("_original")
    )
    state = images.select("image_id").join(first, "image_id", "left")
    moves = state.where("_target is not null and _original is not null and _target <> _original").select(
        "image_id", F.col("_original").alias("category_id"), F.col("_target").alias("kept_id")
    )
    kept = categories.join(moves.select("image_id", "category_id"), ["image_id", "category_id"], "left_anti").join(state, "image_id")
    chosen = F.col("category_id") == F.coalesce("_target", "_original")
    kept = kept.withColumns({"label": F.when(chosen, F.lit(target)).otherwise(F.col("label")), "color": F.when(chosen, F.lit(color)).otherwise(F.col("color"))})
    most = categories.groupBy("image_id").agg(F.max("number").alias("_most"))
    new = state.where("_target is null and _original is null").join(most, "image_id", "left").select(
        "image_id", F.concat_ws("/", F.col("image_id").cast("string"), F.lit(target)).alias("category_id"), (F.coalesce("_most", F.lit(0)) + 1).cast("int").alias("number"),
        F.lit(target).alias("label"), F.lit(color).alias("color"),
    )
    columns = ["image_id", "category_id", "number", "label", "color"]
    return renumber(kept.select(*columns).unionByName(new.select(*columns)), order=["number", "category_id"]), moves


def move_annotations(annotations: DataFrame, moves: DataFrame) -> DataFrame:
    """Annotations (annotation_id, kind, anchor, start, end) moved by ``moves`` (annotation_id, dx, dy): a text by its
    anchor, a shape by its two points."""
    found = annotations.join(moves, "annotation_id", "left")
    dx, dy = F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))

    def moved(column: str) -> Column:
        p = F.col(column)
        return F.when(p.isNotNull(), F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))

    text = F.col("kind") == "text"
    new = {"anchor": F.when(text, moved("anchor")).otherwise(F.col("anchor"))}
    new |= {c: F.when(text, F.col(c)).otherwise(moved(c)) for c in ("start", "end")}
    return found.withColumns(new).drop("dx", "dy")
