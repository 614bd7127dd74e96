"""Writers of reports and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, written


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header in every part, nulls as empty cells. A byte order mark stands before the first
    column's name, so each part opens as UTF-8 in spreadsheets."""
    first, *rest = df.columns
    named = df.select(F.col(f"`{first}`").alias("﻿" + first), *(F.col(f"`{c}`") for c in rest))
    named.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_scale_json(images: DataFrame, path: str) -> None:
    """One JSON line for each calibrated image."""
    rows = images.where("calibration is not null").select(F.lit("1").alias("version"), F.col("path").alias("image_path"), "calibration")
    rows.write.mode("overwrite").json(path)


def write_sidecars(images: DataFrame, path: str) -> None:
    """One JSON line for each image (path, calibration): its sidecar. Images without a calibration have none."""
    rows = images.where("calibration is not null")
    rows.select(F.lit("1").alias("version"), F.col("path").alias("image_path"), "calibration").write.mode("overwrite").json(path)


#: Images and measurements of a project file at most; a project with more is written in parts.
PART_ROWS = 10_000
#: Parts that a task writes, one after the other.
TASK_PARTS = 4


def project_documents(
    image: DataFrame, category: DataFrame, measurement: DataFrame, annotation: DataFrame | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """(project_id, number, documents): each project's images in order, each with its categories, measurements and annotations
    in order, under the names that project files have.

    A project of more than ``part_rows`` images and measurements comes in parts of about so many, numbered from 1, beside a part 0
    without images; ``number`` is null for others. Its images are dealt out to the parts with their places (``image_pos``). An image with more measurements
    than that is in several pieces, of which the later ones have nothing but its id and their measurements, from the place
    ``first_measurement`` on. So no task holds more of a project than a part.
    """
    keys = ["project_id", "image_id"]

    def nested(df: DataFrame, order: str, name: str, fields: dict[str, str], piece: tuple[str, ...] = ()) -> DataFrame:
        row = F.struct(order, *(F.col(c).alias(n) for n, c in fields.items()))
        listed = F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(*(r[n].alias(n) for n in fields)))
        return df.groupBy(*keys, *piece).agg(listed.alias(name))

    groups = {"id": "category_id", "number": "number", "label": "label", "color": "color"}
    rows = {
        "id": "measurement_id", "fiber_group_id": "category_id", "mode": "mode", "measurement_kind": "measurement_kind", "line_px": "line",
        "snapped_line_px": "snapped_line", "polyline_px": "polyline", "point_px": "point", "polygon_px": "polygon", "area_rings_px": "area_rings",
        "exact_area_px": "exact_area_px", "confidence": "confidence", "status": "status", "created_at": "created_at",
    }
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("measurement_pos", "measurement_id")) - 1
    pieces = nested(measurement.withColumn("_piece", F.floor(place / part_rows).cast("int")), "measurement_pos", "measurements", rows, ("_piece",))
    parts = [nested(category, "category_pos", "fiber_groups", groups)]
    if annotation is not None:
        notes = {n: n for n in ("kind", "content", "anchor", "start", "end", "created_at")}
        parts.append(nested(annotation, "annotation_id", "overlay_annotations", {"id": "annotation_id"} | notes))
    lists = [c for p in parts for c in p.columns if c not in keys]
    held = reduce(lambda a, b: a.join(b, keys, "left"), [*parts, pieces], image).withColumn("_piece", F.coalesce("_piece", F.lit(0)))
    size = F.when(F.col("_piece") == 0, 1).otherwise(0) + F.coalesce(F.size("measurements"), F.lit(0))
    whole = written(held.withColumn("_size", size), "images")
    sizes = whole.groupBy("project_id").agg(F.sum("_size").alias("_rows")).select("project_id", F.ceil(F.col("_rows") / part_rows).alias("_parts"))
    split = F.col("_parts") > 1
    number = F.when(split, F.pmod(F.xxhash64("image_id", "_piece"), F.col("_parts")).cast("int") + 1)
    dealt = whole.join(few(sizes), "project_id").withColumn("number", number)
    once = lambda c: F.when(F.col("_piece") == 0, c)
    fields = {
        "path": "path", "source_type": "source_type", "absolute_path": "absolute_path", "calibration": "calibration",
        "active_group_id": "active_category_id", "suppressed_project_group_labels": "suppressed_labels",
    } | {c: c for c in lists}
    document = F.struct(
        F.col("image_pos").alias("_at"), "_piece", F.col("image_id").alias("id"), once(F.array("width", "height")).alias("image_size"),
        *(once(F.col(c)).alias(name) for name, c in fields.items()), "measurements", F.when(split, F.col("image_pos").cast("int")).alias("image_pos"),
        F.when(F.col("_piece") > 0, F.col("_piece") * part_rows).alias("first_measurement"),
    )
    tasks = max(1, -(-(sizes.agg(F.sum("_parts")).first()[0] or 0) // TASK_PARTS))
    listed = F.transform(F.sort_array(F.collect_list(document)), lambda d: d.dropFields("_at", "_piece"))
    found = dealt.repartition(tasks, "project_id", "number").groupBy("project_id", "number").agg(listed.alias("documents"))
    return found.unionByName(sizes.where(split).select("project_id", F.lit(0).alias("number")), allowMissingColumns=True)


def write_projects(archive, path: str, part_rows: int = PART_ROWS) -> None:
    """A JSON file for each project of an archive, as :func:`read_projects` reads it; a large project has one for each part (see
    :func:`project_documents`), of which part 0 has what belongs to no image."""
    documents = project_documents(archive.image, archive.category, archive.measurement, archive.annotation, part_rows)
    presets = archive.preset.groupBy("project_id").agg(
        F.sort_array(F.collect_list(F.struct("preset_pos", "name", F.col("ppu").alias("pixels_per_unit"), "unit"))).alias("calibration_presets")
    )
    templates = archive.template.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("template_pos", "label", "color"))).alias("project_group_templates"))
    head = reduce(lambda a, b: a.join(b, "project_id", "left"), (presets, templates), archive.project)
    head = written(head.select("project_id", "version", "calibration_presets", F.col("calibration").alias("project_default_calibration"), "project_group_templates"), "projects")
    empty = head.select("project_id", F.lit(None).cast("int").alias("number")).join(archive.image.select("project_id").distinct(), "project_id", "left_anti")
    parts = documents.unionByName(empty, allowMissingColumns=True)
    own = [F.when(F.coalesce("number", F.lit(0)) == 0, F.col(c)).alias(c) for c in ("calibration_presets", "project_default_calibration", "project_group_templates")]
    of_part = F.when(F.col("number").isNotNull(), F.struct(F.col("project_id").alias("project"), "number")).alias("part")
    parts.join(few(head), "project_id").select("version", "documents", *own, of_part).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def union_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns in the order in which they are first seen, null where a frame has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
