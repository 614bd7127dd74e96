"""Lookups with defaults, tolerances and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded_case
from ..functions.values import PALETTE, UNCATEGORIZED, UNCATEGORIZED_COLOR, trimmed
from ..session import safe_unions


def with_category(measurements: DataFrame, categories: DataFrame, keys: list[str]) -> DataFrame:
    """Measurements with their category's label, color and number; dangling or null ids are uncategorized."""
    found = measurements.join(categories, keys, "left")
    return found.withColumn("label", F.coalesce("label", F.lit(UNCATEGORIZED))).withColumn("color", F.coalesce("color", F.lit(UNCATEGORIZED_COLOR)))


def match_preset(calibrations: DataFrame, presets: DataFrame, id_col: str, tolerance: float = 1e-9) -> DataFrame:
    """For each calibration (id, name, unit, ppu) the first preset (preset_pos, name, unit, ppu) of its unit and
    scale; one with the same name comes before the others. Calibrations without a match stay."""
    # of presets alike in unit, scale and name only the first can win, and without regard to name only the first of a scale; so
    # a calibration meets two rows for each scale within the tolerance, however many presets there are
    scale = ["unit", "ppu"]
    first = presets.groupBy(*scale, "name").agg(F.min("preset_pos").alias("preset_pos"))
    lowest = first.groupBy(*scale).agg(F.min(F.struct("preset_pos", "name")).alias("_low"))
    lowest = lowest.select(*scale, "_low.preset_pos", F.col("_low.name").alias("preset_name"))
    p = lowest.select("preset_pos", "preset_name", "unit", F.col("ppu").alias("preset_ppu"))
    named = first.select("preset_pos", F.col("name").alias("preset_name"), "unit", F.col("ppu").alias("preset_ppu"))
    near = F.abs(F.col("ppu") - F.col("preset_ppu")) < tolerance
    # scales as multiples of a wider step meet in their own or a neighbouring cell, so the join is on equal keys
    step = max(tolerance * 4, 1e-6)
    cells = F.explode(F.array(*(F.floor(F.col("preset_ppu") / step) + d for d in (-1, 0, 1))))
    placed = calibrations.withColumn("_cell", F.floor(F.col("ppu") / step))
    any_name = placed.join(p.withColumn("_cell", cells), ["unit", "_cell"]).where(near)
    same_name = placed.withColumn("preset_name", F.col("name")).join(named.withColumn("_cell", cells), ["unit", "_cell", "preset_name"]).where(near)
    columns = [id_col, "name", "preset_name", "preset_pos"]
    safe_unions(calibrations.sparkSession)
    pairs = any_name.select(*columns).unionByName(same_name.select(*columns))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.when(F.col("name") == F.col("preset_name"), 0).otherwise(1), "preset_pos"))
    best = pairs.withColumn("_rank", rank).where("_rank = 1").select(id_col, "preset_pos", "preset_name")
    return calibrations.join(best, id_col, "left")


def missing_categories(images: DataFrame, templates: DataFrame, existing: DataFrame) -> DataFrame:
    """(image_id, label, color) of each template label that an image neither has nor suppresses.

    Templates are a short list of a project, so every image is given the list as an array, not joined with it.
    """
    listed = templates.where(trimmed(F.col("label")) != "").groupBy("project_id").agg(
        F.sort_array(F.collect_list(F.struct("template_pos", trimmed(F.col("label")).alias("label"), "color"))).alias("templates")
    )
    wanted = (
        images.join(listed, "project_id")
        .select("image_id", F.coalesce("suppressed_labels", F.array().cast("array<string>")).alias("suppressed"), F.explode("templates").alias("t"))
        .where(~F.array_contains(F.transform("suppressed", trimmed), F.col("t.label")))
        .select("image_id", "t.label", "t.color", "t.template_pos")
    )
    first = F.row_number().over(Window.partitionBy("image_id", "label").orderBy("template_pos"))
    wanted = wanted.withColumn("_first", first).where("_first = 1").drop("_first", "template_pos")
    return wanted.join(existing.select("image_id", trimmed(F.col("label")).alias("label")), ["image_id", "label"], "left_anti")


def label_colors(labels: DataFrame, templates: DataFrame, categories: DataFrame) -> DataFrame:
    """(label, color): the template's color, else that of the first category with the label, else by the palette."""
    from_template = templates.groupBy(trimmed(F.col("label")).alias("label")).agg(F.min_by("color", "template_pos").alias("template_color"))
    from_image = categories.groupBy(trimmed(F.col("label")).alias("label")).agg(F.min_by("color", F.struct("image_pos", "number")).alias("image_color"))
    found = labels.join(from_template, "label", "left").join(from_image, "label", "left")
    # labels without any color are a few; they are numbered after the templates
    bare = found.where("template_color is null and image_color is null").select("label")
    place = F.row_number().over(Window.orderBy("label")) - 1
    palette = F.array(*map(F.lit, PALETTE))
    used = templates.count()
    given = bare.select("label", F.get(palette, ((place + used) % len(PALETTE)).cast("int")).alias("palette_color"))
    return found.join(given, "label", "left").select("label", F.coalesce("template_color", "image_color", "palette_color").alias("color"))


def effective_calibration(images: DataFrame, sidecars: DataFrame, project: DataFrame) -> DataFrame:
    """Each image's own calibration, else its sidecar's, else the project's."""
    found = images.join(sidecars.select(F.col("image_path").alias("path"), F.col("calibration").alias("_sidecar")), "path", "left")
    found = found.join(project.select("project_id", F.col("calibration").alias("_project")), "project_id", "left")
    return found.withColumn("calibration", F.coalesce("calibration", "_sidecar", "_project")).drop("_sidecar", "_project")


def plan_presets(existing: DataFrame, incoming: DataFrame, suffix: str = "导入", tolerance: float = 1e-9) -> DataFrame:
    """(project_id, pos, action, final_name) of incoming presets (project_id, pos, name, unit, ppu).

    One that equals an existing or an earlier incoming preset in name, unit and scale is skipped. A name that is taken
    gets a suffix, then a numbered one: the numbers that are free are dealt out in order.
    """
    step = max(tolerance * 4, 1e-6)
    first = existing.select("project_id", F.lit(-1).cast("long").alias("pos"), "name", "unit", "ppu")
    known = first.unionByName(incoming.select("project_id", F.col("pos").cast("long"), "name", "unit", "ppu"))
    put = known.select("project_id", F.col("pos").alias("_pos"), "name", "unit", F.col("ppu").alias("_ppu"))
    put = put.withColumn("_cell", F.explode(F.array(*(F.floor(F.col("_ppu") / step) + d for d in (-1, 0, 1)))))
    mine = incoming.withColumn("_cell", F.floor(F.col("ppu") / step))
    same = mine.join(put, ["project_id", "name", "unit", "_cell"]).where((F.abs(F.col("ppu") - F.col("_ppu")) < tolerance) & (F.col("_pos") < F.col("pos")))
    skipped = same.select("project_id", "pos").distinct().withColumn("_skip", F.lit(True))
    marked = incoming.join(skipped, ["project_id", "pos"], "left").withColumn("_skip", F.coalesce("_skip", F.lit(False)))
    number = F.regexp_extract("name", rf" \({suffix}(?: (\d+))?\)$", 1)
    plain = F.regexp_replace("name", rf" \({suffix}(?: \d+)?\)$", "")
    n = F.when(plain == F.col("name"), 0).when(number == "", 1).otherwise(number.cast("int"))
    used = existing.groupBy("project_id", plain.alias("name")).agg(F.collect_set(n).alias("_used"))
    place = F.row_number().over(Window.partitionBy("project_id", "name", "_skip").orderBy("pos"))
    taken = F.coalesce("_used", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(0), place + F.size(taken)), taken)
    found = marked.join(used, ["project_id", "name"], "left").withColumn("_k", F.when(~F.col("_skip"), F.element_at(free, place)))
    final = F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("name")).when(F.col("_k") == 1, F.concat("name", F.lit(f" ({suffix})")))
    final = final.otherwise(F.concat("name", F.lit(f" ({suffix} "), F.col("_k").cast("string"), F.lit(")")))
    action = F.when(F.col("_skip"), "skip").when(F.col("_k") > 0, "rename").otherwise("import")
    return found.select("project_id", "pos", action.alias("action"), final.alias("final_name"))


def with_active_category(images: DataFrame, categories: DataFrame) -> DataFrame:
    """Images with the label and color of their active category, null without one."""
    active = categories.select("image_id", F.col("category_id").alias("active_category_id"), F.col("label").alias("active_label"), F.col("color").alias("active_color"))
    return images.join(active, ["image_id", "active_category_id"], "left")


def clean_detections(detections: DataFrame) -> DataFrame:
    """Detections (polygon, bbox) that have a polygon of three points or more, with four numbers of their box."""
    return detections.where(F.size("polygon") >= 3).withColumn("bbox", F.slice("bbox", 1, 4))


def by_folded_path(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """``rows`` (path) with the columns of the template (path, ...) whose path is the same without regard to case."""
    known = templates.withColumn("_path", folded_case(F.col("path"))).drop("path")
    return rows.withColumn("_path", folded_case(F.col("path"))).join(known, "_path").drop("_path")


def in_use(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``used``: whether ``labels`` has their label."""
    known = labels.select(label).distinct().withColumn("used", F.lit(True))
    return rows.join(known, label, "left").withColumn("used", F.coalesce("used", F.lit(False)))
