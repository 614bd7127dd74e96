"""Readers of project files, sidecars, scale files and folders, as normalized tables.

Everything is read through Spark's sources, so archives may lie in any file system that Spark reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .schema import IMAGE_SUFFIXES, PROJECT, SIDECAR

SCALE_BYTES = 400
SCALE_AT = 0x180


@dataclass(frozen=True)
class Archive:
    """The normalized tables of a set of projects."""

    project: DataFrame
    image: DataFrame
    category: DataFrame
    measurement: DataFrame
    annotation: DataFrame
    preset: DataFrame
    template: DataFrame


def read_projects(spark: SparkSession, path: str) -> Archive:
    """Projects below a path or glob. Unknown keys are ignored, missing ones take defaults, old codes are renewed. A project is
    named by its file, one in parts by its folder and the name that its parts give."""
    files = spark.read.schema(PROJECT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    file = F.col("_metadata.file_path")
    parts = F.concat(F.regexp_replace(file, "[^/]*$", ""), F.col("part.project"))
    projects = files.withColumn("project_id", F.coalesce(parts, file))
    documents = projects.select("project_id", F.posexplode("documents").alias("_at", "d"))
    documents = documents.select("project_id", F.coalesce("d.image_pos", "_at").alias("image_pos"), "d")
    image_id, first = F.col("d.id").alias("image_id"), F.coalesce("d.first_measurement", F.lit(0))
    image = documents.where(first == 0).select(
        "project_id", image_id, "image_pos", "d.path", F.coalesce("d.source_type", F.lit("filesystem")).alias("source_type"), "d.absolute_path",
        F.get("d.image_size", F.lit(0)).alias("width"), F.get("d.image_size", F.lit(1)).alias("height"), "d.calibration",
        F.col("d.active_group_id").alias("active_category_id"),
        F.coalesce("d.suppressed_project_group_labels", F.array().cast("array<string>")).alias("suppressed_labels"), F.col("d.metadata").alias("metadata_json"),
    )
    category = documents.select("project_id", image_id, F.posexplode("d.fiber_groups").alias("category_pos", "g")).select(
        "project_id", "image_id", F.col("g.id").alias("category_id"), "category_pos",
        F.coalesce("g.number", F.col("category_pos") + 1).alias("number"), V.trimmed(F.coalesce("g.label", "g.name")).alias("label"), "g.color",
    )
    m = documents.select("project_id", image_id, "image_pos", first.alias("_first"), F.posexplode("d.measurements").alias("_at", "m"))
    m = m.withColumn("measurement_pos", F.col("_first") + F.col("_at"))
    measurement = m.select(
        "project_id", "image_id", "image_pos", F.col("m.id").alias("measurement_id"), "measurement_pos", F.col("m.fiber_group_id").alias("category_id"),
        F.coalesce("m.measurement_kind", F.lit("line")).alias("measurement_kind"),
        V.mapped(F.coalesce("m.mode", F.lit("manual")), V.MODE_UPGRADES).alias("mode"),
        F.col("m.line_px").alias("line"), F.col("m.snapped_line_px").alias("snapped_line"), _array("m.polyline_px").alias("polyline"),
        F.col("m.point_px").alias("point"), _array("m.polygon_px").alias("polygon"), _array("m.area_rings_px", 2).alias("area_rings"), "m.exact_area_px",
        F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), V.mapped(F.coalesce("m.status", F.lit("ready")), {"fiber_auto": "fiber_quick"}).alias("status"),
        "m.created_at", F.col("m.debug_payload").alias("debug_json"),
    )
    notes = F.coalesce("d.overlay_annotations", "d.text_annotations")
    kind = F.when(F.col("a.kind").isin("text", "rect", "circle", "line", "arrow"), F.col("a.kind")).otherwise("text")
    annotation = documents.select("project_id", image_id, F.explode(notes).alias("a")).select(
        "project_id", "image_id", F.col("a.id").alias("annotation_id"), kind.alias("kind"), "a.content", "a.anchor", "a.start", F.col("a.end").alias("end"), "a.created_at"
    )
    preset = projects.select("project_id", F.posexplode("calibration_presets").alias("preset_pos", "p")).select(
        "project_id", "preset_pos", "p.name", V.resolved_ppu(F.col("p.pixels_per_unit"), F.col("p.computed_pixels_per_unit")).alias("ppu"), "p.unit"
    )
    listed = projects.select("project_id", F.posexplode("project_group_templates").alias("template_pos", "t"))
    listed = listed.select("project_id", "template_pos", V.trimmed(F.col("t.label")).alias("label"), "t.color").where("label <> ''")
    first = F.row_number().over(Window.partitionBy("project_id", "label").orderBy("template_pos"))
    template = listed.withColumn("_first", first).where("_first = 1").drop("_first")
    whole = F.coalesce("part.number", F.lit(0)) == 0
    project = projects.where(whole).select("project_id", "version", F.col("project_default_calibration").alias("calibration"), F.col("metadata").alias("metadata_json"))
    return Archive(project, image, category, measurement, annotation, preset, template)


def _array(column: str, depth: int = 1) -> Column:
    kind = "struct<x:double,y:double>"
    for _ in range(depth):
        kind = f"array<{kind}>"
    return F.coalesce(F.col(column), F.array().cast(kind))


def derive(measurement: DataFrame, image: DataFrame) -> DataFrame:
    """Measurements with diameters, areas and display values under their images' calibrations."""
    kind = F.col("measurement_kind")
    line = V.effective_line(F.col("line"), F.col("snapped_line"))
    found = measurement.join(image.select("project_id", "image_id", "calibration"), ["project_id", "image_id"], "left")
    ppu = F.col("calibration.pixels_per_unit")
    px = found.withColumns(
        {"diameter_px": V.diameter_px(kind, line, F.col("polyline")), "area_px": V.area_px(kind, F.col("exact_area_px"), F.col("area_rings"), F.col("polygon"))}
    )
    units = px.withColumns({"diameter_unit": V.to_unit(F.col("diameter_px"), ppu), "area_unit": V.area_to_unit(F.col("area_px"), ppu)})
    value = V.display_value(kind, F.col("diameter_unit"), F.col("diameter_px"), F.col("area_unit"), F.col("area_px"))
    return units.withColumns({"display_value": value, "display_unit": V.display_unit(kind, F.col("calibration.unit"))})


def read_sidecars(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(image_path, calibration, calibration_line) of sidecar files; ``lines``: files with one sidecar a line."""
    return spark.read.schema(SIDECAR).option("multiLine", not lines).json(path).select("image_path", "calibration", "calibration_line")


def read_scale_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ppu, unit, error) of binary scale files: a little-endian float of µm per pixel at byte 0x180."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", SCALE_AT + 1, 4).alias("raw"))

    value = F.when(F.col("length") >= SCALE_BYTES, V.little_endian_float(F.col("raw")))
    error = F.when(F.col("length") < SCALE_BYTES, "too short").when(~(F.col("value") > 0) | F.col("value").isNull(), "not positive")
    stem = F.regexp_replace(V.file_name(F.col("path")), r"\.[^.]*$", "")
    found = files.withColumn("value", value).withColumn("error", error)
    return found.select("path", V.scale_name(stem).alias("name"), F.when(F.col("error").isNull(), 1 / F.nullif("value", F.lit(0.0))).alias("ppu"), F.lit("um").alias("unit"), "error")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) of a folder's images by lower-case name; not recursive. File contents aren't read."""
    return image_files(spark.read.format("binaryFile").load(folder).select("path")).orderBy("name")


def image_files(files: DataFrame) -> DataFrame:
    """Files (path) that are images, with their lower-case name."""
    name = F.lower(V.file_name(F.col("path")))
    return files.where(F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*IMAGE_SUFFIXES)).withColumn("name", name)


def saved_paths(images: DataFrame) -> DataFrame:
    """Images (source_type, path, folder) with the path and the absolute path that a project file in ``folder`` keeps: a
    file below the folder is named from there, with its absolute path beside it; others by their absolute path; assets
    of the project as they are."""
    path, folder = V.trimmed(F.col("path")), F.regexp_replace("folder", "/+$", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    below = whole.startswith(F.concat(folder, F.lit("/")))
    file = (F.col("source_type") == "filesystem") & (path != "")
    short = F.substring(whole, F.length(folder) + 2, F.length(whole))
    new = F.when(~file, F.col("path")).when(below, short).otherwise(whole)
    return images.withColumns({"absolute_path": F.when(file & below, whole), "path": new})


def classify_inputs(paths: DataFrame) -> DataFrame:
    """(path, kind) of dropped paths, once each: project, image or unsupported."""
    suffix = F.regexp_extract(F.lower(F.col("path")), r"\.([^./\\]+)$", 1)
    kind = F.when(suffix == "fdmproj", "project").when(suffix.isin(*IMAGE_SUFFIXES), "image").otherwise("unsupported")
    return paths.select("path", kind.alias("kind")).distinct()


def resolve_paths(images: DataFrame, files: DataFrame) -> DataFrame:
    """(image_id, found, how, repaired): where each image's file is.

    ``images``: image_id, folder, source_type, path, absolute_path; ``files``: path of what exists. Tried in order: a
    project's own asset, the absolute path, the path if it is absolute, the path in the project's folder, the file
    name in it. ``repaired``: an absolute path was there but led nowhere.
    """
    path, backup = V.trimmed(F.col("path")), V.trimmed(F.col("absolute_path"))
    foreign = r"^([A-Za-z]:|\\\\)"
    is_absolute = path.startswith("/")
    name = V.file_name(F.when(path != "", path).otherwise(backup))
    inside = F.concat(F.col("folder"), F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    asset = F.col("source_type") == "project_asset"
    tries = F.array(
        *(
            F.struct(F.lit(rank).alias("rank"), F.lit(how).alias("how"), F.when(condition, candidate).alias("candidate"))
            for rank, (how, condition, candidate) in enumerate(
                [
                    ("project_asset", asset, inside),
                    ("absolute_path", ~asset & (backup != "") & ~backup.rlike(foreign), backup),
                    ("path", ~asset & is_absolute, path),
                    ("relative_path", ~asset & (path != "") & ~is_absolute & ~path.rlike(foreign), inside),
                    ("project_dir_filename", ~asset & (name != ""), F.concat(F.col("folder"), F.lit("/"), name)),
                ]
            )
        )
    )
    asked = images.select("image_id", (~asset & ((backup != "") | is_absolute | path.rlike(foreign))).alias("had_absolute"), F.explode(tries).alias("t"))
    asked = asked.where("t.candidate is not null").select("image_id", "had_absolute", "t.rank", "t.how", "t.candidate")
    hit = asked.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    best = hit.groupBy("image_id").agg(F.min(F.struct("rank", "how", "candidate", "had_absolute")).alias("b"))
    found = best.select("image_id", F.col("b.candidate").alias("found"), F.col("b.how").alias("how"), ((F.col("b.rank") >= 3) & F.col("b.had_absolute")).alias("repaired"))
    return images.select("image_id").join(found, "image_id", "left")
