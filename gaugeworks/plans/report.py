"""Report rules: small declarative queries, compiled to a DataFrame of cells.

A rule names a source, a field, a filter by kind and a place (sheet, start cell, end cell, direction). Places
are arithmetic on positions; the rules are a short list on the driver, the rows never leave Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import KIND_LABELS, UNCATEGORIZED


class ReportError(ValueError):
    """A rule that can't be laid out."""


@dataclass(frozen=True)
class Rule:
    data_source: str  # diameter_result, area_result, measurement_field or unique_field_range
    sheet_name: str
    start_cell: str
    end_cell: str = ""
    direction: str = "vertical"
    field_name: str = ""
    measurement_filter: str = "all"

    @property
    def kind(self) -> str | None:
        """The localized kind that rows must have."""
        code = {"diameter_result": "line", "area_result": "area"}.get(self.data_source, self.measurement_filter)
        return None if code == "all" else KIND_LABELS.get(code, "")


def cell(name: str) -> tuple[int, int]:
    """(row, column) from 1 of a name like ``BA11``."""
    found = re.fullmatch(r"\s*\$?([A-Za-z]+)\$?([0-9]+)\s*", name or "")
    if not found:
        raise ReportError(f"not a cell: {name!r}")
    column = 0
    for letter in found[1].upper():
        column = column * 26 + ord(letter) - 64
    if int(found[2]) < 1:
        raise ReportError(f"rows count from 1: {name!r}")
    return int(found[2]), column


def column_letters(column: int) -> str:
    out = ""
    while column > 0:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def capacity(rule: Rule) -> int:
    """How many cells a range has along its direction."""
    (r0, c0), (r1, c1) = cell(rule.start_cell), cell(rule.end_cell)
    across, along = (r0 == r1, c1 - c0) if rule.direction == "horizontal" else (c0 == c1, r1 - r0)
    if not across or along < 0:
        raise ReportError(f"not a {rule.direction} range: {rule.start_cell}:{rule.end_cell}")
    return along + 1


def category_labels(categories: DataFrame, measurements: DataFrame) -> DataFrame:
    """(label, place): distinct labels by image and number, uncategorized last if any measurement has no category."""
    first = (
        categories.where(F.trim("label") != "")
        .groupBy(F.trim("label").alias("label"))
        .agg(F.min(F.struct("image_pos", "number")).alias("first"))
        .select("label", F.lit(0).alias("last"), "first")
    )
    none = measurements.where("category_id is null").limit(1).select(
        F.lit(UNCATEGORIZED).alias("label"), F.lit(1).alias("last"), F.lit(None).cast(first.schema["first"].dataType).alias("first")
    )
    both = first.unionByName(none.join(first, "label", "left_anti"))
    return both.select("label", F.row_number().over(Window.orderBy("last", "first")).alias("place"))


def _matching(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows if rule.kind is None else rows.where(F.col("kind_label") == rule.kind)


def _placed(rows: DataFrame, rule: Rule, across, along) -> DataFrame:
    """(sheet, row, column, value) at offsets across and along the rule's direction."""
    r0, c0 = cell(rule.start_cell)
    down, right = (along, across) if rule.direction == "vertical" else (across, along)
    return rows.select(F.lit(rule.sheet_name.strip()).alias("sheet"), (F.lit(r0) + down).cast("int").alias("row"), (F.lit(c0) + right).cast("int").alias("column"), "value")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place from 0, by image and position: counted by image first."""
    from ..operators.ordinal import running_number

    return running_number(rows, [], "image_pos", ["measurement_pos"], "place").withColumn("place", F.col("place") - 1)


def rule_cells(rule: Rule, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The cells that a rule writes. ``rows`` are detail rows with image_pos, measurement_pos, label, kind_label,
    display_value (unrounded) and result (rounded); ``labels`` are :func:`category_labels`."""
    found = _matching(rows, rule)
    if rule.data_source == "unique_field_range":
        most, field = capacity(rule), rule.field_name or "label"
        first = found.where("label <> ''").groupBy("label").agg(
            F.min_by(F.col(field).cast("string"), F.struct("image_pos", "measurement_pos")).alias("value"), F.min(F.struct("image_pos", "measurement_pos")).alias("first")
        )
        placed = first.join(labels, "label", "left")
        offset = F.row_number().over(Window.orderBy(F.col("place").asc_nulls_last(), "first")) - 1
        cells = placed.withColumn("offset", offset).where(F.col("offset") < most)
        return _placed(cells, rule, F.lit(0), F.col("offset"))
    plain = {"diameter_result": "display_value", "area_result": "display_value"}
    if rule.end_cell.strip():  # one line of cells for each category, of rounded results
        sideways = Rule(rule.data_source, rule.sheet_name, rule.start_cell, rule.end_cell, "horizontal" if rule.direction == "vertical" else "vertical")
        most, n = capacity(sideways), labels.count()
        if n > most:
            raise ReportError(f"{rule.start_cell}:{rule.end_cell} has room for {most} categories, there are {n}")
        value = "result" if rule.data_source in plain else rule.field_name or "result"
        at = F.row_number().over(Window.partitionBy("label").orderBy("image_pos", "measurement_pos")) - 1
        cells = found.join(labels, "label").withColumn("at", at).withColumn("value", F.col(value).cast("string"))
        return _placed(cells, rule, F.col("place") - 1, F.col("at"))
    value = plain.get(rule.data_source, rule.field_name or "result")
    return _placed(_numbered(found).withColumn("value", F.col(value).cast("string")), rule, F.lit(0), F.col("place"))


def report_cells(rules: list[Rule], rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, sheet, row, column, value) of all rules."""
    parts = [rule_cells(rule, rows, labels).withColumn("rule", F.lit(i)) for i, rule in enumerate(rules)]
    return reduce(DataFrame.unionByName, parts)


def with_fallback(rules: list[Rule], rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """The cells of all rules and no message; or, where a rule can't be laid out or cells overlap, the results of all
    rows as a plain list on sheet A, and why."""
    try:
        cells = report_cells(rules, rows, labels)
        if not overlaps(cells, rules).head(1):
            return cells, ""
        message = "rules overlap"
    except ReportError as error:
        message = str(error)
    return report_cells([Rule("measurement_field", "A", "A1", field_name="result")], rows, labels), message


def overlaps(cells: DataFrame, rules: list[Rule] = ()) -> DataFrame:
    """(sheet, row, column, n) taken by more than one rule: written, or in the range of one of ``rules`` that keeps its whole
    range for distinct values, however many there are."""
    taken = cells.select("sheet", "row", "column", "rule")
    for i, rule in enumerate(rules):
        if rule.data_source == "unique_field_range":
            whole = cells.sparkSession.range(capacity(rule)).withColumn("value", F.lit(None).cast("string"))
            taken = taken.unionByName(_placed(whole, rule, F.lit(0), F.col("id")).select("sheet", "row", "column", F.lit(i).alias("rule")))
    return taken.groupBy("sheet", "row", "column").agg(F.count_distinct("rule").alias("n")).where("n > 1")


def planned_outputs(images: DataFrame, kinds: list[str], per_image: list[str]) -> DataFrame:
    """(kind, image_id, file_name) of the files that an export makes; a scale file needs a calibration."""
    each = images.select("image_id", "stem", "calibrated", F.explode(F.array(*map(F.lit, per_image))).alias("kind"))
    each = each.where((F.col("kind") != "scale_json") | F.col("calibrated"))
    name = F.concat(F.coalesce(F.nullif(F.col("stem"), F.lit("")), F.col("image_id").cast("string")), F.lit("_"), F.col("kind"))
    whole = images.sparkSession.createDataFrame([(k, None, k) for k in kinds], "kind string, image_id string, file_name string")
    return each.select("kind", F.col("image_id").cast("string").alias("image_id"), name.alias("file_name")).unionByName(whole)
