"""The wide detail rows of a report: 32 columns for each measurement, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V
from ..operators.lookup import with_category
from ..operators.ordinal import running_number

# The columns' names, in their order.
COLUMNS = [
    "纤维种类", "类型", "结果", "单位", "标尺信息", "模式", "状态", "置信度", "纤维结果序号", "纤维类别结果序号",
    "起点X(px)", "起点Y(px)", "终点X(px)", "终点Y(px)", "像素直径(px)", "多边形点数", "多边形顶点JSON", "折线点数", "折线顶点JSON",
    "计数点X(px)", "计数点Y(px)", "面积(px²)", "孔洞面积", "创建时间", "图片路径", "图片编号", "测量记录ID", "纤维种类ID",
    "纤维类别序号", "纤维种类编号", "纤维种类名称", "纤维种类颜色",
]


def record_rows(measurements: DataFrame, categories: DataFrame) -> DataFrame:
    """(image_pos, measurement_pos, and ``COLUMNS``) of measurements with derived values and their image's calibration.

    ``categories``: image_id, category_id, number, label, color. Coordinates have three places, results six and
    confidences four; what another kind of measurement has is null, or empty for texts.
    """
    found = with_category(measurements, categories, ["image_id", "category_id"])
    found = running_number(found, ["measurement_kind"], "image_pos", ["measurement_pos"], "_by_kind")
    found = running_number(found, ["measurement_kind", "label"], "image_pos", ["measurement_pos"], "_by_label")
    kind, line, path = F.col("measurement_kind"), V.effective_line(F.col("line"), F.col("snapped_line")), F.col("polyline")
    is_line, is_path, is_count, is_area = (kind == k for k in ("line", "polyline", "count", "area"))
    first, last = F.get(path, F.lit(0)), F.get(path, F.size(path) - 1)
    value = V.display_value(kind, F.col("diameter_unit"), F.col("diameter_px"), F.col("area_unit"), F.col("area_px"))
    hole = V.area_to_unit(G.rings_hole_area(F.col("area_rings")), F.col("ppu"))
    name = F.when(F.col("number").isNotNull(), V.display_name(F.col("number"), F.col("label"))).otherwise(F.col("label"))

    def end(a, b):
        return V.rounded(F.when(is_line, a).when(is_path, b), 3)

    def zero(column):
        return V.rounded(F.coalesce(column, F.lit(0.0)), 6)

    cells = [
        name, V.mapped(kind, V.KIND_LABELS), V.rounded(value, 6), V.display_unit(kind, F.col("unit")), V.calibration_info(F.col("calibration_mode"), F.col("calibration_source")),
        V.mapped(F.col("mode"), V.MODE_LABELS), V.mapped(F.col("status"), V.STATUS_LABELS), V.rounded("confidence", 4), F.col("_by_kind"), F.col("_by_label"),
        end(line["start"]["x"], first["x"]), end(line["start"]["y"], first["y"]), end(line["end"]["x"], last["x"]), end(line["end"]["y"], last["y"]),
        F.when(is_line | is_path, zero(F.col("diameter_px"))), F.when(is_area, F.size("polygon")), F.when(is_area, T.json_points(F.col("polygon"))).otherwise(""),
        F.when(is_path, F.size(path)), F.when(is_path, T.json_points(path)).otherwise(""),
        V.rounded(F.when(is_count, F.col("point.x")), 3), V.rounded(F.when(is_count, F.col("point.y")), 3),
        F.when(is_area, zero(F.col("area_px"))), F.when(is_area, zero(hole)), F.col("created_at"), F.col("image_path"), F.col("image_id"), F.col("measurement_id"),
        F.coalesce(F.col("category_id"), F.lit("")), F.col("number"), F.col("number"), F.col("label"), F.col("color"),
    ]
    return found.select("image_pos", "measurement_pos", *(c.alias(n) for c, n in zip(cells, COLUMNS)))
