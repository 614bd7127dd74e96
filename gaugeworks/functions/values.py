"""Derived values of measurements: calibration, display values and localized labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

# What the reports say for each code.
UNCATEGORIZED = "未分类"
UNCATEGORIZED_COLOR = "#98A2B3"
UNCALIBRATED = "未标定"
CALIBRATION_LABELS = {
    "preset": "标定预设",
    "image_scale": "图内标定",
    "project_default": "项目统一比例尺",
    "none": "未标定",
}
MODE_LABELS = {
    "manual": "手动线段",
    "continuous_manual": "连续测量",
    "count": "计数",
    "snap": "边缘吸附",
    "fiber_auto": "快速测径",
    "fiber_quick": "快速测径",
    "polygon_area": "多边形面积",
    "freehand_area": "自由形状面积",
    "magic_segment": "魔棒分割",
    "auto_instance": "实例分割",
    "reference_instance": "同类扩选",
}
KIND_LABELS = {"line": "线段", "polyline": "折线", "area": "面积", "count": "计数点"}
STATUS_LABELS = {
    "manual": "手动测量",
    "continuous_manual": "连续测量",
    "manual_review": "需人工复核",
    "snapped": "吸附成功",
    "edited": "已编辑",
    "line_too_short": "测量线过短",
    "profile_too_flat": "灰度变化不足",
    "edge_pair_not_found": "未找到有效边缘",
    "component_not_found": "未找到目标区域",
    "centerline_not_found": "未找到可靠中心线",
    "boundary_not_found": "未找到边界",
    "fiber_auto": "快速测径",
    "fiber_quick": "快速测径",
    "count": "计数",
    "reference_instance": "同类扩选",
}
MODE_UPGRADES = {"fiber_auto": "fiber_quick", "continuous": "continuous_manual"}
PALETTE = ["#1F7A8C", "#E07A5F", "#81B29A", "#3D405B", "#F2CC8F", "#6D597A", "#227C9D", "#FF7C43", "#2A9D8F"]


def mapped(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; unknown codes pass through."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items()))
    return F.coalesce(F.try_element_at(table, code), code)


def rounded(value: Column | str, places: int) -> Column:
    """A number to some places, halves away from zero, of the number times a power of ten, as SQL engines that work in binary do;
    Spark's own takes the shortest decimal text, by which 47.3705 + 27 is less than 74.3705."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * float(10**places), 0) / float(10**places)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def to_unit(px: Column, ppu: Column) -> Column:
    """Pixels to units; the pixel value without a positive calibration."""
    return F.when(ppu.isNull() | (ppu <= 0), px).otherwise(px / F.nullif(ppu, F.lit(0.0)))


def to_px(value: Column, ppu: Column) -> Column:
    return value * ppu


def area_to_unit(px: Column, ppu: Column) -> Column:
    return F.when(ppu.isNull() | (ppu <= 0), px).otherwise(px / F.nullif(ppu * ppu, F.lit(0.0)))


def resolved_ppu(ppu: Column, computed: Column) -> Column:
    """A preset's scale: the computed one unless it is missing or 0."""
    return F.coalesce(F.nullif(computed, F.lit(0.0)), ppu)


def effective_line(line: Column, snapped: Column) -> Column:
    return F.coalesce(snapped, line)


def diameter_px(kind: Column, line: Column, polyline: Column) -> Column:
    return F.when(kind.isin("area", "count"), F.lit(None).cast("double")).when(kind == "polyline", G.polyline_length(polyline)).otherwise(G.line_length(line))


def area_px(kind: Column, exact: Column, rings: Column, polygon: Column) -> Column:
    """An exact area wins, then rings, then the polygon; null for other kinds."""
    shape = F.when(F.coalesce(F.size(rings), F.lit(0)) > 0, G.rings_area(rings)).otherwise(G.polygon_area(polygon))
    return F.when(kind == "area", F.coalesce(exact, shape))


def display_value(kind: Column, diameter_unit: Column, diameter: Column, area_unit: Column, area: Column) -> Column:
    zero = F.lit(0.0)
    return (
        F.when(kind == "area", F.coalesce(area_unit, area, zero)).when(kind == "count", F.lit(1.0)).otherwise(F.coalesce(diameter_unit, diameter, zero))
    )


def display_unit(kind: Column, unit: Column) -> Column:
    unit = F.coalesce(unit, F.lit("px"))
    return F.when(kind == "area", F.concat(unit, F.lit("²"))).when(kind == "count", F.lit("个")).otherwise(unit)


def fixed(value: Column, digits: int) -> Column:
    """A double with ``digits`` decimals, rounded as the binary number stands, exact halves to the even digit.

    The product with the power of ten is taken with its error, so it is known on which side of a half a value lies.
    """
    power, size = float(10**digits), F.abs(value.cast("double"))

    def halves(v: Column | float) -> tuple:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (a, b), (c, d) = halves(size), halves(power)
    product = size * power
    error = a * c - product + a * d + b * c + b * d
    whole = F.floor(product)
    over = product - whole - 0.5  # exact; its sign counts, then the error's, then whether the number is odd
    up = (over > 0) & ~((over <= 1e-9) & (error < -over)) | (over == 0) & ((error > 0) | (error == 0) & (whole % 2 == 1)) | (over < 0) & (error > -over)
    n = whole + F.when(up, 1).otherwise(0)
    text = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(digits + 1)), "0")
    places = F.length(text) - digits
    number = text if digits == 0 else F.concat(F.substring(text, F.lit(1), places), F.lit("."), F.substring(text, places + 1, F.lit(digits)))
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(product < 4503599627370496.0, F.concat(sign, number)).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def label_text(value: Column, unit: Column, digits: int = 4) -> Column:
    return F.concat(fixed(value, max(0, min(8, digits))), F.lit(" "), F.coalesce(unit, F.lit("null")))


def calibration_info(mode: Column, source: Column) -> Column:
    """"mode / source", or the mode alone; an uncalibrated image says so."""
    name = F.when(F.coalesce(mode, F.lit("")) == "", F.lit(UNCALIBRATED)).otherwise(mapped(mode, CALIBRATION_LABELS))
    source = trimmed(source)
    return F.when(mode.isNull(), F.lit(UNCALIBRATED)).when(source == "", name).otherwise(F.concat(name, F.lit(" / "), source))


def display_name(number: Column, label: Column) -> Column:
    return trimmed(F.concat(number.cast("string"), F.lit(" "), F.coalesce(label, F.lit(""))))


def scale_name(stem: Column) -> Column:
    """A binary scale file's name without its date."""
    return F.regexp_replace(stem, r"-\d{4}\.\d{2}\.\d{2}$", "")


def file_name(token: Column) -> Column:
    """The last part of a POSIX, Windows or UNC path."""
    return F.regexp_extract(token, r"([^\\/]+)[\\/]*$", 1)


def class_labels(model: Column, aliases: dict[str, str], default: str = UNCATEGORIZED) -> Column:
    """Labels of a model's name: split at "-", aliased, distinct in order."""
    parts = F.filter(F.transform(F.split(model, "-"), trimmed), lambda p: p != "")
    names = F.array_distinct(F.transform(parts, lambda p: mapped(p, aliases)))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def line_calibration(length_px: Column, actual: Column) -> Column:
    """Pixels per unit of a drawn line whose length is known; null unless both are positive."""
    return F.when((actual > 0) & (length_px > 0), length_px / F.nullif(actual, F.lit(0.0)))


def scale_bar(value: Column, ppu: Column, unit: Column, output_scale: Column) -> Column:
    """struct (value, unit, pixels) of a scale bar; null for a value that isn't positive."""
    px = F.when(ppu.isNull(), value * output_scale).otherwise(to_px(value, ppu) * output_scale)
    bar = F.struct(value.alias("value"), F.when(ppu.isNull(), "px").otherwise(unit).alias("unit"), px.alias("pixels"))
    return F.when(value > 0, bar)


def result_label(model: Column, label: Column, aliases: dict[str, str], swaps: dict[str, dict[str, str]]) -> Column:
    """The label of a detection: trimmed, aliased, and swapped for the models that give two labels the wrong way round."""
    name = trimmed(label)
    plain = F.when(name == "", UNCATEGORIZED).otherwise(mapped(name, aliases))
    model, out = F.replace(trimmed(model), F.lit(" "), F.lit("")), None
    for swapped, table in swaps.items():
        out = (F if out is None else out).when(model == swapped, mapped(plain, table))
    return plain if out is None else out.otherwise(plain)


def option(value: Column, default: float, low: float, high: float) -> Column:
    """A model's option: the default where it is missing or 0, then within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), F.lit(default))))


def hole_area_unit(rings: Column, ppu: Column) -> Column:
    return area_to_unit(G.rings_hole_area(rings), ppu)


def little_endian_float(raw: Column) -> Column:
    """The number that four bytes hold as a little-endian 32-bit float."""
    digits = F.hex(raw)
    bits = F.conv(F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1))), 16, 10).cast("long")
    sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1)) / float(1 << 23)
    normal = (1 + fraction) * F.pow(F.lit(2.0), exponent - 127)
    number = F.when(exponent == 0, fraction * 2.0**-126).when(exponent < 255, normal).when(fraction == 0, float("inf")).otherwise(float("nan"))
    return F.when(F.length(raw) == 4, sign * number)
