"""Texts of numbers, colours, ids and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import rounded, trimmed


def plain_number(value: Column) -> Column:
    """A whole number without a point, else the shortest digits that give the number back."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def dimension(value: Column) -> Column:
    """To four places, without zeros at the end."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), "0+$", ""), r"\.$", "")
    return F.when(text == "", "0").otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """``digits`` places, 0 to 8; the decimal text of the number is rounded half up."""
    return F.format_string(f"%.{max(0, min(8, digits))}f", value)


def color(value: Column, fallback: str = "#1f7a8c") -> Column:
    """``#rrggbb`` in lower case; short forms are doubled, anything else becomes the fallback."""
    name = F.lower(trimmed(value))
    double = F.regexp_replace(name, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    return F.when(double.rlike("^#[0-9a-f]{6}$"), double).otherwise(fallback.lower())


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 12 hex digits that the parts decide."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 12))


def stamp(time: Column) -> Column:
    """``YYYYmmdd_HHMMSS`` in the session's time zone."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def iso_seconds(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def folded_case(text: Column) -> Column:
    """Lower case for comparing; a sharp s counts as two."""
    return F.replace(F.lower(F.replace(text, F.lit("ẞ"), F.lit("ss"))), F.lit("ß"), F.lit("ss"))


def json_points(points: Column) -> Column:
    """``[{"x": 1.0, "y": 2.5}, ...]`` with three places and blanks after colons and commas."""
    one = F.transform(
        points,
        lambda p: F.concat(F.lit('{"x": '), rounded(p["x"], 3).cast("string"), F.lit(', "y": '), rounded(p["y"], 3).cast("string"), F.lit("}")),
    )
    return F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))
