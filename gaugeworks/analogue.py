"""The driver tables seen as a measurement archive: customers are images, orders measurements, line items vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import values as V
from .session import table

#: The same archive for DuckDB: ``m`` has the measurements with their derived values.
MEASUREMENTS_SQL = """
    image AS (
        SELECT c_custkey AS image_id,
               CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0.0
                    ELSE 1 + (c_custkey % 10) / 4.0 END AS ppu
        FROM customer
    ),
    base AS (
        SELECT o_custkey AS image_id, o_orderkey AS measurement_id,
               CASE WHEN o_orderkey % 13 = 0 THEN 'count' WHEN o_orderstatus = 'F' THEN 'line'
                    WHEN o_orderstatus = 'O' THEN 'area' ELSE 'polyline' END AS kind,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS label,
               CAST(o_orderkey % 100 AS DOUBLE) AS x0, CAST(o_custkey % 100 AS DOUBLE) AS y0,
               o_totalprice / 1000 AS dx, CAST(o_orderkey % 50 AS DOUBLE) AS dy,
               CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS exact,
               CAST(1 + o_orderkey % 40 AS DOUBLE) AS w, CAST(1 + o_custkey % 30 AS DOUBLE) AS h
        FROM orders
    ),
    px AS (
        SELECT b.*, i.ppu,
               CASE kind WHEN 'line' THEN sqrt(dx * dx + dy * dy) WHEN 'polyline' THEN 10 + abs(dx) END AS diameter_px,
               CASE kind WHEN 'area' THEN coalesce(exact, w * h) END AS area_px
        FROM base b JOIN image i ON b.image_id = i.image_id
    ),
    m AS (
        SELECT *, CASE WHEN ppu > 0 THEN diameter_px / ppu ELSE diameter_px END AS diameter_unit,
               CASE WHEN ppu > 0 THEN area_px / (ppu * ppu) ELSE area_px END AS area_unit
        FROM px
    )
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    ppu = F.when(key % 7 == 0, F.lit(None).cast("double")).when(key % 11 == 0, 0.0).otherwise(1 + (key % 10) / 4.0)
    return table(spark, sf_dir, "customer").select(key.alias("image_id"), ppu.alias("ppu"))


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with their geometry, nothing derived."""
    key, image = F.col("o_orderkey"), F.col("o_custkey")
    kind = (
        F.when(key % 13 == 0, "count").when(F.col("o_orderstatus") == "F", "line").when(F.col("o_orderstatus") == "O", "area").otherwise("polyline")
    )
    x0, y0, dx, dy = key % 100, image % 100, F.col("o_totalprice") / 1000, key % 50
    start, corner = G.point(x0, y0), G.point(x0 + 10, y0)
    w, h = 1 + key % 40, 1 + image % 30
    polygon = F.array(start, G.point(x0 + w, y0), G.point(x0 + w, y0 + h), G.point(x0, y0 + h))
    return table(spark, sf_dir, "orders").select(
        image.alias("image_id"),
        key.alias("measurement_id"),
        kind.alias("measurement_kind"),
        F.when(key % 17 != 0, F.col("o_orderpriority")).alias("label"),
        F.struct(start.alias("start"), G.point(x0 + dx, y0 + dy).alias("end")).alias("line"),
        F.array(start, corner, G.point(x0 + 10, y0 + dx)).alias("polyline"),
        polygon.alias("polygon"),
        F.when(key % 5 == 0, F.col("o_totalprice")).alias("exact_area_px"),
    )


def derived(measurements: DataFrame, images_: DataFrame) -> DataFrame:
    """Measurements with diameters and areas in pixels and units under their image's calibration."""
    kind = F.col("measurement_kind")
    rings = F.array(F.col("polygon"))
    px = measurements.join(images_, "image_id").withColumns(
        {"diameter_px": V.diameter_px(kind, F.col("line"), F.col("polyline")), "area_px": V.area_px(kind, F.col("exact_area_px"), rings, F.col("polygon"))}
    )
    return px.withColumns({"diameter_unit": V.to_unit(F.col("diameter_px"), F.col("ppu")), "area_unit": V.area_to_unit(F.col("area_px"), F.col("ppu"))})


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(raw_measurements(spark, sf_dir), images(spark, sf_dir))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, points): each order's line items as the vertices of a path."""
    vertex = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        G.point(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("p"),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.transform(F.sort_array(F.collect_list(vertex)), lambda v: v["p"]).alias("points"))
    )


#: The vertices for DuckDB, with the next vertex of the path and of the closed ring.
VERTICES_SQL = """
    v AS (
        SELECT l_orderkey AS id, l_quantity AS x, l_extendedprice / 1000 AS y,
               row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)
    ),
    e AS (
        SELECT a.id, a.i, a.n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.x * b.y - b.x * a.y AS c,
               sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d
        FROM v a JOIN v b ON a.id = b.id AND b.i = a.i % a.n + 1
    )
"""
