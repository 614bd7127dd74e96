"""The reference queries by name, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analogue as A
from .analogue import MEASUREMENTS_SQL as M
from .analogue import VERTICES_SQL as E
from .functions import geometry as G
from .functions import text as T
from .functions import values as V
from .operators import aggregate, lookup, mutate, nearest, ordinal, sequential, spatial
from .plans import report
from .session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def r4(column) -> Column:
    """To four places; what is added takes exact halves up in every engine."""
    return F.round((F.col(column) if isinstance(column, str) else column) + 1e-7, 4)


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


# ---------------------------------------------------------------- summaries


@query(f"""
    WITH {M}
    SELECT i.image_id, count(m.measurement_id) AS n, count(*) FILTER (WHERE kind = 'line') AS n_line,
           count(*) FILTER (WHERE kind = 'area') AS n_area,
           round(avg(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS mean,
           round(min(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS min,
           round(max(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS max,
           round(stddev_pop(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS stddev
    FROM image i LEFT JOIN m ON i.image_id = m.image_id GROUP BY i.image_id
""")
def image_summary(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.image_summary(A.images(spark, d), A.measurements(spark, d))
    return found.select("image_id", "n", "n_line", "n_area", *(r4(F.col(c)).alias(c) for c in ("mean", "min", "max", "stddev")))


@query(f"""
    WITH {M}, category AS (SELECT DISTINCT image_id, label FROM m WHERE label IS NOT NULL
                           UNION ALL SELECT image_id, 'empty' FROM image)
    SELECT c.image_id, c.label, count(m.measurement_id) AS n,
           round(avg(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS mean,
           round(min(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS min,
           round(max(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS max,
           round(stddev_pop(diameter_unit) FILTER (WHERE kind = 'line') + 1e-7, 4) AS stddev
    FROM category c LEFT JOIN m ON c.image_id = m.image_id AND c.label = m.label GROUP BY c.image_id, c.label
""")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    m = A.measurements(spark, d)
    categories = m.where("label is not null").select("image_id", "label").distinct()
    categories = categories.unionByName(A.images(spark, d).select("image_id", F.lit("empty").alias("label")))
    found = aggregate.category_summary(categories, m, ["image_id", "label"])
    return found.select("image_id", "label", "n", *(r4(F.col(c)).alias(c) for c in ("mean", "min", "max", "stddev")))


@query(f"""
    WITH {M}
    SELECT (SELECT count(*) FROM image) AS images, count(*) AS measurements, count(DISTINCT label) AS labels,
           count(*) FILTER (WHERE label IS NULL) AS uncategorized FROM m
""")
def project_totals(spark: SparkSession, d: str) -> DataFrame:
    m = A.raw_measurements(spark, d)
    per_image = m.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("none"))
    totals = A.images(spark, d).join(per_image, "image_id", "left").agg(
        F.count(F.lit(1)).alias("images"), F.sum("n").alias("measurements"), F.sum("none").alias("uncategorized")
    )
    labels = m.agg(F.count_distinct("label").alias("labels"))
    return totals.join(labels, on=F.lit(True)).select("images", "measurements", "labels", "uncategorized")


@query("""
    SELECT trim(coalesce(CASE WHEN o_orderkey % 9 = 0 THEN '  ' WHEN o_orderkey % 10 = 0 THEN ' ' || o_orderpriority || ' '
                              ELSE o_orderpriority END, '')) AS label, count(*) AS n FROM orders GROUP BY 1
""")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    key, p = F.col("o_orderkey"), F.col("o_orderpriority")
    label = F.when(key % 9 == 0, "　 ").when(key % 10 == 0, F.concat(F.lit(" "), p, F.lit("\t"))).otherwise(p)
    return aggregate.label_counts(table(spark, d, "orders").select(label.alias("label")))


@query(f"""
    WITH {M}, f AS (SELECT coalesce(label, '未分类') AS label, label IS NULL AS none, min(measurement_id) AS first FROM m GROUP BY 1, 2)
    SELECT label, row_number() OVER (ORDER BY none, first) AS place FROM f
""")
def used_labels(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    found = aggregate.used_labels(A.raw_measurements(spark, d), F.col("measurement_id"))
    return found.select("label", F.row_number().over(Window.orderBy("none", "first")).cast("long").alias("place"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.outcome_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""
    SELECT l_suppkey, round(CASE WHEN coalesce(avg(l_quantity), 0) <= 1e-6 THEN 1.0
                                 ELSE stddev_pop(l_quantity) / avg(l_quantity) END + 1e-7, 4) AS cv FROM lineitem GROUP BY 1
""")
def cv_by_group(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.coefficient_of_variation(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")
    return found.select("l_suppkey", r4("cv").alias("cv"))


@query("""
    WITH b AS (SELECT event_type, least(floor((value - 0) / 100 * 16), 15)::INT AS bin FROM events WHERE value BETWEEN 0 AND 100),
         c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT event_type, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY event_type)), 6) AS weight FROM c
""")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.histogram(_events(spark, d), "event_type", "value", 16, 0.0, 100.0)
    return found.select("event_type", "bin", F.round("weight", 6).alias("weight"))


@query("""
    WITH med AS (SELECT l_suppkey, median(l_quantity) AS median FROM lineitem GROUP BY 1),
    near AS (
        SELECT l.*, median, l_discount * 10 AS score FROM lineitem l JOIN med USING (l_suppkey)
        WHERE abs(l_quantity - median) <= greatest(2.0, 0.18 * median) AND l_discount * 10 >= 0.22
    )
    SELECT l_suppkey, l_quantity AS width, round(score + 1e-7, 4) AS score, l_orderkey, l_linenumber, l_partkey, l_extendedprice
    FROM near QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_quantity - median), score DESC,
                                         l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1
""")
def median_band_pick(spark: SparkSession, d: str) -> DataFrame:
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("width"), (F.col("l_discount") * 10).alias("score"), *ties)
    return aggregate.median_band(rows, "l_suppkey", "width", "score", ties=ties).select("l_suppkey", "width", r4("score").alias("score"), *ties)


@query("""
    WITH per AS (SELECT p_brand, p_size % 3 AS cls, sum(p_size)::DOUBLE AS area FROM part WHERE p_size % 4 <> 0 GROUP BY 1, 2),
         cls AS (SELECT DISTINCT p_brand, c AS cls FROM part, (VALUES (0), (1), (2), (7)) t(c))
    SELECT cls.p_brand, cls.cls, coalesce(area, 0.0) AS area_px FROM cls LEFT JOIN per USING (p_brand, cls)
""")
def class_areas(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    classes = part.select("p_brand").distinct().select("p_brand", F.explode(F.array(*map(F.lit, (0, 1, 2, 7)))).alias("cls"))
    found = part.where("p_size % 4 <> 0").select("p_brand", (F.col("p_size") % 3).alias("cls"), F.col("p_size").cast("double").alias("area_px"))
    return aggregate.class_areas(classes, found, ["p_brand", "cls"])


@query("SELECT user_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY 1")
def pixel_statistics(spark: SparkSession, d: str) -> DataFrame:
    from .operators.pixels import frame_measures as measured

    found = measured(_events(spark, d).select(F.col("user_id").alias("id"), "value"))
    return found.select(F.col("id").alias("user_id"), r4("mean").alias("mean"), r4("deviation").alias("deviation"))


# ---------------------------------------------------------------- derived values


@query(f"""
    WITH {M}
    SELECT measurement_id, round(diameter_px + 1e-7, 4) AS diameter_px, round(area_px + 1e-7, 4) AS area_px,
           round(diameter_unit + 1e-7, 4) AS diameter_unit, round(area_unit + 1e-7, 4) AS area_unit FROM m
""")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    columns = ("diameter_px", "area_px", "diameter_unit", "area_unit")
    return A.measurements(spark, d).select("measurement_id", *(r4(c).alias(c) for c in columns))


@query(f"""
    WITH {M}
    SELECT measurement_id,
           round(CASE kind WHEN 'area' THEN coalesce(area_unit, area_px, 0) WHEN 'count' THEN 1.0
                           ELSE coalesce(diameter_unit, diameter_px, 0) END + 1e-7, 4) AS value,
           CASE kind WHEN 'area' THEN unit || '²' WHEN 'count' THEN '个' ELSE unit END AS unit
    FROM (SELECT *, CASE WHEN ppu IS NULL THEN 'px' ELSE 'um' END AS unit FROM m)
""")
def display_values(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("measurement_kind")
    value = V.display_value(kind, F.col("diameter_unit"), F.col("diameter_px"), F.col("area_unit"), F.col("area_px"))
    unit = V.display_unit(kind, F.when(F.col("ppu").isNotNull(), "um"))
    return A.measurements(spark, d).select("measurement_id", r4(value).alias("value"), unit.alias("unit"))


@query(f"""
    WITH {M}
    SELECT measurement_id, coalesce(label, '未分类') AS label, CASE WHEN label IS NULL THEN '#98A2B3' ELSE '#' || left(md5(label), 6) END AS color,
           CASE kind WHEN 'line' THEN '线段' WHEN 'polyline' THEN '折线' WHEN 'area' THEN '面积' ELSE '计数点' END AS kind_label,
           CASE WHEN kind = 'line' THEN round(x0, 3) WHEN kind = 'polyline' THEN round(x0, 3) END AS start_x,
           CASE WHEN kind = 'line' THEN round(x0 + dx, 3) WHEN kind = 'polyline' THEN round(x0 + 10, 3) END AS end_x,
           CASE WHEN kind = 'polyline' THEN 3 END AS n_polyline, CASE WHEN kind = 'area' THEN 4 END AS n_polygon,
           round(CASE kind WHEN 'area' THEN area_unit WHEN 'count' THEN 1.0 ELSE diameter_unit END + 1e-7, 4) AS result
    FROM m
""")
def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    m = A.measurements(spark, d)
    categories = m.where("label is not null").select("image_id", "label").distinct().withColumns(
        {"category_id": F.col("label"), "color": F.concat(F.lit("#"), F.substring(F.md5("label"), 1, 6))}
    )
    found = lookup.with_category(m.withColumnRenamed("label", "category_id"), categories, ["image_id", "category_id"])
    kind, path = F.col("measurement_kind"), F.col("polyline")
    line, poly = kind == "line", kind == "polyline"
    value = V.display_value(kind, F.col("diameter_unit"), F.col("diameter_px"), F.col("area_unit"), F.col("area_px"))
    return found.select(
        "measurement_id", "label", "color", V.mapped(kind, V.KIND_LABELS).alias("kind_label"),
        F.round(F.when(line, F.col("line.start.x")).when(poly, F.element_at(path, 1)["x"]), 3).alias("start_x"),
        F.round(F.when(line, F.col("line.end.x")).when(poly, F.element_at(path, -1)["x"]), 3).alias("end_x"),
        F.when(poly, F.size(path)).alias("n_polyline"), F.when(kind == "area", F.size("polygon")).alias("n_polygon"),
        r4(value).alias("result"),
    )


@query("""
    SELECT o_orderkey,
           CASE s WHEN 'manual' THEN '手动测量' WHEN 'snapped' THEN '吸附成功' WHEN 'edited' THEN '已编辑' ELSE s END AS status,
           CASE WHEN c IS NULL THEN '未标定' WHEN c = 'preset' THEN '标定预设 / ' || o_orderpriority ELSE '图内标定' END AS calibration,
           CASE md WHEN 'fiber_auto' THEN 'fiber_quick' WHEN 'continuous' THEN 'continuous_manual' ELSE md END AS mode
    FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'snapped' WHEN 2 THEN 'edited' ELSE 'odd' END AS s,
                 CASE o_orderkey % 3 WHEN 0 THEN 'preset' WHEN 1 THEN 'image_scale' END AS c,
                 CASE o_orderkey % 5 WHEN 0 THEN 'fiber_auto' WHEN 1 THEN 'continuous' ELSE 'snap' END AS md FROM orders)
""")
def code_labels(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(key % 4 == 0, "manual").when(key % 4 == 1, "snapped").when(key % 4 == 2, "edited").otherwise("odd")
    mode = F.when(key % 3 == 0, "preset").when(key % 3 == 1, "image_scale")
    source = F.when(key % 3 == 0, F.concat(F.lit(" "), "o_orderpriority"))
    old = F.when(key % 5 == 0, "fiber_auto").when(key % 5 == 1, "continuous").otherwise("snap")
    return table(spark, d, "orders").select(
        "o_orderkey", V.mapped(status, V.STATUS_LABELS).alias("status"), V.calibration_info(mode, source).alias("calibration"), V.mapped(old, V.MODE_UPGRADES).alias("mode")
    )


@query("""
    SELECT p_partkey, list_distinct(string_split(p_type, ' '))[1] IS NOT NULL AS named,
           array_to_string([CASE x WHEN 'SMALL' THEN 'S' ELSE x END FOR x IN string_split(p_type, ' ')], '|') AS labels
    FROM part
""")
def class_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = V.class_labels(F.replace("p_type", F.lit(" "), F.lit("-")), {"SMALL": "S"})
    return table(spark, d, "part").select("p_partkey", (F.size(labels) > 0).alias("named"), F.array_join(labels, "|").alias("labels"))


@query("""
    SELECT page_id, regexp_extract(url, '([^/\\\\]+)[/\\\\]*$', 1) AS file_name,
           'scale-' || page_id AS scale_name FROM pages
""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("scale-"), "page_id", F.lit("-2024.01.31"))
    return table(spark, d, "pages").select("page_id", V.file_name(F.col("url")).alias("file_name"), V.scale_name(stem).alias("scale_name"))


# ---------------------------------------------------------------- running numbers and first rows


@query("""
    SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id, ts, event_id) AS by_kind,
           row_number() OVER (PARTITION BY event_type, lbl ORDER BY user_id, ts, event_id) AS by_label
    FROM (SELECT *, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 5 END AS lbl FROM events)
""")
def running_sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("lbl", F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 5))
    order = ["ts", "event_id"]
    rows = ordinal.running_number(rows, ["event_type"], "user_id", order, "by_kind")
    return ordinal.running_number(rows, ["event_type", "lbl"], "user_id", order, "by_label").select("event_id", "by_kind", "by_label")


@query("""
    WITH f AS (SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1)
    SELECT f.event_type, f.event_id, round(e.value + 1e-7, 4) AS value, row_number() OVER (ORDER BY f.event_id) AS place
    FROM f JOIN events e USING (event_id) QUALIFY place <= 3
""")
def first_per_label(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    first = ordinal.first_value_per_key(_events(spark, d), "event_type", F.col("event_id"), ["event_id", "value"])
    place = F.row_number().over(Window.orderBy("event_id")).cast("long")
    return first.select("event_type", "event_id", r4("value").alias("value"), place.alias("place")).where("place <= 3")


@query("""
    SELECT p_partkey, row_number() OVER (PARTITION BY p_brand
        ORDER BY CASE WHEN p_size = 7 THEN 0 WHEN p_size = 3 THEN 1 ELSE 2 END, p_retailprice, p_partkey)::INT AS number FROM part
""")
def renumber(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("p_size") == 7, 0).when(F.col("p_size") == 3, 1)
    return ordinal.renumber(table(spark, d, "part"), "p_brand", ["p_retailprice", "p_partkey"], priority).select("p_partkey", "number")


@query("""
    SELECT p_brand, p_partkey, place::INT AS place FROM (
        SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part)
    WHERE place <= 12
""")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ordinal.top_k(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 12).select("p_brand", "p_partkey", "place")


@query("""
    WITH t AS (SELECT c_mktsegment AS label, min(c_custkey) AS first FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1)
    SELECT label, first FROM t
""")
def ordered_labels(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    used = table(spark, d, "customer").join(orders, "c_custkey", "left_semi").withColumnRenamed("c_mktsegment", "label")
    return ordinal.ordered_labels(used, "label", F.col("c_custkey"), used.select("label"))


# ---------------------------------------------------------------- geometry


@query(f"WITH {E} SELECT v.id, round(coalesce((SELECT sum(d) FROM e WHERE e.id = v.id AND e.i < e.n), 0), 3) AS length FROM v GROUP BY v.id")
def polyline_length(spark: SparkSession, d: str) -> DataFrame:
    return A.outlines(spark, d).select("id", F.round(G.polyline_length(F.col("points")), 3).alias("length"))


@query(f"WITH {E} SELECT id, round(CASE WHEN min(n) < 3 THEN 0.0 ELSE abs(sum(c)) / 2 END, 3) AS area FROM e GROUP BY id")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return A.outlines(spark, d).select("id", F.round(G.polygon_area(F.col("points")), 3).alias("area"))


@query(f"""
    WITH {E}, o AS (SELECT id, x AS ox, y AS oy FROM v WHERE i = 1),
         r AS (SELECT id, n, x1 - ox AS x1, y1 - oy AS y1, x2 - ox AS x2, y2 - oy AS y2, x1 AS px, y1 AS py, ox, oy FROM e JOIN o USING (id)),
         s AS (SELECT id, any_value(ox) AS ox, any_value(oy) AS oy, sum(x1 * y2 - x2 * y1) AS a,
                      sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS cy,
                      min(px) AS lx, max(px) AS hx, min(py) AS ly, max(py) AS hy FROM r GROUP BY id)
    SELECT id, round(CASE WHEN abs(a) < 1e-9 THEN (lx + hx) / 2 ELSE ox + cx / (3 * a) END + 1e-7, 2) AS x,
           round(CASE WHEN abs(a) < 1e-9 THEN (ly + hy) / 2 ELSE oy + cy / (3 * a) END + 1e-7, 2) AS y FROM s
""")
def polygon_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = G.polygon_centroid(F.col("points"))
    return A.outlines(spark, d).select("id", F.round(c["x"] + 1e-7, 2).alias("x"), F.round(c["y"] + 1e-7, 2).alias("y"))


@query(f"WITH {E} SELECT id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v GROUP BY id")
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return A.outlines(spark, d).select("id", G.bounds(F.col("points")).alias("b")).select("id", "b.*")


@query(f"""
    WITH {E}, s AS (SELECT id, sum(d) AS w, sum((x1 + x2) / 2 * d) AS cx, sum((y1 + y2) / 2 * d) AS cy FROM e WHERE i < n AND d > 1e-9 GROUP BY id),
         b AS (SELECT id, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y FROM v GROUP BY id)
    SELECT b.id, round(CASE WHEN w > 1e-9 THEN cx / w ELSE b.x END, 3) AS x, round(CASE WHEN w > 1e-9 THEN cy / w ELSE b.y END, 3) AS y
    FROM b LEFT JOIN s ON b.id = s.id
""")
def polyline_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = G.polyline_centroid(F.col("points"))
    return A.outlines(spark, d).select("id", F.round(c["x"], 3).alias("x"), F.round(c["y"], 3).alias("y"))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    """(id, rings): parts as rectangles with a hole, and a second hole that is no ring for some."""
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 17 + 2).cast("double")

    def box(x0, y0, x1, y1):
        return F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1))

    zero = F.lit(0.0)
    rings = F.array(box(zero, zero, w, h), box(w / 4, h / 4, w / 2, h / 2), F.slice(box(zero, zero, w, h), 1, 2))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rings.alias("rings"))


@query("""
    SELECT p_partkey AS id, round(w * h - w * h / 16 + 1e-7, 4) AS area, round(w * h / 16 + 1e-7, 4) AS hole_area,
           round((w / 2 * w * h - 3 * w / 8 * w * h / 16) / (w * h * 15 / 16) + 1e-7, 4) AS x
    FROM (SELECT *, p_size::DOUBLE AS w, (p_partkey % 17 + 2)::DOUBLE AS h FROM part)
""")
def ring_area_with_holes(spark: SparkSession, d: str) -> DataFrame:
    rings = F.col("rings")
    return _squares(spark, d).select(
        "id", r4(G.rings_area(rings)).alias("area"), r4(G.rings_hole_area(rings)).alias("hole_area"), r4(G.rings_centroid(G.oriented(rings))["x"]).alias("x")
    )


@query("""
    SELECT p_partkey AS id, (px > 0 AND px < w AND py > 0 AND py < h) AND NOT (px > w / 4 AND px < w / 2 AND py > h / 4 AND py < h / 2) AS inside
    FROM (SELECT *, p_size::DOUBLE AS w, (p_partkey % 17 + 2)::DOUBLE AS h, p_partkey % 23 + 0.37 AS px, p_partkey % 13 + 0.41 AS py FROM part)
""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    p = G.point(F.col("id") % 23 + 0.37, F.col("id") % 13 + 0.41)
    return _squares(spark, d).select("id", G.point_in_rings(p, F.col("rings")).alias("inside"))


@query("""
    WITH s AS (SELECT o_orderkey AS id, o_orderkey % 37 AS px, o_custkey % 29 AS py, o_orderkey % 11 AS xa, o_custkey % 7 AS ya,
                      o_orderkey % 11 + o_custkey % 5 AS xb, o_custkey % 7 + o_orderkey % 3 AS yb FROM orders),
    t AS (SELECT *, xb - xa AS vx, yb - ya AS vy FROM s),
    u AS (SELECT *, CASE WHEN vx = 0 AND vy = 0 THEN 0.0
                         ELSE greatest(0.0, least(1.0, ((px - xa) * vx + (py - ya) * vy) / nullif((vx * vx + vy * vy)::DOUBLE, 0))) END AS t FROM t)
    SELECT id, round(sqrt((px - xa - t * vx) ** 2 + (py - ya - t * vy) ** 2) + 1e-7, 4) AS distance FROM u
""")
def segment_distance(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p, a = G.point(k % 37, c % 29), G.point(k % 11, c % 7)
    b = G.point(k % 11 + c % 5, c % 7 + k % 3)
    return table(spark, d, "orders").select(k.alias("id"), r4(G.segment_distance(p, a, b)).alias("distance"))


# ---------------------------------------------------------------- spatial


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (k * 37 % 4000).cast("double"), (c * 53 % 4000).cast("double")
    return table(spark, d, "orders").select(
        k.alias("shape"), x.alias("min_x"), y.alias("min_y"), (x + 5 + k % 60).alias("max_x"), (y + 5 + c % 60).alias("max_y")
    )


_BOXES = """
    box AS (SELECT o_orderkey AS shape, (o_orderkey * 37 % 4000)::DOUBLE AS min_x, (o_custkey * 53 % 4000)::DOUBLE AS min_y,
                   (o_orderkey * 37 % 4000)::DOUBLE + 5 + o_orderkey % 60 AS max_x, (o_custkey * 53 % 4000)::DOUBLE + 5 + o_custkey % 60 AS max_y
            FROM orders)
"""


@query(f"""
    WITH {_BOXES}, p AS (SELECT event_id, (event_id * 71 % 4000)::DOUBLE AS x, (event_id * 29 % 4000)::DOUBLE AS y FROM events)
    SELECT event_id, max(shape) AS shape, count(*) AS n_hits
    FROM p JOIN box ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY event_id
""")
def spatial_hit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    points = _events(spark, d).select(k, (k * 71 % 4000).cast("double").alias("x"), (k * 29 % 4000).cast("double").alias("y"))
    return spatial.latest_hits(points, _boxes(spark, d), "event_id", "shape", F.col("shape"))


@query(f"""
    WITH {_BOXES} SELECT shape FROM box WHERE (max_x >= 990 AND min_x <= 1810 AND max_y >= 490 AND min_y <= 1210) OR shape % 500 = 0
""")
def viewport_cull(spark: SparkSession, d: str) -> DataFrame:
    return spatial.in_view(_boxes(spark, d), 1000, 500, 1800, 1200, 10, F.col("shape") % 500 == 0).select("shape")


@query(f"""
    WITH {E}, q AS (SELECT *, sqrt((x - (id % 50)) ** 2 + (y - (id % 90)) ** 2) AS d FROM v)
    SELECT id, (arg_min(i, d) - 1)::INT AS index, round(min(d), 3) AS distance FROM q GROUP BY id HAVING min(d) <= 12
""")
def nearest_vertex(spark: SparkSession, d: str) -> DataFrame:
    p = G.point(F.col("id") % 50, F.col("id") % 90)
    far = G.point(F.lit(1e9), F.lit(1e9))
    found = A.outlines(spark, d).select("id", spatial.nearest_vertex(p, F.col("points"), 12.0, far).alias("v")).where("v is not null")
    return found.select("id", "v.index", F.round("v.distance", 3).alias("distance"))


@query("""
    WITH s AS (SELECT p_partkey AS id, p_partkey % 3 AS kind, p_size::DOUBLE AS w, p_partkey % 19 + 0.5 AS px, p_partkey % 31 + 0.25 AS py FROM part),
    t AS (SELECT *, px - w / 2 AS u, py - w / 2 AS v FROM s)
    SELECT id, CASE kind WHEN 0 THEN px BETWEEN -2 AND w + 2 AND py BETWEEN -2 AND w + 2
                         WHEN 1 THEN (u * u + v * v) / ((w / 2 + 2) * (w / 2 + 2)) <= 1
                         ELSE sqrt((px - t) ** 2 + (py - t) ** 2) <= 2 END AS hit
    FROM (SELECT *, greatest(0.0, least(w, (px + py) / 2)) AS t FROM t)
""")
def annotation_hit(spark: SparkSession, d: str) -> DataFrame:
    k, w = F.col("p_partkey"), F.col("p_size").cast("double")
    kind = F.when(k % 3 == 0, "rect").when(k % 3 == 1, "circle").otherwise("line")
    zero = F.lit(0.0)
    hit = G.annotation_hit(kind, G.point(k % 19 + 0.5, k % 31 + 0.25), G.point(zero, zero), G.point(w, w), 2.0)
    return table(spark, d, "part").select(k.alias("id"), hit.alias("hit"))


# ---------------------------------------------------------------- lookups


@query("""
    WITH preset AS (SELECT s_suppkey AS pos, 'n' || s_suppkey % 9 AS name, s_nationkey AS unit, round(s_acctbal / 100) AS ppu FROM supplier),
    cal AS (SELECT c_custkey AS id, 'n' || c_custkey % 9 AS name, c_nationkey AS unit, round(c_acctbal / 100) AS ppu FROM customer),
    best AS (
        SELECT id, pos, p.name AS preset_name FROM cal c JOIN preset p ON c.unit = p.unit AND abs(c.ppu - p.ppu) < 1e-9
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN c.name = p.name THEN 0 ELSE 1 END, pos) = 1
    )
    SELECT cal.id, pos AS preset_pos, preset_name FROM cal LEFT JOIN best ON cal.id = best.id
""")
def tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    def named(key):
        return F.concat(F.lit("n"), (F.col(key) % 9).cast("string")).alias("name")

    presets = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("preset_pos"), named("s_suppkey"), F.col("s_nationkey").alias("unit"), F.round(F.col("s_acctbal") / 100).alias("ppu")
    )
    cal = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), named("c_custkey"), F.col("c_nationkey").alias("unit"), F.round(F.col("c_acctbal") / 100).alias("ppu")
    )
    return lookup.match_preset(cal, presets, "id").select("id", "preset_pos", "preset_name")


@query("""
    WITH t AS (SELECT n_name AS label, n_nationkey AS pos FROM nation WHERE n_nationkey < 8),
    have AS (SELECT c_custkey AS image_id, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey AS image_id, t.label FROM customer, t
    WHERE NOT (c_custkey % 8 = t.pos) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.image_id = c_custkey AND h.label = t.label)
""")
def missing_categories(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    templates = nation.where("n_nationkey < 8").select(
        F.lit(0).alias("project_id"), F.col("n_nationkey").alias("template_pos"), F.concat(F.lit(" "), "n_name").alias("label"), F.lit("#000000").alias("color")
    )
    listed = nation.where("n_nationkey < 8").select((F.col("n_nationkey")).alias("slot"), F.array("n_name").alias("suppressed_labels"))
    images = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.lit(0).alias("project_id"), (F.col("c_custkey") % 8).cast("int").alias("slot"), "c_nationkey")
    have = images.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("image_id", F.col("n_name").alias("label"))
    return lookup.missing_categories(images.join(listed, "slot"), templates, have).select("image_id", "label")


@query("""
    WITH lab AS (SELECT n_name AS label, n_nationkey AS k FROM nation),
    tpl AS (SELECT n_name AS label, '#t' || n_nationkey AS color FROM nation WHERE n_nationkey < 5),
    img AS (SELECT n_name AS label, '#c' || min(c_custkey) AS color FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey BETWEEN 3 AND 14 GROUP BY 1),
    bare AS (SELECT label, row_number() OVER (ORDER BY label) - 1 + (SELECT count(*) FROM tpl) AS place FROM lab
             WHERE label NOT IN (SELECT label FROM tpl) AND label NOT IN (SELECT label FROM img))
    SELECT lab.label, coalesce(tpl.color, img.color,
        ['#1F7A8C', '#E07A5F', '#81B29A', '#3D405B', '#F2CC8F', '#6D597A', '#227C9D', '#FF7C43', '#2A9D8F'][(bare.place % 9 + 1)::INT]) AS color
    FROM lab LEFT JOIN tpl USING (label) LEFT JOIN img USING (label) LEFT JOIN bare USING (label)
""")
def label_colors(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").withColumnRenamed("n_name", "label")
    templates = nation.where("n_nationkey < 5").select("label", F.col("n_nationkey").alias("template_pos"), F.concat(F.lit("#t"), "n_nationkey").alias("color"))
    categories = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey between 3 and 14").select(
        "label", F.col("c_custkey").alias("image_pos"), F.lit(1).alias("number"), F.concat(F.lit("#c"), "c_custkey").alias("color")
    )
    return lookup.label_colors(nation.select("label"), templates, categories)


@query("""
    SELECT c_custkey AS image_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 0.5 END, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 0.25 END, 7.0) AS ppu FROM customer
""")
def calibration_cascade(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    images = table(spark, d, "customer").select(
        k.alias("image_id"), F.col("c_name").alias("path"), F.lit(1).alias("project_id"), F.when(k % 3 == 0, k + 0.5).cast("double").alias("calibration")
    )
    sidecars = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_name").alias("image_path"), (k + 0.25).cast("double").alias("calibration"))
    project = spark.range(1).select(F.lit(1).alias("project_id"), F.lit(7.0).alias("calibration"))
    return lookup.effective_calibration(images, sidecars, project).select("image_id", F.col("calibration").alias("ppu"))


@query("""
    SELECT e.user_id, e.event_id FROM events e
    WHERE e.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
    QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) = 1
""")
def load_requests(spark: SparkSession, d: str) -> DataFrame:
    opened = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    wanted = mutate.delete_rows(_events(spark, d), opened, ["user_id"])
    return ordinal.first_value_per_key(wanted, "user_id", F.col("event_id"), ["event_id"]).select("user_id", "event_id")


@query("""
    WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM t WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id AS query_id, t.vec_id, list_inner_product(q.v, t.v) AS score FROM q JOIN t ON q.vec_id <> t.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
    SELECT query_id, vec_id, place::INT AS place, round(score, 6) AS score FROM r WHERE place <= 12
""")
def similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return nearest.inner_products(queries, rows, 12).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- edits


@query("""
    SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS kept_id FROM orders
""")
def label_merge(spark: SparkSession, d: str) -> DataFrame:
    categories = table(spark, d, "orders").select(
        F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("category_id"), F.concat("o_orderpriority", F.lit("\t")).alias("label"), F.col("o_orderkey").alias("number")
    )
    return mutate.merge_same_labels(categories).select(F.col("category_id").alias("id"), "kept_id")


@query("""
    SELECT o_orderkey FROM orders WHERE NOT (o_custkey % 10 = 3 AND o_orderpriority = '1-URGENT') AND o_orderkey % 19 <> 0
""")
def delete_by_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    left = mutate.delete_where(rows, (F.col("o_custkey") % 10 == 3) & (F.col("o_orderpriority") == "1-URGENT"))
    return mutate.delete_rows(left, rows.where("o_orderkey % 19 = 0"), ["o_orderkey"]).select("o_orderkey")


@query("""
    WITH seen AS (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 5 = 0)
    SELECT o_orderkey AS measurement_id FROM orders
    WHERE NOT (o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_custkey IN (SELECT * FROM seen))
    UNION ALL SELECT -c_custkey FROM seen
""")
def replace_detections(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("measurement_id") % 2 == 0, "auto_instance").otherwise("manual")
    kind = F.when(F.col("o_orderstatus") == "O", "area").otherwise("line")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("measurement_id"), kind.alias("measurement_kind")
    ).withColumn("mode", mode)
    new = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("image_id"), (-F.col("c_custkey")).alias("measurement_id"))
    return mutate.replace_detections(rows, new).select("measurement_id")


@query("""
    SELECT c_custkey AS image_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS number, o_orderkey AS category_id
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'
""")
def delete_category(spark: SparkSession, d: str) -> DataFrame:
    categories = table(spark, d, "orders").select(
        F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("category_id"), F.col("o_orderkey").alias("number"), "o_orderpriority"
    )
    gone = categories.where("o_orderpriority = '5-LOW'").select("image_id", "category_id")
    _, left = mutate.delete_category(categories.select("image_id", "category_id"), categories, gone)
    return left.select("image_id", "number", "category_id")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 7 = 1
    UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey > 0
""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    after = before.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    after = after.unionByName(before.where("o_orderkey % 11 = 0 and o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    return mutate.snapshot_diff(before, after, ["o_orderkey"])


@query(f"""
    WITH {M} SELECT measurement_id, round(diameter_px / 2.5 + 1e-7, 4) AS diameter_unit, round(area_px / 6.25 + 1e-7, 4) AS area_unit FROM m
""")
def recalibrate(spark: SparkSession, d: str) -> DataFrame:
    images = A.images(spark, d).withColumn("ppu", F.lit(2.5))
    return A.derived(A.raw_measurements(spark, d), images).select("measurement_id", *(r4(c).alias(c) for c in ("diameter_unit", "area_unit")))


@query("""
    SELECT c_custkey AS image_id, array_to_string(list_sort(list_distinct(['b', 'a', n_name])), '|') AS labels
    FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def suppressed_labels(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.array(F.lit("b"), F.lit(" a"), F.lit("b")).alias("suppressed_labels"), "c_nationkey")
    labels = images.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("image_id", F.concat(F.lit(" "), "n_name").alias("label"))
    return mutate.suppress(images, labels).select("image_id", F.array_join("suppressed_labels", "|").alias("labels"))


# ---------------------------------------------------------------- reports


def _report_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as detail rows; event types are categories."""
    kind = F.when(F.col("event_id") % 3 == 0, "area").otherwise("line")
    rows = _events(spark, d).select(
        F.col("user_id").alias("image_pos"), F.col("event_id").alias("measurement_pos"), F.col("event_type").alias("label"),
        F.col("event_type").alias("category_id"), V.mapped(kind, V.KIND_LABELS).alias("kind_label"),
        F.round("value", 3).alias("display_value"), F.round("value", 1).alias("result"),
    )
    categories = rows.select("image_pos", F.col("measurement_pos").alias("number"), "label")
    return rows, report.category_labels(categories, rows)


_REPORT = """
    r AS (SELECT user_id AS i, event_id AS p, event_type AS label, CASE WHEN event_id % 3 = 0 THEN 'area' ELSE 'line' END AS kind,
                 round(value, 3) AS v, round(value, 1) AS result FROM events),
    lab AS (SELECT label, row_number() OVER (ORDER BY min(struct_pack(i := i, p := p))) AS place FROM r GROUP BY label)
"""


@query(f"""
    WITH {_REPORT}
    SELECT 0 AS rule, 'A' AS sheet, (10 + row_number() OVER (ORDER BY i, p))::INT AS row, 2 AS col, v::DOUBLE AS value FROM r WHERE kind = 'line'
    UNION ALL
    SELECT 1, 'B', (4 + row_number() OVER (PARTITION BY label ORDER BY i, p))::INT, (2 + place)::INT, result FROM r JOIN lab USING (label) WHERE kind = 'area'
    UNION ALL
    SELECT 2, 'C', 1, (52 + place)::INT, (SELECT arg_min(result, struct_pack(i := i, p := p)) FROM r WHERE r.label = lab.label) FROM lab WHERE place <= 3
""")
def report_cells(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _report_rows(spark, d)
    rules = [
        report.Rule("diameter_result", "A", "B11"),
        report.Rule("area_result", "B", "C5", "Z5"),
        report.Rule("unique_field_range", "C", "BA1", "BC1", "horizontal", "result"),
    ]
    cells = report.report_cells(rules, rows, labels)
    return cells.select("rule", "sheet", "row", F.col("column").alias("col"), F.col("value").cast("double").alias("value"))


@query(f"""
    WITH {_REPORT}, a AS (SELECT row_number() OVER (ORDER BY i, p) AS n FROM r WHERE kind = 'line'),
         b AS (SELECT row_number() OVER (ORDER BY i, p) AS n FROM r WHERE kind = 'area')
    SELECT 'A' AS sheet, a.n::INT AS row, 1 AS col FROM a JOIN b ON a.n = b.n + 4
""")
def report_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _report_rows(spark, d)
    rules = [report.Rule("diameter_result", "A", "A1"), report.Rule("area_result", "A", "A5")]
    return report.overlaps(report.report_cells(rules, rows, labels)).select("sheet", "row", F.col("column").alias("col"))


@query("""
    WITH i AS (SELECT c_custkey::VARCHAR AS image_id, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS stem, c_custkey % 7 <> 0 AS ok FROM customer)
    SELECT kind, image_id, coalesce(nullif(stem, ''), image_id) || '_' || kind AS file_name FROM i, (VALUES ('overlay'), ('scale_json')) t(kind) WHERE kind = 'overlay' OR ok
    UNION ALL SELECT 'workbook', NULL, 'workbook'
""")
def export_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    images = table(spark, d, "customer").select(k.alias("image_id"), F.when(k % 6 == 0, "").otherwise(F.col("c_name")).alias("stem"), (k % 7 != 0).alias("calibrated"))
    return report.planned_outputs(images, ["workbook"], ["overlay", "scale_json"])


@query("""
    SELECT o_orderkey, '[{"x": ' || (o_orderkey % 97 * 1.5)::DOUBLE || ', "y": ' || (o_orderkey % 5)::DOUBLE || '}, {"x": ' || (o_orderkey % 7)::DOUBLE || ', "y": '
                       || (o_orderkey % 3)::DOUBLE || '}]' AS text, o_orderkey % 97 * 1.5 AS x0, 2 AS n FROM orders
""")
def json_vertices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = T.json_points(F.array(G.point(k % 97 * 1.5, k % 5), G.point(k % 7, k % 3)))
    back = F.from_json(text, f"array<{G.POINT}>")
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"), F.get(back, F.lit(0))["x"].alias("x0"), F.size(back).alias("n"))


# ---------------------------------------------------------------- order-dependent and streams in batch form


@query("""
    WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, i, event_id, value AS last, true AS kept FROM s WHERE i = 1
          UNION ALL
          SELECT s.user_id, s.i, s.event_id, CASE WHEN abs(s.value - f.last) < 5 THEN f.last ELSE s.value END, abs(s.value - f.last) >= 5
          FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
    SELECT user_id, event_id FROM f WHERE kept
""")
def duplicate_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "user_id", "value")
    return sequential.last_accepted_filter(rows, "user_id", ["event_id"], "value", 5.0).select("user_id", "event_id")


@query("""
    WITH s AS (SELECT user_id, event_id, value <= 60 AS steady, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, steady ORDER BY event_id) AS run FROM s)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id)::INT AS streak FROM g WHERE steady
    QUALIFY streak >= 2
""")
def stability_gate(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import streaks

    return streaks(_events(spark, d), "user_id", "event_id", F.col("value") <= 60).where("streak >= 2").select("user_id", "event_id", "streak")


@query("""
    SELECT user_id, event_id FROM (SELECT *, max(event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id) AS newest FROM events)
    WHERE event_id % 5 >= newest
""")
def stale_frames(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import drop_stale

    rows = _events(spark, d).withColumn("generation", F.col("event_id") % 5)
    return drop_stale(rows, "user_id", "event_id", "generation").select("user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_request(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import latest

    return latest(_events(spark, d), "user_id", "event_id", ["event_type"])


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id, epoch_us(ts) // 3600000000")
def throttle(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import throttled

    return throttled(_events(spark, d), "user_id", "ts", "event_id", "1 hour").select("user_id", "event_id")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """Orders as boxes that a model has found in their customer's image."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (k * 7 % 60).cast("double"), (k * 3 % 40 + c % 9).cast("double")
    return table(spark, d, "orders").select(
        c.alias("image_id"), k.alias("shape"), x.alias("min_x"), y.alias("min_y"), (x + 30 + k % 20).alias("max_x"), (y + 25 + k % 16).alias("max_y")
    )


_DETECTIONS = """
    det AS (SELECT o_custkey AS image_id, o_orderkey AS shape, (o_orderkey * 7 % 60)::DOUBLE AS x0, (o_orderkey * 3 % 40 + o_custkey % 9)::DOUBLE AS y0,
                   (o_orderkey * 7 % 60)::DOUBLE + 30 + o_orderkey % 20 AS x1, (o_orderkey * 3 % 40 + o_custkey % 9)::DOUBLE + 25 + o_orderkey % 16 AS y1,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
"""


def _greedy_sql(threshold: float, first: str = "true") -> str:
    """Boxes one after the other with the list of kept ones; those for which ``first`` is false are there before."""
    shared = "greatest(least(k.x1, d.x1) - greatest(k.x0, d.x0), 0) * greatest(least(k.y1, d.y1) - greatest(k.y0, d.y0), 0)"
    union = f"((k.x1 - k.x0) * (k.y1 - k.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) - {shared})"
    return f"""
    WITH RECURSIVE {_DETECTIONS},
    new AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY shape) AS n FROM det WHERE {first}),
    f AS (SELECT image_id, 0::BIGINT AS n, NULL::BIGINT AS shape, false AS ok,
                 list(struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1)) FILTER (WHERE NOT ({first})) AS kept FROM det GROUP BY image_id
          UNION ALL
          SELECT image_id, n, shape, ok, CASE WHEN ok THEN list_append(kept, box) ELSE kept END
          FROM (SELECT d.image_id, d.n, d.shape, coalesce(f.kept, []) AS kept, struct_pack(x0 := d.x0, y0 := d.y0, x1 := d.x1, y1 := d.y1) AS box,
                       NOT coalesce(list_bool_or([{shared} / {union} >= {threshold} FOR k IN f.kept]), false) AS ok
                FROM f JOIN new d ON d.image_id = f.image_id AND d.n = f.n + 1))
    SELECT image_id, shape FROM f WHERE ok
    """


@query(_greedy_sql(0.55))
def suppress_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return sequential.greedy_boxes(_detections(spark, d), ["image_id"], ["shape"], 0.55).select("image_id", "shape")


@query(_greedy_sql(0.7, "shape % 3 <> 0"))
def accepted_candidates(spark: SparkSession, d: str) -> DataFrame:
    boxes = _detections(spark, d)
    found = sequential.greedy_boxes(boxes.where("shape % 3 <> 0"), ["image_id"], ["shape"], 0.7, boxes.where("shape % 3 = 0"))
    return found.select("image_id", "shape")


@query("""
    WITH RECURSIVE p AS (SELECT user_id, event_id, (event_id * 71 % 97)::DOUBLE AS x, (event_id * 29 % 89)::DOUBLE AS y,
                                row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS ok, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept FROM (SELECT DISTINCT user_id FROM p)
          UNION ALL
          SELECT user_id, i, event_id, ok, CASE WHEN ok THEN list_append(kept, struct_pack(x := x, y := y)) ELSE kept END
          FROM (SELECT p.*, f.kept, len(f.kept) < 12 AND NOT coalesce(list_bool_or([sqrt((k.x - p.x) ** 2 + (k.y - p.y) ** 2) < 20 FOR k IN f.kept]), false) AS ok
                FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1))
    SELECT user_id, event_id, p.x, p.y FROM f JOIN p USING (user_id, event_id) WHERE ok
""")
def spaced_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    points = _events(spark, d).select("user_id", k, (k * 71 % 97).cast("double").alias("x"), (k * 29 % 89).cast("double").alias("y"))
    return sequential.greedy_spacing(points, ["user_id"], ["event_id"], 20.0, 12)


@query(f"""
    WITH {_DETECTIONS},
    p AS (SELECT a.shape AS a, b.shape AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h,
                 (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas
          FROM det a JOIN det b ON a.image_id = b.image_id AND a.shape < b.shape)
    SELECT a, b, round(w * h / (areas - w * h) + 1e-7, 4) AS iou FROM p WHERE w > 0 AND h > 0 AND w * h / (areas - w * h) >= 0.5
""")
def ring_overlaps(spark: SparkSession, d: str) -> DataFrame:
    boxes = _detections(spark, d).withColumnRenamed("shape", "id")
    return sequential.overlapping(boxes, boxes, ["image_id"], 0.5).where("a < b").select("a", "b", r4("iou").alias("iou"))


# ---------------------------------------------------------------- rasters


def drawn_fibres(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, value, left, width): suppliers as grey images of one dark fibre each."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("id"), (40 + k % 20).cast("int").alias("left"), (6 + k % 15).cast("int").alias("width"))
    rows = spread(rows, "id").select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("x"))
    return rows.withColumn("value", F.when((F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("width")), 25).otherwise(235))


@query("SELECT s_suppkey AS id, 'snapped' AS status, (6 + s_suppkey % 15)::INT AS width FROM supplier")
def edge_snap(spark: SparkSession, d: str) -> DataFrame:
    from .operators.pixels import edge_pair

    k = F.col("s_suppkey")
    left = 40 + k % 20
    lines = table(spark, d, "supplier").select(
        k.alias("id"), (left - 18).alias("line_x0"), (left + 6 + k % 15 + 18).alias("line_x1"), F.lit(30.0).alias("line_y")
    )
    found = edge_pair(drawn_fibres(spark, d).select("id", "x", "y", "value"), lines)
    return found.select("id", "status", F.round(F.col("right") - F.col("left")).cast("int").alias("width"))


@query("""
    SELECT s_suppkey AS id, 60 * (6 + s_suppkey % 15) AS area, 1 AS parts, 40 + s_suppkey % 20 AS min_x, 45 + s_suppkey % 20 + s_suppkey % 15 AS max_x FROM supplier
""")
def mask_measures(spark: SparkSession, d: str) -> DataFrame:
    from .operators.pixels import mask_measures as measured

    masks = drawn_fibres(spark, d).withColumn("value", (F.col("value") < 128).cast("int"))
    return measured(masks.select("id", "x", "y", "value"))


@query("""
    SELECT s_suppkey AS id, round((235.0 * (120 - w) + 25.0 * w) / 120 + 1e-7, 4) AS mean FROM (SELECT *, 6 + s_suppkey % 15 AS w FROM supplier)
""")
def frame_measures(spark: SparkSession, d: str) -> DataFrame:
    from .operators.pixels import frame_measures as measured

    return measured(drawn_fibres(spark, d)).select("id", r4("mean").alias("mean"))


# ---------------------------------------------------------------- more of the same families


@query("""
    WITH RECURSIVE s AS (SELECT user_id, event_id, event_id * 7 % 50 * 1.0 AS x, event_id * 13 % 40 * 1.0 AS y, event_id * 0.011 AS t,
                                row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, i, event_id, x, y, t, true AS kept FROM s WHERE i = 1
          UNION ALL
          SELECT user_id, i, event_id, CASE WHEN k THEN nx ELSE x END, CASE WHEN k THEN ny ELSE y END, CASE WHEN k THEN nt ELSE t END, k
          FROM (SELECT f.user_id, s.i, s.event_id, f.x, f.y, f.t, s.x AS nx, s.y AS ny, s.t AS nt,
                       s.t - f.t >= 0.5 AND sqrt((s.x - f.x) * (s.x - f.x) + (s.y - f.y) * (s.y - f.y)) >= 12 AS k
                FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1))
    SELECT user_id, count(*) FILTER (WHERE kept)::INT AS n, round(max(t) FILTER (WHERE kept) + 1e-7, 4) AS last FROM f GROUP BY user_id
""")
def freehand_thinning(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    points = _events(spark, d).select("user_id", k, (k * 7 % 50).cast("double").alias("x"), (k * 13 % 40).cast("double").alias("y"), (k * 0.011).cast("double").alias("t"))
    kept = sequential.thinned_path(points, "user_id", ["event_id"], 0.5, 12.0)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"), r4(F.max("t")).alias("last"))


@query(f"""
    WITH {M}
    SELECT image_id, round(CASE WHEN ppu > 0 THEN 1280 / ppu ELSE 1280 END + 1e-7, 4) AS width,
           CASE WHEN ppu IS NULL THEN 'px' ELSE 'um' END AS bar_unit, round(coalesce(50 * ppu, 50) * 0.5 + 1e-7, 4) AS bar_px,
           round(CASE WHEN image_id % 3 > 0 THEN (image_id % 50 + 1) / (image_id % 3)::DOUBLE END + 1e-7, 4) AS line_ppu FROM image
""")
def image_scales(spark: SparkSession, d: str) -> DataFrame:
    ppu, k = F.col("ppu"), F.col("image_id")
    bar = V.scale_bar(F.lit(50.0), ppu, F.lit("um"), F.lit(0.5))
    line = V.line_calibration((k % 50 + 1).cast("double"), (k % 3).cast("double"))
    found = A.images(spark, d).select("image_id", r4(V.to_unit(F.lit(1280.0), ppu)).alias("width"), bar.alias("bar"), r4(line).alias("line_ppu"))
    return found.select("image_id", "width", F.col("bar.unit").alias("bar_unit"), r4("bar.pixels").alias("bar_px"), "line_ppu")


@query("""
    SELECT o_orderkey AS id, floor(greatest(0.0, least(40.0, x))) + 0.5 AS x, floor(greatest(0.0, least(30.0, y))) + 0.5 AS y
    FROM (SELECT o_orderkey, CASE WHEN abs(dx) >= abs(dy) THEN ax + dx ELSE ax END AS x, CASE WHEN abs(dx) >= abs(dy) THEN ay ELSE ay + dy END AS y
          FROM (SELECT o_orderkey, o_orderkey % 60 * 1.0 AS ax, o_custkey % 50 * 1.0 AS ay, o_orderkey % 23 - 11 AS dx, o_custkey % 19 - 9 AS dy FROM orders))
""")
def constrained_points(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = G.point(k % 60, c % 50)
    b = G.point(k % 60 + k % 23 - 11, c % 50 + c % 19 - 9)
    p = G.pixel_center(G.inside_image(G.axis_locked(a, b), F.lit(40), F.lit(30)))
    return table(spark, d, "orders").select(k.alias("id"), p["x"].alias("x"), p["y"].alias("y"))


@query("""
    SELECT o_custkey, o_orderpriority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS ids FROM orders GROUP BY 1, 2
""")
def values_by_category(spark: SparkSession, d: str) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    found = aggregate.values_in_order(table(spark, d, "orders"), keys, ["o_orderdate", "o_orderkey"], "o_orderkey")
    return found.select(*keys, F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


@query("SELECT lower(p_brand) || p_size % 7 AS path, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def template_dedupe(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    rows = table(spark, d, "part").withColumn("path", F.lower(V.trimmed(F.concat(F.lit(" "), brand, (F.col("p_size") % 7).cast("string")))))
    return ordinal.first_value_per_key(rows, "path", F.col("p_partkey"), ["p_partkey"]).select("path", "p_partkey")


@query("""
    SELECT s_name AS name, s_acctbal AS a, NULL AS b FROM supplier UNION ALL SELECT r_name, NULL, r_regionkey FROM region
""")
def union_of_columns(spark: SparkSession, d: str) -> DataFrame:
    from .sources.sinks import union_columns

    left = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("a"))
    return union_columns(left, table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("b")))


@query("""
    WITH c AS (SELECT DISTINCT o_custkey AS image_id, o_orderpriority AS label FROM orders),
    h AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) AS number FROM c),
    w AS (SELECT c_custkey AS image_id, l AS label FROM customer, (VALUES ('1-URGENT'), ('x'), ('y')) t(l)),
    n AS (SELECT w.image_id, w.label FROM w ANTI JOIN h ON w.image_id = h.image_id AND w.label = h.label)
    SELECT image_id, label, number::INT AS number FROM h
    UNION ALL
    SELECT n.image_id, n.label, (coalesce((SELECT max(number) FROM h WHERE h.image_id = n.image_id), 0) + row_number() OVER (PARTITION BY n.image_id ORDER BY n.label))::INT FROM n
""")
def ensure_categories(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("label")).distinct()
    have = ordinal.renumber(have.withColumn("number", F.lit(0)), "image_id", ["label"])
    labels = F.explode(F.array(*map(F.lit, (" 1-URGENT", "x ", "y", "x"))))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), labels.alias("label"))
    return mutate.ensure_categories(have, wanted)


@query("""
    SELECT c_custkey AS image_id, CASE WHEN c_custkey % 3 = 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN c_custkey END AS active
    FROM customer
""")
def restore_active(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    images = table(spark, d, "customer").select(k.alias("image_id"), F.when(k % 3 == 0, k).otherwise(-k).alias("active_category_id"))
    categories = table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_custkey").alias("category_id"))
    return mutate.restore_active(images, categories).select("image_id", F.col("active_category_id").alias("active"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'edited' ELSE o_orderstatus END AS status FROM orders
    UNION ALL SELECT -1 - o_orderkey, 'edited' FROM orders WHERE o_orderkey % 100 = 0
""")
def edit_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    edits = rows.where("o_orderkey % 8 = 0").unionByName(rows.where("o_orderkey % 100 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    return mutate.upsert(rows, edits.withColumn("status", F.lit("edited")), ["o_orderkey"])


@query("""
    WITH p AS (SELECT l_suppkey % 50 AS x, l_partkey % 20 AS y, l_quantity AS v, l_extendedprice AS s, l_orderkey AS f FROM lineitem)
    SELECT x, y, arg_max(v, struct_pack(s := s, f := -f)) AS v FROM p GROUP BY x, y
""")
def focus_fusion(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import fused

    pixels = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("x"), (F.col("l_partkey") % 20).alias("y"), F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("s"), F.col("l_orderkey").alias("f")
    )
    return fused(pixels, ["x", "y"], "v", "s", "f")


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY 1")
def sharpest_frame(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import fused

    return fused(table(spark, d, "orders").withColumn("seq", F.col("o_orderkey")), ["o_custkey"], "o_orderkey", "o_totalprice", "seq")


@query("""
    WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events)
    SELECT user_id, event_type, count(*) FILTER (WHERE i <= 3)::INT AS kept, count(*) FILTER (WHERE i > 3) AS excess, max(event_id) FILTER (WHERE i <= 3) AS last
    FROM r GROUP BY 1, 2
""")
def tile_caps(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import capped_tiles

    return capped_tiles(_events(spark, d), ["user_id", "event_type"], "event_id", 3)


@query("""
    SELECT user_id, count(DISTINCT event_id % 3) AS tiles, count(CASE WHEN value > 80 THEN 1 END) AS edges FROM events
    GROUP BY user_id HAVING count(DISTINCT event_id % 3) >= 2 AND count(CASE WHEN value > 80 THEN 1 END) >= 1
""")
def finish_guard(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import ready_to_finish

    rows = _events(spark, d).select("user_id", (F.col("event_id") % 3).alias("tile"), F.when(F.col("value") > 80, 1).alias("edge"))
    return ready_to_finish(rows, "user_id", "tile", "edge")


@query("""
    SELECT id, n, 4 AS n_box FROM (SELECT l_orderkey AS id, count(*)::INT AS n FROM lineitem GROUP BY 1) WHERE n >= 3
""")
def valid_detections(spark: SparkSession, d: str) -> DataFrame:
    rows = A.outlines(spark, d).select("id", F.col("points").alias("polygon"), F.array(*map(F.lit, range(6))).alias("bbox"))
    return lookup.clean_detections(rows).select("id", F.size("polygon").alias("n"), F.size("bbox").alias("n_box"))


@query("""
    SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'a.FDMPROJ' WHEN o_orderkey % 4 = 1 THEN 'dir/b' || o_orderkey % 30 || '.TIF' ELSE 'c' END AS path,
           CASE WHEN o_orderkey % 4 = 0 THEN 'project' WHEN o_orderkey % 4 = 1 THEN 'image' ELSE 'unsupported' END AS kind FROM orders GROUP BY 1, 2
""")
def classified_inputs(spark: SparkSession, d: str) -> DataFrame:
    from .sources.archive import classify_inputs

    k = F.col("o_orderkey")
    path = F.when(k % 4 == 0, "a.FDMPROJ").when(k % 4 == 1, F.concat(F.lit("dir/b"), (k % 30).cast("string"), F.lit(".TIF"))).otherwise("c")
    return classify_inputs(table(spark, d, "orders").select(path.alias("path")))


from . import catalog_masks, catalog_pixels, catalog_records  # noqa: E402, F401  their queries join these
