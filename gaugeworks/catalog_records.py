"""Further reference queries with their SQL: archives, records, edits, texts and streams in batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analogue as A
from .analogue import MEASUREMENTS_SQL as M
from .analogue import VERTICES_SQL as E
from .catalog import _events, query, r4
from .functions import geometry as G
from .functions import text as T
from .functions import values as V
from .operators import history, lookup, mutate, ordinal, sequential, spatial
from .plans import records, report
from .session import shared_folder, table
from .sources import archive, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- archives


def _archive(spark: SparkSession, d: str) -> archive.Archive:
    """Nations as projects, customers as images, orders as measurements with their priorities as categories."""
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    key = F.col("c_custkey")
    calibration = F.struct(
        F.lit("preset").alias("mode"), (1 + key % 10 / 4.0).cast("double").alias("pixels_per_unit"), F.lit("um").alias("unit"), F.lit("lens").alias("source_label")
    )
    image = customer.select(
        F.col("c_nationkey").cast("string").alias("project_id"), key.cast("string").alias("image_id"), key.alias("image_pos"), F.concat("c_name", F.lit(".png")).alias("path"),
        F.lit("filesystem").alias("source_type"), F.lit(None).cast("string").alias("absolute_path"), F.lit(640).alias("width"), F.lit(480).alias("height"),
        F.when(key % 7 != 0, calibration).alias("calibration"), F.lit(None).cast("string").alias("active_category_id"),
        F.array(F.lit("x")).alias("suppressed_labels"), F.lit(None).cast("string").alias("metadata_json"),
    )
    held = orders.join(customer.select(key.alias("o_custkey"), F.col("c_nationkey").cast("string").alias("project_id")), "o_custkey")
    held = held.withColumn("image_id", F.col("o_custkey").cast("string"))
    category = held.select("project_id", "image_id", F.col("o_orderpriority").alias("category_id")).distinct()
    number = F.substring("category_id", 1, 1).cast("int")
    category = category.select("*", number.alias("category_pos"), number.alias("number"), F.concat(F.lit(" "), "category_id").alias("label"), F.lit("#112233").alias("color"))
    k = F.col("o_orderkey")
    line = F.struct(G.point(k % 100, k % 7).alias("start"), G.point(k % 100 + 3, k % 7 + 4).alias("end"))
    none = F.array().cast(f"array<{G.POINT}>")
    measurement = held.select(
        "project_id", "image_id", F.col("o_custkey").alias("image_pos"), k.cast("string").alias("measurement_id"), k.alias("measurement_pos"), F.col("o_orderpriority").alias("category_id"),
        F.lit("line").alias("measurement_kind"), F.lit("manual").alias("mode"), line.alias("line"), F.lit(None).cast(f"struct<start:{G.POINT},end:{G.POINT}>").alias("snapped_line"),
        none.alias("polyline"), F.lit(None).cast(G.POINT).alias("point"), none.alias("polygon"), F.array().cast(f"array<array<{G.POINT}>>").alias("area_rings"),
        F.lit(None).cast("double").alias("exact_area_px"), F.lit(0.5).alias("confidence"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("created_at"),
    )
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("project_id"))
    project = nation.select("project_id", F.lit("1").alias("version"), F.lit(None).cast("string").alias("calibration"), F.lit(None).cast("string").alias("metadata_json"))
    annotation = image.limit(0).select("project_id", "image_id", *(F.lit(None).cast(t).alias(n) for n, t in (("annotation_id", "string"), ("kind", "string"), ("content", "string"), ("anchor", G.POINT), ("start", G.POINT), ("end", G.POINT), ("created_at", "string"))))
    preset = nation.select("project_id", F.lit(0).alias("preset_pos"), F.concat(F.lit("p"), "project_id").alias("name"), F.lit(2.0).alias("ppu"), F.lit("um").alias("unit"))
    labels = F.explode(F.array(*(F.struct(F.lit(i).alias("template_pos"), F.lit(x).alias("label"), F.lit(c).alias("color")) for i, (x, c) in enumerate((("a", "#1"), (" a ", "#2"), (" ", "#3"), ("b", "#4"))))))
    template = nation.select("project_id", labels.alias("t")).select("project_id", "t.*")
    return archive.Archive(project, image, category, measurement, annotation, preset, template)


def _read_back(spark: SparkSession, d: str) -> archive.Archive:
    path = _folder(spark, "projects")
    sinks.write_projects(_archive(spark, d), path)
    return archive.read_projects(spark, f"{path}/*.json")


@query("""
    SELECT o_orderkey::VARCHAR AS measurement_id, o_custkey::VARCHAR AS image_id, o_orderpriority AS category_id, 5.0 AS diameter_px,
           round(CASE WHEN o_custkey % 7 = 0 THEN 5.0 ELSE 5.0 / (1 + o_custkey % 10 / 4.0) END + 1e-7, 4) AS diameter_unit,
           CASE WHEN o_custkey % 7 = 0 THEN 'px' ELSE 'um' END AS unit
    FROM orders JOIN customer ON o_custkey = c_custkey
""")
def project_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Projects written and read again."""
    again = _read_back(spark, d)
    found = archive.derive(again.measurement, again.image)
    return found.select("measurement_id", "image_id", "category_id", "diameter_px", r4("diameter_unit").alias("diameter_unit"), F.col("display_unit").alias("unit"))


@query("""
    SELECT c_custkey::VARCHAR AS image_id, c_name || '.png' AS path, c.categories::INT AS categories, c.first_label
    FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS categories, min(o_orderpriority) AS first_label FROM orders GROUP BY 1) c ON o_custkey = c_custkey
""")
def project_images(spark: SparkSession, d: str) -> DataFrame:
    again = _read_back(spark, d)
    held = again.category.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("categories"), F.min_by("label", "number").alias("first_label"))
    return again.image.join(held, "image_id", "left").select("image_id", "path", "categories", "first_label")


@query("""
    SELECT n_nationkey AS nation, label, color, 2.0 AS ppu FROM nation, (VALUES ('a', '#1'), ('b', '#4')) t(label, color)
""")
def project_templates(spark: SparkSession, d: str) -> DataFrame:
    again = _read_back(spark, d)
    nation = again.preset.select("project_id", F.substring("name", 2, 9).cast("int").alias("nation"), "ppu")
    return again.template.join(nation, "project_id").select("nation", "label", "color", "ppu")


@query("""
    SELECT c_name || '.png' AS path, 1 + c_custkey % 10 / 4.0 AS ppu FROM customer WHERE c_custkey % 7 <> 0
""")
def sidecar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "sidecars")
    sinks.write_sidecars(_archive(spark, d).image, path)
    return archive.read_sidecars(spark, f"{path}/*.json", lines=True).select(F.col("image_path").alias("path"), F.col("calibration.pixels_per_unit").alias("ppu"))


@query("SELECT c_name || '.png' AS path, '1' AS version FROM customer WHERE c_custkey % 7 <> 0")
def scale_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "scales")
    sinks.write_scale_json(_archive(spark, d).image, path)
    return spark.read.json(path).select(F.col("image_path").alias("path"), "version")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS half FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, key = _folder(spark, "csv"), F.col("n_nationkey")
    sinks.write_csv(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(key % 2 == 0, key).alias("half")), path)
    read = spark.read.option("header", True).schema("name string, half int").csv(path)
    return read


@query("""
    SELECT p_partkey AS id, [0.5, 1.25, 2.0, -3.5, 0.1::FLOAT::DOUBLE, NULL][p_partkey % 6 + 1] AS value FROM part
""")
def scale_floats(spark: SparkSession, d: str) -> DataFrame:
    raw = [F.unhex(F.lit(h)) for h in ("0000003F", "0000A03F", "00000040", "000060C0", "CDCCCC3D", "00")]
    bytes_ = F.get(F.array(*raw), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), V.little_endian_float(bytes_).alias("value"))


@query("""
    SELECT 'dir/' || page_id || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tiff' END AS path,
           page_id || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.tiff' END AS name FROM pages WHERE page_id % 3 < 2
""")
def folder_images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    suffix = F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".tiff").otherwise(".txt")
    return archive.image_files(table(spark, d, "pages").select(F.concat(F.lit("dir/"), k.cast("string"), suffix).alias("path")))


@query("""
    SELECT o_orderkey AS id,
           CASE o_orderkey % 4 WHEN 0 THEN 'img/a.png' WHEN 1 THEN '/other/b.png' WHEN 2 THEN 'c.png' ELSE 'assets/d.png' END AS path,
           CASE o_orderkey % 4 WHEN 0 THEN '/p/img/a.png' WHEN 2 THEN '/p/c.png' END AS absolute_path FROM orders
""")
def saved_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.when(k % 4 == 0, "/p/img/a.png").when(k % 4 == 1, "/other/b.png").when(k % 4 == 2, "c.png").otherwise("assets/d.png")
    images = table(spark, d, "orders").select(
        k.alias("id"), path.alias("path"), F.lit("/p/").alias("folder"), F.when(k % 4 == 3, "project_asset").otherwise("filesystem").alias("source_type")
    )
    return archive.saved_paths(images).select("id", "path", "absolute_path")


@query("""
    SELECT c_custkey::VARCHAR AS image_id,
           CASE c_custkey % 4 WHEN 0 THEN '/p/' || c_custkey || '.png' WHEN 1 THEN '/abs/' || c_custkey || '.png' WHEN 2 THEN '/p/' || c_custkey || '.png' END AS found,
           CASE c_custkey % 4 WHEN 0 THEN 'project_asset' WHEN 1 THEN 'absolute_path' WHEN 2 THEN 'relative_path' END AS how,
           CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true END AS repaired FROM customer
""")
def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(k.cast("string"), F.lit(".png"))
    images = table(spark, d, "customer").select(
        k.cast("string").alias("image_id"), F.lit("/p").alias("folder"), F.when(k % 4 == 0, "project_asset").otherwise("filesystem").alias("source_type"), name.alias("path"),
        F.when((k % 4 == 1) | (k % 4 == 2), F.concat(F.lit("/abs/"), name)).alias("absolute_path"),
    )
    where = F.when(k % 4 == 1, "/abs/").otherwise("/p/")
    files = table(spark, d, "customer").where("c_custkey % 4 <> 3").select(F.concat(where, name).alias("path"))
    return archive.resolve_paths(images, files)


@query("""
    SELECT o_orderkey, 'captures/capture_19980102_030405_' || lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::VARCHAR, 2, '0') || '.png' AS path FROM orders
""")
def capture_names(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    stamp = T.stamp(F.lit("1998-01-02 03:04:05").cast("timestamp"))
    digits = F.when(place < 10, F.concat(F.lit("0"), place.cast("string"))).otherwise(place.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("captures/capture_"), stamp, F.lit("_"), digits, F.lit(".png")).alias("path"))


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    t AS (SELECT DISTINCT o_custkey, o_orderkey * 7 % 12 + 1 AS n FROM orders WHERE o_orderkey % 3 = 0),
    c AS (SELECT o_custkey, n FROM (SELECT o_custkey, count(*) + 12 AS most FROM orders GROUP BY 1), unnest(range(1, most + 1)) AS u(n)),
    f AS (SELECT c.o_custkey, c.n, row_number() OVER (PARTITION BY c.o_custkey ORDER BY c.n) AS i FROM c ANTI JOIN t ON t.o_custkey = c.o_custkey AND t.n = c.n)
    SELECT r.o_orderkey, 'capture_' || printf('%02d', f.n) || '.png' AS name FROM r JOIN f ON r.o_custkey = f.o_custkey AND r.i = f.i
""")
def free_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that no file has yet: some numbers of each customer's are taken."""
    from .operators.ordinal import free_numbers

    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    taken = rows.where("o_orderkey % 3 = 0").select("o_custkey", (F.col("o_orderkey") * 7 % 12 + 1).alias("number"))
    n = F.col("number").cast("string")
    name = F.concat(F.lit("capture_"), F.lpad(n, F.greatest(F.length(n), F.lit(2)), "0"), F.lit(".png"))
    return free_numbers(rows, taken, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", name.alias("name"))


# ---------------------------------------------------------------- records and derived values


@query(f"""
    WITH {M}, r AS (
        SELECT m.*, CASE WHEN label IS NOT NULL THEN left(label, 1)::INT END AS number, coalesce(label, '未分类') AS name, m.ppu AS p,
               CASE WHEN kind = 'area' THEN w * h / 4 END AS hole FROM m
    )
    SELECT image_id AS image_pos, measurement_id AS measurement_pos, CASE WHEN label IS NULL THEN '未分类' ELSE number || ' ' || label END AS "纤维种类",
           CASE kind WHEN 'line' THEN '线段' WHEN 'polyline' THEN '折线' WHEN 'area' THEN '面积' ELSE '计数点' END AS "类型",
           round(CASE kind WHEN 'area' THEN area_unit WHEN 'count' THEN 1.0 ELSE diameter_unit END, 6) AS "结果",
           CASE kind WHEN 'area' THEN u || '²' WHEN 'count' THEN '个' ELSE u END AS "单位",
           CASE WHEN p IS NULL THEN '未标定' ELSE '标定预设 / lens' END AS "标尺信息", '手动线段' AS "模式", '已编辑' AS "状态", 0.1235 AS "置信度",
           row_number() OVER (PARTITION BY kind ORDER BY image_id, measurement_id) AS "纤维结果序号",
           row_number() OVER (PARTITION BY kind, name ORDER BY image_id, measurement_id) AS "纤维类别结果序号",
           CASE WHEN kind IN ('line', 'polyline') THEN round(x0, 3) END AS "起点X(px)", CASE WHEN kind IN ('line', 'polyline') THEN round(y0, 3) END AS "起点Y(px)",
           CASE kind WHEN 'line' THEN round(x0 + dx, 3) WHEN 'polyline' THEN round(x0 + 10, 3) END AS "终点X(px)",
           CASE kind WHEN 'line' THEN round(y0 + dy, 3) WHEN 'polyline' THEN round(y0 + dx, 3) END AS "终点Y(px)",
           CASE WHEN kind IN ('line', 'polyline') THEN round(diameter_px, 6) END AS "像素直径(px)",
           CASE WHEN kind = 'area' THEN 4 END AS "多边形点数",
           CASE WHEN kind = 'area' THEN '[{{"x": ' || x0 || ', "y": ' || y0 || '}}, {{"x": ' || (x0 + w) || ', "y": ' || y0 || '}}, {{"x": ' || (x0 + w) || ', "y": ' || (y0 + h)
                || '}}, {{"x": ' || x0 || ', "y": ' || (y0 + h) || '}}]' ELSE '' END AS "多边形顶点JSON",
           CASE WHEN kind = 'polyline' THEN 3 END AS "折线点数",
           CASE WHEN kind = 'polyline' THEN '[{{"x": ' || x0 || ', "y": ' || y0 || '}}, {{"x": ' || (x0 + 10) || ', "y": ' || y0 || '}}, {{"x": ' || (x0 + 10) || ', "y": '
                || round(y0 + dx, 3) || '}}]' ELSE '' END AS "折线顶点JSON",
           CASE WHEN kind = 'count' THEN round(x0, 3) END AS "计数点X(px)", CASE WHEN kind = 'count' THEN round(y0, 3) END AS "计数点Y(px)",
           CASE WHEN kind = 'area' THEN round(area_px, 6) END AS "面积(px²)", round(CASE WHEN p > 0 THEN hole / (p * p) ELSE hole END, 6) AS "孔洞面积",
           'now' AS "创建时间", 'i' || image_id AS "图片路径", image_id AS "图片编号", measurement_id AS "测量记录ID", coalesce(label, '') AS "纤维种类ID",
           number AS "纤维类别序号", number AS "纤维种类编号", name AS "纤维种类名称", CASE WHEN label IS NULL THEN '#98A2B3' ELSE '#aabbcc' END AS "纤维种类颜色"
    FROM (SELECT *, CASE WHEN p IS NULL THEN 'px' ELSE 'um' END AS u FROM r)
""")
def record_rows(spark: SparkSession, d: str) -> DataFrame:
    m = A.measurements(spark, d)
    known = m.where("label is not null").select("image_id", F.col("label").alias("category_id")).distinct()
    categories = known.select("*", F.substring("category_id", 1, 1).cast("int").alias("number"), F.col("category_id").alias("label"), F.lit("#aabbcc").alias("color"))
    quarter = F.transform("polygon", lambda p: G.point(F.col("polygon")[0]["x"] + (p["x"] - F.col("polygon")[0]["x"]) / 2, F.col("polygon")[0]["y"] + (p["y"] - F.col("polygon")[0]["y"]) / 2))
    rows = m.withColumnRenamed("label", "category_id").withColumns(
        {
            "image_pos": F.col("image_id"), "measurement_pos": F.col("measurement_id"), "snapped_line": F.lit(None).cast(f"struct<start:{G.POINT},end:{G.POINT}>"),
            "point": F.col("line.start"), "area_rings": F.array(F.col("polygon"), quarter), "mode": F.lit("manual"), "status": F.lit("edited"), "confidence": F.lit(0.12345678),
            "created_at": F.lit("now"), "image_path": F.concat(F.lit("i"), F.col("image_id").cast("string")), "unit": F.when(F.col("ppu").isNotNull(), "um"),
            "calibration_mode": F.when(F.col("ppu").isNotNull(), "preset"), "calibration_source": F.lit("lens"),
        }
    )
    return records.record_rows(rows, categories)


@query(f"""
    WITH {M}
    SELECT measurement_id, round(CASE kind WHEN 'line' THEN x0 + CASE WHEN measurement_id % 3 = 0 THEN 2 ELSE dx END / 2 WHEN 'area' THEN x0 + w / 2 WHEN 'count' THEN x0
                                      ELSE (10 * (x0 + 5) + abs(dx) * (x0 + 10)) / (10 + abs(dx)) END + 1e-7, 4) AS x FROM m
""")
def geometry_centers(spark: SparkSession, d: str) -> DataFrame:
    """Centres by kind; every third line was snapped."""
    snapped = F.when(F.col("measurement_id") % 3 == 0, F.struct(F.col("line.start").alias("start"), G.point(F.col("line.start.x") + 2, F.col("line.end.y")).alias("end")))
    line = V.effective_line(F.col("line"), snapped)
    c = G.geometry_center(F.col("measurement_kind"), line, F.col("polyline"), F.col("line.start"), F.array(F.col("polygon")), F.col("polygon"))
    return A.measurements(spark, d).select("measurement_id", r4(c["x"]).alias("x"))


@query("""
    SELECT p_partkey AS id, round(CASE WHEN p_partkey % 3 = 0 THEN a ELSE a / ((p_partkey % 3) ** 2) END + 1e-7, 4) AS hole
    FROM (SELECT p_partkey, p_size::DOUBLE * (p_partkey % 17 + 2) / 16 AS a FROM part)
""")
def hole_areas(spark: SparkSession, d: str) -> DataFrame:
    from .catalog import _squares

    ppu = (F.col("id") % 3).cast("double")
    return _squares(spark, d).select("id", r4(V.hole_area_unit(F.col("rings"), ppu)).alias("hole"))


@query("""
    SELECT o_orderkey AS id, printf('%.2f', o_orderkey % 1000 / 8.0::DOUBLE) || ' um' AS label, printf('%.4f', o_totalprice / 7 - 9000) || ' px' AS signed FROM orders
""")
def label_texts(spark: SparkSession, d: str) -> DataFrame:
    halves, any_ = F.col("o_orderkey") % 1000 / 8.0, F.col("o_totalprice").cast("double") / 7 - 9000
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), V.label_text(halves, F.lit("um"), 2).alias("label"), V.label_text(any_, F.lit("px")).alias("signed"))


@query("""
    SELECT p_partkey AS id, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS number,
           CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.4f', v), '0'), '.') END AS dimension,
           CASE p_partkey % 4 WHEN 0 THEN '#aabbcc' WHEN 1 THEN '#aabbcc' WHEN 2 THEN '#1f7a8c' ELSE '#0f0f0f' END AS color,
           'strasse' AS folded, '19980102_030405' AS stamp, '1998-01-02T03:04:05' AS iso, length('meas_') + 12 AS id_length
    FROM (SELECT *, p_partkey % 64 / 8.0 AS v FROM part)
""")
def texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v, time = k % 64 / 8.0, F.lit("1998-01-02 03:04:05").cast("timestamp")
    given = F.when(k % 4 == 0, " #AABBCC ").when(k % 4 == 1, "#abc").when(k % 4 == 2, "nothing").otherwise("#0F0F0F")
    return table(spark, d, "part").select(
        k.alias("id"), T.plain_number(v).alias("number"), T.dimension(v).alias("dimension"), T.color(given).alias("color"), T.folded_case(F.lit("STRAẞE")).alias("folded"),
        T.stamp(time).alias("stamp"), T.iso_seconds(time).alias("iso"), F.length(T.stable_id("meas", k.cast("string"))).cast("long").alias("id_length"),
    )


@query("""
    SELECT o_orderkey AS id, greatest(0.0, least(1.0, CASE o_orderkey % 4 WHEN 1 THEN 0.4 WHEN 2 THEN 7.0 ELSE 0.15 END)) AS threshold,
           greatest(1.0, least(1000.0, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 200 ELSE o_orderkey % 3000 END))::INT AS top_k,
           CASE o_orderkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE '未分类' END AS label
    FROM orders WHERE o_orderkey % 4 IN (0, 3) OR o_orderkey % 3000 <> 0
""")
def detection_options(spark: SparkSession, d: str) -> DataFrame:
    """Options within bounds, and labels that one model gives the wrong way round."""
    k = F.col("o_orderkey")
    threshold = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 0.4).when(k % 4 == 2, 7.0)
    top = F.when(k % 4 == 0, 0).when(k % 4 != 3, k % 3000)
    label = F.when(k % 3 == 0, " a ").when(k % 3 == 1, "B").otherwise(" ")
    named = V.result_label(F.lit("A - B"), label, {"a": "A"}, {"A-B": {"A": "B", "B": "A"}})
    rows = table(spark, d, "orders").where((k % 4).isin(0, 3) | (k % 3000 != 0))
    return rows.select(k.alias("id"), V.option(threshold, 0.15, 0.0, 1.0).alias("threshold"), V.option(top, 200, 1, 1000).cast("int").alias("top_k"), named.alias("label"))


def _x(p: str) -> str:
    return f"{p}x"


def _y(p: str) -> str:
    return "b_y" if p == "b" else f"{p}y"  # by is a word of SQL


def _to_segment(p: str, a: str, b: str) -> str:
    """SQL for the distance of a point to a segment; points are named by letters, with columns such as ax and ay."""
    ux, uy, vx, vy = f"({_x(p)} - {_x(a)})", f"({_y(p)} - {_y(a)})", f"({_x(b)} - {_x(a)})", f"({_y(b)} - {_y(a)})"
    t = f"greatest(0.0, least(1.0, coalesce(({ux} * {vx} + {uy} * {vy}) / nullif({vx} * {vx} + {vy} * {vy}, 0), 0)))"
    return f"sqrt(({ux} - {t} * {vx}) ** 2 + ({uy} - {t} * {vy}) ** 2)"


def _apart(p: str, q: str) -> str:
    return f"sqrt(({_x(p)} - {_x(q)}) ** 2 + ({_y(p)} - {_y(q)}) ** 2)"


@query(f"""
    WITH {E}, p AS (SELECT a.id, a.x1 AS ax, a.y1 AS ay, a.x2 AS bx, a.y2 AS b_y, b.x1 AS cx, b.y1 AS cy, b.x2 AS dx, b.y2 AS dy
                    FROM e a JOIN e b ON a.id = b.id AND b.i > a.i + 1 AND NOT (a.i = 1 AND b.i = b.n)),
         s AS (SELECT id, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS s1, (bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax) AS s2,
                      (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS s3, (dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx) AS s4,
                      least({_apart("a", "c")}, {_apart("a", "d")}, {_apart("b", "c")}, {_apart("b", "d")}) AS ends,
                      least({_to_segment("c", "a", "b")}, {_to_segment("d", "a", "b")}, {_to_segment("a", "c", "d")}, {_to_segment("b", "c", "d")}) AS touch FROM p),
         x AS (SELECT DISTINCT id FROM s WHERE ends > 1e-6 AND (touch <= 1e-6 OR ((s1 > 1e-6 AND s2 < -1e-6) OR (s1 < -1e-6 AND s2 > 1e-6))
                                                                  AND ((s3 > 1e-6 AND s4 < -1e-6) OR (s3 < -1e-6 AND s4 > 1e-6))))
    SELECT DISTINCT v.id, x.id IS NOT NULL AS crossed FROM v LEFT JOIN x ON v.id = x.id
""")
def self_crossings(spark: SparkSession, d: str) -> DataFrame:
    return A.outlines(spark, d).select("id", G.self_intersects(F.col("points")).alias("crossed"))


@query("""
    SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 4 END AS n_outline, p_size::DOUBLE AS max_x, 4 AS n_cleaned FROM part
""")
def display_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Rings with repeated and collinear vertices: as they are when selected, else simplified."""
    w = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    ring = F.array(G.point(zero, zero), G.point(zero, zero), G.point(w / 2, zero), G.point(w, zero), G.point(w, w), G.point(zero, w))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ring.alias("ring")).withColumn("clean", G.clean_ring(F.col("ring")))
    ring, clean = F.col("ring"), F.col("clean")
    shown = G.display_geometry(F.array(ring), ring, F.array(clean), clean, F.col("id") % 2 == 0)
    rows = rows.select("id", shown.alias("s"), F.size("clean").alias("n_cleaned"))
    return rows.select("id", F.size("s.outline").alias("n_outline"), F.col("s.bounds.max_x").alias("max_x"), "n_cleaned")


@query("""
    SELECT o_orderkey AS id, CASE WHEN d0 <= d1 THEN 'start' ELSE 'end' END AS name, round(least(d0, d1) + 1e-7, 4) AS distance, round(lx + 1e-7, 4) AS mid_x, round(ux + 1e-7, 4) AS unit_x,
           px BETWEEN least(ax, bx) - 2 AND greatest(ax, bx) + 2 AND py BETWEEN least(ay, by_) - 2 AND greatest(ay, by_) + 2 AS near
    FROM (SELECT *, sqrt((px - ax) ** 2 + (py - ay) ** 2) AS d0, sqrt((px - bx) ** 2 + (py - by_) ** 2) AS d1, (ax + bx) / 2 AS lx,
                 CASE WHEN ax = bx AND ay = by_ THEN 1.0 ELSE (bx - ax) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) END AS ux
          FROM (SELECT o_orderkey, o_orderkey % 37 * 1.0 AS px, o_custkey % 29 * 1.0 AS py, o_orderkey % 11 * 1.0 AS ax, o_custkey % 7 * 1.0 AS ay,
                       (o_orderkey % 11 + o_custkey % 5) * 1.0 AS bx, (o_custkey % 7 + o_orderkey % 3) * 1.0 AS by_ FROM orders))
""")
def line_handles(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p, a, b = G.point(k % 37, c % 29), G.point(k % 11, c % 7), G.point(k % 11 + c % 5, c % 7 + k % 3)
    end = G.nearest_endpoint(F.struct(a.alias("start"), b.alias("end")), p)
    box = G.near_bounds(p, G.bounds(F.array(a, b)), 2.0)
    return table(spark, d, "orders").select(
        k.alias("id"), end["name"].alias("name"), r4(end["distance"]).alias("distance"), r4(G.midpoint(a, b)["x"]).alias("mid_x"),
        r4(G.normalize(G.subtract(b, a))["x"]).alias("unit_x"), box.alias("near"),
    )


@query("""
    SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN abs(py) <= 5 AND px BETWEEN 0 AND s OR sqrt(least((px) ** 2, (px - s) ** 2) + py * py) <= 5 AND NOT px BETWEEN 0 AND s
                                               WHEN 1 THEN sqrt(px * px + py * py) <= 5
                                               ELSE sqrt(greatest(0.0 - px, 0, px - s) ** 2 + greatest(0.0 - py, 0, py - s) ** 2) <= 5 END AS hit,
           round(px + 1 + 1e-7, 4) AS moved_x
    FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_partkey % 61 - 5.25 AS px, p_partkey % 43 - 6.5 AS py FROM part)
""")
def hit_tests(spark: SparkSession, d: str) -> DataFrame:
    """Hits by kind: a line from the origin, a point there, a square."""
    k, s, zero = F.col("p_partkey"), F.col("p_size").cast("double"), F.lit(0.0)
    p = G.point(k % 61 - 5.25, k % 43 - 6.5)
    kind = F.when(k % 3 == 0, "line").when(k % 3 == 1, "count").otherwise("area")
    line = F.struct(G.point(zero, zero).alias("start"), G.point(s, zero).alias("end"))
    square = F.array(G.point(zero, zero), G.point(s, zero), G.point(s, s), G.point(zero, s))
    hit = spatial.hits(kind, p, 5.0, line, F.array(line["start"], line["end"]), G.point(zero, zero), F.array(square))
    moved = F.get(G.translate(F.array(p), 1.0, 0.0), F.lit(0))
    return table(spark, d, "part").select(k.alias("id"), hit.alias("hit"), r4(moved["x"]).alias("moved_x"))


@query(f"""
    WITH {E}, q AS (SELECT id, i, n, x1, y1, x2 - x1 AS vx, y2 - y1 AS vy, (id % 50)::DOUBLE - x1 AS ux, (id % 90)::DOUBLE - y1 AS uy FROM e),
         t AS (SELECT *, CASE WHEN vx * vx + vy * vy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (ux * vx + uy * vy) / nullif(vx * vx + vy * vy, 0))) END AS t FROM q)
    SELECT id, round(min(sqrt((ux - t * vx) ** 2 + (uy - t * vy) ** 2)) FILTER (WHERE i < n OR n = 1) + 1e-7, 3) AS path,
           round(CASE WHEN min(n) < 2 THEN -1 ELSE min(sqrt((ux - t * vx) ** 2 + (uy - t * vy) ** 2)) END + 1e-7, 3) AS edge FROM t GROUP BY id
""")
def path_distances(spark: SparkSession, d: str) -> DataFrame:
    p, points = G.point(F.col("id") % 50, F.col("id") % 90), F.col("points")
    edge = F.when(F.size(points) < 2, -1.0).otherwise(G.polygon_edge_distance(p, points))
    return A.outlines(spark, d).select("id", F.round(G.polyline_distance(p, points) + 1e-7, 3).alias("path"), F.round(edge + 1e-7, 3).alias("edge"))


@query("""
    SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders WHERE o_orderkey % 13 = 0
""")
def count_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderkey % 13 = 0").select("o_custkey", F.col("o_orderkey").alias("id"))
    return ordinal.running_number(rows, ["o_custkey"], "o_custkey", ["id"], "number").select("id", "number")


# ---------------------------------------------------------------- lookups and edits


@query("""
    WITH ex AS (SELECT s_nationkey AS project_id, 'n' || s_suppkey % 3 || CASE WHEN s_suppkey % 5 = 0 THEN ' (导入)' ELSE '' END AS name, (s_suppkey % 4)::DOUBLE AS ppu FROM supplier),
    inc AS (SELECT c_nationkey AS project_id, c_custkey AS pos, 'n' || c_custkey % 3 AS name, (c_custkey % 6)::DOUBLE AS ppu FROM customer),
    marked AS (SELECT *, EXISTS (SELECT 1 FROM ex WHERE ex.project_id = inc.project_id AND ex.name = inc.name AND abs(ex.ppu - inc.ppu) < 1e-9)
                      OR EXISTS (SELECT 1 FROM inc o WHERE o.project_id = inc.project_id AND o.name = inc.name AND o.pos < inc.pos AND abs(o.ppu - inc.ppu) < 1e-9) AS skip FROM inc),
    used AS (SELECT project_id, left(name, 2) AS name, list(DISTINCT CASE WHEN length(name) > 2 THEN 1 ELSE 0 END) AS ks FROM ex GROUP BY 1, 2),
    placed AS (SELECT m.*, row_number() OVER (PARTITION BY project_id, name, skip ORDER BY pos) AS place FROM marked m),
    k AS (SELECT p.*, list_filter(range(0, 99), lambda x: NOT list_contains(coalesce(u.ks, []), x))[place] AS k FROM placed p LEFT JOIN used u USING (project_id, name))
    SELECT project_id, pos, CASE WHEN skip THEN 'skip' WHEN k > 0 THEN 'rename' ELSE 'import' END AS action,
           CASE WHEN skip OR k = 0 THEN name WHEN k = 1 THEN name || ' (导入)' ELSE name || ' (导入 ' || k || ')' END AS final_name FROM k
""")
def preset_imports(spark: SparkSession, d: str) -> DataFrame:
    def rows(name, prefix, most):
        key = F.col(f"{prefix}key")
        nation = F.col("s_nationkey" if name == "supplier" else "c_nationkey")
        return table(spark, d, name).select(
            nation.alias("project_id"), key.alias("pos"), F.concat(F.lit("n"), (key % 3).cast("string")).alias("name"), F.lit("um").alias("unit"), (key % most).cast("double").alias("ppu")
        )

    existing = rows("supplier", "s_supp", 4)
    existing = existing.withColumn("name", F.when(F.col("pos") % 5 == 0, F.concat("name", F.lit(" (导入)"))).otherwise(F.col("name")))
    return lookup.plan_presets(existing, rows("customer", "c_cust", 6))


@query("""
    SELECT c_custkey AS image_id, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS label, CASE WHEN c_custkey % 2 = 0 THEN '#' || n_nationkey END AS color
    FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def active_categories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    images = table(spark, d, "customer").select(k.alias("image_id"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("active_category_id"), "c_nationkey")
    nation = table(spark, d, "nation")
    categories = images.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "image_id", F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("label"), F.concat(F.lit("#"), "n_nationkey").alias("color")
    )
    found = lookup.with_active_category(images.drop("c_nationkey"), categories)
    return found.select("image_id", F.col("active_label").alias("label"), F.col("active_color").alias("color"))


def _order_categories(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's priorities as categories."""
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("category_id")).distinct()
    number = F.substring("category_id", 1, 1).cast("int")
    return found.select("*", number.alias("number"), F.substring("category_id", 3, 20).alias("label"), F.lit("#000000").alias("color"))


_CATEGORIES = """
    cat AS (SELECT DISTINCT o_custkey AS image_id, o_orderpriority AS category_id, left(o_orderpriority, 1)::INT AS number, substr(o_orderpriority, 3) AS label FROM orders)
"""


@query(f"""
    WITH {_CATEGORIES}, pairs AS (SELECT image_id FROM cat WHERE label IN ('URGENT', 'LOW') GROUP BY 1 HAVING count(*) = 2),
    kept AS (SELECT cat.image_id, category_id, number, CASE WHEN label IN ('URGENT', 'LOW') THEN 'LOW' ELSE label END AS label, label IN ('URGENT', 'LOW') AS chosen
             FROM cat WHERE NOT (label = 'URGENT' AND image_id IN (SELECT * FROM pairs))),
    fresh AS (SELECT c_custkey AS image_id, c_custkey || '/LOW' AS category_id, coalesce((SELECT max(number) FROM cat WHERE cat.image_id = c_custkey), 0) + 1 AS number, 'LOW' AS label, true AS chosen
            FROM customer WHERE c_custkey NOT IN (SELECT image_id FROM cat WHERE label IN ('URGENT', 'LOW'))),
    every AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
    SELECT image_id, category_id, label, CASE WHEN chosen THEN '#ff0000' ELSE '#000000' END AS color,
           row_number() OVER (PARTITION BY image_id ORDER BY number, category_id)::INT AS number FROM every
""")
def edited_template(spark: SparkSession, d: str) -> DataFrame:
    """URGENT becomes LOW in every image: renamed, merged or added."""
    images = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"))
    return mutate.edit_template(images, _order_categories(spark, d), "URGENT", "LOW", "#ff0000")[0]


@query(f"""
    WITH {_CATEGORIES}, real AS (SELECT image_id FROM cat WHERE label IN ('HIGH', 'MEDIUM') GROUP BY 1 HAVING count(*) = 2),
    moved AS (SELECT o_custkey AS image_id, o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' AND o_custkey IN (SELECT * FROM real) THEN '3-MEDIUM' ELSE o_orderpriority END AS category_id FROM orders),
    left_ AS (SELECT * FROM cat WHERE NOT (label = 'HIGH' AND image_id IN (SELECT * FROM real)))
    SELECT l.image_id, l.category_id, row_number() OVER (PARTITION BY l.image_id ORDER BY l.number)::INT AS number, count(m.o_orderkey) AS n, min(m.o_orderkey) AS first, max(m.o_orderkey) AS last
    FROM left_ l LEFT JOIN moved m ON l.image_id = m.image_id AND l.category_id = m.category_id GROUP BY l.image_id, l.category_id, l.number
""")
def merged_memberships(spark: SparkSession, d: str) -> DataFrame:
    """HIGH merged into MEDIUM where an image has both; what each category holds afterwards."""
    measurements = table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("measurement_id"), F.col("o_orderpriority").alias("category_id"))
    merges = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.lit("2-HIGH").alias("source"), F.lit("3-MEDIUM").alias("target"))
    moved, categories = mutate.merge_into(measurements, _order_categories(spark, d), merges)
    held = mutate.memberships(moved, categories)
    return held.join(categories.select("image_id", "category_id", "number"), ["image_id", "category_id"])


@query("""
    SELECT c_custkey AS image_id, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a|b' END AS labels FROM customer
""")
def unsuppressed_labels(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.array(F.lit("a"), F.lit("b")).alias("suppressed_labels"))
    labels = images.where("image_id % 2 = 0").select("image_id", F.lit(" a ").alias("label"))
    return mutate.unsuppress(images, labels).select("image_id", F.array_join("suppressed_labels", "|").alias("labels"))


@query("""
    SELECT s_suppkey AS annotation_id, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 + CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 0 END END AS anchor_x,
           CASE WHEN s_suppkey % 2 = 1 THEN 2.0 + CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 0 END END AS end_x FROM supplier WHERE s_suppkey % 10 <> 0
""")
def annotation_edits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = k % 2 == 0
    rows = table(spark, d, "supplier").select(
        k.alias("annotation_id"), F.when(text, "text").otherwise("rect").alias("kind"), F.when(text, G.point(F.lit(1), F.lit(1))).alias("anchor"),
        F.when(~text, G.point(F.lit(0), F.lit(0))).alias("start"), F.when(~text, G.point(F.lit(2), F.lit(2))).alias("end"),
    )
    left = mutate.delete_rows(rows, rows.where("annotation_id % 10 = 0"), ["annotation_id"])
    moves = rows.where("annotation_id % 3 = 0").select("annotation_id", F.lit(5.0).alias("dx"), F.lit(0.0).alias("dy"))
    return mutate.move_annotations(left, moves).select("annotation_id", F.col("anchor.x").alias("anchor_x"), F.col("end.x").alias("end_x"))


@query("""
    WITH RECURSIVE l AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'undo' WHEN event_id % 7 = 0 THEN 'redo' ELSE 'push' END AS action, floor(value / 20)::INT AS state,
                                row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::INT[] AS past, []::INT[] AS future FROM (SELECT DISTINCT user_id FROM l)
          UNION ALL
          SELECT l.user_id, l.i, l.event_id,
                 CASE WHEN action = 'push' AND (len(past) = 0 OR past[-1] <> state) THEN list_append(past, state) WHEN action = 'undo' AND len(past) > 1 THEN past[:-2]
                      WHEN action = 'redo' AND len(future) > 0 THEN list_append(past, future[-1]) ELSE past END,
                 CASE WHEN action = 'push' AND (len(past) = 0 OR past[-1] <> state) THEN [] WHEN action = 'undo' AND len(past) > 1 THEN list_append(future, past[-1])
                      WHEN action = 'redo' AND len(future) > 0 THEN future[:-2] ELSE future END
          FROM f JOIN l ON f.user_id = l.user_id AND l.i = f.i + 1)
    SELECT user_id, event_id, past[-1] AS current, greatest(len(past) - 1, 0)::INT AS n_undo, len(future)::INT AS n_redo FROM f WHERE i > 0
""")
def undo_redo(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    action = F.when(k % 5 == 0, "undo").when(k % 7 == 0, "redo").otherwise("push")
    log = _events(spark, d).select("user_id", k, action.alias("action"), F.floor(F.col("value") / 20).cast("int").alias("state"))
    return history.replay(log, "user_id", ["event_id"]).select("user_id", "event_id", F.col("current").cast("int").alias("current"), "n_undo", "n_redo")


@query("""
    SELECT user_id AS id, arg_max(event_type, event_id) AS kind FROM events WHERE event_id <= 5000 GROUP BY 1 HAVING max(event_id) % 9 <> 0
""")
def table_version(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), (F.col("event_id") % 9 == 0).alias("deleted"), F.col("event_type").alias("kind"))
    return history.as_of_version(rows, ["id"], 5000)


# ---------------------------------------------------------------- streams in batch form


@query("""
    WITH RECURSIVE s AS (SELECT user_id, event_id, value AS light, event_id % 9 * 1.0 AS sharp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, i, event_id, light, sharp, true AS ok, 1 AS n, sharp AS best FROM s WHERE i = 1
          UNION ALL
          SELECT user_id, i, event_id, CASE WHEN ok THEN nl ELSE light END, CASE WHEN ok THEN ns ELSE sharp END, ok, n + ok::INT, CASE WHEN ok THEN greatest(best, ns) ELSE best END
          FROM (SELECT s.user_id, s.i, s.event_id, f.light, f.sharp, f.n, f.best, s.light AS nl, s.sharp AS ns,
                       NOT (abs(s.light - f.light) < 10 AND abs(s.sharp - f.sharp) < 3) AS ok FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1))
    SELECT user_id, event_id, ok AS accepted, n::INT AS n_accepted, best FROM f
""")
def focus_stack(spark: SparkSession, d: str) -> DataFrame:
    """Frames that differ from the last accepted one in light or sharpness, with the running report."""
    from .streaming.frames import stacked

    rows = _events(spark, d).select("user_id", "event_id", F.col("value").alias("light"), (F.col("event_id") % 9).cast("double").alias("sharpness"))
    return stacked(rows, "user_id", "event_id", 10.0, 3.0).select("user_id", "event_id", "accepted", "n_accepted", "best")


@query("""
    WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, i, event_id, t, true AS shown FROM s WHERE i = 1
          UNION ALL
          SELECT s.user_id, s.i, s.event_id, CASE WHEN s.t - f.t >= 7200000000 THEN s.t ELSE f.t END, s.t - f.t >= 7200000000 FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
    SELECT user_id, event_id FROM f WHERE shown
""")
def progress_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report at most every so often since the last one."""
    from .streaming.frames import reports

    rows = _events(spark, d).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return reports(rows, "user_id", "event_id", "t", 7_200_000_000).select("user_id", "event_id")


@query("""
    SELECT user_id, max(event_id) AS event_id FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = e.user_id AND c_custkey % 3 = 0) GROUP BY 1
""")
def cancelled_requests(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import latest, without_cancelled

    cancelled = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return latest(without_cancelled(_events(spark, d), cancelled, ["user_id"]), "user_id", "event_id", [])


@query("""
    SELECT user_id, event_id, event_type AS reason, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events WHERE value < 50
""")
def rejection_counters(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.frames import running_counters

    rows = _events(spark, d).where("value < 50").withColumnRenamed("event_type", "reason")
    return running_counters(rows, "user_id", "event_id", "reason").select("user_id", "event_id", "reason", "n")


@query("""
    SELECT 0 AS rule, 'A' AS sheet, (row_number() OVER (ORDER BY user_id, event_id))::INT AS row, 1 AS col, round(value, 3)::DOUBLE AS value, true AS fallback FROM events
""")
def report_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rules that have no room for all categories give way to the plain list, with the reason."""
    rows = _events(spark, d).select(
        F.col("user_id").alias("image_pos"), F.col("event_id").alias("measurement_pos"), F.col("event_type").alias("label"), F.col("event_type").alias("category_id"),
        F.lit("线段").alias("kind_label"), F.round("value", 3).alias("display_value"), F.round("value", 3).alias("result"),
    )
    labels = report.category_labels(rows.select("image_pos", F.col("measurement_pos").alias("number"), "label"), rows)
    cells, message = report.with_fallback([report.Rule("measurement_field", "X", "A1", "B1", "vertical", "result")], rows, labels)
    return cells.select("rule", "sheet", "row", F.col("column").alias("col"), F.col("value").cast("double").alias("value"), F.lit(message != "").alias("fallback"))


@query("""
    WITH RECURSIVE s AS (SELECT user_id, event_id, event_id // 200 - CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS g, event_id % 4 * 0.9 AS dx,
                                CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 0.5 END AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, -1::BIGINT AS newest, 0 AS streak, false AS ok FROM (SELECT DISTINCT user_id FROM s)
          UNION ALL
          SELECT user_id, i, event_id, greatest(newest, g), CASE WHEN g < newest THEN streak WHEN dx <= 2 AND r >= 0.015 OR was >= 2 AND dx <= 1.1 THEN was + 1 ELSE 0 END, g >= newest
          FROM (SELECT s.*, f.newest, f.streak, CASE WHEN s.g > f.newest THEN 0 ELSE f.streak END AS was FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1))
    SELECT user_id, event_id, streak::INT AS streak, streak >= 2 AS stable FROM f WHERE ok AND i > 0
""")
def stability_states(spark: SparkSession, d: str) -> DataFrame:
    """When a view stands still, with stale generations and weak responses."""
    from .streaming.frames import gated

    k = F.col("event_id")
    rows = _events(spark, d).select(
        "user_id", k, (F.floor(k / 200) - F.when(k % 10 == 0, 1).otherwise(0)).alias("generation"), (k % 4 * 0.9).cast("double").alias("dx"), F.lit(0.0).alias("dy"),
        F.when(k % 3 == 0, 0.0).otherwise(0.5).alias("response"),
    )
    return gated(rows, "user_id", "event_id", 320.0).select("user_id", "event_id", "streak", "stable")


@query("""
    WITH RECURSIVE s AS (SELECT user_id, event_id, floor(value / 30) * 8.0 AS x, event_id % 3 / 2.0 AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS last, 0 AS streak, 0 AS tile, 0.0::DOUBLE AS x0, 0 AS n, false AS leaving, NULL::VARCHAR AS state
          FROM (SELECT DISTINCT user_id FROM s)
          UNION ALL
          SELECT user_id, i, event_id, x, CASE WHEN state = 'candidate_rejected' THEN 0 ELSE streak END, CASE WHEN fresh THEN tile + 1 ELSE tile END, CASE WHEN fresh THEN x ELSE x0 END,
                 CASE WHEN fresh THEN 1 WHEN state = 'sampling' THEN n + 1 ELSE n END, leaving AND state <> 'tile_committed', state
          FROM (SELECT *, state = 'tile_committed' OR state = 'sampling' AND n = 0 AS fresh
                FROM (SELECT *, CASE WHEN streak = 0 THEN 'moving' WHEN streak < 2 THEN 'settling' WHEN n = 0 THEN 'sampling' WHEN leaving AND m >= 0.5 THEN 'tile_committed'
                                     WHEN leaving THEN 'candidate_rejected' WHEN n < 3 THEN 'sampling' ELSE 'tile_full' END AS state
                      FROM (SELECT user_id, i, event_id, x, m, tile, x0, n, leaving OR starts AS leaving, CASE WHEN starts THEN steady::INT WHEN steady THEN streak + 1 ELSE 0 END AS streak
                            FROM (SELECT *, n > 0 AND away >= 6 AND NOT leaving AS starts
                                  FROM (SELECT *, was AND NOT (n > 0 AND away <= 3.9) AS leaving, moved <= 2 OR n > 0 AND NOT was AND moved <= 1.1 AS steady
                                        FROM (SELECT s.user_id, s.i, s.event_id, s.x, s.m, f.streak, f.tile, f.x0, f.n, f.leaving AS was, coalesce(abs(s.x - f.last), 0) AS moved,
                                                     CASE WHEN f.n > 0 THEN abs(s.x - f.x0) ELSE 0 END AS away
                                              FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)))))))
    SELECT user_id, event_id, state, tile::INT AS tile, n::INT AS n_frames FROM f WHERE i > 0
""")
def tile_states(spark: SparkSession, d: str) -> DataFrame:
    """The tile map of a moving view."""
    from .streaming.frames import tiles

    k = F.col("event_id")
    rows = _events(spark, d).select("user_id", k, (F.floor(F.col("value") / 30) * 8.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("response"), (k % 3 / 2.0).alias("match"))
    return tiles(rows, "user_id", "event_id", 320.0).select("user_id", "event_id", "state", "tile", "n_frames")


@query("""
    SELECT p_partkey AS id, min(s_suppkey) OVER (PARTITION BY p_partkey) AS template, c.label IS NOT NULL AS used
    FROM part JOIN supplier ON s_suppkey = p_partkey % 50 + 1 LEFT JOIN (SELECT DISTINCT p_size % 5 AS label FROM part WHERE p_size < 3) c ON c.label = p_size % 5
""")
def template_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Templates found by their path without regard to case, and whether a label is in use."""
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    asked = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Dir/Straße"), (F.col("p_partkey") % 50 + 1).cast("string")).alias("path"), (F.col("p_size") % 5).alias("label"))
    known = supplier.where("s_suppkey <= 50").select(F.concat(F.lit("DIR/STRASSE"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_suppkey").alias("template"))
    found = lookup.by_folded_path(asked, known)
    labels = part.where("p_size < 3").select((F.col("p_size") % 5).alias("label"))
    return lookup.in_use(found, labels, "label").select("id", "template", "used")
