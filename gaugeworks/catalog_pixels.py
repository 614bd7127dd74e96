"""Queries over grey images whose pixels are rows, with their SQL: suppliers as small images drawn by rule."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query, r4
from .operators import correlation, focus, snap, tiles
from .session import shared_folder, spread, table, written
from .sources import images

WIDTH, HEIGHT = 120, 44


def _value_sql(x: str, y: str) -> str:
    """The grey value at a whole place of an image (m, l, w): a strip, a step or nothing, with a faint texture."""
    strip = f"{x} BETWEEN l AND l + w - 1"
    drawn = (
        f"CASE WHEN m = 1 THEN CASE WHEN {strip} THEN 220 ELSE 40 END WHEN m = 3 THEN 200 WHEN m = 4 THEN CASE WHEN {x} < l THEN 210 ELSE 60 END "
        f"WHEN m = 5 THEN CASE WHEN {strip} THEN 192 ELSE 200 END ELSE CASE WHEN {strip} THEN 25 ELSE 235 END END"
    )
    return f"({drawn} + ({x} * 7 + {y} * 5) % 11 * 0.0625)"


_SNAP_SQL = f"""
    line AS (SELECT *, l - 18.3::DOUBLE AS ax, 20.6::DOUBLE AS ay, CASE WHEN m = 6 THEN l - 16.3::DOUBLE ELSE l + w + 18.2::DOUBLE END AS ex,
                    CASE WHEN m = 2 THEN 34.3::DOUBLE ELSE 20.6::DOUBLE END AS ey
             FROM (SELECT s_suppkey AS line, s_suppkey % 7 AS m, 40 + s_suppkey % 20 AS l, 10 + s_suppkey % 15 AS w FROM supplier)),
    sized AS (SELECT *, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS len FROM line),
    cut AS (SELECT *, greatest(7, ceil(len / 0.5)::INT + 1) AS n FROM sized WHERE len >= 3),
    spot AS (SELECT *, greatest(0.0, least(ax + i * len / (n - 1) * (ex - ax) / len - o * (ey - ay) / len, {WIDTH - 1}.0)) AS sx,
                  greatest(0.0, least(ay + i * len / (n - 1) * (ey - ay) / len + o * (ex - ax) / len, {HEIGHT - 1}.0)) AS sy
           FROM cut, unnest(range(0, n)) AS t(i), unnest(range(-2, 3)) AS u(o)),
    near AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0, least(floor(sx)::INT + 1, {WIDTH - 1}) AS x1, least(floor(sy)::INT + 1, {HEIGHT - 1}) AS y1,
                    sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM spot),
    p AS (SELECT line, len, n, i, avg(({_value_sql("x0", "y0")} * (1 - fx) + {_value_sql("x1", "y0")} * fx) * (1 - fy)
                                    + ({_value_sql("x0", "y1")} * (1 - fx) + {_value_sql("x1", "y1")} * fx) * fy) AS v FROM near GROUP BY line, len, n, i),
    soft AS (SELECT a.line, a.len, a.n, a.i, a.len / (a.n - 1) AS step, sum(b.v * t.c) / 16 AS v FROM p a, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(k, c), p b
             WHERE b.line = a.line AND b.i = least(greatest(a.i + t.k, 0), a.n - 1) GROUP BY ALL),
    g AS (SELECT a.*, (b.v - c.v) / ((b.i - c.i) * a.step) AS g FROM soft a JOIN soft b ON b.line = a.line AND b.i = least(a.i + 1, a.n - 1)
          JOIN soft c ON c.line = a.line AND c.i = greatest(a.i - 1, 0)),
    k AS (SELECT line, n, len, step, max(abs(g)) AS steep,
                 avg(v) FILTER (WHERE i >= (n - greatest(1, floor(n * 0.3)::INT)) // 2 AND i < (n - greatest(1, floor(n * 0.3)::INT)) // 2 + greatest(1, floor(n * 0.3)::INT))
                 - avg(v) FILTER (WHERE i < greatest(1, floor(n * 0.15)::INT) OR i >= n - greatest(1, floor(n * 0.15)::INT)) AS inside FROM g GROUP BY line, n, len, step),
    s AS (SELECT *, n // 2 AS mid, greatest(2, least(n // 2 - 1, round_even(n * 0.05, 0)::INT)) AS guard, greatest(3.0, steep / 4) AS lim,
                 CASE WHEN inside < 0 THEN -1 ELSE 1 END AS sg FROM k),
    h AS (SELECT g.line, g.i, g.g, lag(g.g) OVER w AS gp, lead(g.g) OVER w AS gn, lim,
                 CASE WHEN g.i >= guard AND g.i < mid THEN 0 WHEN g.i > mid AND g.i < greatest(mid + 1, s.n - guard) THEN 1 END AS half,
                 CASE WHEN g.i < mid THEN g.i > guard AND g.i < mid - 1 ELSE g.i > mid + 1 AND g.i < greatest(mid + 1, s.n - guard) - 1 END AS inner_,
                 CASE WHEN g.i < mid THEN sg ELSE -sg END AS q
          FROM g JOIN s ON g.line = s.line WINDOW w AS (PARTITION BY g.line ORDER BY g.i)),
    c AS (SELECT line, min(i) FILTER (WHERE half = 0 AND inner_ AND q * g >= lim AND q * g >= q * gp AND q * g >= q * gn) AS pl,
                 max(i) FILTER (WHERE half = 1 AND inner_ AND q * g >= lim AND q * g >= q * gp AND q * g >= q * gn) AS pr,
                 arg_max(i, struct_pack(v := abs(g), b := -i)) FILTER (WHERE half = 0 AND q * g >= lim) AS sl,
                 arg_max(i, struct_pack(v := abs(g), b := -i)) FILTER (WHERE half = 1 AND q * g >= lim) AS sr,
                 arg_max(i, struct_pack(v := abs(g), b := -i)) FILTER (WHERE half = 0 AND abs(g) >= lim) AS al,
                 arg_max(i, struct_pack(v := abs(g), b := -i)) FILTER (WHERE half = 1 AND abs(g) >= lim) AS ar FROM h GROUP BY line),
    d AS (SELECT c.line, CASE WHEN pl IS NOT NULL AND pr IS NOT NULL THEN pl WHEN sl IS NOT NULL AND sr IS NOT NULL THEN sl WHEN x.g * y.g < 0 THEN al END AS lo,
                 CASE WHEN pl IS NOT NULL AND pr IS NOT NULL THEN pr WHEN sl IS NOT NULL AND sr IS NOT NULL THEN sr WHEN x.g * y.g < 0 THEN ar END AS hi,
                 pl IS NULL OR pr IS NULL AS fallback
          FROM c LEFT JOIN h x ON x.line = c.line AND x.i = al LEFT JOIN h y ON y.line = c.line AND y.i = ar),
    e AS (SELECT d.*, (lo + coalesce(greatest(-1.0, least(1.0, (x.gp - x.gn) / 2 / nullif(x.gp - 2 * x.g + x.gn, 0))), 0)) * step AS a,
                 (hi + coalesce(greatest(-1.0, least(1.0, (y.gp - y.gn) / 2 / nullif(y.gp - 2 * y.g + y.gn, 0))), 0)) * step AS b,
                 (abs(x.g) + abs(y.g)) / 2 AS strength
          FROM d JOIN s ON d.line = s.line JOIN h x ON x.line = d.line AND x.i = lo JOIN h y ON y.line = d.line AND y.i = hi),
    f AS (SELECT z.line, CASE WHEN z.len < 3 THEN 'line_too_short' WHEN s.steep < 3 AND abs(inside) < 4 THEN 'profile_too_flat' WHEN e.line IS NULL OR a >= b THEN 'edge_pair_not_found' END AS why,
                 b - a AS diameter, fallback, inside, greatest(0.01, least(0.99, least(1.0, strength / 20) * 0.45
                     + greatest(0.0, 1 - abs((a + b) / 2 - s.len / 2) / greatest(s.len / 2, 1)) * 0.25 + least(1.0, abs(inside) / 24) * 0.3)) AS sure
          FROM sized z LEFT JOIN s ON s.line = z.line LEFT JOIN e ON e.line = z.line)
"""


def small_images(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pixels (id, x, y, value) of one image for each supplier, and a line across it."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("id"), (k % 7).alias("m"), (40 + k % 20).alias("l"), (10 + k % 15).alias("w"))
    places = spread(rows, "id").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))))
    pixels = places.select("id", "x", "y", _value(F.col("m")).alias("value"))
    m, left = F.col("m"), F.col("l").cast("double")
    lines = rows.select(
        F.col("id").alias("line"), "id", (left - 18.3).alias("ax"), F.lit(20.6).alias("ay"),
        F.when(m == 6, left - 16.3).otherwise(F.col("l") + F.col("w") + F.lit(18.2)).alias("bx"), F.when(m == 2, 34.3).otherwise(20.6).alias("by"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )
    return pixels, lines


def _value(m: Column) -> Column:
    x, y = F.col("x"), F.col("y")
    strip = x.between(F.col("l"), F.col("l") + F.col("w") - 1)
    drawn = (
        F.when(m == 1, F.when(strip, 220).otherwise(40)).when(m == 3, 200).when(m == 4, F.when(x < F.col("l"), 210).otherwise(60))
        .when(m == 5, F.when(strip, 192).otherwise(200)).otherwise(F.when(strip, 25).otherwise(235))
    )
    return drawn + (x * 7 + y * 5) % 11 * 0.0625


@query(f"""
    WITH {_SNAP_SQL}
    SELECT line, coalesce(why, CASE WHEN sure < 0.45 THEN 'manual_review' ELSE 'snapped' END) AS status,
           CASE WHEN why IS NULL THEN round(diameter + 1e-7, 4) END AS diameter, CASE WHEN why IS NULL THEN round(sure + 1e-7, 4) ELSE 0 END AS confidence,
           CASE WHEN inside < 0 THEN 'dark_on_light' WHEN inside IS NOT NULL THEN 'light_on_dark' END AS polarity, CASE WHEN why IS NULL THEN fallback END AS fallback FROM f
""")
def snapped_lines(spark: SparkSession, d: str) -> DataFrame:
    found = snap.snapped_lines(*small_images(spark, d))
    sure = F.when(F.col("status").isin(snap.REVIEW, snap.SNAPPED), r4("confidence")).otherwise(0.0)
    return found.select("line", "status", r4("diameter").alias("diameter"), sure.alias("confidence"), "polarity", "fallback")


#: Images of 24 x 18 pixels by supplier, and what a stencil of 3 x 3 and a blur make of them; beyond the border they are mirrored.
_FOCUS_SQL = f"""
    px AS (SELECT s_suppkey AS id, x, y, ((x * x * 7 + y * y * 5 + x * y * (s_suppkey % 7 + 1)) % 256)::DOUBLE AS v FROM supplier, unnest(range(0, 24)) AS t(x), unnest(range(0, 18)) AS u(y)),
    k3 AS (SELECT * FROM (VALUES (-1, -1, 2, -1, -1), (0, -1, 0, 0, -2), (1, -1, 2, 1, -1), (-1, 0, 0, -2, 0), (0, 0, -8, 0, 0), (1, 0, 0, 2, 0), (-1, 1, 2, -1, 1), (0, 1, 0, 0, 2), (1, 1, 2, 1, 1)) t(dx, dy, l, gx, gy)),
    d AS (SELECT a.id, a.x, a.y, abs(sum(b.v * l)) + 0.35 * sqrt(sum(b.v * gx) * sum(b.v * gx) + sum(b.v * gy) * sum(b.v * gy)) AS s FROM px a, k3, px b
          WHERE b.id = a.id AND b.x = CASE WHEN abs(a.x + dx) > 23 THEN 46 - abs(a.x + dx) ELSE abs(a.x + dx) END
            AND b.y = CASE WHEN abs(a.y + dy) > 17 THEN 34 - abs(a.y + dy) ELSE abs(a.y + dy) END GROUP BY a.id, a.x, a.y),
    k9 AS (SELECT * FROM (VALUES {", ".join(f"({i - 4}, {t!r}::DOUBLE)" for i, t in enumerate(focus.gaussian(1.0)))}) t(o, t)),
    h AS (SELECT a.id, a.x, a.y, sum(b.s * t) AS s FROM d a, k9, d b WHERE b.id = a.id AND b.y = a.y AND b.x = CASE WHEN abs(a.x + o) > 23 THEN 46 - abs(a.x + o) ELSE abs(a.x + o) END GROUP BY ALL),
    f AS (SELECT a.id, a.x, a.y, sum(b.s * t) AS s FROM h a, k9, h b WHERE b.id = a.id AND b.x = a.x AND b.y = CASE WHEN abs(a.y + o) > 17 THEN 34 - abs(a.y + o) ELSE abs(a.y + o) END GROUP BY ALL)
"""


@query(f"""
    WITH {_FOCUS_SQL} SELECT id, y, round(avg(s) + 1e-7, 4) AS mean, round(max(s) + 1e-7, 4) AS sharpest FROM f GROUP BY id, y
""")
def focus_measures(spark: SparkSession, d: str) -> DataFrame:
    """The sharpness of each line of the suppliers' images."""
    k, x, y = F.col("s_suppkey"), F.col("x"), F.col("y")
    # a task sorts its images' pixels, then lines with an array for each stencil: about 100,000 pixels at a time
    suppliers = spread(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 250)
    rows = suppliers.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(17))))
    pixels = rows.select(k.alias("id"), "x", "y", ((x * x * 7 + y * y * 5 + x * y * (k % 7 + 1)) % 256).alias("value"))
    found = focus.sharpness(focus.image_lines(pixels))
    mean = F.aggregate("focus", F.lit(0.0), lambda a, v: a + v) / F.size("focus")
    return found.select("id", "y", r4(mean).alias("mean"), r4(F.array_max("focus")).alias("sharpest"))


@query("""
    SELECT o_custkey AS map, o_orderkey AS tile, round(x - first_value(x) OVER w + 1e-7, 4) AS x, round(y - first_value(y) OVER w + 1e-7, 4) AS y
    FROM (SELECT *, o_orderkey * 37 % 500 + o_totalprice % 1 AS x, o_orderkey * 53 % 400 * 0.5 AS y FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
""")
def tile_places(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as tiles of a map, placed by what the edges between neighbours in three orders say."""
    k = F.col("o_orderkey")
    x, y = k * 37 % 500 + F.col("o_totalprice").cast("double") % 1, k * 53 % 400 * 0.5
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("map"), k.alias("tile"), x.alias("x"), y.alias("y"), F.col("o_totalprice").alias("p"))
    edges = None
    for order in (["tile"], ["p", "tile"], ["x", "tile"]):
        w = Window.partitionBy("map").orderBy(*order)
        found = rows.select("map", F.lag("tile").over(w).alias("source"), F.col("tile").alias("target"), (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
        found = found.where("source is not null").withColumn("weight", 0.4 + F.col("target") % 5 * 0.1)
        edges = found if edges is None else edges.unionByName(found)
    placed = tiles.tile_positions(rows, edges)
    return placed.select("map", "tile", r4("x").alias("x"), r4("y").alias("y"))


@query("""
    WITH t AS (SELECT s_suppkey // 4 AS map, s_suppkey AS tile, s_suppkey % 4 * 13.4 + s_suppkey % 3 * 0.25 - 2.1 AS x, s_suppkey % 2 * 7.7 AS y, 20 AS width, 16 AS height FROM supplier),
    o AS (SELECT map, floor(min(x)) AS x0, floor(min(y)) AS y0 FROM t GROUP BY map),
    p AS (SELECT t.map, round_even(x - x0, 0)::BIGINT + px AS x, round_even(y - y0, 0)::BIGINT + py AS y, (tile * 31 + px * 7 + py * 11) % 256 AS v,
                 greatest(0.12, least(1.0, 8 * least(px / 19.0::DOUBLE, 1 - px / 19.0::DOUBLE, py / 15.0::DOUBLE, 1 - py / 15.0::DOUBLE))) AS w
          FROM t JOIN o ON t.map = o.map, unnest(range(0, 20)) AS a(px), unnest(range(0, 16)) AS b(py)),
    m AS (SELECT map, x, y, floor(greatest(0, least(255, sum(v * w) / sum(w))) + 1e-6)::BIGINT AS v FROM p GROUP BY map, x, y)
    SELECT map, y, count(*) AS n, sum(v)::BIGINT AS total, max(x) AS last FROM m GROUP BY map, y
""")
def mosaics(spark: SparkSession, d: str) -> DataFrame:
    """The lines of maps of four suppliers' tiles each."""
    k = F.col("s_suppkey")
    tile = table(spark, d, "supplier").select(
        F.floor(k / 4).alias("map"), k.alias("tile"), (k % 4 * 13.4 + k % 3 * 0.25 - 2.1).alias("x"), (k % 2 * 7.7).alias("y"), F.lit(20).alias("width"), F.lit(16).alias("height")
    )
    places = spread(tile, "tile").withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(15))))
    pixels = places.select("map", "tile", "px", "py", ((F.col("tile") * 31 + F.col("px") * 7 + F.col("py") * 11) % 256).alias("value"))
    found = tiles.mosaic(pixels, tile)
    return found.groupBy("map", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("x").alias("last"))


@query("""
    WITH a AS (SELECT s_suppkey AS id, x, y, ((x * x * 7 + y * y * 5 + x * y * (s_suppkey % 7 + 1)) % 256)::DOUBLE AS v FROM supplier, unnest(range(0, 14)) AS t(x), unnest(range(0, 10)) AS u(y)),
    b AS (SELECT id, x - 2 AS x, y - 1 AS y, v + (x * 3 + y) % 5 * 4 AS v FROM a WHERE x >= 2 AND y >= 1),
    s AS (SELECT dx, dy FROM unnest(range(-3, 4)) AS t(dx), unnest(range(-3, 4)) AS u(dy)),
    m AS (SELECT a.id, dx, dy, count(*) AS n, corr(a.v, b.v) AS ncc, stddev_pop(a.v) AS texture FROM s, a JOIN b ON a.id = b.id AND a.x = b.x + dx AND a.y = b.y + dy GROUP BY a.id, dx, dy)
    SELECT id, dx, dy, round(n / 108.0::DOUBLE + 1e-7, 4) AS ratio, round(ncc + 1e-7, 4) AS ncc, round(texture + 1e-7, 4) AS texture FROM m
""")
def shifted_frames(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's image and a part of it, with some noise, over all shifts up to three pixels."""
    k, x, y = F.col("s_suppkey"), F.col("x"), F.col("y")
    steps = lambda n, first=0: F.explode(F.sequence(F.lit(first), F.lit(n)))
    rows = spread(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").withColumn("x", steps(13)).withColumn("y", steps(9))
    a = rows.select(k.alias("id"), "x", "y", ((x * x * 7 + y * y * 5 + x * y * (k % 7 + 1)) % 256).alias("value"))
    b = a.where("x >= 2 and y >= 1").select("id", (x - 2).alias("x"), (y - 1).alias("y"), (F.col("value") + (x * 3 + y) % 5 * 4).alias("value"))
    ids = table(spark, d, "supplier").select(k.alias("id"))
    sizes = ids.select("id", F.lit(14).alias("width_a"), F.lit(10).alias("height_a"), F.lit(12).alias("width_b"), F.lit(9).alias("height_b"))
    shifts = ids.withColumn("dx", steps(3, -3)).withColumn("dy", steps(3, -3))
    found = correlation.shifted_agreement(a, b, sizes, shifts)
    return found.select("id", "dx", "dy", *(r4(c).alias(c) for c in ("ratio", "ncc", "texture")))


def _hex(value: Column, n_bytes: int) -> Column:
    """A whole number as hex digits, its lowest byte first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n_bytes)))


def _image_files(suppliers: DataFrame, folder: str) -> None:
    """A bitmap of each supplier as a file of its own; every seventh is text and no image."""
    k, w, h = F.col("s_suppkey"), F.col("w"), F.col("h")
    size = w * 3 + (4 - w * 3 % 4) % 4  # lines are filled up to four bytes
    value = lambda x, y, c: _hex((k * 7 + x * 13 + y * 29 + c * 61) % 256, 1)
    pixel = lambda x, y: F.concat(*(value(x, y, c) for c in (2, 1, 0)))
    line = lambda y: F.rpad(F.array_join(F.transform(F.sequence(F.lit(0), w - 1), lambda x: pixel(x, y)), ""), size * 2, "0")
    body = F.array_join(F.transform(F.sequence(h - 1, F.lit(0), F.lit(-1)), line), "")
    four = [h * size + 54, F.lit(0), F.lit(54), F.lit(40), w, h]
    head = F.concat(F.lit("424D"), *(_hex(c, 4) for c in four), F.lit("01001800"), F.repeat(F.lit("00"), 24))
    content = F.when(k % 7 == 0, F.lit("no image")).otherwise(F.unhex(F.concat(head, body)).cast("string"))
    rows = spread(suppliers.select("s_suppkey", content.alias("value")), "s_suppkey", 100)
    # tasks move their own files; the driver would move one after the other
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(folder)


@query("""
    WITH s AS (SELECT s_suppkey AS k, (3 + s_suppkey % 5)::INT AS w, (2 + s_suppkey % 3)::INT AS h FROM supplier),
    p AS (SELECT k, x, y, (((k * 7 + x * 13 + y * 29) % 256) * 11 + ((k * 7 + x * 13 + y * 29 + 61) % 256) * 16 + ((k * 7 + x * 13 + y * 29 + 122) % 256) * 5) // 32 AS g
          FROM s, unnest(range(0, w)) AS t(x), unnest(range(0, h)) AS u(y) WHERE k % 7 <> 0)
    SELECT s.k AS supplier, CASE WHEN s.k % 7 <> 0 THEN s.w END AS width, CASE WHEN s.k % 7 <> 0 THEN s.h END AS height,
           CASE WHEN s.k % 7 = 0 THEN 'unreadable image' END AS error, count(g) AS n, sum(g)::BIGINT AS total, sum(g * (y * s.w + x))::BIGINT AS weighted
    FROM s LEFT JOIN p ON s.k = p.k GROUP BY s.k, s.w, s.h
""")
def decoded_images(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' image files, good ones and others, in one read, and their grey values in place."""
    k = F.col("s_suppkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey", (3 + k % 5).cast("int").alias("w"), (2 + k % 3).cast("int").alias("h"))
    folder = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    _image_files(suppliers, folder)
    files = written(images.read_images(spark, folder), "decoded")  # each file is opened once
    lines = images.grey_lines(files)
    n, placed = F.size("line"), F.transform("line", lambda v, x: v.cast("long") * (F.col("y") * F.size("line") + x))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    sums = lines.groupBy("path").agg(F.sum(n).alias("n"), F.sum(add(F.col("line"))).alias("total"), F.sum(add(placed)).alias("weighted"))
    supplier = F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("supplier")
    found = files.drop("data").join(sums, "path", "left")
    return found.select(supplier, "width", "height", "error", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "total", "weighted")
