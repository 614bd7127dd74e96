"""Queries over masks and rings, with their SQL: pixels of line items by supplier, rings of parts, paths of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, r4
from .functions import geometry as G
from .operators import contours, masks, sequential
from .session import many, table

#: Masks of 24 x 16 pixels, one for each supplier, and what is taken off them; for DuckDB.
PIXELS_SQL = """
    a AS (SELECT DISTINCT l_suppkey AS id, l_partkey * 7 % 24 AS x, l_orderkey % 16 AS y FROM lineitem WHERE l_linenumber <= 2),
    b AS (SELECT DISTINCT l_suppkey AS id, l_partkey * 5 % 24 AS x, l_orderkey % 16 AS y FROM lineitem WHERE l_linenumber >= 6)
"""

#: The same by pixels: what can be reached by steps of one pixel, corners included, and each pixel's part by its first pixel.
PARTS_SQL = """
    r AS (SELECT id, y * 100 + x AS seed, x, y FROM {0}
          UNION SELECT r.id, r.seed, p.x, p.y FROM r JOIN {0} p ON p.id = r.id AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
    part AS (SELECT id, x, y, min(seed) AS first FROM r GROUP BY id, x, y)
"""

#: Background that is reached from outside by steps along lines and columns.
OUTSIDE_SQL = """
    free AS (SELECT id, x, y FROM (SELECT DISTINCT id FROM a), unnest(range(-1, 25)) AS t(x), unnest(range(-1, 17)) AS u(y)
             EXCEPT SELECT id, x, y FROM a),
    o AS (SELECT id, x, y FROM free WHERE x = -1 AND y = -1
          UNION SELECT f.id, f.x, f.y FROM o JOIN free f ON f.id = o.id AND abs(f.x - o.x) + abs(f.y - o.y) = 1),
    hole AS (SELECT id, x, y FROM free EXCEPT SELECT id, x, y FROM o)
"""


def _pixels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem")
    place = lambda by: [F.col("l_suppkey").alias("id"), (F.col("l_partkey") * by % 24).alias("x"), (F.col("l_orderkey") % 16).alias("y")]
    return masks.runs_of(rows.where("l_linenumber <= 2").select(*place(7))), masks.runs_of(rows.where("l_linenumber >= 6").select(*place(5)))


@query(f"""
    WITH {PIXELS_SQL}, c AS (
        SELECT 'union' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
        SELECT 'intersection', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
        SELECT 'difference', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
    SELECT op, id, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) + 1 AS max_x, max(y) + 1 AS max_y,
           round(avg(x) + 1e-7, 4) AS center_x, round(avg(y) + 1e-7, 4) AS center_y FROM c GROUP BY op, id
""")
def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pixels(spark, d)
    out = None
    for name in ("union", "intersection", "difference"):
        found = masks.measures(getattr(masks, name)(a, b)).withColumn("op", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.select("op", "id", "area", "min_x", "min_y", "max_x", "max_y", r4("center_x").alias("center_x"), r4("center_y").alias("center_y"))


@query(f"""
    WITH RECURSIVE {PIXELS_SQL}, {PARTS_SQL.format("a")}
    SELECT id, first % 100 AS part_x, first // 100 AS part_y, count(*) AS area, max(x) + 1 AS max_x FROM part GROUP BY id, first
""")
def mask_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = masks.components(_pixels(spark, d)[0], band=4)
    return masks.part_measures(parts).select("id", "part_x", "part_y", "area", "max_x")


@query(f"""
    WITH RECURSIVE {PIXELS_SQL}, {PARTS_SQL.format("a")},
    s AS (SELECT id, first, count(*) AS area FROM part GROUP BY id, first),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, first) AS i, count(*) OVER (PARTITION BY id) AS n FROM s)
    SELECT id, area, n > 1 AS discarded FROM n WHERE i = 1
""")
def largest_parts(spark: SparkSession, d: str) -> DataFrame:
    kept = masks.largest_part(_pixels(spark, d)[0])
    return kept.groupBy("id").agg(F.sum(F.expr("x1 - x0 + 1")).alias("area"), F.any_value("discarded").alias("discarded"))


@query(f"""
    WITH RECURSIVE {PIXELS_SQL}, {PARTS_SQL.format("a")},
    p AS (SELECT l_suppkey AS id, l_partkey % 30 - 2.5 AS x, l_orderkey % 20 - 1.25 AS y, l_quantity > 20 AS positive FROM lineitem WHERE l_linenumber = 5),
    h AS (SELECT part.id, first, count(*) FILTER (WHERE positive) AS pos, count(*) FILTER (WHERE NOT positive) AS neg FROM p JOIN part
          ON part.id = p.id AND part.x = greatest(0, least(23, round_even(p.x, 0))) AND part.y = greatest(0, least(15, round_even(p.y, 0))) GROUP BY ALL),
    c AS (SELECT id, avg(x) AS mx, avg(y) AS my FROM p WHERE positive GROUP BY id),
    s AS (SELECT id, first, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM part GROUP BY id, first),
    o AS (SELECT s.id, s.first, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, count(*) OVER (PARTITION BY s.id) AS n,
                 row_number() OVER (PARTITION BY s.id ORDER BY coalesce(pos, 0) DESC, coalesce(neg, 0),
                     coalesce(sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)), 0), area DESC, s.first) AS i
          FROM s LEFT JOIN h ON s.id = h.id AND s.first = h.first LEFT JOIN c ON s.id = c.id)
    SELECT id, n AS parts, first % 100 AS part_x, first // 100 AS part_y, pos AS positive_hits, neg AS negative_hits FROM o WHERE i = 1
""")
def prompted_parts(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _pixels(spark, d)
    x, y = (F.col("l_partkey") % 30 - 2.5).cast("double"), (F.col("l_orderkey") % 20 - 1.25).cast("double")
    prompts = table(spark, d, "lineitem").where("l_linenumber = 5").select(F.col("l_suppkey").alias("id"), x.alias("x"), y.alias("y"), (F.col("l_quantity") > 20).alias("positive"))
    sizes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(24).alias("width"), F.lit(16).alias("height"))
    return masks.prompted_part(a, prompts, sizes)


@query(f"""
    WITH RECURSIVE {PIXELS_SQL}, {OUTSIDE_SQL},
    r AS (SELECT id, y * 100 + x AS seed, x, y FROM hole
          UNION SELECT r.id, r.seed, p.x, p.y FROM r JOIN hole p ON p.id = r.id AND abs(p.x - r.x) + abs(p.y - r.y) = 1),
    h AS (SELECT id, count(DISTINCT first) AS holes, count(*) AS area FROM (SELECT id, x, y, min(seed) AS first FROM r GROUP BY ALL) GROUP BY id),
    n AS (SELECT id, count(*) AS area FROM a GROUP BY id)
    SELECT n.id, n.area + coalesce(h.area, 0) AS area, coalesce(h.area, 0) AS added, coalesce(holes, 0) AS holes FROM n LEFT JOIN h ON n.id = h.id
""")
def filled_masks(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _pixels(spark, d)
    added = masks.holes(a)
    holes = added.groupBy("id").agg(F.count_distinct(F.struct(*masks.PART)).alias("holes"), F.sum(F.expr("x1 - x0 + 1")).alias("added"))
    whole = masks.measures(masks.union(a, added)).select("id", "area")
    return whole.join(holes, "id", "left").select("id", "area", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("holes", F.lit(0)).alias("holes"))


#: Rectangles of line items, with a smaller one of each supplier to take off.
_BLOCKS_SQL = """
    k AS (SELECT s_suppkey AS id, s_suppkey % 5 AS k FROM supplier),
    a AS (SELECT id, x, y FROM k, unnest(range(0, 12)) AS t(x), unnest(range(0, 9)) AS u(y)),
    b AS (SELECT id, x, y FROM k, unnest(range(0, 40)) AS t(x), unnest(range(0, 12)) AS u(y)
          WHERE k = 0 AND x < 3 AND y < 3 OR k = 1 AND x > 30 OR k = 2 OR k = 3 AND x BETWEEN 3 + id % 4 AND 5 + id % 4),
    c AS (SELECT * FROM a EXCEPT SELECT * FROM b)
"""


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    ids = table(spark, d, "supplier").select(k.alias("id"), (k % 5).alias("k"))
    lines = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("y")
    number = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    a = ids.select("id", lines(9), number(0).alias("x0"), number(11).alias("x1"))
    shapes = [(0, 3, 0, 2), (1, 12, 31, 39), (2, 12, 0, 39), (3, 12, 3 + F.col("id") % 4, 5 + F.col("id") % 4)]
    b = None
    for case, height, x0, x1 in shapes:
        part = ids.where(F.col("k") == case).select("id", lines(height), number(x0).alias("x0"), number(x1).alias("x1"))
        b = part if b is None else b.unionByName(part)
    return a, b


@query(f"""
    WITH RECURSIVE {_BLOCKS_SQL}, {PARTS_SQL.format("c")},
    n AS (SELECT id, count(DISTINCT first) AS parts, count(*) AS left_ FROM part GROUP BY id)
    SELECT k.id, CASE WHEN k = 4 THEN 'no_shape' WHEN k = 1 THEN 'no_intersection' WHEN parts IS NULL THEN 'empty' WHEN parts > 1 THEN 'split' ELSE 'subtracted' END AS outcome,
           CASE WHEN k = 0 THEN left_ ELSE 108 END AS area FROM k LEFT JOIN n ON k.id = n.id
""")
def area_subtraction(spark: SparkSession, d: str) -> DataFrame:
    return masks.subtract_edit(*_blocks(spark, d))[0]


@query(f"""
    WITH RECURSIVE {_BLOCKS_SQL}, {PARTS_SQL.format("c")},
    s AS (SELECT id, first, count(*) AS n FROM part GROUP BY id, first),
    m AS (SELECT id, max(n) AS n, count(*) > 1 AS many FROM s GROUP BY id)
    SELECT k.id, k IN (0, 2, 3) AS had_intersection, m.n IS NULL AS result_empty, k IN (0, 3) AND m.many AS discarded_fragments,
           coalesce(m.n, 0) AS area FROM k LEFT JOIN m ON k.id = m.id
""")
def final_masks(spark: SparkSession, d: str) -> DataFrame:
    return masks.final_mask(*_blocks(spark, d))[0]


#: Rings of parts: an outer one of five vertices, and for two of three parts a hole of three.
_RINGS_SQL = """
    v AS (SELECT p_partkey AS id, ring, i, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y FROM part, LATERAL (VALUES
              (0, 0, p_partkey % 17 + 0.5, p_partkey % 13 + 0.0), (0, 1, 20.5 + p_partkey % 19, p_partkey % 7 + 0.25),
              (0, 2, 35.0 - p_partkey % 11, 18.0 + p_partkey % 9), (0, 3, 22.0, 39.0 - p_partkey % 15), (0, 4, 3.0 + p_partkey % 8, 30.5 - p_partkey % 10),
              (1, 0, 14.0, 13.0), (1, 1, 20.0 + p_partkey % 5, 14.5), (1, 2, 15.0, 20.0 + p_partkey % 4)) t(ring, i, x, y)
          WHERE ring = 0 OR p_partkey % 3 > 0),
    e AS (SELECT a.id, a.ring, a.x AS ax, a.y AS ay, b.x AS xb, b.y AS yb FROM v a JOIN v b ON a.id = b.id AND a.ring = b.ring
              AND b.i = (a.i + 1) % CASE a.ring WHEN 0 THEN 5 ELSE 3 END),
    l AS (SELECT id, ring, CASE WHEN t THEN xb ELSE ax END AS x, CASE WHEN t THEN yb ELSE ay END AS y, abs(xb - ax) AS dx,
                 CASE WHEN t THEN ay - yb ELSE yb - ay END AS dy, greatest(abs(xb - ax), abs(yb - ay)) AS n
          FROM (SELECT *, xb < ax OR xb = ax AND yb < ay AS t FROM e)),
    outline AS (SELECT id, ring, CASE WHEN dx >= abs(dy) THEN x + k ELSE x + ceil((2 * k * dx - n) / (2.0 * n)) END AS x,
                       CASE WHEN dx >= abs(dy) THEN y + sign(dy) * ceil((2 * k * abs(dy) - n) / (2.0 * n)) ELSE y + sign(dy) * k END AS y
                FROM l, unnest(range(0, n + 1)) AS t(k) WHERE n > 0),
    box AS (SELECT id, ring, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY id, ring),
    grid AS (SELECT id, ring, x, y FROM box, unnest(range(x0, x1 + 1)) AS t(x), unnest(range(y0, y1 + 1)) AS u(y)),
    cut AS (SELECT g.id, g.ring, g.x, g.y, count(*) FILTER (WHERE c <= g.x) AS le, count(*) FILTER (WHERE c < g.x) AS lt
            FROM grid g JOIN (SELECT *, unnest(range(least(ay, yb), greatest(ay, yb))) AS y FROM e WHERE ay <> yb) f ON f.id = g.id AND f.ring = g.ring AND f.y = g.y,
                 LATERAL (SELECT f.ax + (f.y - f.ay) * (f.xb - f.ax) / (f.yb - f.ay)::DOUBLE AS c) GROUP BY ALL),
    fill AS (SELECT id, ring, x::INT AS x, y::INT AS y FROM cut WHERE le % 2 = 1 OR lt % 2 = 1 UNION SELECT id, ring, x::INT, y::INT FROM outline),
    shape AS (SELECT id, x, y FROM fill WHERE ring = 0 EXCEPT SELECT id, x, y FROM fill WHERE ring = 1)
"""


def _rings(rows: DataFrame, key: str = "p_partkey") -> DataFrame:
    """(id, rings): the parts' rings."""
    k = F.col(key)
    p = lambda x, y: G.point(F.lit(0.0) + x, F.lit(0.0) + y)
    outer = F.array(p(k % 17 + 0.5, k % 13), p(20.5 + k % 19, k % 7 + 0.25), p(35 - k % 11, 18 + k % 9), p(F.lit(22), 39 - k % 15), p(3 + k % 8, 30.5 - k % 10))
    hole = F.array(p(F.lit(14), F.lit(13)), p(20 + k % 5, F.lit(14.5)), p(F.lit(15), 20 + k % 4))
    return rows.select(k.alias("id"), F.when(k % 3 > 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))


@query(f"""
    WITH {_RINGS_SQL}
    SELECT id, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) + 1 AS max_x, max(y) + 1 AS max_y,
           round(avg(x) + 1e-7, 4) AS center_x, round(avg(y) + 1e-7, 4) AS center_y FROM shape GROUP BY id
""")
def ring_masks(spark: SparkSession, d: str) -> DataFrame:
    found = masks.measures(masks.shape_runs(_rings(table(spark, d, "part"))))
    return found.select("id", "area", "min_x", "min_y", "max_x", "max_y", r4("center_x").alias("center_x"), r4("center_y").alias("center_y"))


@query(f"""
    WITH {_RINGS_SQL}, n AS (SELECT id, count(*) AS n FROM shape GROUP BY id),
    c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM shape a JOIN shape b ON a.id // 8 = b.id // 8 AND a.id < b.id AND a.x = b.x AND a.y = b.y GROUP BY ALL)
    SELECT a, b, common, round(common / (p.n + q.n - common)::DOUBLE + 1e-7, 4) AS iou FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b
""")
def ring_iou(spark: SparkSession, d: str) -> DataFrame:
    shapes = masks.shape_runs(_rings(table(spark, d, "part"))).withColumn("image", F.floor(F.col("id") / 8))
    found = masks.run_overlaps(shapes, shapes, ["image"]).where("a < b")
    return found.select("a", "b", "common", r4("iou").alias("iou"))


@query(f"""
    WITH RECURSIVE {_RINGS_SQL}, n AS (SELECT id, count(*) AS n FROM shape GROUP BY id),
    o AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM shape a JOIN shape b ON a.id // 8 = b.id // 8 AND a.id <> b.id AND a.x = b.x AND a.y = b.y GROUP BY ALL),
    t AS (SELECT a, list(b) AS near FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE common / (p.n + q.n - common)::DOUBLE >= 0.5 GROUP BY a),
    s AS (SELECT p_partkey AS id, p_partkey // 8 AS image, coalesce(near, []) AS near, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_size DESC, p_partkey) AS i
          FROM part LEFT JOIN t ON a = p_partkey),
    g AS (SELECT DISTINCT image, 0::BIGINT AS i, []::BIGINT[] AS kept FROM s
          UNION ALL SELECT g.image, s.i, CASE WHEN list_has_any(g.kept, s.near) THEN g.kept ELSE list_append(g.kept, s.id) END FROM g JOIN s ON s.image = g.image AND s.i = g.i + 1)
    SELECT image, unnest(kept) AS id FROM g WHERE i = (SELECT max(i) FROM s WHERE s.image = g.image)
""")
def suppress_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Of the shapes of an image those that overlap no larger kept one by half."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (-F.col("p_size")).alias("first"))
    rows = _rings(table(spark, d, "part")).join(many(parts), "id").select(F.floor(F.col("id") / 8).alias("image"), F.col("id").alias("part"), "first", "rings")
    return sequential.greedy_shapes(rows, ["image"], ["first", "part"], 0.5).select("image", F.col("part").alias("id"))


@query(f"""
    WITH RECURSIVE {PIXELS_SQL}, {PARTS_SQL.format("a")}, {OUTSIDE_SQL.replace("hole AS", "hollow AS")},
    q AS (SELECT id, y * 100 + x AS seed, x, y FROM hollow
          UNION SELECT q.id, q.seed, p.x, p.y FROM q JOIN hollow p ON p.id = q.id AND abs(p.x - q.x) + abs(p.y - q.y) = 1),
    h AS (SELECT id, count(DISTINCT first) AS n FROM (SELECT id, x, y, min(seed) AS first FROM q GROUP BY ALL) GROUP BY id),
    s AS (SELECT a.id, count(*) AS n FROM a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(dx, dy)
          WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.id = a.id AND b.x = a.x + dx AND b.y = a.y + dy) GROUP BY a.id),
    p AS (SELECT id, count(DISTINCT first) AS n FROM part GROUP BY id)
    SELECT p.id, p.n AS outer_lines, coalesce(h.n, 0) AS holes, s.n AS edges FROM p JOIN s ON p.id = s.id LEFT JOIN h ON p.id = h.id
""")
def mask_outlines(spark: SparkSession, d: str) -> DataFrame:
    drawn = contours.contours(_pixels(spark, d)[0])
    return drawn.groupBy("id").agg(F.count_if(~F.col("hole")).alias("outer_lines"), F.count_if("hole").alias("holes"), F.sum("n_edges").alias("edges"))


@query(f"""
    WITH {_RINGS_SQL.replace("p_partkey", "s_suppkey").replace("FROM part,", "FROM supplier,")}, f AS (SELECT DISTINCT id, x, y FROM fill WHERE ring = 0)
    SELECT id, count(*) AS area, 1 AS n_rings FROM f GROUP BY id
""")
def traced_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings to masks, to rings, to masks again."""
    outer = _rings(table(spark, d, "supplier"), "s_suppkey").select("id", F.slice("rings", 1, 1).alias("rings"))
    rings = contours.mask_rings(masks.filled(masks.shape_runs(outer)))
    area = masks.measures(masks.shape_runs(rings)).select("id", "area")
    return rings.select("id", F.size("rings").alias("n_rings")).join(area, "id")


@query("""
    WITH RECURSIVE s AS (SELECT user_id AS id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    v AS (SELECT id, i, n, i * 2.0::DOUBLE AS x, abs(i * 2 - n) * 3.0::DOUBLE + event_id * 13 % 7 * 0.75 AS y FROM s),
    big AS (SELECT * FROM v WHERE n >= 3),
    len AS (SELECT a.id, sum(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS len FROM big a JOIN big b ON a.id = b.id AND b.i = (a.i + 1) % a.n GROUP BY a.id),
    eps AS (SELECT id, greatest(1.0, len * 0.0035) AS eps FROM len),
    f0 AS (SELECT id, i AS j FROM (SELECT b.id, b.i, row_number() OVER (PARTITION BY b.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) DESC, b.i) AS k
                            FROM big a JOIN big b ON a.id = b.id WHERE a.i = 0) WHERE k = 1),
    f1 AS (SELECT id, i AS j FROM (SELECT b.id, b.i, row_number() OVER (PARTITION BY b.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) DESC, (b.i - a.i + a.n) % a.n) AS k
                            FROM f0 JOIN big a ON a.id = f0.id AND a.i = f0.j JOIN big b ON a.id = b.id) WHERE k = 1),
    f2 AS (SELECT id, i AS j, d FROM (SELECT b.id, b.i, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d,
                            row_number() OVER (PARTITION BY b.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) DESC, (b.i - a.i + a.n) % a.n) AS k
                            FROM f1 JOIN big a ON a.id = f1.id AND a.i = f1.j JOIN big b ON a.id = b.id) WHERE k = 1),
    t AS (SELECT b.id, (b.i - f1.j + b.n) % b.n AS i, b.n, b.x, b.y FROM big b JOIN f1 ON b.id = f1.id
          UNION ALL SELECT b.id, b.n, b.n, b.x, b.y FROM big b JOIN f1 ON b.id = f1.id AND b.i = f1.j),
    g AS (SELECT f1.id, 0 AS a, (f2.j - f1.j + n.n) % n.n AS b FROM f1 JOIN f2 ON f1.id = f2.id JOIN (SELECT DISTINCT id, n FROM big) n ON n.id = f1.id JOIN eps ON eps.id = f1.id WHERE f2.d > eps * eps
          UNION ALL SELECT f1.id, (f2.j - f1.j + n.n) % n.n, n.n FROM f1 JOIN f2 ON f1.id = f2.id JOIN (SELECT DISTINCT id, n FROM big) n ON n.id = f1.id JOIN eps ON eps.id = f1.id WHERE f2.d > eps * eps),
    c AS (SELECT id, a, b FROM g
          UNION ALL
          SELECT id, CASE side WHEN 0 THEN a ELSE m END, CASE side WHEN 0 THEN m ELSE b END
          FROM (SELECT id, a, b, m FROM (SELECT c.id, c.a, c.b, p.i AS m, q.dx * q.dx + q.dy * q.dy AS l, abs((p.y - q.y) * q.dx - (p.x - q.x) * q.dy) AS d, eps.eps,
                                     row_number() OVER (PARTITION BY c.id, c.a ORDER BY abs((p.y - q.y) * q.dx - (p.x - q.x) * q.dy) DESC, p.i) AS k
                              FROM c JOIN (SELECT u.id, u.i AS a, w.i AS b, u.x, u.y, w.x - u.x AS dx, w.y - u.y AS dy FROM t u JOIN t w ON u.id = w.id) q ON q.id = c.id AND q.a = c.a AND q.b = c.b
                              JOIN t p ON p.id = c.id AND p.i > c.a AND p.i < c.b JOIN eps ON eps.id = c.id)
                WHERE k = 1 AND d * d > eps * eps * l), (VALUES (0), (1)) z(side)),
    kept AS (SELECT id, count(DISTINCT a) AS n FROM c GROUP BY id)
    SELECT v.id, any_value(v.n)::INT AS n_before, CASE WHEN any_value(kept.n) >= 3 THEN any_value(kept.n) ELSE any_value(v.n) END::INT AS n_after
    FROM v LEFT JOIN kept ON v.id = kept.id GROUP BY v.id
""")
def simplified_rings(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a closed ring, with as many vertices as its display needs."""
    e = F.sort_array(F.collect_list("event_id"))
    n = F.size("e")
    points = F.transform("e", lambda v, i: G.point(i * 2.0, F.abs(i * 2 - n) * 3.0 + v * 13 % 7 * 0.75))
    rings = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(e.alias("e")).select("id", points.alias("points"))
    found = contours.simplified(rings, ["id"], contours.display_epsilon(F.col("points")))
    return rings.select("id", F.size("points").alias("n_before")).join(found.select("id", F.size("points").alias("n_after")), "id")


def _grown_sql(name: str, source: str, reach: int) -> str:
    """A mask dilated by pixels of an image of 24 x 16, as far as the image goes."""
    return f"""{name} AS (SELECT DISTINCT id, x + i AS x, y + j AS y FROM {source}, unnest(range(-{reach}, {reach + 1})) AS t(i), unnest(range(-{reach}, {reach + 1})) AS u(j)
              WHERE x + i BETWEEN 0 AND 23 AND y + j BETWEEN 0 AND 15)"""


def _shrunk_sql(name: str, source: str, reach: int) -> str:
    return f"""{name} AS (SELECT p.id, p.x, p.y FROM {source} p JOIN {source} q ON q.id = p.id AND abs(q.x - p.x) <= {reach} AND abs(q.y - p.y) <= {reach} GROUP BY p.id, p.x, p.y
              HAVING count(*) = (least(p.x + {reach}, 23) - greatest(p.x - {reach}, 0) + 1) * (least(p.y + {reach}, 15) - greatest(p.y - {reach}, 0) + 1))"""


@query(f"""
    WITH {PIXELS_SQL}, {_grown_sql("g", "b", 1)}, {_shrunk_sql("c", "g", 1)}, {_shrunk_sql("s", "c", 1)}, {_grown_sql("o", "s", 1)}
    SELECT n.id, n.area, (SELECT count(*) FROM c WHERE c.id = n.id) AS closed, (SELECT count(*) FROM o WHERE o.id = n.id) AS opened FROM (SELECT id, count(*) AS area FROM b GROUP BY id) n
""")
def mask_morphology(spark: SparkSession, d: str) -> DataFrame:
    _, b = _pixels(spark, d)
    sizes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(24).alias("width"), F.lit(16).alias("height"))
    closed = masks.closed(b, sizes, 1)
    found = masks.measures(b).select("id", "area").join(masks.measures(closed).select("id", F.col("area").alias("closed")), "id")
    opened = masks.measures(masks.opened(closed, sizes, 1)).select("id", F.col("area").alias("opened"))
    return found.join(opened, "id", "left").fillna(0, ["opened"])


@query(f"""
    WITH {PIXELS_SQL}, {_grown_sql("g", "a", 1)},
    f AS (SELECT id, x, y FROM (SELECT DISTINCT id FROM a), unnest(range(-1, 25)) AS t(x), unnest(range(-1, 17)) AS u(y) EXCEPT SELECT id, x, y FROM g),
    m AS (SELECT g.id, g.x, g.y, min((g.x - f.x) * (g.x - f.x) + (g.y - f.y) * (g.y - f.y)) AS square FROM g JOIN f ON g.id = f.id GROUP BY g.id, g.x, g.y)
    SELECT id, count(*) AS n, sum(square)::BIGINT AS total, max(square) AS largest FROM m GROUP BY id
""")
def mask_distances(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(24).alias("width"), F.lit(16).alias("height"))
    found = masks.distances(masks.dilated(_pixels(spark, d)[0], sizes, 1, 1))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("square").alias("total"), F.max("square").alias("largest"))
