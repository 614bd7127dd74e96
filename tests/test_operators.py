import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import values as V
from gaugeworks.operators import aggregate, ordinal, sequential, spatial
from gaugeworks.plans import report


def test_running_numbers_go_through_images(spark):
    rows = spark.createDataFrame(
        [(0, 0, "line", "棉"), (0, 1, "line", "麻"), (0, 2, "area", "棉"), (1, 0, "line", "棉"), (1, 1, "count", "棉")],
        "image_pos int, measurement_pos int, kind string, label string",
    )
    rows = ordinal.running_number(rows, ["kind"], "image_pos", ["measurement_pos"], "a")
    rows = ordinal.running_number(rows, ["kind", "label"], "image_pos", ["measurement_pos"], "b").orderBy("image_pos", "measurement_pos").collect()
    assert [r.a for r in rows] == [1, 2, 1, 3, 1]
    assert [r.b for r in rows] == [1, 1, 1, 2, 1]


def test_unique_range_keeps_order_and_capacity(spark):
    labels = ["棉", "麻", "棉", "莱赛尔", "莫代尔"]
    rows = spark.createDataFrame([(0, i, x, x, "线段", 1.0, 1.0, i + 1) for i, x in enumerate(labels)],
                                 "image_pos int, measurement_pos int, label string, category_id string, kind_label string, display_value double, result double, number int")
    listed = report.category_labels(rows.select("image_pos", "number", "label"), rows)
    names = report.rule_cells(report.Rule("unique_field_range", "S", "BA11", "BC11", "horizontal"), rows, listed).orderBy("column").collect()
    numbers = report.rule_cells(report.Rule("unique_field_range", "S", "BA11", "BC11", "horizontal", "number"), rows, listed).orderBy("column").collect()
    assert [r.value for r in names] == ["棉", "麻", "莱赛尔"] and [r.value for r in numbers] == ["1", "2", "4"]
    assert [report.column_letters(r.column) for r in names] == ["BA", "BB", "BC"]
    with pytest.raises(report.ReportError):
        report.rule_cells(report.Rule("measurement_field", "S", "A1", "B1", "vertical", "result"), rows, listed)


def test_deviation_is_of_the_population(spark):
    m = spark.createDataFrame([(1, "line", 3.0), (3, "line", 2.0), (3, "line", 4.0), (3, "polyline", 9.0)], "image_id int, measurement_kind string, diameter_unit double")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    found = {r.image_id: r for r in aggregate.image_summary(images, m).collect()}
    assert (found[1].stddev, found[2].stddev, found[3].stddev) == (0.0, None, 1.0)
    assert (found[2].n, found[3].n, found[3].mean) == (0, 3, 3.0)


def test_latest_of_coincident_points_wins(spark):
    boxes = spark.range(500).select(F.col("id").alias("shape"), *(F.lit(float(v)).alias(c) for v, c in ((42, "min_x"), (58, "min_y"), (42, "max_x"), (58, "max_y"))))
    points = spark.createDataFrame([(1, 43.0, 57.0), (2, 400.0, 400.0)], "p int, x double, y double")
    hit = spatial.latest_hit(spatial.point_box_join(points, boxes, tolerance=5.0), "p", "shape", F.col("shape")).collect()
    assert [(r.p, r.shape, r.n_hits) for r in hit] == [(1, 499, 500)]


def test_values(spark):
    row = spark.range(1).select(
        V.to_unit(F.lit(10.0), F.lit(4.0)).alias("a"), V.area_to_unit(F.lit(64.0), F.lit(4.0)).alias("b"), V.to_unit(F.lit(10.0), F.lit(0.0)).alias("c"),
        V.trimmed(F.lit("　\t x \n")).alias("d"), V.class_labels(F.lit("a-b-a- "), {"b": "c"}).alias("e"), V.display_unit(F.lit("area"), F.lit(None)).alias("f"),
        V.calibration_info(F.lit("preset"), F.lit(" lens ")).alias("g"), V.scale_name(F.lit("10x-2024.01.31")).alias("h"), V.label_text(F.lit(2.5), F.lit("um"), 2).alias("i"),
        V.file_name(F.lit("C:\\a\\b.png")).alias("j"),
    ).first()
    assert list(row) == [2.5, 4.0, 10.0, "x", ["a", "c"], "px²", "标定预设 / lens", "10x", "2.50 um", "b.png"]


def test_rules_that_meet_in_the_free_part_of_a_range(spark):
    from pyspark.sql import functions as F

    from gaugeworks.plans import report

    rows = spark.createDataFrame([(1, 1, "a", 1, "线段", 2.0, 2.0)], "image_pos long, measurement_pos long, label string, category_id long, kind_label string, display_value double, result double")
    labels = report.category_labels(rows.select("image_pos", F.col("measurement_pos").alias("number"), "label"), rows)
    unique = report.Rule("unique_field_range", "X", "A1", "A9", "vertical", "label")
    for start, message in (("A5", "rules overlap"), ("A10", ""), ("B5", "")):
        cells, said = report.with_fallback([unique, report.Rule("diameter_result", "X", start)], rows, labels)
        assert said == message and cells.count() == (1 if message else 2)
    cells, said = report.with_fallback([report.Rule("diameter_result", "X", "A0")], rows, labels)
    assert "A0" in said and cells.count() == 1


def test_fixed_decimals_are_those_of_the_binary_number(spark):
    import random

    from gaugeworks.functions import values as V

    rng = random.Random(1)
    numbers = [0.125, 2.675, 1.005, 0.5, 1.5, 2.5, -0.125, -0.001, 0.0, -0.0, 1e15, 123456.7895, 0.045, 1e-9, 4.35, 1e300]
    numbers += [rng.uniform(-1e4, 1e4) for _ in range(500)] + [round(rng.uniform(0, 100), 3) + 0.0005 for _ in range(500)] + [rng.randint(0, 4000) / 32 for _ in range(300)]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (0, 1, 2, 3, 4):
        found = frame.select("x", V.fixed(F_col("x"), digits).alias("t")).collect()
        assert [(r.x, r.t) for r in found if r.x < 1e100] == [(x, f"{x:.{digits}f}") for x in numbers if x < 1e100]


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.mark.parametrize("small", [0, 32])
def test_overlaps_of_small_and_large_groups(spark, monkeypatch, small):
    monkeypatch.setattr(sequential, "SMALL_GROUP", small)
    corner = [(i, i % 2 if i < 20 else 2, float(i * 37 % 41), float(i * 29 % 23), 9.0 + i * i % 17, 8.0 + i * 7 % 13) for i in range(120)]  # groups of 10 and of 100
    boxes = [(i, g, x, y, x + w, y + h) for i, g, x, y, w, h in corner]
    wanted = set()
    for i, g, *a in boxes:
        for j, k, *b in boxes:
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if g == k and min(w, h) > 0 and w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) >= 0.5:
                wanted.add((i, j))
    rows = spark.createDataFrame(boxes, "id long, g long, min_x double, min_y double, max_x double, max_y double")
    found = [(r.a, r.b) for r in sequential.overlapping(rows, rows, ["g"], 0.5).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and any(a != b for a, b in wanted)


def test_points_of_one_place_are_looked_up_once(spark):
    points = spark.createDataFrame([(i, float(i % 3), 0.0 if i % 2 else -0.0) for i in range(30)] + [(30, None, 1.0)], "p long, x double, y double")
    boxes = spark.createDataFrame([(1, 0.0, -1.0, 1.0, 1.0), (2, 1.0, 0.0, 1.5, 0.5)], "shape long, min_x double, min_y double, max_x double, max_y double")
    one = spatial.latest_hits(points, boxes, "p", "shape", F.col("shape"))
    two = spatial.latest_hit(spatial.point_box_join(points, boxes), "p", "shape", F.col("shape"))
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 20
