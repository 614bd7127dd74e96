import json
import struct

from pyspark.sql import functions as F

from gaugeworks.operators import mutate
from gaugeworks.sources import archive, sinks


def project(tmp_path):
    line = {"start": {"x": 0, "y": 0}, "end": {"x": 6, "y": 8}}
    square = [{"x": 0, "y": 0}, {"x": 8, "y": 0}, {"x": 8, "y": 8}, {"x": 0, "y": 8}]
    measurements = [
        {"id": "m1", "image_id": "i1", "fiber_group_id": "g1", "mode": "fiber_auto", "line_px": line, "status": "fiber_auto", "confidence": 0.5},
        {"id": "m2", "image_id": "i1", "fiber_group_id": None, "measurement_kind": "area", "polygon_px": square, "unknown": 1},
        {"id": "m3", "image_id": "i1", "fiber_group_id": "g2", "measurement_kind": "area", "polygon_px": square, "exact_area_px": 32},
        {"id": "m4", "image_id": "i1", "measurement_kind": "count", "point_px": {"x": 1, "y": 2}},
    ]
    document = {
        "id": "i1", "path": "a.png", "image_size": [100, 80], "calibration": {"mode": "preset", "pixels_per_unit": 4, "unit": "um", "source_label": "x"},
        "fiber_groups": [{"id": "g1", "image_id": "i1", "name": " 棉 "}, {"id": "g2", "image_id": "i1", "number": 7, "label": "麻", "color": "#000000"}],
        "measurements": measurements, "text_annotations": [{"id": "t", "content": "note", "kind": "odd"}], "metadata": {"k": 1},
    }
    payload = {"version": "1", "documents": [document], "project_group_templates": [{"label": "a", "color": "1"}, {"label": " a "}, {"label": " "}],
               "calibration_presets": [{"name": "p", "pixels_per_unit": 2, "unit": "um", "computed_pixels_per_unit": 0}]}
    (tmp_path / "p.fdmproj").write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")


def test_project_tables(spark, tmp_path):
    project(tmp_path)
    a = archive.read_projects(spark, f"file://{tmp_path}/*.fdmproj")
    assert [(r.label, r.number) for r in a.category.orderBy("category_pos").collect()] == [("棉", 1), ("麻", 7)]
    assert [r.label for r in a.template.collect()] == ["a"] and a.preset.first().ppu == 2
    assert a.annotation.first().kind == "text"
    found = {r.measurement_id: r for r in archive.derive(a.measurement, a.image).collect()}
    assert (found["m1"].mode, found["m1"].status, found["m1"].diameter_unit) == ("fiber_quick", "fiber_quick", 2.5)
    assert (found["m2"].area_unit, found["m3"].area_unit, found["m3"].display_unit) == (4.0, 2.0, "um²")
    assert (found["m4"].display_value, found["m4"].display_unit, found["m4"].diameter_px) == (1.0, "个", None)
    sinks.write_projects(a, f"file://{tmp_path}/again")
    b = archive.read_projects(spark, f"file://{tmp_path}/again/*.json")
    for name in ("image", "category", "measurement", "annotation", "preset", "template"):
        one, two = (sorted(map(str, getattr(x, name).drop("project_id", "debug_json", "metadata_json").collect())) for x in (a, b))
        assert one == two, name


def test_a_large_project_is_written_in_parts(spark, tmp_path):
    project(tmp_path)
    a = archive.read_projects(spark, f"file://{tmp_path}/*.fdmproj")
    sinks.write_projects(a, f"file://{tmp_path}/parts", part_rows=2)  # one image of four measurements
    files = [json.loads(f.read_text("utf-8")) for f in (tmp_path / "parts").glob("*.json")]
    held = [len(d.get("measurements", [])) for f in files for d in f.get("documents", [])]
    assert held == [2, 2] and len([f for f in files if "calibration_presets" in f]) == 1
    b = archive.read_projects(spark, f"file://{tmp_path}/parts/*.json")
    for name in ("project", "image", "category", "measurement", "annotation", "preset", "template"):
        one, two = (sorted(map(str, getattr(x, name).drop("project_id", "debug_json", "metadata_json").collect())) for x in (a, b))
        assert one == two, name
    assert b.image.select("project_id").union(b.preset.select("project_id")).distinct().count() == 1


def test_delete_category_frees_and_renumbers(spark, tmp_path):
    project(tmp_path)
    a = archive.read_projects(spark, f"file://{tmp_path}/*.fdmproj")
    gone = a.category.where("category_id = 'g1'").select("image_id", "category_id")
    m, c = mutate.delete_category(a.measurement, a.category, gone)
    assert {r.measurement_id: r.category_id for r in m.collect()} == {"m1": None, "m2": None, "m3": "g2", "m4": None}
    assert [(r.category_id, r.number) for r in c.collect()] == [("g2", 1)]


def test_scale_files_and_folder(spark, tmp_path):
    (tmp_path / "10x-2024.01.31.bin").write_bytes(bytes(0x180) + struct.pack("<f", 0.5) + bytes(64))
    (tmp_path / "short.bin").write_bytes(b"x")
    (tmp_path / "zero.bin").write_bytes(bytes(500))
    found = {r.name: r for r in archive.read_scale_files(spark, f"file://{tmp_path}/*.bin").collect()}
    assert found["10x"].ppu == 2.0 and found["10x"].error is None
    assert (found["short"].error, found["zero"].error, found["zero"].ppu) == ("too short", "not positive", None)
    for name in ("B.png", "a.TIF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in archive.list_images(spark, f"file://{tmp_path}").collect()] == ["a.tif", "b.png"]


def test_path_cascade(spark):
    images = spark.createDataFrame(
        [("1", "/p", "project_asset", "x.png", None), ("2", "/p", "filesystem", "y.png", "/gone/y.png"), ("3", "/p", "filesystem", "D:\\q\\z.png", None),
         ("4", "/p", "filesystem", "sub\\w.png", None), ("5", "/p", "filesystem", "none.png", None), ("6", "/p", "filesystem", "q.png", "/abs/q.png")],
        "image_id string, folder string, source_type string, path string, absolute_path string",
    )
    files = spark.createDataFrame([(p,) for p in ("/p/x.png", "/p/y.png", "/p/z.png", "/p/sub/w.png", "/abs/q.png", "/p/q.png")], "path string")
    found = {r.image_id: (r.found, r.how, r.repaired) for r in archive.resolve_paths(images, files).collect()}
    assert found == {
        "1": ("/p/x.png", "project_asset", False), "2": ("/p/y.png", "relative_path", True), "3": ("/p/z.png", "project_dir_filename", True),
        "4": ("/p/sub/w.png", "relative_path", False), "5": (None, None, None), "6": ("/abs/q.png", "absolute_path", False),
    }


def test_csv_starts_with_a_byte_order_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, None)], "`甲` int, b string").coalesce(1), f"file://{tmp_path}/out")
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf") and part.read_text("utf-8-sig").splitlines() == ["甲,b", "1,"]
    merged = sinks.union_columns(spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit(2).alias("b")))
    assert merged.columns == ["a", "b"]
