import struct
import zlib

from gaugeworks.sources import images


def png(lines, kind):
    """A PNG file of lines of raw bytes; kind 0: grey, 2: red, green, blue, 6: those and opacity."""
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    width = len(lines[0]) // {0: 1, 2: 3, 6: 4}[kind]
    head = struct.pack(">IIBBBBB", width, len(lines), 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + line for line in lines))) + chunk(b"IEND", b"")


def test_a_broken_and_a_good_file_in_one_read(spark, tmp_path):
    color = png([bytes([255, 0, 0, 0, 255, 0]), bytes([0, 0, 255, 255, 255, 255])], 2)
    files = {
        "grey.png": png([bytes([0, 7, 255])], 0),
        "below/color.png": color,
        "opacity.png": png([bytes([255, 255, 255, 9])], 6),
        "cut.png": color[: len(color) // 2],
        "empty.png": b"",
        "words.png": b"not an image",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = images.read_images(spark, f"file://{tmp_path}").cache()
    by = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert {n: (r.width, r.height, r.channels, r.error) for n, r in by.items()} == {
        "grey.png": (3, 1, 1, None),
        "color.png": (2, 2, 3, None),
        "opacity.png": (1, 1, 4, None),
        **{n: (None, None, None, images.UNREADABLE) for n in ("cut.png", "words.png")},
    }  # the file of no bytes gives no row, as the docstring says
    assert tuple(images.load_counts(found).first()) == (3, 2)
    pixels = {(r.path.rsplit("/", 1)[1], r.y, r.x): r.value for r in images.grey_pixels(found).collect()}
    assert pixels == {
        **{("grey.png", 0, x): v for x, v in enumerate([0, 7, 255])},
        **{("color.png", y, x): v for (y, x), v in {(0, 0): 87, (0, 1): 127, (1, 0): 39, (1, 1): 255}.items()},
        ("opacity.png", 0, 0): 255,
    }
    found.unpersist()


def test_image_files_are_written_by_several_tasks(spark, tmp_path):
    from gaugeworks.catalog_pixels import _image_files

    suppliers = spark.range(1, 202, numPartitions=1).selectExpr("id as s_suppkey", "3 as w", "2 as h")
    _image_files(suppliers, f"file://{tmp_path}/files")
    files = list((tmp_path / "files").glob("s_suppkey=*/part-*"))
    assert len(files) == 201 and len({f.name[:10] for f in files}) > 1
