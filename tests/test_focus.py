"""Stencils and fusion against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.catalog_pixels import focus_measures
from gaugeworks.operators import focus as S


def plain_blur(image, along, across):
    pad = (len(across) // 2, len(along) // 2)
    wide = np.pad(image, ((pad[0],) * 2, (pad[1],) * 2), mode="reflect")
    rows = sum(t * wide[:, k : k + image.shape[1]] for k, t in enumerate(along))
    return sum(t * rows[k : k + image.shape[0]] for k, t in enumerate(across))


def plain_focus(image):
    lap = plain_blur(image, S.BEND, S.MEAN) + plain_blur(image, S.MEAN, S.BEND)
    gx, gy = plain_blur(image, S.SLOPE, S.MEAN), plain_blur(image, S.MEAN, S.SLOPE)
    blur = S.gaussian(1.0)
    return plain_blur(np.abs(lap) + 0.35 * np.hypot(gx, gy), blur, blur)


@pytest.fixture(scope="module")
def stack():
    rng = np.random.default_rng(2)
    base = np.kron(rng.integers(0, 256, (14, 8)), np.ones((6, 5)))
    blur = S.gaussian(2.0)
    soft = plain_blur(base, blur, blur)
    middle = np.arange(base.shape[1]) < 20
    return {0: np.floor(np.where(middle, base, soft)), 1: np.floor(np.where(middle, soft, base)), 2: np.floor(soft)}


def frames(spark, stack):
    rows = [(1, k, y, image[y].tolist()) for k, image in stack.items() for y in range(image.shape[0])]
    return spark.createDataFrame(rows, "id long, frame int, y int, v array<double>")


def back(found, values="v"):
    return np.array([list(r[values]) for r in sorted(found, key=lambda r: r.y)])


@pytest.mark.parametrize("band", [5, 64])
def test_stencils(spark, stack, band):
    lines = frames(spark, stack).where("frame = 0")
    found = S.stencils(lines, {"a": [("v", S.SLOPE, S.MEAN)], "b": [("v", S.gaussian(1.6), S.gaussian(3.0)), ("v", (1,), (0, 0, 1))]}, band=band).collect()
    assert len(found) == stack[0].shape[0]
    assert np.allclose(back(found, "a"), plain_blur(stack[0], S.SLOPE, S.MEAN))
    expected = plain_blur(stack[0], S.gaussian(1.6), S.gaussian(3.0)) + plain_blur(stack[0], (1,), (0, 0, 1))
    assert np.allclose(back(found, "b"), expected)


def test_sharpness_and_fusion(spark, stack):
    from gaugeworks.session import written

    scored = written(S.sharpness(frames(spark, stack), ["id", "frame"]), "scored")
    for k, image in stack.items():
        assert np.allclose(back(scored.where(f"frame = {k}").collect(), "focus"), plain_focus(image))
    maps = np.array([plain_focus(image) for image in stack.values()])
    images = np.array(list(stack.values()))
    hard = np.take_along_axis(images, maps.argmax(0)[None], 0)[0]
    sharp = {}
    for profile, (sigmas, power, share) in S.PROFILES.items():
        total = 0
        for s in sigmas:
            w = np.clip(np.array([plain_blur(m, S.gaussian(s), S.gaussian(s)) for m in maps]), 1e-6, None) ** power + 1e-6
            total = total + w / w.sum(0)
        total = total / len(sigmas)
        soft = np.floor(np.clip((images * total / total.sum(0)).sum(0), 0, 255))
        found = back(S.fused(scored, profile=profile).collect())
        expected = np.floor(np.clip(soft * (1 - share) + hard * share, 0, 255))
        assert (np.abs(found - expected) <= 1).all() and (found == expected).mean() > 0.999
        sharp[profile] = plain_focus(found).mean()
    assert sharp["sharp"] >= sharp["balanced"] >= sharp["soft"]


def test_sharpening(spark, stack):
    lines = frames(spark, stack).where("frame = 2").drop("frame")
    blur = S.gaussian(1.1, 3.0)
    assert len(blur) == 9
    expected = np.floor(np.clip(stack[2] * 1.6 - 0.6 * np.floor(plain_blur(stack[2], blur, blur) + 0.5), 0, 255))
    found = back(S.sharpened(lines, 60).collect())
    assert (np.abs(found - expected) <= 1).all() and (found == expected).mean() > 0.99
    assert (back(S.sharpened(lines, 0).collect()) == stack[2]).all()
    pixels = S.image_pixels(lines)
    assert (back(S.image_lines(pixels).collect()) == stack[2]).all()


def test_no_task_holds_many_images(spark, tmp_path):
    spark.range(1, 1501).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    tasks = focus_measures(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count_distinct("id").alias("n")).collect()
    assert sum(t.n for t in tasks) == 1500 and max(t.n for t in tasks) <= 400
