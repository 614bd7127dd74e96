"""Image files: decoded in one read, with an error for each file that can't be, and as lines and pixels of grey."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of red, green and blue in a grey value, of 32 (fixed values).
GREY = (11, 16, 5)
UNREADABLE = "unreadable image"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data, error) of each file below a folder or of one file, by Spark's image source (BMP, PNG,
    JPEG, GIF). A file that can't be decoded has an error and nulls beside its path; the others are read all the same.
    Files of no bytes give no row, as Spark's file sources leave them out. Turning by the camera's orientation mark isn't done."""
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    good = (F.col("height") > 0) & (F.col("width") > 0)
    values = [F.when(good, F.col(c)).alias(name) for c, name in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))]
    return image.select(F.col("origin").alias("path"), *values, F.when(~good, UNREADABLE).alias("error"))


def load_counts(images: DataFrame) -> DataFrame:
    """(loaded, failed): how many files were decoded, and how many weren't."""
    return images.agg(F.count_if(F.col("error").isNull()).alias("loaded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def grey_lines(images: DataFrame) -> DataFrame:
    """(path, y, line): each line of the decoded images as grey values from 0 to 255. Images of one channel are grey already;
    the opacity of those of four is left out."""
    size = F.col("width") * F.col("channels")
    rows = images.where("error is null").select("path", "channels", "data", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.select("path", "y", "channels", F.substring("data", F.col("y") * F.col("size") + 1, F.col("size")).alias("bytes"))

    def grey(batches):
        weights = np.array(GREY[::-1], np.int32)  # the source gives blue, green, red
        for batch in batches:
            lines = []
            for channels, raw in zip(batch.column(2).to_pylist(), batch.column(3)):
                line = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, channels).astype(np.int32)
                lines.append(line[:, 0] if channels == 1 else line[:, :3] @ weights // 32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.int32()))], ["path", "y", "line"])

    return rows.mapInArrow(grey, "path string, y int, line array<int>")


def grey_pixels(images: DataFrame) -> DataFrame:
    """(path, y, x, value) of the decoded images."""
    return grey_lines(images).select("path", "y", F.posexplode("line").alias("x", "value"))
