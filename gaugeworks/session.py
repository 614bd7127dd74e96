"""Session and table helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "gaugeworks", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries assume (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    safe_unions(spark)
    return spark


def safe_unions(spark: SparkSession) -> None:
    """Has every union dealt out anew before it is grouped. Spark 4.1 leaves that out where both sides are dealt out alike,
    and gives wrong rows when it then puts a reused exchange in one side's place (``tests/test_masks.py`` has the case)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, through Spark's reader."""
    safe_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: As many thin rows may be sent to all executors.
MOST_SENT = 500_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` for a join with many more, such as pixels: sent to all tasks up to ``MOST_SENT`` of them, else dealt out by the
    keys. Spark takes exploded rows for as few as those they come from, and would send the pixels instead."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows.hint("shuffle_hash")


def many(rows: DataFrame) -> DataFrame:
    """``rows`` for a join of many with many: never sent, whatever their estimate says."""
    return rows.hint("merge")


def spread(rows: DataFrame, key: str, each: int = 2000) -> DataFrame:
    """``rows`` dealt out by a key, about ``each`` to a task: for rows of a small file that become many, as its reader has one task."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and one machine runs all, a local one, then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a table of :func:`written` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this path in the file system that Spark reads it from."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
