"""Line dedup over levelled sorted runs of line hashes, DataFrame functions only.

The documents are taken in batches. Each batch's line hashes are merge-anti-joined with the runs that
earlier batches left: hashes that no run holds become a run of their own, the others are logged as
repeats. So every hash stands in one run only. ``FAN_OUT`` runs of a level are compacted into one run of
the next. A run is a table bucketed and sorted by hash, so a merge with it moves only the batch. :class:`LineRuns`
keeps the runs under a name: what later batches bring can be appended to them, in another session too.

Counts come from the runs and the log of repeats: a line found in ``min_docs`` documents or more loses
all its lines except those in the largest ``doc_id`` that holds it.

Defined results
---------------
* A null or empty text is one empty line. Keys shorter than ``min_chars`` code points never go.
* Rows with one ``doc_id`` are one document when documents are counted; each row is cleaned on its own.
* A null ``doc_id`` is one document, smaller than any other.
* A line that a document repeats counts once for it; all its copies stay or go together.
* Very long texts and lines are taken whole. Extra columns are left out of the result; an empty table gives an empty
  result.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, exists, ordered_id, shared_folder, written
from .exact_dedup import MAX_BROADCAST_BITS, _blocks, filter_bits, possibly_held

BATCHES = 4
FAN_OUT = 2
#: A line with this share of all (document, line) pairs is "heavy": there are at most 10,000 of them.
HEAVY_SHARE = 10_000
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _hashes(docs: DataFrame, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(id, h1, h2, batch) of every line key that is long enough, once for each document."""
    keys = F.array_distinct(F.filter(F.transform(_lines(text_col), line_key), lambda k: F.char_length(k) >= min_chars))
    return (
        docs.select("id", F.explode(keys).alias("key"))
        .select("id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
        .withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    )


class LineRuns:
    """Levelled sorted runs of line hashes under a name, in the shared folder.

    A run holds (h1, h2, n, last): in how many documents of its batch a line was found, and the largest id. A log holds
    the same of lines that an earlier run has. What there is is listed in a manifest that each append adds a version to,
    so a failed append leaves the version before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folder = spark, name, f"{shared_folder(spark)}/line-runs-{name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels, self.logs, self.tables = 0, [[]], [], []
        if exists(spark, f"{self.folder}/manifest"):
            self._open()

    def _open(self) -> None:
        rows = self.spark.read.parquet(f"{self.folder}/manifest")
        self.version = rows.agg(F.max("version")).first()[0]
        for r in rows.where(F.col("version") == self.version).orderBy("level", "place").collect():  # one row for each run
            if r.level < 0:
                self.logs.append(r.table)
                continue
            self.buckets = r.buckets
            while len(self.levels) <= r.level:
                self.levels.append([])
            self.levels[r.level].append(r.table)
            if not self.spark.catalog.tableExists(r.table):
                columns = ", ".join(HASH)
                self.spark.sql(
                    f"CREATE TABLE {r.table} (h1 LONG, h2 LONG, n LONG, last LONG) USING parquet CLUSTERED BY ({columns}) "
                    f"SORTED BY ({columns}) INTO {r.buckets} BUCKETS LOCATION '{self.folder}/{r.table}'"
                )
            self.tables.append(r.table)

    def _run(self, df: DataFrame) -> str:
        """Writes a sorted run: a table bucketed and sorted by hash."""
        table = f"line_run_{uuid.uuid4().hex}"
        (
            df.select(*HASH, "n", "last")
            .repartition(self.buckets, *HASH)
            .write.bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", f"{self.folder}/{table}")
            .saveAsTable(table)
        )
        self.tables.append(table)
        return table

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def append(self, hashes: DataFrame) -> None:
        """Takes a batch (id, h1, h2) in: documents that no earlier batch had."""
        batch = hashes.select("id", *HASH).distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        runs = self._runs()
        if runs:
            batch, log = written(batch, "line-batch"), f"log-{uuid.uuid4().hex}"
            known = reduce(DataFrame.unionByName, (run.select(*HASH) for run in runs))
            batch.join(known.hint("merge"), HASH, "left_semi").write.parquet(f"{self.folder}/{log}")
            self.logs.append(log)
        for run in runs:
            batch = batch.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        self.levels[0].append(self._run(batch))
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) < FAN_OUT:
                break
            merged = reduce(DataFrame.unionByName, map(self.spark.table, self.levels[depth]))
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._run(merged))
            self.levels[depth] = []
        self.version += 1
        listed = [(self.version, k, i, t, self.buckets) for k, level in enumerate(self.levels) for i, t in enumerate(level)]
        listed += [(self.version, -1, i, t, self.buckets) for i, t in enumerate(self.logs)]
        rows = self.spark.createDataFrame(listed, "version int, level int, place int, table string, buckets int")
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, n, last) of the lines found in ``min_docs`` documents or more."""
        logged = self.spark.createDataFrame([], "h1 long, h2 long, n long, last long")
        if self.logs:
            logged = self.spark.read.schema(logged.schema).parquet(*(f"{self.folder}/{log}" for log in self.logs))
        logged = logged.groupBy(*HASH).agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        parts = [
            run.join(logged.hint("merge"), HASH, "left").select(
                *HASH, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last")
            )
            for run in self._runs()
        ]
        return reduce(DataFrame.unionByName, parts).where(F.col("n") >= min_docs)

    def close(self) -> None:
        """Takes the runs out of the session's catalogue; their files stay and the name can be opened again."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    batches: int = BATCHES,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), ordered_id(id_col).alias("id"))
    hashes = written(_hashes(rows, "text", min_chars, batches), "line-hashes", "batch")
    total = hashes.count()
    runs = LineRuns(docs.sparkSession, uuid.uuid4().hex)
    for b in range(batches):
        runs.append(hashes.where(F.col("batch") == b))
    found = written(runs.repeated(min_docs), "line-repeated")
    runs.close()
    heavy = F.col("n") >= max(1000, total // HEAVY_SHARE)
    # at most 10,000 lines are heavy, so that side has a bound; every other line has few rows in each task
    in_heavy = hashes.join(F.broadcast(found.where(heavy)), HASH)
    in_light = hashes.join(F.broadcast(found.where(heavy).select(*HASH)), HASH, "left_anti").join(found.where(~heavy).hint("merge"), HASH)
    drops = written(
        in_heavy.unionByName(in_light)
        .where(F.col("id") != F.col("last"))
        .groupBy("id")
        .agg(F.collect_set(F.struct(*HASH)).alias("drops")),
        "line-drops",
    )
    lines = _lines("text")
    key = F.transform(lines, lambda line: F.struct(line.alias("line"), line_key(line).alias("key")))
    left = F.filter(key, lambda x: ~F.array_contains(F.col("drops"), F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"))))
    # only documents that may lose a line move
    blocks = _blocks(drops.count(), MAX_BROADCAST_BITS)
    marked = possibly_held(rows, "id", written(filter_bits(drops, "id", blocks, 1), "line-bits"), blocks)
    n_lines = F.size(lines).cast("long").alias("n_lines")
    whole = marked.where("not _maybe").select("doc_id", n_lines, F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text"))
    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.transform(left, lambda x: x["line"])).alias("kept")
    changed = (
        marked.where("_maybe")
        .join(drops.hint("merge"), "id", "left")
        .select("doc_id", n_lines, kept)
        .select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
    )
    return whole.unionByName(changed)
