"""Exact dedup by two-pass Bloom filtering, DataFrame functions only.

Pass one sets, for every text hash, two bits of a blocked Bloom filter and keeps the bits that were set more than once.
It exchanges one 8-byte number for each row, by block; each task then counts the bits of its own blocks. (Bitmaps that
tasks build and merge would move two bits a row and *task*, which is more from 32 tasks on.) Pass two tests every row
against those bits: only rows whose bits were all set twice may have a copy, and only they shuffle; the rest pass
straight through.

The filter has ``BITS_PER_ROW`` bits a row, in blocks of 32,768 bits (the size of Spark's bitmap aggregates). It is
broadcast up to ``MAX_BROADCAST_BITS``. Hashes are tested against a larger one by a join on the block, which moves
hashes and row numbers, never texts: :func:`drop_exact_copies` reads texts only after the hashes that do repeat are
known, and tests them against a second filter of those hashes alone, of ``MAX_BROADCAST_BITS`` at most.

Defined results
---------------
* A null text counts as the empty text, so nulls and empty texts are copies of each other.
* The row with the largest ``doc_id`` of a group stays; a null ``doc_id`` is smaller than any other.
* Of rows that repeat both ``doc_id`` and text exactly one stays; if other columns differ, the one with the largest hash
  of all its columns, so that reruns agree.
* Very long texts are hashed whole (SHA-256). An empty table gives an empty result.
* Extra columns don't matter to :func:`exact_dedup` and are kept by :func:`drop_exact_copies`, whatever
  their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from .common import NO_ID, ordered_id, written

BLOCK_BITS = 32_768
BITS_PER_ROW = 16
#: 64 MB of bitmaps at most are broadcast.
MAX_BROADCAST_BITS = 2**29
#: A key with this share of all rows is "heavy": there are at most 1,000 of them.
HEAVY_SHARE = 1000


def text_hash(text: str = "text") -> Column:
    """SHA-256 of the text's UTF-8 bytes in lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _blocks(rows: int, most: int | None = None) -> int:
    blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    return blocks if most is None else min(blocks, max(1, most // BLOCK_BITS))


def _block(hash_: Column, blocks: int) -> Column:
    return F.pmod(hash_, F.lit(blocks)).cast("long")


def _bits(hash_: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(seed), hash_), F.lit(BLOCK_BITS)) for seed in (1, 2)))


def filter_bits(keys: DataFrame, digest: str, blocks: int, least: int) -> DataFrame:
    """(block, bitmap) of the filter bits that ``least`` rows or more set."""
    # equal hashes are counted where they lie first, so a text that many rows hold is a row of each task when they are dealt out
    counted = keys.groupBy(F.xxhash64(digest).alias("h")).agg(F.least(F.count(F.lit(1)), F.lit(least)).alias("n"))
    hashes = counted.withColumn("block", _block(F.col("h"), blocks))
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        hashes.repartition(partitions, "block")  # both groupings below keep to it
        .select("block", "n", F.explode(_bits(F.col("h"))).alias("bit"))
        .groupBy("block", "bit")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .groupBy("block")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    )


def possibly_held(rows: DataFrame, digest: str, bits: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``_maybe``, false for rows with a bit that isn't set."""
    side = bits.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))
    side = F.broadcast(side) if blocks * BLOCK_BITS <= MAX_BROADCAST_BITS else side.hint("merge")
    held = "getbit(cast(conv(hex(substring(_bitmap, cast(b div 8 as int) + 1, 1)), 16, 10) as int), cast(b % 8 as int)) = 1"
    return (
        rows.withColumn("_hash", F.xxhash64(digest))
        .withColumn("_block", _block(F.col("_hash"), blocks))
        .withColumn("_bits", _bits(F.col("_hash")))
        .join(side, "_block", "left")
        .withColumn("_maybe", F.expr(f"_bitmap is not null and forall(_bits, b -> {held})"))
        .drop("_hash", "_block", "_bits", "_bitmap")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            text_hash(text_col).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-keys",
    )
    total = keys.count()
    blocks = _blocks(total)
    bits = written(filter_bits(keys, "text_sha256", blocks, 2), "exact-bits")
    rows = possibly_held(keys, "text_sha256", bits, blocks)
    single = rows.where("not _maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = rows.where("_maybe").drop("_maybe")
    # the last row of a group, and how many it has; partly counted before the shuffle
    groups = written(
        maybe.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct(ordered_id("doc_id").alias("id"), F.col("row").alias("row"))).alias("last")
        ),
        "exact-groups",
    )
    heavy = F.col("group_size") >= max(1000, total // HEAVY_SHARE)
    # at most 1,000 groups are heavy, so that side has a bound; every other group is small enough to shuffle
    large = F.broadcast(groups.where(heavy))
    in_large = maybe.join(large, "text_sha256", "inner")
    in_small = maybe.join(F.broadcast(groups.where(heavy).select("text_sha256")), "text_sha256", "left_anti").join(
        groups.where(~heavy).hint("merge"), "text_sha256", "inner"
    )
    copies = in_large.unionByName(in_small).select(
        "doc_id",
        F.when(F.col("last.id") != NO_ID, F.col("last.id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(copies)


def _hashable(field: StructField) -> Column:
    """The column, as JSON if it has a type that Spark doesn't hash."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if re.search("map<|variant", field.dataType.simpleString()) else column


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(
        text_hash(text_col).alias("_digest"),
        F.struct(ordered_id(id_col).alias("id"), F.xxhash64(*map(_hashable, docs.schema)).alias("of_all")).alias("_order"),
        F.struct(*columns).alias("_row"),
    )
    keys = written(packed.select("_digest", "_order"), "exact-digests")
    total = keys.count()
    blocks = _blocks(total)
    bits = written(filter_bits(keys, "_digest", blocks, 2), "exact-bits")
    maybe = possibly_held(keys, "_digest", bits, blocks).where("_maybe")
    groups = written(
        maybe.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("_order").alias("_last")).where("_n > 1"), "exact-groups"
    )
    # the hashes that do repeat, in a filter that can always be broadcast
    blocks = _blocks(groups.count(), MAX_BROADCAST_BITS)
    bits = written(filter_bits(groups, "_digest", blocks, 1), "exact-bits")
    rows = possibly_held(packed, "_digest", bits, blocks)
    once = rows.where("not _maybe").select("_row")
    # of a repeated text only the rows that may be the last of its group are moved on to the choice of one; the copies of a
    # heavy group, of which there are 1,000 at most, are told where they lie
    large = F.broadcast(groups.where(F.col("_n") >= max(1000, total // HEAVY_SHARE)).select("_digest", F.col("_last").alias("_heavy")))
    maybe = rows.where("_maybe").join(large, "_digest", "left").where("_heavy is null or _order = _heavy").drop("_heavy")
    last = maybe.join(groups.drop("_n").hint("merge"), "_digest", "left").where("_last is null or _order = _last")
    last = written(last.select("_digest", "_last", "_row"), "exact-last")  # read twice below; its texts are sorted once
    chosen = last.where("_last is not null").select("_digest", "_row").dropDuplicates(["_digest"]).select("_row")
    return once.unionByName(last.where("_last is null").select("_row")).unionByName(chosen).select("_row.*")
