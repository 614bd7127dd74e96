"""URL filters by a temporal list join, DataFrame functions only.

A list is a log of dated entries that add or remove a key. Its entries become validity intervals: an added key
holds from its date until the next date on which it is removed. Every capture has several keys (its host, the
host's parent domains, the host with the first path segment). The as-of join lays the intervals and the captures of a
key side by side in order of time; each capture takes the last interval that began before it or with it, in one pass,
and is blocked if that interval hasn't ended. So work is the sum of captures and intervals, not their product.

Captures whose keys are not listed are left out first, by a broadcast of the list's keys if there are up to
``MAX_BROADCAST_ROWS``. A key with over ``HEAVY_ROWS`` captures and a thousandth of all is dealt out by capture: its
intervals go to every part. There are at most 1,000 such keys.

Defined results
---------------
* Hosts are compared in lower case without user, port and a leading ``www.``; a null or unparsable URL has no
  keys and is not blocked, nor is a capture with a null time.
* Entries with a null key, kind, date or action are ignored. Of entries of one key on one date, a removal wins.
  An entry holds from its date on, that date included; on the date of its removal it doesn't.
* Each row of the captures gives one row. Rows that repeat are judged on their own. Extra columns are left out.
* Very long URLs are read whole: all parent domains of a host are keys, and its first path segment.
* Empty captures give an empty result; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: About 60 bytes each: at most 12 MB are broadcast.
MAX_BROADCAST_ROWS = 200_000
HEAVY_ROWS = 10_000


def host(url: Column) -> Column:
    """The host in lower case without user, port and a leading ``www.``; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def keys(url: Column) -> Column:
    """An array of (kind, key): the host, its parent domains of two labels or more, the host and first segment."""
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.transform(
        F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")),
    )
    segment = F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^/?#]+)", 1)
    exact = F.array(
        F.struct(F.lit("host").alias("kind"), name.alias("key")),
        F.struct(F.lit("domain").alias("kind"), name.alias("key")),
        F.struct(F.lit("prefix").alias("kind"), F.when(segment != "", F.concat(name, F.lit("/"), segment)).alias("key")),
    )
    return F.filter(F.concat(exact, parents), lambda k: k["key"].isNotNull())


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, since, until) of a log (kind, key, day, action): when each key is on the list."""
    log = (
        entries.where("kind is not null and key is not null and day is not null and action in ('add', 'remove')")
        .groupBy("kind", "key", "day")
        .agg(F.max("action").alias("action"))  # 'remove' comes after 'add'
    )
    w = Window.partitionBy("kind", "key").orderBy("day")
    changes = log.withColumn("before", F.lag("action").over(w)).where("before is null or before <> action")
    return changes.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("kind", "key", F.col("day").alias("since"), "until")


def as_of(asked: DataFrame, active: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The rows (row, kind, key) of ``asked`` (row, time, kind, key) whose key is on the list at their time."""
    key = ["kind", "key"]
    most = max(heavy_rows, asked.count() // 1000)
    heavy = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    heavy = F.broadcast(written(heavy.select(*key, F.ceil(F.col("n") / most).alias("parts")), "url-heavy"))  # 1,000 rows at most
    parts = F.coalesce("parts", F.lit(1))
    captures = asked.join(heavy, key, "left").select(
        *key, F.pmod(F.xxhash64("row"), parts).alias("part"), F.col("time").alias("at"), F.lit(1).alias("order"), "row", F.lit(None).alias("interval")
    )
    listed = active.join(heavy, key, "left").select(
        *key, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("since").alias("at"), F.lit(0).alias("order"),
        F.lit(None).cast("long").alias("row"), F.struct("until").alias("interval"),
    )
    so_far = Window.partitionBy(*key, "part").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("interval", ignorenulls=True).over(so_far)
    found = listed.unionByName(captures).withColumn("last", last).where("row is not null and last is not null")
    return found.where("last.until is null or at < last.until").select("row", *key)


def url_filter(
    captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, broadcast_rows: int = MAX_BROADCAST_ROWS, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """(id, time, blocked, n_matches, first_match) of every capture; ``first_match`` is the smallest "kind key"."""
    active = written(intervals(entries), "url-intervals")
    rows = captures.select(F.col(id_col).alias("id"), F.col(time_col).alias("time"), F.col(url_col).alias("url"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "url-captures")
    asked = rows.where("time is not null").select("row", "time", F.explode(keys(F.col("url"))).alias("k")).select("row", "time", "k.kind", "k.key")
    listed = active.select("kind", "key").distinct()
    listed = F.broadcast(listed) if active.count() <= broadcast_rows else listed.hint("merge")
    asked = written(asked.join(listed, ["kind", "key"], "left_semi"), "url-asked")
    matches = (
        as_of(asked, active, heavy_rows)
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws(" ", "kind", "key")).alias("first_match"))
    )
    return rows.join(matches.hint("merge"), "row", "left").select(
        "id", "time", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), "first_match"
    )
