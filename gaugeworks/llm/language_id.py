"""Language ID by word-first backoff.

Training counts every word of every training document by language, and from those counts every character
n-gram of 1 to 5 characters (words stand between spaces). Words are runs of letters in lower case; learning and scoring
find them with the same function (:func:`words_of`). Nothing that was seen is left out, however rare.

A word seen in training adds its log frequency in every language. An unseen word falls back to its 5-character n-grams,
the mean of those that were seen; if none was, to those of 4 characters, and so on. A language in which a word or n-gram
was never seen counts it as half a sighting in the most that any language has of its size. That floor is the same for
all languages, so what is stored and summed are gains over it, and only for the languages that have the token. Gains are
whole numbers of 2**-26, so sums don't depend on their order and reruns agree.

How it scales: the most frequent words go to all tasks, ``CACHED_WORDS`` at most and no more than ``CACHED_CELLS`` divided by
the number of languages; which these are decides what is quick, not what comes out. A task adds up those words and hands on
the others of each document with their counts. They are looked up in the full counts by a join, once for each distinct word;
words that aren't found there are cut into n-grams, the longest first, which are looked up in the full counts of n-grams. Tokens that hold
a share of all rows of a look-up, 1 / ``HEAVY`` or more, are joined by broadcast (``HEAVY`` at most), so none of them gathers in one
task. The driver holds the cached words, the languages and their six totals each.

Defined results
---------------
* A text that is null or has no letters is ``und`` with score 0, as is every text if nothing was learned.
* A null doc_id counts as the empty text for the split into training and held-out documents.
* Documents with a null lang are not learned from. Ties go to the smallest lang by code point.
* The score is the posterior probability of the language under equal priors.
* Whole texts are read, however long. Repeated rows count each time. Extra columns are left out by :func:`language_id` and kept
  by :func:`keep_languages`, whatever their names.
* An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, worker_state, written

ORDERS = (1, 2, 3, 4, 5)
UNKNOWN = "und"
#: Words that every task holds, and words x languages.
CACHED_WORDS = 200_000
CACHED_CELLS = 4_000_000
#: Longer words are never sent to all tasks.
LONGEST = 64
#: Tokens with one part in so many of a look-up's rows are joined by broadcast; they are sought in so many buckets.
HEAVY = 1_000
BUCKETS = 16_384
#: Distinct tokens that a task counts before it hands them on.
COUNTED = 500_000
#: What a gain of 1 is stored as.
UNIT = 1 << 26
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """The runs of letters (Unicode categories L*) of the lower-cased text."""
    return _WORD.findall(text.lower())


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Model:
    """``langs`` in order; ``tokens``: (size, token, lang, gain) with lang a place in them. size 0: words; else n-grams of so
    many characters. ``known``: the cached words and their gains, words x languages."""

    langs: list[str]
    tokens: DataFrame
    known: tuple[str, np.ndarray]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the words and n-grams of all rows with a text and a language."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counted(found):
        for (lang, size), counts in found.items():
            n = len(counts)
            columns = [pa.array([lang] * n, pa.int32()), pa.array([size] * n, pa.int32())]
            columns += [pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "token", "n"])

    def count_words(batches):
        found, held = defaultdict(Counter), 0
        for part in chain.from_iterable(map(slices, batches)):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                counts = found[place[lang], 0]
                held -= len(counts)
                counts.update(words_of(text.as_py()))
                held += len(counts)
                if held > COUNTED:
                    yield from counted(found)
                    found, held = defaultdict(Counter), 0
        yield from counted(found)

    def count_grams(batches):
        found = defaultdict(dict)
        for part in chain.from_iterable(map(slices, batches)):
            for lang, token, n in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                padded = f" {token} "
                for size in ORDERS:
                    counts = found[lang, size]
                    for i in range(len(padded) - size + 1):
                        gram = padded[i : i + size]
                        counts[gram] = counts.get(gram, 0) + n
            if sum(map(len, found.values())) > COUNTED:
                yield from counted(found)
                found = defaultdict(dict)
        yield from counted(found)

    rows, schema, same = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "lang int, size int, token string, n long", ["lang", "size", "token"]
    labels = sorted(r.lang for r in rows.select("lang").where("lang is not null").distinct().collect())
    place = {lang: i for i, lang in enumerate(labels)}
    counts = rows.where("lang is not null and text is not null").mapInArrow(count_words, schema)
    counts = written(counts.groupBy(*same).agg(F.sum("n").alias("n")), "lang-words")
    parts = counts.repartition(partitions, *same).mapInArrow(count_grams, schema).groupBy(*same).agg(F.sum("n").alias("n"))
    every = counts.unionByName(written(parts, "lang-grams"))
    totals = [tuple(r) for r in every.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()]  # six rows for each language
    used = sorted({lang for lang, _, _ in totals})  # languages whose texts have words
    most = {size: max(total for _, s, total in totals if s == size) for _, size, _ in totals}
    width = len(ORDERS) + 1
    scale, at = [0.0] * max(1, len(labels) * width), [used.index(i) if i in used else -1 for i in range(max(1, len(labels)))]
    for lang, size, total in totals:
        scale[lang * width + size] = 2.0 * most[size] / total
    # looked up by place, as a join would send the same few numbers again to each use of the tokens
    gain = F.round(F.log(F.col("n") * F.get(F.lit(scale), F.col("lang") * width + F.col("size"))) * UNIT).cast("long")
    tokens = every.select("size", "token", F.get(F.lit(at), F.col("lang")).alias("lang"), gain.alias("gain"))
    langs = [labels[i] for i in used]
    return Model(langs, tokens, _cached(counts, tokens, len(langs)))


def _cached(counts: DataFrame, tokens: DataFrame, n_langs: int) -> tuple[str, np.ndarray]:
    """The most frequent words with a line end between them and their gains, by classes of frequency as far as there is room."""
    room = min(CACHED_WORDS, CACHED_CELLS // max(1, n_langs))
    short = counts.where(F.length("token") <= LONGEST).groupBy("token").agg(F.sum("n").alias("n"))
    short = short.select("token", F.floor(F.log2("n") * 8).alias("class"))
    least = None
    for cls, n in sorted(map(tuple, short.groupBy("class").count().collect()), reverse=True):  # a few hundred rows
        room -= n
        if room < 0:
            break
        least = cls
    if least is None:
        return "", np.zeros((0, n_langs), np.int64)
    chosen = tokens.where("size = 0").join(short.where(F.col("class") >= int(least)), "token", "left_semi")
    # columns, as a row object for each word and gain would be many times their size
    found = chosen.select("token", "lang", "gain").toArrow()
    words = found["token"].combine_chunks().dictionary_encode()
    gains = np.zeros((len(words.dictionary), n_langs), np.int64)
    gains[words.indices.to_numpy(), found["lang"].to_numpy()] = found["gain"].to_numpy()
    return "\n".join(words.dictionary.to_pylist()), gains


class Scorer:
    """Adds up the cached words of a text."""

    def __init__(self, tokens: str, gains: np.ndarray):
        self.place = {word: i for i, word in enumerate(tokens.split("\n"))} if tokens else {}
        self.gains = np.concatenate([gains, np.zeros((1, gains.shape[1]), np.int64)])  # the last row: words that aren't cached

    def read(self, text: str | None) -> tuple[bool, list[int], Counter]:
        """Whether the text has letters, its cached words' gains by language, and how often each other word stands in it."""
        found, total, others = words_of(text) if text else [], np.zeros(self.gains.shape[1], np.int64), Counter()
        get, none = self.place.get, len(self.place)
        for start in range(0, len(found), 1 << 15):
            part = found[start : start + (1 << 15)]
            at = np.fromiter((get(word, none) for word in part), np.int64, len(part))
            total += np.add.reduce(self.gains[at])
            others.update(part[i] for i in np.flatnonzero(at == none))
        return bool(found), total.tolist(), others


_READ = "struct<uid: bigint, letters: boolean, gains: array<bigint>, others: array<struct<token: string, n: bigint>>>"
_READ_ARROW = pa.struct(
    [("uid", pa.int64()), ("letters", pa.bool_()), ("gains", pa.list_(pa.int64())), ("others", pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))]
)


def _read(rows: DataFrame, model: Model, text_at: int, keep: list[int], name: str) -> DataFrame:
    """The columns of ``rows`` at ``keep`` and a column ``name`` of what :meth:`Scorer.read` says of the text, written."""
    spark = rows.sparkSession
    shared, token = spark.sparkContext.broadcast(model.known), uuid.uuid4().hex
    names = [rows.columns[i] for i in keep]
    shape = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in (rows.schema[i] for i in keep))

    def make() -> Scorer:
        gc.disable()  # no cycles are made, and each collection would walk the words
        return Scorer(*shared.value)

    def run(batches):
        scorer = worker_state(token, make)
        for part in chain.from_iterable(map(slices, batches)):
            found = []
            for uid, text in zip(part.column(part.num_columns - 1).to_pylist(), part.column(text_at)):
                letters, gains, others = scorer.read(text.as_py())
                found.append({"uid": uid, "letters": letters, "gains": gains, "others": [{"token": w, "n": n} for w, n in others.items()]})
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(found, _READ_ARROW)], [*names, name])

    numbered = rows.withColumn(f"{name}_uid", F.monotonically_increasing_id())
    found = written(numbered.mapInArrow(run, f"{shape}, `{name}` {_READ}" if keep else f"`{name}` {_READ}"), "lang-read")
    shared.destroy()  # the driver and the executors hold the words no longer than that
    return found


def _heavy(rows: DataFrame) -> list[tuple]:
    """The tokens (size, token) that each have one part in ``HEAVY`` of all rows, or more, so ``HEAVY`` at most. Counted by buckets
    first, so that what is counted exactly are those buckets' rows only."""
    bucket = F.pmod(F.xxhash64("size", "token"), F.lit(BUCKETS))
    sizes = rows.groupBy(bucket.alias("bucket")).count().collect()  # BUCKETS rows at most
    least = max(2, sum(r["count"] for r in sizes) / HEAVY)
    full = [r.bucket for r in sizes if r["count"] >= least]
    if not full:
        return []
    counts = rows.where(bucket.isin(full) & (F.length("token") <= LONGEST)).groupBy("size", "token").count()
    return [(r["size"], r["token"]) for r in counts.where(F.col("count") >= least).collect()]


def _looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` (unique by size and token), frequent tokens by broadcast."""
    keys, frequent = ["size", "token"], _heavy(rows)
    if not frequent:
        return rows.join(table, keys)
    heavy = F.broadcast(rows.sparkSession.createDataFrame(frequent, "size int, token string"))
    beside = rows.join(heavy, keys, "left_anti").join(table, keys)
    return beside.unionByName(rows.join(F.broadcast(table.join(heavy, keys, "left_semi")), keys))


def _gains() -> Column:
    return F.collect_list(F.struct("lang", "gain")).alias("gains")  # one for each language at most


def _by_grams(words: DataFrame, model: Model, sizes: tuple[int, ...], partitions: int) -> DataFrame:
    """(id, lang, gain) of the rows (id, token) of ``words`` that have n-grams of these sizes that were seen: the means
    of the longest."""
    padded = F.concat(F.lit(" "), "token", F.lit(" "))
    rows = words.select("id", padded.alias("padded"), F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.col("size") <= F.length("padded"))
    rows = rows.select("id", "size", "padded", F.explode(F.sequence(F.lit(1), F.length("padded") - F.col("size") + 1)).alias("i"))
    rows = rows.select("id", "size", F.substring("padded", F.col("i"), F.col("size")).alias("token"))
    kept = model.tokens.where(F.col("size").isin(*sizes)).groupBy("size", "token").agg(_gains())
    hits = _looked_up(rows, kept).select("id", "size", "gains").repartition(partitions, "id")  # what follows stays where it lies
    # a language of its own, -1, counts the n-grams found
    each = F.explode(F.concat("gains", F.array(F.struct(F.lit(-1).alias("lang"), F.lit(1).cast("long").alias("gain"))))).alias("g")
    sums = hits.select("id", "size", each).groupBy("id", "size", F.col("g.lang").alias("lang")).agg(F.sum("g.gain").alias("sum"))
    longest = F.max("size").over(Window.partitionBy("id"))  # five sizes of each language at most
    found = F.max(F.when(F.col("lang") == -1, F.col("sum"))).over(Window.partitionBy("id", "size"))
    means = sums.withColumn("longest", longest).withColumn("found", found).where("size = longest and lang >= 0")
    return means.select("id", "lang", F.round(F.col("sum") / F.col("found")).cast("long").alias("gain"))


def _others(read: DataFrame, model: Model) -> DataFrame:
    """(uid, more): what the words that weren't cached add to each language, of rows (uid, others)."""
    partitions = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = read.select("uid", F.explode("others").alias("o")).select("uid", F.lit(0).alias("size"), "o.token", "o.n")
    words = model.tokens.where("size = 0").groupBy("token").agg(_gains())
    distinct = rows.select("token").distinct().join(words, "token", "left").withColumn("id", F.monotonically_increasing_id())
    distinct = written(distinct, "lang-others")
    unseen = distinct.where("gains is null").select("id", "token")
    long = written(_by_grams(unseen, model, ORDERS[-1:], partitions).groupBy("id").agg(_gains()), "lang-grams-long")
    short = _by_grams(unseen.join(long, "id", "left_anti"), model, ORDERS[:-1], partitions).groupBy("id").agg(_gains())
    means = unseen.join(long.unionByName(short), "id").select("token", "gains")
    scores = written(distinct.where("gains is not null").select("token", "gains").unionByName(means), "lang-others-gains")
    more = _looked_up(rows, scores.withColumn("size", F.lit(0))).select("uid", "n", "gains").repartition(partitions, "uid")
    more = more.select("uid", "n", F.explode("gains").alias("g")).groupBy("uid", F.col("g.lang").alias("lang")).agg(F.sum(F.col("n") * F.col("g.gain")).alias("gain"))
    return more.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("lang", "gain"))).alias("more"))


def _with(gains: Column, more: Column) -> Column:
    return F.transform(gains, lambda x, i: x + F.coalesce(F.try_element_at(more, i), F.lit(0)))


def _score(gains: Column) -> Column:
    """The posterior of the best language."""
    over = F.transform(gains, lambda x: F.exp((x - F.array_max(gains)) / F.lit(float(UNIT))))
    return 1 / F.aggregate(over, F.lit(0.0), lambda a, x: a + x)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    read = _read(rows, model, 2, [0, 1], "read").select("doc_id", "held_out", "read.*")
    done, open_ = read.where(F.size("others") == 0), read.where(F.size("others") > 0)
    more = open_.drop("others").join(_others(open_.select("uid", "others"), model), "uid", "left")
    settled = done.select("doc_id", "held_out", "letters", "gains").unionByName(more.select("doc_id", "held_out", "letters", _with(F.col("gains"), F.col("more")).alias("gains")))
    best = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("gains", F.array_max("gains")).cast("int"))
    return settled.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), best).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), _score(F.col("gains"))).otherwise(0.0).alias("score"),
    )


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that aren't held out and predicts every one."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    return predict(docs, model, id_col, text_col)


def keep_languages(docs: DataFrame, least_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a language that scores ``least_score`` or more, with all their columns.

    Other words are looked up only where they could change that: where the score would fall short if each of them went to all
    languages but the best with the largest gain there is. Only those rows are joined with what the look-up finds.
    """
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    if not model.langs:
        return docs.limit(0)
    name = "read"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    rows = docs.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))
    read = _read(rows, model, docs.columns.index(text_col), list(range(len(docs.columns))), name).where(f"{name}.letters")
    gains, others = F.col(f"{name}.gains"), F.col(f"{name}.others")
    most = model.tokens.agg(F.max("gain")).first()[0] or 0
    words = F.aggregate(others, F.lit(0).cast("long"), lambda a, o: a + o["n"])
    best = F.array_position(gains, F.array_max(gains)).cast("int") - 1
    worst = F.transform(gains, lambda x, i: x + F.when(i == best, F.lit(0)).otherwise(words * F.lit(most)))
    # scores of the best language there, which need not be the best of all any more
    share = F.exp((F.array_max(gains) - F.array_max(worst)) / F.lit(float(UNIT))) * _score(worst)
    sure = (F.size(others) == 0) & (_score(gains) >= least_score) | (F.size(others) > 0) & (share >= least_score)
    open_ = read.where((F.size(others) > 0) & ~sure)
    more = _others(open_.select(f"{name}.uid", f"{name}.others"), model)
    late = open_.withColumn(f"{name}_uid", F.col(f"{name}.uid")).join(more.withColumnsRenamed({"uid": f"{name}_uid", "more": f"{name}_more"}), f"{name}_uid", "left")
    late = late.where(_score(_with(gains, F.col(f"{name}_more"))) >= least_score)
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return read.where(sure).select(*columns).unionAll(late.select(*columns))
