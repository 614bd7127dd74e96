"""The training-text pipeline: each stage works on what the stage before it kept, written as Parquet and read again.

1. language ID: documents without a language, or whose language is unsure, go;
2. exact dedup: of equal texts the one with the largest doc_id stays;
3. MinHash near-dedup: of each class of near copies the smallest doc_id stays;
4. mixing: documents are left out or repeated until each source has its target of words;
5. byte-level BPE: every remaining row becomes token ids, checked by decoding them.

Defined results
---------------
* Null and empty texts, and texts without letters, have no language and go in the first stage. Every other text goes
  through whole, however long.
* A null doc_id is an id, smaller than any other; null sources are a source of their own.
* Of rows that repeat id and text one is left after the second stage; ties of larger groups are settled by all columns.
* Columns of any name beside doc_id, text, lang and source are carried along unchanged by all stages but the last.
* An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import byte_bpe, exact_dedup, language_id, minhash_dedup, mixing
from gaugeworks.llm.common import exists, shared_folder, written
from gaugeworks.llm.queries import vocabulary_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_languages(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _tokens(words: byte_bpe.Vocabulary, ids: list[int], offsets):
    return len(ids), ids, offsets, sha256(words.decode(ids, offsets)).hexdigest()


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, vocabulary_file(), _tokens, "n_tokens long, ids array<int>, offsets array<long>, decoded_sha256 string")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: No stage but the exact dedup can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """``documents`` through all stages. A run that is given a name keeps its stages under it in the shared folder; the
    same name takes up after the last stage that was finished."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = f"{shared_folder(spark)}/pipeline-{resume}/{name.replace(' ', '-')}"
        if resume is None:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            continue
        if not exists(spark, f"{folder}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
