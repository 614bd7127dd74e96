"""One query for each operator of this package, and the SQL it must agree with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    found = line_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents"))


def vocabulary_file(path: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The file of a public tokenizer by its name, the rank file of the byte-level BPE at first; ``path`` names another one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        return file.read()


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import digests

    return digests(_read(spark, sf_dir, "documents"), vocabulary_file())


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import align

    files = vocabulary_file(name="byte_bpe_50k.json"), vocabulary_file(name="piece_bpe_32k.model")
    return align(_read(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_bpe import digests

    return digests(_read(spark, sf_dir, "documents"), vocabulary_file(name="word_bpe_49k.json"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs, repeated_tails

    found = periodic_runs(_read(spark, sf_dir, "documents"), arrange=repeated_tails)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(_read(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_dedup

    return near_dedup(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    found = substring_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .additive_quantisation import nearest

    return nearest(_read(spark, sf_dir, "embeddings"))


def example_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``, made by rule: the tables hold none.

    By the first four hex digits v of the MD5 of its key, a key is added on day v % 300; if v is even it is
    removed 30 + v % 7 days later, and if v is a multiple of 4 it is added again 60 days after the first time.
    Listed are a third of the hosts, a fifth of the prefixes and every domain of two labels.
    """
    from .url_filter import keys

    found = pages.select(F.explode(keys(F.col("url"))).alias("k")).select("k.kind", "k.key").distinct()
    v = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")
    labels = F.size(F.split("key", r"\."))
    listed = (
        ((F.col("kind") == "host") & (v % 3 == 0)) | ((F.col("kind") == "prefix") & (v % 5 == 0)) | ((F.col("kind") == "domain") & (labels == 2))
    )
    day = v % 300
    log = F.array(
        F.struct(day.alias("day"), F.lit("add").alias("action")),
        F.when(v % 2 == 0, F.struct((day + 30 + v % 7).alias("day"), F.lit("remove").alias("action"))),
        F.when(v % 4 == 0, F.struct((day + 60).alias("day"), F.lit("add").alias("action"))),
    )
    return found.where(listed).select("kind", "key", F.explode(log).alias("e")).where("e is not null").select("kind", "key", "e.day", "e.action")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    pages = _read(spark, sf_dir, "pages")
    # the table has no time of fetching: page_id decides the day
    captures = pages.select("page_id", "url", (F.col("page_id") * 37 % 365).cast("int").alias("day"))
    found = url_filter(captures, example_list(pages), "page_id", "url", "day")
    return found.select(F.col("id").alias("page_id"), F.col("time").alias("day"), "blocked", "n_matches", "first_match")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op7_quality_classifier": op7_quality_classifier,
    "op2_url_filter": op2_url_filter,
    "op1_additive_quantisation": op1_additive_quantisation,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op8_language_id": op8_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mixing": op4_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_word_bpe": op12_word_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op2_url_filter": r"""
        WITH captures AS (
            SELECT page_id, url, CAST(page_id * 37 % 365 AS INT) AS day,
                   nullif(regexp_replace(lower(regexp_extract(
                       url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.', ''), '') AS host,
                   regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)', 1) AS segment
            FROM pages
        ),
        labelled AS (SELECT *, string_split(host, '.') AS labels FROM captures),
        asked AS (
            SELECT page_id, day, 'host' AS kind, host AS key FROM labelled
            UNION ALL SELECT page_id, day, 'domain', host FROM labelled
            UNION ALL SELECT page_id, day, 'prefix', host || '/' || segment FROM labelled WHERE segment <> ''
            UNION ALL SELECT page_id, day, 'domain', array_to_string(labels[i:], '.')
                      FROM labelled, unnest(range(2, len(labels))) AS r(i)
        ),
        found AS (
            SELECT DISTINCT kind, key, CAST('0x' || substr(md5(key), 1, 4) AS INT) AS v
            FROM asked WHERE key IS NOT NULL
        ),
        listed AS (
            SELECT * FROM found
            WHERE kind = 'host' AND v % 3 = 0 OR kind = 'prefix' AND v % 5 = 0
               OR kind = 'domain' AND len(string_split(key, '.')) = 2
        ),
        log AS (
            SELECT kind, key, v % 300 AS at, 'add' AS action FROM listed
            UNION ALL SELECT kind, key, v % 300 + 30 + v % 7, 'remove' FROM listed WHERE v % 2 = 0
            UNION ALL SELECT kind, key, v % 300 + 60, 'add' FROM listed WHERE v % 4 = 0
        ),
        latest AS (
            SELECT a.page_id, a.kind, a.key, arg_max(l.action, l.at) AS action
            FROM asked a JOIN log l ON a.kind = l.kind AND a.key = l.key AND l.at <= a.day
            GROUP BY a.page_id, a.kind, a.key
        ),
        matches AS (
            SELECT page_id, count(*) AS n, min(kind || ' ' || key) AS first_match
            FROM latest WHERE action = 'add' GROUP BY page_id
        )
        SELECT c.page_id, c.day, m.n IS NOT NULL AS blocked, coalesce(m.n, 0) AS n_matches, m.first_match
        FROM captures c LEFT JOIN matches m ON c.page_id = m.page_id
    """,
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
                 unnest(parts) WITH ORDINALITY AS u(line, pos)
        ),
        repeated AS (
            SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ),
        marked AS (
            SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.last AS gone
            FROM lines l LEFT JOIN repeated r ON l.key = r.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY sha256(coalesce(text, '')))
    """,
}
