"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, storage
from .exact_dedup import exact_dedup
from .langid import identify
from .line_dedup import line_dedup
from .mixing import MIX_SQL, mix
from .quality_classifier import classify
from .quality_rules import MAX_DOCS_SHARE, MIN_DOCS, MIN_KEPT_SHARE, MIN_WORDS, digests
from .simhash import simhash_dedup
from .simhash_sql import SIMHASH_SQL
from .substring_dedup import WINDOW, substring_dedup
from .warc import MIN_PAYLOAD, archive_pages


#: The public vocabulary file that op8 and the pipeline use; it is read where it lies.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lambda spark, d: line_dedup(_documents(spark, d)),
    "op2_simhash_near_dedup": lambda spark, d: simhash_dedup(_documents(spark, d)),
    "op4_source_mixing": lambda spark, d: mix(_documents(spark, d)).drop("copies"),
    "op6_warc_revisits": lambda spark, d: archive_pages(_pages(spark, d), storage.scratch_path(spark, "warc")),
    "op3_language_id": lambda spark, d: identify(_documents(spark, d)),
    "op5_quality_rules": lambda spark, d: digests(_documents(spark, d)),
    "op7_substring_dedup": lambda spark, d: substring_dedup(_documents(spark, d)),
    "op9_quality_classifier": lambda spark, d: classify(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op8_word_bpe": lambda spark, d: bpe.encode_documents(_documents(spark, d), WORD_BPE),
    "op10_exact_dedup": lambda spark, d: exact_dedup(_documents(spark, d)),
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_NORMAL = _WORDS.format("translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000')")
_NORMAL_LINE = f"coalesce(array_to_string({_NORMAL}, ' '), '')"

ORACLE_SQL: dict[str, str] = {
    "op2_simhash_near_dedup": SIMHASH_SQL,
    "op5_quality_rules": f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
        split AS MATERIALIZED (SELECT r, doc_id, source, text, {_WORDS.format("text")} AS words, string_split(text, chr(10)) AS parts FROM docs),
        lines AS MATERIALIZED (
            SELECT r, source, place, line, {_NORMAL_LINE.format("line")} AS norm, len({_WORDS.format("line")}) AS size
            FROM (SELECT r, source, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS line FROM split)),
        held AS (SELECT source, norm, count(DISTINCT r) AS n FROM lines WHERE size > 0 GROUP BY ALL),
        hosts AS (SELECT source, count(*) AS docs FROM docs GROUP BY ALL),
        frequent AS (SELECT held.source, norm FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE n > {MIN_DOCS} AND n > docs * {MAX_DOCS_SHARE}::DOUBLE),
        judged AS (
            SELECT l.r, place, line, size, f.norm IS NOT NULL AS goes, size > 0 AND row_number() OVER (PARTITION BY l.r, line ORDER BY place) > 1 AS again
            FROM lines l LEFT JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source),
        by_line AS (
            SELECT r, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(size) FILTER (goes), 0)::BIGINT AS n_line_words,
                   coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '') AS left_text
            FROM judged GROUP BY r),
        words AS MATERIALIZED (SELECT r, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS w FROM split),
        spans AS (SELECT r, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS span FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
        twice AS (SELECT r, p, span IS NOT NULL AND count(*) OVER (PARTITION BY r, span) > 1 AS starts FROM spans),
        covered AS (SELECT r, bool_or(starts) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS repeated FROM twice),
        by_word AS (SELECT r, count(*) FILTER (repeated) AS n FROM covered GROUP BY r),
        figures AS (
            SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, n_dup_lines,
                   coalesce(by_word.n, 0) AS n_repeat_words, n_line_words, sha256(left_text) AS text_sha256
            FROM split JOIN by_line USING (r) LEFT JOIN by_word USING (r)),
        based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
        SELECT *, NOT base_failed AND n_words - n_line_words >= {MIN_KEPT_SHARE} * n_words AS kept FROM based""",
    "op7_substring_dedup": f"""
        WITH split AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
        starts AS (
            SELECT r, doc_id, p, words[p] AS w, CASE WHEN p + {WINDOW} <= len(words) + 1 THEN array_to_string(words[p : p + {WINDOW - 1}], ' ') END AS span
            FROM (SELECT r, doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM split)),
        seen AS (SELECT r, p, w, span IS NOT NULL AND row_number() OVER (PARTITION BY span ORDER BY doc_id NULLS FIRST, r, p) > 1 AS again FROM starts),
        covered AS (SELECT r, p, w, bool_or(again) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS goes FROM seen),
        per AS (SELECT r, count(*) FILTER (goes) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT goes) AS kept FROM covered GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM split LEFT JOIN per USING (r)""",
    "op4_source_mixing": MIX_SQL,
    "op6_warc_revisits": f"""
        WITH h AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= {MIN_PAYLOAD} AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= {MIN_PAYLOAD} AND page_id <> original THEN original END AS refers_to
        FROM o""",
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
