"""The pN_ queries: each runs a problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, leakage, lookalike, provenance, secrets, split, survivor
from scanloom.llm.syntax import check as syntax
from scanloom.session import once, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    events = secrets.scan_sources(table(spark, d, "chunks"), "chunk_key", "file_path", "source", with_source=False)
    return events.select("chunk_key", F.explode("events").alias("e")).select("chunk_key", "e.line", "e.type").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan_sources(once(table(spark, d, "chunks").select("chunk_key", "file_path", "source"), "chunk_key"), "chunk_key", "file_path", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_oversized(table(spark, d, "chunks"), "chunk_key", "source", "start_line", with_text=False)
    return pieces.where("piece = 1 AND n_pieces > 1").select("chunk_key").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(once(table(spark, d, "chunks").select("chunk_key", "source", "start_line"), "chunk_key"), "chunk_key", "source", "start_line")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_syntax(table(spark, d, "files"), "file_id", "path", "content", invalid_only=True).select("file_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "files"), "file_id", "repo", "path", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.label_files(table(spark, d, "files"), "file_id", "repo", "path", "content").where("label <> 'handwritten'").select("file_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return provenance.label_report(table(spark, d, "files"), "file_id", "repo", "path", "content", "is_test")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "findings"), table(spark, d, "scans"))


def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    return survivor.merged_records(table(spark, d, "findings"), table(spark, d, "scans"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the passages stand, for removal."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", spans=True)
    return found.select("doc_id", "item_id", F.explode("spans").alias("s")).select("doc_id", "item_id", "s.begin", "s.end")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, d, "documents"), "doc_id", "text")


def p8_one_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


_GROUPED = r"""
WITH once AS (
  SELECT DISTINCT ON (finding_key) finding_key, scan_id, repo, line,
    regexp_replace(CASE WHEN regexp_matches(replace(trim(file), '\', '/'), '^(/|[A-Za-z]:/)') AND instr(replace(trim(file), '\', '/'), '/' || repo || '/') > 0
      THEN substr(replace(trim(file), '\', '/'), instr(replace(trim(file), '\', '/'), '/' || repo || '/') + length(repo) + 2)
      ELSE replace(trim(file), '\', '/') END, '^(\./)+', '') AS file,
    regexp_replace(lower(type), '[^a-z0-9]', '', 'g') AS type,
    CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS confidence,
    (coalesce(col_number, 0) > 0)::INT
    + (lower(trim(coalesce(function_name, ''))) NOT IN ('', '-', 'n/a', 'none', 'null', 'unknown'))::INT
    + (lower(trim(coalesce(recommendation, ''))) NOT IN ('', '-', 'n/a', 'none', 'null', 'unknown'))::INT
    + (lower(trim(coalesce(code_snippet, ''))) NOT IN ('', '-', 'n/a', 'none', 'null', 'unknown'))::INT
    + (lower(trim(coalesce(quote, ''))) NOT IN ('', '-', 'n/a', 'none', 'null', 'unknown'))::INT AS filled
  FROM findings),
timed AS (SELECT once.*, s.scanned_at FROM once LEFT JOIN (SELECT scan_id, min(scanned_at) AS scanned_at FROM scans GROUP BY scan_id) s USING (scan_id)),
marked AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 3 THEN 0 ELSE 1 END AS fresh FROM timed WINDOW w AS (PARTITION BY repo, file, type ORDER BY line, finding_key)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY repo, file, type ORDER BY line, finding_key) AS g FROM marked),
best AS (SELECT *, filled = max(filled) OVER w AND confidence = max(confidence) OVER w AND scanned_at = max(scanned_at) OVER w AS stays FROM grouped WINDOW w AS (PARTITION BY repo, file, type, g))
"""


def oracle_sql() -> dict[str, str]:
    look = lookalike.one_form_sql("text")
    return {
        "p2_found": "SELECT DISTINCT chunk_key FROM chunks WHERE strlen(source) // 4 > 600",
        "p5_found": _GROUPED + "SELECT a.finding_key, b.finding_key AS survivor_key FROM best a JOIN best b ON a.repo = b.repo AND a.file = b.file AND a.type = b.type AND a.g = b.g AND b.stays WHERE a.finding_key <> b.finding_key",
        "p8_found": f"WITH f AS (SELECT doc_id, text, {look} AS look FROM documents WHERE regexp_matches(text, '\\S')) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id",
        "p8_classes": f"WITH f AS (SELECT DISTINCT doc_id, text, {look} AS look FROM documents WHERE regexp_matches(text, '\\S')), g AS (SELECT * FROM f WHERE trim(look, ' \t\r\n') <> ''), s AS (SELECT look, text, count(*) AS n FROM g GROUP BY ALL), c AS (SELECT look, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS total FROM s GROUP BY look HAVING count(*) > 1) SELECT g.doc_id, sha256(g.look) AS class, c.spellings, c.total - s.n AS links FROM g JOIN c USING (look) JOIN s ON s.look = g.look AND s.text = g.text",
        "p8_one_form": f"SELECT doc_id, {look} AS text FROM documents",
    }
