"""All queries of the core over the driver's tables, each beside the SQL that gives the same rows.

Queries without SQL (sequential matching, resampling, parsing, models) are held against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import paths, prompts, stats
from scanloom.functions import text as tx
from scanloom.operators import analysis, chunking, evaluation, families, matching, ordered, redaction, reporting, retrieval, review, usage
from scanloom.operators import findings as fd
from scanloom.session import table

KEY = ["repo", "file", "type"]
THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# views that several SQL texts share
_TYPES = str(list(analysis.WEB_TYPES + analysis.NATIVE_TYPES))
_F = "f AS (SELECT DISTINCT ON (finding_key) * REPLACE (CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS confidence) FROM findings)"
_FILES = "fl AS (SELECT DISTINCT ON (file_id) * FROM files)"
_CHUNKS = "ch AS (SELECT DISTINCT ON (chunk_key) * FROM chunks)"
_SCANS = "sc AS (SELECT DISTINCT ON (scan_id) * FROM scans)"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings without redelivery, confidence on one scale."""
    c = F.col("confidence")
    return table(spark, d, "findings").drop("ingested_at").dropDuplicates(["finding_key"]).withColumn("confidence", F.when(c > 1, c / 100).otherwise(c))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Files without redelivery."""
    return table(spark, d, "files").drop("ingested_at").dropDuplicates(["file_id"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without redelivery."""
    return table(spark, d, "chunks").drop("ingested_at").dropDuplicates(["chunk_key"])


def scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans without redelivery."""
    return table(spark, d, "scans").drop("ingested_at").dropDuplicates(["scan_id"])


_FOLD = """
g AS (SELECT repo, file, type, list({'l': line, 'o': finding_key, 'c': confidence} ORDER BY line, finding_key) AS xs
      FROM f WHERE repo IS NOT NULL AND file IS NOT NULL AND type IS NOT NULL AND line IS NOT NULL GROUP BY ALL),
kept AS (SELECT repo, file, type, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y:
      CASE WHEN y[1].l - acc[-1].l > 3 THEN list_concat(acc, y) WHEN coalesce(y[1].c, -1) > coalesce(acc[-1].c, -1) THEN list_concat(acc[:-2], y) ELSE acc END)) AS x FROM g)
"""


@query(f"WITH {_F}, {_FOLD} SELECT repo, file, type, x.l AS line, x.o AS finding_key, x.c AS confidence FROM kept")
def near_line_dedup(spark, d):
    return ordered.near_line_fold(findings(spark, d), KEY, "line", "confidence", "finding_key")


@query(
    f"WITH {_F}, {_FOLD}, s AS (SELECT f.severity, f.type FROM kept JOIN f ON f.finding_key = x.o WHERE x.c >= 0.5)"
    " SELECT 'severity' AS facet, severity AS value, count(*) AS findings FROM s GROUP BY severity UNION ALL SELECT 'type', type, count(*) FROM s GROUP BY type UNION ALL SELECT 'total', 'all', count(*) FROM s HAVING count(*) > 0"
)
def finding_summary(spark, d):
    f = findings(spark, d)
    kept = ordered.near_line_fold(f, KEY, "line", "confidence", "finding_key").select("finding_key")
    strong, _ = fd.confidence_filter(f.join(kept, "finding_key", "left_semi"), "confidence", 0.5)
    return reporting.summary(strong, "severity", "type")


_EXT = "CASE regexp_extract(lower(path), '(\\.[^./]*)$', 1) WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.c' THEN 'c' WHEN '.cpp' THEN 'cpp' END"
_TEST = "(regexp_matches(regexp_extract(lower(path), '[^/]*$'), '[._](test|spec)\\.') OR regexp_matches(regexp_replace(regexp_extract(lower(path), '[^/]*$'), '\\.[^.]*$', ''), '(test|spec)$') OR starts_with(regexp_extract(lower(path), '[^/]*$'), 'test_') OR regexp_matches(lower(path), '(^|/)(tests?|__tests__)/'))"


@query(f"WITH {_FILES} SELECT {_EXT} AS language, count(*) AS files, count(*) FILTER ({_TEST}) AS test_files FROM fl GROUP BY 1")
def files_by_language(spark, d):
    p = F.col("path")
    return files(spark, d).groupBy(paths.language(p).alias("language")).agg(F.count("*").alias("files"), F.count_if(paths.is_test(p)).alias("test_files"))


@query(f"WITH {_FILES} SELECT file_id, {_TEST} AS looks_like_test, is_test FROM fl")
def test_paths(spark, d):
    return files(spark, d).select("file_id", paths.is_test(F.col("path")).alias("looks_like_test"), "is_test")


@query(
    f"WITH {_FILES} SELECT file_id, path FROM fl WHERE NOT (list_has_any(string_split(path, '/')[:-2], ['node_modules', 'vendor', '.git', 'dist', 'build', '__pycache__', 'static'])"
    " OR regexp_matches(path, '\\.min\\.js$') OR regexp_matches(path, '\\.bundle\\.js$') OR path = 'static')"
)
def kept_paths(spark, d):
    return files(spark, d).where(~paths.excluded(F.col("path"), ("# comment", "static"))).select("file_id", "path")


_NORM = "replace({s}, chr(13) || chr(10), chr(10))"
_STRIP = (
    "CASE WHEN {lang} IN ('javascript', 'typescript', 'java') THEN regexp_replace(regexp_replace({s}, '(?s)/\\*.*?\\*/', '', 'g'), '//.*', '', 'g')"
    " WHEN {lang} = 'python' THEN regexp_replace(regexp_replace(regexp_replace({s}, '(?s)\"\"\".*?\"\"\"', '', 'g'), '(?s)''''''.*?''''''', '', 'g'), '#.*', '', 'g') ELSE {s} END"
)


def _normalized_sql(s: str, lang: str) -> str:
    out = _STRIP.replace("{s}", _NORM.replace("{s}", s)).replace("{lang}", lang)
    for a, b in (("\\n{3,}", "\\n\\n"), ("([^=!><])[ \\t\\n\\f\\r]*=[ \\t\\n\\f\\r]*([^=])", "\\1 = \\2"), ("[ \\t\\n\\f\\r]*([+\\-*/%])[ \\t\\n\\f\\r]*", " \\1 "), ("[ \\t]+", " "), ("[ \\t]+\\n", "\\n"), ("^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$", "")):
        b = "chr(10) || chr(10)" if b == "\\n\\n" else "chr(10)" if b == "\\n" else f"'{b}'"
        out = f"regexp_replace({out}, '{a}', {b}, 'g')"
    return out


@query(f"WITH {_CHUNKS}, n AS (SELECT chunk_key, source, {_normalized_sql('source', 'language')} AS s FROM ch) SELECT chunk_key, CAST(strlen(source) // 4 AS INT) AS tokens, s AS normalized, sha256(s) AS chunk_id FROM n")
def normalized_chunks(spark, d):
    s = tx.normalize_source(F.col("source"), F.col("language"))
    return chunks(spark, d).select("chunk_key", tx.tokens(F.col("source")).alias("tokens"), s.alias("normalized")).withColumn("chunk_id", tx.chunk_id(F.col("normalized")))


@query(f"WITH {_CHUNKS}, l AS (SELECT chunk_key, start_line, string_split(source, chr(10)) AS ls FROM ch) SELECT chunk_key, array_to_string(list_transform(ls, lambda x, i: lpad(CAST(start_line + i - 1 AS VARCHAR), CAST(length(CAST(start_line + len(ls) - 1 AS VARCHAR)) AS INT), ' ') || ': ' || x), chr(10)) AS numbered FROM l")
def numbered_sources(spark, d):
    return chunks(spark, d).select("chunk_key", tx.numbered(F.col("source"), F.col("start_line")).alias("numbered"))


@query(
    f"WITH {_F}, {_FILES}, j AS (SELECT finding_key, line, string_split(content, chr(10)) AS ls FROM f JOIN fl ON f.repo = fl.repo AND f.file = fl.path),"
    " b AS (SELECT *, greatest(line - 15, 1) AS lo, least(line + 15, len(ls)) AS hi FROM j) SELECT finding_key, array_to_string(list_transform(CASE WHEN hi >= lo THEN ls[lo:hi] ELSE [] END, lambda x, i: CAST(lo + i - 1 AS VARCHAR) || ': ' || x), chr(10)) AS excerpt FROM b"
)
def finding_excerpts(spark, d):
    src = files(spark, d).select("repo", F.col("path").alias("file"), "content")
    return findings(spark, d).select("finding_key", "repo", "file", "line").join(src, ["repo", "file"]).select("finding_key", tx.excerpt(F.col("content"), F.col("line")).alias("excerpt"))


def _line_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '^[ \\t\\n\\f\\r]*[0-9]+[ \\t\\n\\f\\r]*[:|][ \\t\\n\\f\\r]?', ''), '^[ \\t\\n\\f\\r\\x0B]+|[ \\t\\n\\f\\r\\x0B]+$', '', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g')"


_SNAP = (
    f"{_F}, {_FILES}, j AS (SELECT finding_key, f.repo, file, type, confidence, line, {_line_sql('quote')} AS q, list_transform(string_split(content, chr(10)), lambda x: {_line_sql('x')}) AS ls, content IS NULL AS missing FROM f LEFT JOIN fl ON f.repo = fl.repo AND f.file = fl.path),"
    " h AS (SELECT *, list_filter(list_transform(ls, lambda x, i: CASE WHEN x = q THEN i END), lambda i: i IS NOT NULL) AS exact,"
    " list_filter(list_transform(ls, lambda x, i: CASE WHEN strlen(q) >= 12 AND (contains(x, q) OR (strlen(x) >= 12 AND contains(q, x))) THEN i END), lambda i: i IS NOT NULL) AS part FROM j),"
    " c AS (SELECT *, CASE WHEN len(exact) > 0 THEN exact ELSE part END AS cand FROM h),"
    " n AS (SELECT *, list_min(list_transform(cand, lambda i: struct_pack(d := abs(i - line), n := i))) AS best FROM c),"
    " s AS (SELECT *, CASE WHEN coalesce(q, '') = '' THEN 'without_quote' WHEN missing THEN 'file_unreadable' WHEN best IS NULL THEN 'quote_not_found' WHEN best.d = 0 THEN 'confirmed' WHEN best.d <= 40 THEN 'snapped' ELSE 'too_far' END AS outcome FROM n)"
)


def _snapped(spark, d):
    src = files(spark, d).select("repo", F.col("path").alias("file"), "content").withColumn("fk", F.struct("repo", "file")).select("fk", "content")
    return fd.snap_to_quotes(findings(spark, d).withColumn("fk", F.struct("repo", "file")), src, "fk", "line", "quote", "content")


@query(f"WITH {_SNAP} SELECT finding_key, outcome, CAST(CASE WHEN outcome = 'snapped' THEN best.n ELSE line END AS INT) AS snapped_line FROM s")
def quote_snap(spark, d):
    return _snapped(spark, d).select("finding_key", "outcome", F.col("snapped_line").cast("int").alias("snapped_line"))


@query(f"WITH {_SNAP}, k AS (SELECT *, CASE WHEN outcome = 'snapped' THEN best.n ELSE line END AS place FROM s) SELECT outcome, count(*) AS findings, count(DISTINCT (repo, file, type, place)) AS places FROM k GROUP BY outcome")
def snap_outcomes(spark, d):
    s = _snapped(spark, d)
    return s.groupBy("outcome").agg(F.count("*").alias("findings"), F.countDistinct(F.struct("repo", "file", "type", "snapped_line")).alias("places"))


_SITES = (
    f"{_F}, l AS (SELECT repo, file, line, count(*) AS n FROM f WHERE repo IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL GROUP BY ALL),"
    " m AS (SELECT *, CASE WHEN line - lag(line) OVER w <= 3 THEN NULL ELSE line END AS s FROM l WINDOW w AS (PARTITION BY repo, file ORDER BY line)),"
    " st AS (SELECT *, max(s) OVER (PARTITION BY repo, file ORDER BY line) AS site FROM m)"
)


@query(f"WITH {_SITES} SELECT repo, file, site, count(*) AS site_lines, CAST(sum(n) AS BIGINT) AS findings, CAST((sum(line * n) + sum(n) // 2) // sum(n) AS BIGINT) AS center FROM st GROUP BY repo, file, site")
def finding_sites(spark, d):
    return fd.sites(findings(spark, d), ["repo", "file"], "line")


@query(
    f"WITH {_SITES}, j AS (SELECT f.repo, f.file, st.site, f.type, max(f.confidence) AS c FROM f JOIN st ON f.repo = st.repo AND f.file = st.file AND f.line = st.line WHERE f.type IS NOT NULL GROUP BY ALL)"
    " SELECT repo, file, site, count(*) AS types, max(c) AS confidence FROM j GROUP BY repo, file, site HAVING count(*) >= 2"
)
def contested_sites(spark, d):
    c = fd.contested_sites(findings(spark, d), ["repo", "file"], "line", "type", "confidence", "finding_key")
    return c.select("repo", "file", "site", "types", F.array_max("best.confidence").alias("confidence"))


@query(f"WITH {_F} SELECT true AS enabled, CAST(0.5 AS DOUBLE) AS threshold_used, count(*) AS total_findings, count(*) FILTER (NOT coalesce(confidence >= 0.5, false)) AS filtered_findings, count(*) FILTER (confidence >= 0.5) AS kept_findings FROM f")
def confidence_filter_stats(spark, d):
    return fd.confidence_filter(findings(spark, d), "confidence", 0.5)[1]


_DIRECTIVE = (
    f"{_FILES}, r AS (SELECT file_id, {_EXT} AS lang, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM fl),"
    " t AS (SELECT file_id, lang, CAST(n AS INT) AS n, regexp_replace(raw, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g') AS t FROM r),"
    " w AS (SELECT *, regexp_matches(t, '(?:^|[^a-zA-Z0-9_])[a-z][a-z0-9_]*:ignore-next-line(?:[ \\t]+([a-z_]+))?(?:[ \\t]*-[ \\t]*(.+))?') AS nx FROM t WHERE (lang IN ('javascript', 'typescript', 'java') AND starts_with(t, '//')) OR (lang = 'python' AND starts_with(t, '#'))),"
    " k AS (SELECT *, CASE WHEN nx THEN regexp_extract(t, '(?:^|[^a-zA-Z0-9_])[a-z][a-z0-9_]*:ignore-next-line(?:[ \\t]+([a-z_]+))?(?:[ \\t]*-[ \\t]*(.+))?', ['a', 'b']) ELSE regexp_extract(t, '(?:^|[^a-zA-Z0-9_])[a-z][a-z0-9_]*:ignore(?:[ \\t]+([a-z_]+))?(?:[ \\t]*-[ \\t]*(.+))?', ['a', 'b']) END AS m FROM w WHERE regexp_matches(t, '(?:^|[^a-zA-Z0-9_])[a-z][a-z0-9_]*:ignore'))"
)


@query(f"WITH {_DIRECTIVE} SELECT file_id, CASE WHEN nx THEN n + 1 ELSE n END AS line, CASE WHEN m.a = '' THEN 'all' ELSE m.a END AS type, CASE WHEN trim(m.b) <> '' THEN trim(m.b) END AS justification, CASE WHEN nx THEN 'next' ELSE 'same' END AS applies_to, n AS source_line FROM k")
def suppression_directives(spark, d):
    src = files(spark, d).withColumn("lang", paths.language(F.col("path")))
    return fd.suppressions(src, "file_id", "lang", "content")


_SUPP = f"{_F}, {_CHUNKS}, dr AS (SELECT DISTINCT repo, file_path, s.line AS dl, s.type AS dt FROM (SELECT repo, file_path, unnest(suppressed_lines) AS s FROM ch))"


@query(
    f"WITH {_DIRECTIVE}, dr AS (SELECT DISTINCT file_id, CASE WHEN nx THEN n + 1 ELSE n END AS line, CASE WHEN m.a = '' THEN 'all' ELSE m.a END AS type FROM k), p AS (SELECT DISTINCT file_id, line + s AS line FROM dr, (SELECT unnest([-1, 0, 1]) AS s)), c AS (SELECT *, unnest({_TYPES}) AS type FROM p)"
    " SELECT c.file_id, c.line, c.type FROM c WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.file_id = c.file_id AND dr.line = c.line AND dr.type IN ('all', c.type))"
)
def kinds_left_at_directives(spark, d):
    """What suppression leaves of a finding of every kind on and beside each line that a directive speaks for."""
    said = suppression_directives(spark, d)
    places = said.select("file_id", F.explode(F.array(*[F.col("line") + k for k in (-1, 0, 1)])).alias("line")).distinct()
    every = places.select("*", F.explode(F.array(*map(F.lit, analysis.WEB_TYPES + analysis.NATIVE_TYPES))).alias("type"))
    return fd.drop_suppressed(every, said, ["file_id"], "line", "type")


@query(f"WITH {_SUPP} SELECT f.finding_key FROM f WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.repo = f.repo AND dr.file_path = f.file AND dr.dl = f.line AND (dr.dt = 'all' OR dr.dt = f.type))")
def unsuppressed_findings(spark, d):
    s = chunks(spark, d).select("repo", F.col("file_path").alias("file"), F.explode("suppressed_lines").alias("s")).select("repo", "file", "s.line", "s.type")
    return fd.drop_suppressed(findings(spark, d), s, ["repo", "file"], "line", "type").select("finding_key")


@query(
    f"WITH {_F}, {_CHUNKS}, last AS (SELECT function_name, arg_max(suppressed_lines, chunk_key) AS sl FROM ch WHERE function_name IS NOT NULL GROUP BY function_name),"
    " dr AS (SELECT DISTINCT function_name, s.line AS dl, s.type AS dt FROM (SELECT function_name, unnest(sl) AS s FROM last))"
    " SELECT count(*) AS total_findings, count(*) FILTER (EXISTS (SELECT 1 FROM dr WHERE dr.function_name = f.function_name AND dr.dl = f.line AND (dr.dt = 'all' OR dr.dt = f.type))) AS suppressed_findings FROM f"
)
def suppression_by_name(spark, d):
    last = chunking.last_by_name(chunks(spark, d).select("function_name", "chunk_key", "suppressed_lines"), "function_name", ["chunk_key"])
    s = last.select("function_name", F.explode("suppressed_lines").alias("s")).select("function_name", "s.line", "s.type")
    f = findings(spark, d)
    kept = fd.drop_suppressed(f, s, ["function_name"], "line", "type").select("finding_key", F.lit(1).alias("kept"))
    return f.select("finding_key").join(kept, "finding_key", "left").agg(F.count("*").alias("total_findings"), F.count_if(F.col("kept").isNull()).alias("suppressed_findings"))


@query(
    f"WITH {_FILES}, l AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM fl WHERE content IS NOT NULL), p AS (SELECT file_id, ls, unnest(range(0, (len(ls) - 1) // 60 + 1)) AS p FROM l),"
    " w AS (SELECT file_id, CAST(p + 1 AS INT) AS part, CAST(p * 60 + 1 AS INT) AS start_line, CAST(least(p * 60 + 60, len(ls)) AS INT) AS end_line, array_to_string(ls[p * 60 + 1:p * 60 + 60], chr(10)) AS source FROM p) SELECT * FROM w WHERE regexp_matches(source, '[^ \\t\\n\\r\\f\\x0B]')"
)
def file_windows(spark, d):
    return chunking.windows(files(spark, d), "file_id", "content")


@query(
    f"WITH {_CHUNKS}, l AS (SELECT chunk_key, coalesce(start_line, 1) AS s, function_name AS n, string_split(source, chr(10)) AS ls, strlen(source) // 4 > 600 AS big FROM ch WHERE source IS NOT NULL),"
    " p AS (SELECT *, CASE WHEN big THEN list_reduce(list_transform(list_transform(ls, lambda x: CAST(strlen(x) // 4 AS BIGINT)), lambda t, i: [struct_pack(a := i, b := i, t := t)]), lambda acc, y: CASE WHEN acc[-1].t + y[1].t > 600 THEN list_concat(acc, y) ELSE list_concat(acc[:-2], [struct_pack(a := acc[-1].a, b := y[1].b, t := acc[-1].t + y[1].t)]) END)"
    " ELSE [struct_pack(a := CAST(1 AS BIGINT), b := CAST(len(ls) AS BIGINT), t := CAST(0 AS BIGINT))] END AS ps FROM l),"
    " u AS (SELECT *, unnest(ps) AS x, generate_subscripts(ps, 1) AS k FROM p)"
    " SELECT chunk_key, CAST(k AS INT) AS part, CAST(s + x.a - 1 AS INT) AS start_line, CAST(s + x.b - 1 AS INT) AS end_line, CASE WHEN big THEN n || '_part' || k ELSE n END AS name, array_to_string(ls[x.a:x.b], chr(10)) AS source FROM u"
)
def split_chunks(spark, d):
    return chunking.split_chunks(chunks(spark, d), "chunk_key", "source", "start_line", "function_name")


@query()
def function_chunks(spark, d):
    src = files(spark, d).withColumn("lang", paths.language(F.col("path")))
    return chunking.function_chunks(src, "file_id", "lang", "content").select("file_id", "function_name", "start_line", "end_line", F.sha2("source", 256).alias("source_sha"))


_BM = (
    f"{_CHUNKS}, kb AS (SELECT item_id AS kb, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM eval_items WHERE text IS NOT NULL),"
    " st AS (SELECT count(*) AS nd, avg(len(ws)) AS al FROM kb), tf AS (SELECT kb, length, term, count(*) AS tf FROM (SELECT kb, len(ws) AS length, unnest(ws) AS term FROM kb) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),"
    " q AS (SELECT chunk_key, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', CASE WHEN coalesce(function_name, '') NOT IN ('', 'anonymous', 'unknown') THEN function_name END, language, regexp_replace(trim(substr(source, 1, 200)), '[ \\t\\n\\r\\f]+', ' ', 'g'))), '[^a-z0-9]+'), lambda x: x <> '')) AS ws FROM ch),"
    " s AS (SELECT chunk_key, tf.kb, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score FROM (SELECT chunk_key, unnest(ws) AS term FROM q) w JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)"
)


def _kb(spark, d):
    return retrieval.postings(table(spark, d, "eval_items"), "item_id", F.col("text"))


@query(f"WITH {_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY score DESC, kb) AS rank FROM s) SELECT chunk_key, kb, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def bm25_topk(spark, d):
    return retrieval.top_k(chunks(spark, d), "chunk_key", retrieval.query_text(F.col("function_name"), F.col("language"), F.col("source")), _kb(spark, d))


_BUDGET = (
    f"{_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY score DESC, kb) AS rank FROM s),"
    " g AS (SELECT chunk_key, list({'i': strlen(CAST(item_id AS VARCHAR)) + strlen(coalesce(expected_type, '')) + strlen(replace(text, chr(10), '')), 'd': strlen(text) * 6} ORDER BY rank) AS es FROM r JOIN eval_items ON item_id = kb WHERE rank <= 3 GROUP BY chunk_key),"
    " o AS (SELECT *, greatest(list_sum(list_transform(es, lambda e: e.i + e.d)) - 6000, 0) AS excess, list_sum(list_transform(es, lambda e: e.d)) AS dd FROM g),"
    " k AS (SELECT chunk_key, len(es) AS entries, list_reduce(es, lambda acc, e: CASE WHEN acc.over <= 0 OR e.d = 0 THEN {'over': acc.over, 'size': acc.size + e.i + e.d}"
    " ELSE {'over': acc.over - (CASE WHEN e.d - least(CAST(ceil(excess * e.d / dd) AS BIGINT), acc.over) - 3 < 100 THEN greatest(e.d - 100, 0) - 3 ELSE least(CAST(ceil(excess * e.d / dd) AS BIGINT), acc.over) END),"
    " 'size': acc.size + e.i + e.d - (CASE WHEN e.d - least(CAST(ceil(excess * e.d / dd) AS BIGINT), acc.over) - 3 < 100 THEN greatest(e.d - 100, 0) - 3 ELSE least(CAST(ceil(excess * e.d / dd) AS BIGINT), acc.over) END)} END,"
    " {'over': CAST(excess AS BIGINT), 'size': CAST(0 AS BIGINT)}) AS x FROM o)"
)


@query(f"WITH {_BUDGET} SELECT chunk_key, CAST(x.size AS INT) AS bytes, CAST(entries AS INT) AS entries FROM k")
def retrieval_budget(spark, d):
    top = retrieval.top_k(chunks(spark, d), "chunk_key", retrieval.query_text(F.col("function_name"), F.col("language"), F.col("source")), _kb(spark, d))
    kb = table(spark, d, "eval_items").select(F.col("item_id").alias("kb"), F.col("item_id").cast("string").alias("id"), F.col("expected_type").alias("title"), F.repeat(F.col("text"), 6).alias("description"), F.split("text", "\n").alias("patterns"))
    got = top.join(kb, "kb").groupBy("chunk_key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "description", "patterns"))).alias("es"))  # at most 3 a chunk
    cut = retrieval.within_budget(F.transform("es", lambda e: F.struct(*[e[k].alias(k) for k in ("id", "title", "description", "patterns")])))
    n = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    size = F.aggregate("cut", F.lit(0), lambda a, e: a + n(e["id"]) + n(e["title"]) + n(e["description"]) + F.aggregate(e["patterns"], F.lit(0), lambda x, p: x + n(p)))
    return got.select("chunk_key", cut.alias("cut")).select("chunk_key", size.alias("bytes"), F.size("cut").alias("entries"))


@query(
    f"WITH {_CHUNKS}, k AS (SELECT list_concat(CASE WHEN max((NOT coalesce(language IN ('c', 'cpp'), false))::INT) = 1 THEN {_TYPES}[1:9] ELSE [] END, CASE WHEN max(coalesce(language IN ('c', 'cpp'), false)::INT) = 1 THEN {_TYPES}[10:13] ELSE [] END) AS ts FROM ch)"
    " SELECT chunk_key, unnest(ts) AS type FROM ch, k"
)
def work_items(spark, d):
    return analysis.work_items(chunks(spark, d), "chunk_key", "language")


@query(f"WITH {_CHUNKS} SELECT language, unnest(list_sort(list_distinct(flatten(list(frameworks))))) AS framework FROM ch WHERE frameworks IS NOT NULL GROUP BY language")
def framework_inventory(spark, d):
    return chunks(spark, d).select("language", F.explode("frameworks").alias("framework")).distinct()


@query(
    f"WITH {_CHUNKS}, c AS (SELECT id, count(*) AS chunks, count(DISTINCT (repo, file_path)) AS places FROM ch GROUP BY id) SELECT id, chunks, places FROM c WHERE chunks > 1"
)
def repeated_functions(spark, d):
    return chunks(spark, d).groupBy("id").agg(F.count("*").alias("chunks"), F.countDistinct(F.struct("repo", "file_path")).alias("places")).where("chunks > 1")


@query(f"WITH {_SCANS} SELECT model_used AS model, count(*) AS calls, round(coalesce(sum(total_cost), 0), 6) AS cost FROM sc GROUP BY 1")
def usage_by_model(spark, d):
    return usage.by_model(scans(spark, d).withColumnRenamed("model_used", "model"), "model", "total_cost")


_RUN = f"{_SCANS}, r AS (SELECT scan_id, scanned_at, total_cost, sum(coalesce(total_cost, 0)) OVER (ORDER BY scanned_at, scan_id) AS total FROM sc), b AS (SELECT *, round(total - coalesce(total_cost, 0), 6) AS cost_before FROM r)"


@query(f"WITH {_RUN} SELECT scan_id, cost_before, CASE WHEN cost_before >= 0.9 THEN 'stopped' WHEN cost_before >= 0.4 THEN 'fallback' ELSE 'primary' END AS choice FROM b")
def running_budget(spark, d):
    s = scans(spark, d).select("scan_id", "scanned_at", "total_cost")
    return usage.model_choice(s, ["scanned_at", "scan_id"], "total_cost", 0.4, 0.9).select("scan_id", "cost_before", "choice")


@query(f"WITH {_RUN}, t AS (SELECT unnest([0.5, 0.8, 1.0]::DOUBLE[]) AS share) SELECT share, (SELECT arg_min(scan_id, (scanned_at, scan_id)) FROM b WHERE round(total, 9) >= round(0.9 * share, 9)) AS reached_at FROM t")
def budget_milestones(spark, d):
    return usage.milestones(scans(spark, d).select("scan_id", "scanned_at", "total_cost"), ["scanned_at", "scan_id"], "total_cost", 0.9)


@query(
    f"WITH {_SCANS}, o AS (SELECT scan_id, scanned_at, total_cost IS NULL AS bad, sum((total_cost IS NOT NULL)::INT) OVER (ORDER BY scanned_at, scan_id) AS run FROM sc)"
    " SELECT CAST(run AS BIGINT) AS run, arg_min(scan_id, (scanned_at, scan_id)) AS first, count(*) AS length FROM o WHERE bad GROUP BY run HAVING count(*) >= 1"
)
def failure_runs(spark, d):
    return ordered.failure_runs(scans(spark, d).select("scan_id", "scanned_at", "total_cost"), ["scanned_at", "scan_id"], F.col("total_cost").isNull(), 1)


@query(f"WITH {_SCANS}, w AS (SELECT repo, scanned_at, scan_id, model_used, lag(model_used) OVER (PARTITION BY repo ORDER BY scanned_at, scan_id) AS p FROM sc) SELECT repo, scanned_at, scan_id, p AS from_model, model_used AS to_model FROM w WHERE p IS NOT NULL AND p <> model_used")
def model_transitions(spark, d):
    return usage.transitions(scans(spark, d), ["repo"], ["scanned_at", "scan_id"], "model_used")


def _sides(spark, d):
    """Labels and all findings (severity says which count when nothing matches them) under base names."""
    base = lambda c: paths.base_name(paths.slashes(F.col(c)))
    e = table(spark, d, "expected_findings").select(F.col("label_id").alias("id"), "repo", base("file").alias("file"), F.col("line").cast("long").alias("line"), "type", "confidence_min")
    a = findings(spark, d).select(F.col("finding_key").alias("id"), "repo", base("file").alias("file"), F.col("line").cast("long").alias("line"), "type", "confidence", "severity")
    return e, a


_SIDES = (
    f"{_F}, a AS (SELECT finding_key AS id, repo, regexp_extract(replace(file, '\\', '/'), '[^/]*$') AS file, CAST(line AS BIGINT) AS line, type, confidence, coalesce(lower(severity) IN ('high', 'critical'), false) AS severe FROM f),"
    " e AS (SELECT label_id AS id, repo, regexp_extract(replace(file, '\\', '/'), '[^/]*$') AS file, CAST(line AS BIGINT) AS line, type, confidence_min FROM expected_findings)"
)
# the greedy matching as a fold over the labels of a group, which remembers the findings it took
_TAKE = (
    "list_reduce(es, lambda acc, x: list_append(acc, {'e': x.id, 'a': list_extract(list_filter(fs, lambda y: abs(y.line - x.line) <= 20{more} AND NOT list_contains(list_transform(acc, lambda p: p.a), y.id)), 1).id}), CAST([] AS STRUCT(e BIGINT, a BIGINT)[]))"
)


def _pairs_sql(name: str = "p", more: str = "", where: str = "", left: str = "e", right: str = "a") -> str:
    key = "repo IS NOT NULL AND file IS NOT NULL AND type IS NOT NULL AND line IS NOT NULL"
    return (
        f"{name}_e AS (SELECT repo, file, type, list({{'id': id, 'line': line}} ORDER BY id) AS es FROM {left} WHERE {key} GROUP BY ALL), {name}_a AS (SELECT repo, file, type, list({{'id': id, 'line': line}} ORDER BY id) AS fs FROM {right} WHERE {key}{where} GROUP BY ALL),"
        f" {name}_t AS (SELECT unnest({_TAKE.replace('{more}', more)}) AS x FROM {name}_e JOIN {name}_a USING (repo, file, type)), {name} AS (SELECT x.e AS expected_id, x.a AS actual_id FROM {name}_t WHERE x.a IS NOT NULL)"
    )


_PAIRS = f"{_SIDES}, {_pairs_sql()}"
_SCORES = "coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fn + fp, 0), 6), 0) AS f1, coalesce(round(100 * 5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6), 0) AS f2"
_COUNTS = (
    "u AS (SELECT e.{by}, (p.actual_id IS NOT NULL)::INT AS tp, 0 AS fp, (p.actual_id IS NULL)::INT AS fn FROM e LEFT JOIN p ON p.expected_id = e.id"
    " UNION ALL SELECT {by}, 0, 1, 0 FROM a WHERE severe AND id NOT IN (SELECT actual_id FROM p)), c AS (SELECT {by}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM u GROUP BY {by})"
)


@query(f"WITH {_PAIRS} SELECT expected_id, actual_id FROM p")
def label_matches(spark, d):
    e, a = _sides(spark, d)
    return matching.greedy_match(e, a, KEY, 20)


@query(f"WITH {_PAIRS}, {_COUNTS.replace('{by}', 'type')} SELECT type, tp, fp, fn, {_SCORES} FROM c")
def match_scores(spark, d):
    e, a = _sides(spark, d)
    return matching.scores(matching.match_counts(e, a, matching.greedy_match(e, a, KEY, 20), ["type"]), ["type"])


_SWEEP = ", ".join(_pairs_sql(f"p{k}", where=f" AND confidence >= {t}") for k, t in enumerate(THRESHOLDS))
_SWEPT = " UNION ALL ".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, (SELECT count(*) FROM p{k}) AS tp, (SELECT count(*) FROM a WHERE severe AND confidence >= {t} AND id NOT IN (SELECT actual_id FROM p{k})) AS fp, (SELECT count(*) FROM e) - (SELECT count(*) FROM p{k}) AS fn"
    for k, t in enumerate(THRESHOLDS)
)


@query(f"WITH {_SIDES}, {_SWEEP}, c AS ({_SWEPT}) SELECT threshold, tp, fp, fn, {_SCORES} FROM c")
def threshold_sweep(spark, d):
    e, a = _sides(spark, d)
    return matching.threshold_sweep(e, a, KEY, 20, THRESHOLDS)


_WHOLE = "CASE WHEN repo IS NOT NULL AND file IS NOT NULL THEN repo || '/' || file END"


@query(
    f"WITH {_PAIRS}, x AS (SELECT id, {_WHOLE} AS file, line, type FROM a WHERE id NOT IN (SELECT actual_id FROM p)), t AS (SELECT DISTINCT {_WHOLE} AS file, line, type FROM e WHERE {_WHOLE} IS NOT NULL AND line IS NOT NULL AND type IS NOT NULL),"
    " k AS (SELECT x.id, bool_or(t.type <> x.type AND abs(t.line - x.line) <= 10) AS wrong, bool_or(t.type = x.type AND abs(t.line - x.line) BETWEEN 11 AND 30) AS off, bool_or(t.type = x.type) AS claimed FROM x LEFT JOIN t ON t.file = x.file GROUP BY x.id),"
    f" n AS (SELECT {_WHOLE} AS file, line, count(*) AS n FROM a WHERE {_WHOLE} IS NOT NULL AND line IS NOT NULL GROUP BY ALL),"
    " c AS (SELECT CASE WHEN wrong THEN 'wrong_type' WHEN off THEN 'line_off' WHEN n.n > 1 THEN 'duplicate_site' WHEN claimed THEN 'gt_claimed_or_far' ELSE 'no_nearby_gt' END AS category FROM k JOIN x USING (id) LEFT JOIN n ON n.file = x.file AND n.line = x.line)"
    " SELECT category, count(*) AS findings, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY category"
)
def false_positive_kinds(spark, d):
    e, a = _sides(spark, d)
    pairs = matching.greedy_match(e, a, KEY, 20)
    whole = lambda df: df.withColumn("file", F.concat("repo", F.lit("/"), "file"))
    kinds = matching.false_positive_kinds(whole(a), whole(e).withColumn("vulnerable", F.lit(True)), pairs).groupBy("category").agg(F.count("*").alias("findings"))
    total = kinds.agg(F.sum("findings").alias("all"))
    return kinds.crossJoin(F.broadcast(total)).select("category", "findings", F.round(F.col("findings") / F.col("all"), 6).alias("share"))


@query(
    f"WITH {_SIDES}, ef AS (SELECT DISTINCT {_WHOLE} AS file FROM e WHERE {_WHOLE} IS NOT NULL), af AS (SELECT DISTINCT {_WHOLE} AS file FROM a WHERE {_WHOLE} IS NOT NULL)"
    " SELECT count(*) AS labelled_files, count(*) FILTER (file IN (SELECT file FROM af)) AS found_files, round(count(*) FILTER (file IN (SELECT file FROM af)) / count(*), 6) AS rate, (SELECT count(*) FROM af WHERE file NOT IN (SELECT file FROM ef)) AS other_files FROM ef"
)
def file_detection(spark, d):
    e, a = _sides(spark, d)
    whole = lambda df: df.withColumn("file", F.concat("repo", F.lit("/"), "file"))
    return matching.file_detection(whole(e), whole(a))


@query(
    f"WITH {_PAIRS}, k AS (SELECT repo, count(*) AS expected, arg_min(type, id) AS kind, count(*) FILTER (id IN (SELECT expected_id FROM p)) AS matched FROM e WHERE repo IS NOT NULL GROUP BY repo),"
    " w AS (SELECT e.repo, count(*) AS mismatches FROM p JOIN e ON e.id = p.expected_id JOIN a ON a.id = p.actual_id WHERE a.confidence < e.confidence_min GROUP BY e.repo),"
    " s AS (SELECT a.repo, count(*) AS actual, count(*) FILTER (severe AND id NOT IN (SELECT actual_id FROM p)) AS extra, count(*) FILTER (severe AND id NOT IN (SELECT actual_id FROM p) AND coalesce(k.kind IS NULL OR a.type = k.kind, false)) AS extra_typed FROM a LEFT JOIN k USING (repo) WHERE a.repo IS NOT NULL GROUP BY a.repo),"
    " j AS (SELECT repo, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(matched, 0) AS matched, coalesce(extra, 0) AS extra, coalesce(extra_typed, 0) AS extra_typed, coalesce(mismatches, 0) AS mismatches, coalesce(expected, 0) - coalesce(matched, 0) AS missing FROM k FULL JOIN s USING (repo) LEFT JOIN w USING (repo)),"
    " o AS (SELECT *, coalesce(round(matched / nullif(matched + extra, 0), 6), 0) AS precision, coalesce(round(2 * matched / nullif(2 * matched + extra + missing, 0), 6), 0) AS f1, coalesce(round(matched / nullif(matched + extra_typed, 0), 6), 0) AS precision_typed, coalesce(2 * matched / nullif(2 * matched + extra_typed + missing, 0), 0) AS ft, coalesce(round(matched / nullif(matched + missing, 0), 6), 0) AS recall FROM j)"
    " SELECT * EXCLUDE (ft), round(ft, 6) AS f1_typed, ft >= 0.45 AND mismatches = 0 AS success FROM o"
)
def label_comparison(spark, d):
    e, a = _sides(spark, d)
    return matching.comparison(e, a, matching.greedy_match(e, a, KEY, 20), "repo")


def _tail_sides(spark, d):
    clean = lambda c: F.regexp_replace(paths.slashes(F.col(c)), r"^(\./)+", "")
    cols = lambda df, i: df.select(F.col(i).alias("id"), "repo", clean("file").alias("file"), F.col("line").cast("long").alias("line"), "type")
    return cols(table(spark, d, "expected_findings"), "label_id"), cols(findings(spark, d), "finding_key")


_TAIL_CLEAN = "regexp_replace(replace(file, '\\', '/'), '^(\\./)+', '')"
_TAIL_KEY = "repo IS NOT NULL AND file IS NOT NULL AND file <> '' AND type IS NOT NULL AND line IS NOT NULL"


@query(
    f"WITH {_F}, te AS (SELECT repo, type, list({{'id': label_id, 'line': line, 'file': file}} ORDER BY label_id) AS es FROM (SELECT * REPLACE ({_TAIL_CLEAN} AS file) FROM expected_findings) WHERE {_TAIL_KEY} GROUP BY ALL),"
    f" ta AS (SELECT repo, type, list({{'id': finding_key, 'line': line, 'file': file}} ORDER BY finding_key) AS fs FROM (SELECT * REPLACE ({_TAIL_CLEAN} AS file) FROM f) WHERE {_TAIL_KEY} GROUP BY ALL),"
    f" tp AS (SELECT unnest({_TAKE.replace('{more}', ' AND (ends_with(y.file, x.file) OR ends_with(x.file, y.file))')}) AS x FROM te JOIN ta USING (repo, type)) SELECT x.e AS expected_id, x.a AS actual_id FROM tp WHERE x.a IS NOT NULL"
)
def tail_matches(spark, d):
    e, a = _tail_sides(spark, d)
    return matching.greedy_match(e, a, ["repo", "type"], 20, tails=True)


@query(
    f"WITH {_F}, te AS (SELECT repo, file, list({{'id': label_id, 'line': line, 'type': type}} ORDER BY label_id) AS ts FROM (SELECT * REPLACE ({_TAIL_CLEAN} AS file) FROM expected_findings) WHERE {_TAIL_KEY} GROUP BY ALL),"
    f" ta AS (SELECT repo, file, list({{'id': finding_key, 'line': line, 'type': type}} ORDER BY finding_key) AS es FROM (SELECT * REPLACE ({_TAIL_CLEAN} AS file) FROM f) WHERE {_TAIL_KEY} GROUP BY ALL),"
    " c AS (SELECT unnest(list_reduce(es, lambda acc, x: list_append(acc, {'f': x.id, 't': list_extract(list_filter(ts, lambda y: abs(y.line - x.line) <= 10 AND y.type = x.type AND NOT list_contains(list_transform(acc, lambda p: p.t), y.id)), 1).id}), CAST([] AS STRUCT(f BIGINT, t BIGINT)[]))) AS x FROM te JOIN ta USING (repo, file))"
    " SELECT x.f AS finding_id, x.t AS truth_id FROM c WHERE x.t IS NOT NULL"
)
def claimed_labels(spark, d):
    e, a = _tail_sides(spark, d)
    truth = e.where("file <> '' AND type IS NOT NULL").select("id", "repo", "file", F.col("line").alias("start_line"), F.lit(None).cast("long").alias("end_line"), F.array("type").alias("kinds"), F.lit(True).alias("vulnerable"))
    return matching.claim_match(a.where("file <> '' AND type IS NOT NULL").withColumn("kinds", F.array("type")), truth, 10)


@query(
    f"WITH {_SIDES}, le AS (SELECT * FROM e WHERE repo IS NOT NULL AND file IS NOT NULL AND type IS NOT NULL AND line IS NOT NULL), n_e AS (SELECT repo, file, type, list({{'id': id, 'line': line}} ORDER BY id) AS es FROM le GROUP BY ALL), n_a AS (SELECT repo, file, type, list({{'id': id, 'line': line}} ORDER BY id) AS fs FROM a WHERE repo IS NOT NULL AND file IS NOT NULL AND type IS NOT NULL AND line IS NOT NULL GROUP BY ALL),"
    " q AS (SELECT unnest(list_reduce(es, lambda acc, x: list_append(acc, {'e': x.id, 'a': list_min(list_transform(list_filter(fs, lambda y: abs(y.line - x.line) <= 20 AND NOT list_contains(list_transform(acc, lambda p: p.a), y.id)), lambda y: {'d': abs(y.line - x.line), 'i': y.id})).i}), CAST([] AS STRUCT(e BIGINT, a BIGINT)[]))) AS x FROM n_e JOIN n_a USING (repo, file, type))"
    " SELECT x.e AS expected_id, x.a AS actual_id FROM q WHERE x.a IS NOT NULL"
)
def nearest_matches(spark, d):
    e, a = _sides(spark, d)
    return matching.greedy_match(e, a, KEY, 20, nearest=True)


@query(
    f"WITH {_F}, c AS (SELECT type, count(*) AS n, count(*) FILTER (confidence >= 0.7) AS k FROM f GROUP BY type)"
    " SELECT type, n AS findings, k AS confident, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS low, round(least(1, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM c"
)
def confident_share(spark, d):
    c = findings(spark, d).groupBy("type").agg(F.count("*").alias("findings"), F.count_if(F.col("confidence") >= 0.7).alias("confident"))
    lo, hi = stats.wilson(F.col("confident"), F.col("findings"))
    return c.withColumns({"low": F.round(lo, 6), "high": F.round(hi, 6)})


@query()
def bootstrap_f1(spark, d):
    """Percentile interval of F1 over repositories, 10,000 resamples: per-repository counts joined to drawn units.

    The ends are the values at 0.025 and 0.975 of the sorted list, not interpolated.
    """
    e, a = _sides(spark, d)
    counts = matching.match_counts(e, a, matching.greedy_match(e, a, KEY, 20), ["repo"])
    ranked = ordered.running_total(counts, ["repo"], {"unit": F.lit(1)}).withColumn("unit", F.col("unit").cast("long") - 1)
    n = ranked.count()
    units = F.broadcast(ranked) if n <= 100_000 else ranked
    per = matching.scores(stats.resample_table(spark, n, 10_000, 7).join(units, "unit"), ["iteration"])
    at = lambda q: F.get(F.col("f1"), F.floor(F.lit(q) * F.col("iterations")).cast("int"))
    return per.agg(F.count("*").alias("iterations"), F.array_sort(F.collect_list("f1")).alias("f1")).select("iterations", at(0.025).alias("low"), at(0.975).alias("high"))


@query(
    f"WITH {_F}, v AS (SELECT repo, file, line, type, lower(severity) AS severity, finding_key FROM f WHERE severity IS NOT NULL), c AS (SELECT repo, file, line, type, severity, count(*) AS n, min(finding_key) AS pos FROM v GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (PARTITION BY repo, file, line, type) AS total FROM c WINDOW w AS (PARTITION BY repo, file, line, type ORDER BY n DESC, pos)) SELECT repo, file, line, type, severity, round(n / total, 6) AS agreement FROM r WHERE k = 1"
)
def severity_votes(spark, d):
    v = findings(spark, d).where("severity IS NOT NULL").withColumn("severity", F.lower("severity"))
    return matching.plurality(v, ["repo", "file", "line", "type"], "severity", "finding_key")


@query(f"WITH {_F} SELECT floor(floor(confidence * 1000 + 0.5) / 100) / 10 AS tenth, count(*) AS findings FROM f GROUP BY 1")
def confidence_histogram(spark, d):
    return findings(spark, d).groupBy(matching.tenth(F.col("confidence")).alias("tenth")).agg(F.count("*").alias("findings"))


@query(f"WITH {_F} SELECT type, count(*) AS n FROM f GROUP BY type ORDER BY n DESC, type LIMIT 10")
def top_types(spark, d):
    return reporting.top(findings(spark, d), "type")


@query(f"WITH {_F} SELECT finding_key FROM f WHERE severity = 'critical' AND contains(lower(concat_ws(chr(10), file, type, message)), 'ledger')")
def dashboard_search(spark, d):
    return reporting.search(findings(spark, d), "Ledger", "critical").select("finding_key")


@query(f"WITH {_F} SELECT count(*) AS findings, count(*) FILTER (coalesce(trim(type) <> '', false) AND coalesce(severity IN ('low', 'medium', 'high', 'critical'), false) AND coalesce(trim(file) <> '', false) AND coalesce(line > 0, false) AND coalesce(trim(message) <> '', false) AND coalesce(confidence BETWEEN 0 AND 1, false)) AS valid FROM f")
def valid_findings(spark, d):
    f = findings(spark, d)
    return f.agg(F.count("*").alias("findings"), F.count_if(fd.valid_findings(f)).alias("valid"))


@query(f"WITH {_F} SELECT DISTINCT file FROM f WHERE file IS NOT NULL EXCEPT SELECT file FROM expected_findings")
def files_only_found(spark, d):
    return findings(spark, d).select("file").dropna().distinct().subtract(table(spark, d, "expected_findings").select("file"))


@query(f"WITH {_F} SELECT repo FROM f INTERSECT SELECT repo FROM expected_findings")
def shared_repos(spark, d):
    return findings(spark, d).select("repo").intersect(table(spark, d, "expected_findings").select("repo"))


@query(
    f"WITH {_F} SELECT CASE WHEN file IS NULL THEN NULL ELSE regexp_extract(file, '[^/]*$') END AS file, line, type, severity, round(confidence - 0.1, 6) AS confidence_min, code_snippet AS code_pattern FROM f"
)
def labels_from_report(spark, d):
    return reporting.labels_from_report(findings(spark, d))


@query(
    f"WITH {_SCANS}, b AS (SELECT repo, min(struct_pack(s := (filtering).total_findings, t := scan_duration_seconds)) AS b FROM sc WHERE filtering IS NOT NULL GROUP BY repo)"
    " SELECT scan_id, round((filtering).total_findings / nullif(b.s, 0), 6) AS size_ratio, round(scan_duration_seconds / nullif(b.t, 0), 6) AS time_ratio FROM sc JOIN b USING (repo) WHERE filtering IS NOT NULL"
)
def scan_scaling(spark, d):
    s = scans(spark, d).where("filtering IS NOT NULL").select("scan_id", "repo", F.col("filtering.total_findings").alias("size"), "scan_duration_seconds")
    return reporting.scaling(s, ["repo"], "size", "scan_duration_seconds").select("scan_id", "size_ratio", "time_ratio")


_LINKED = (
    f"RECURSIVE {_CHUNKS}, e AS (SELECT DISTINCT a.file_id AS x, b.file_id AS y FROM ch a JOIN (SELECT id, min(file_id) AS file_id FROM ch GROUP BY id) b USING (id)),"
    " both_ AS (SELECT x, y FROM e UNION SELECT y, x FROM e), w AS (SELECT x AS node, x AS component FROM both_ UNION SELECT both_.y, w.component FROM w JOIN both_ ON both_.x = w.node), r AS (SELECT node, min(component) AS component FROM w GROUP BY node)"
)


@query(
    f"WITH {_LINKED} SELECT count(DISTINCT node) AS files, count(DISTINCT component) AS components FROM r"
)
def linked_file_count(spark, d):
    return _linked(spark, d).agg(F.count("*").alias("files"), F.countDistinct("component").alias("components"))


def _linked(spark, d):
    c = chunks(spark, d).select("id", "file_id")
    first = c.groupBy("id").agg(F.min("file_id").alias("other"))
    return reporting.components(c.join(first, "id"), "file_id", "other")


@query(f"WITH {_LINKED} SELECT node, component FROM r")
def linked_files(spark, d):
    return _linked(spark, d)


@query(
    "WITH r AS (SELECT doc_id, trim(CASE WHEN regexp_extract(text, '(?s)```json\\s*(.*?)```', 1) <> '' THEN regexp_extract(text, '(?s)```json\\s*(.*?)```', 1) WHEN regexp_extract(text, '(?s)```\\s*(.*?)```', 1) <> '' THEN regexp_extract(text, '(?s)```\\s*(.*?)```', 1) ELSE text END) AS t FROM documents WHERE source = 'model_response'),"
    " o AS (SELECT doc_id, nullif(regexp_extract(t, '(?s)\\{.*\\}'), '') AS t FROM r), j AS (SELECT doc_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM o)"
    " SELECT doc_id, coalesce(json_type(j, '$.findings') = 'ARRAY', false) AS parsed, CAST(CASE WHEN json_type(j, '$.findings') = 'ARRAY' THEN json_array_length(j, '$.findings') ELSE 0 END AS INT) AS findings, json_extract_string(j, '$.chunk') AS chunk FROM j"
)
def parsed_replies(spark, d):
    docs = table(spark, d, "documents").where("source = 'model_response'")
    ddl = "findings array<struct<type:string,severity:string,confidence:double,line:int,quote:string,message:string,recommendation:string>>, chunk string"
    body = F.from_json(tx.json_object(tx.fenced(F.col("text"))), ddl)
    return docs.select("doc_id", body["findings"].isNotNull().alias("parsed"), F.size(F.coalesce(body["findings"], F.array())).alias("findings"), body["chunk"].alias("chunk"))


@query()
def redaction_counts(spark, d):
    return redaction.counts(redaction.redact(chunks(spark, d), "chunk_key", "language", "source", "start_line"))


_RULES = " UNION ALL ".join(
    f"SELECT '{k}' AS type, count(*) AS findings FROM l WHERE native = {str(k in analysis.NATIVE_TYPES).lower()} AND regexp_matches(t, '{sign}') HAVING count(*) > 0" for k, sign in analysis.RuleAnalyzer.SIGNS.items()
)


@query(f"WITH {_CHUNKS}, l AS (SELECT coalesce(language IN ('c', 'cpp'), false) AS native, unnest(string_split(source, chr(10))) AS t FROM ch WHERE start_line IS NOT NULL) {_RULES}")
def rule_analysis(spark, d):
    c = chunks(spark, d)
    work = analysis.work_items(c, "chunk_key", "language", per_language=True).join(c.select("chunk_key", tx.numbered(F.col("source"), F.col("start_line")).alias("n")), "chunk_key")
    prompts = work.select(F.struct("chunk_key", "type").alias("item"), F.concat_ws("\n", "type", "n").alias("prompt"))
    out = analysis.analyze(prompts.withColumn("item", F.to_json("item")), "item", "prompt", analysis.RuleAnalyzer)
    return out.select(F.explode("findings").alias("f")).groupBy(F.col("f.type").alias("type")).agg(F.count("*").alias("findings"))


@query(f"WITH {_F} SELECT severity, type, count(*) AS findings FROM f GROUP BY GROUPING SETS ((severity, type), (severity), (type), ())")
def severity_type_cube(spark, d):
    return findings(spark, d).cube("severity", "type").agg(F.count("*").alias("findings"))


def _case(column: str, pairs: dict[str, object]) -> str:
    shown = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, tuple) else f"'{v}'"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {shown(v)}" for k, v in pairs.items()) + " END"


_KINDS = _case("type", {k: next((cs for cs in families.FAMILIES.values() if n in cs), (n,)) for k, n in families.NUMBERS.items()})


@query(f"WITH {_F} SELECT {_case('type', families.NUMBERS)} AS cwe, count(*) AS findings, coalesce(max(len({_KINDS})), 0) AS family FROM f GROUP BY 1")
def weakness_numbers(spark, d):
    f = findings(spark, d).withColumn("cwe", families.number_of(F.col("type")))
    return f.groupBy("cwe").agg(F.count("*").alias("findings"), F.max(F.coalesce(F.array_size(families.family_of(F.col("cwe"))), F.lit(0))).cast("long").alias("family"))


@query(
    f"WITH {_F}, te AS (SELECT repo, file, list({{'id': label_id, 'line': line, 'kinds': {_KINDS}}} ORDER BY label_id) AS ts FROM (SELECT * REPLACE ({_TAIL_CLEAN} AS file) FROM expected_findings) WHERE {_TAIL_KEY} AND {_KINDS} IS NOT NULL GROUP BY ALL),"
    f" ta AS (SELECT repo, file, list({{'id': finding_key, 'line': line, 'kinds': {_KINDS}}} ORDER BY finding_key) AS es FROM (SELECT * REPLACE ({_TAIL_CLEAN} AS file) FROM f) WHERE {_TAIL_KEY} AND {_KINDS} IS NOT NULL GROUP BY ALL),"
    " c AS (SELECT unnest(list_reduce(es, lambda acc, x: list_append(acc, {'f': x.id, 't': list_extract(list_filter(ts, lambda y: abs(y.line - x.line) <= 10 AND list_has_any(y.kinds, x.kinds) AND NOT list_contains(list_transform(acc, lambda p: p.t), y.id)), 1).id}), CAST([] AS STRUCT(f BIGINT, t BIGINT)[]))) AS x FROM te JOIN ta USING (repo, file))"
    " SELECT x.f AS finding_id, x.t AS truth_id FROM c WHERE x.t IS NOT NULL"
)
def family_claims(spark, d):
    e, a = _tail_sides(spark, d)
    kinds = families.family_of(families.number_of(F.col("type")))
    truth = e.where("file <> ''").select("id", "repo", "file", F.col("line").alias("start_line"), F.lit(None).cast("long").alias("end_line"), kinds.alias("kinds"), F.lit(True).alias("vulnerable"))
    return families.claims(a.where("file <> ''"), truth)


@query(
    f"WITH {_F}, r AS (SELECT *, CASE WHEN starts_with(replace(file, '\\', '/'), repo || '/') THEN substr(replace(file, '\\', '/'), length(repo) + 2) ELSE replace(file, '\\', '/') END AS p FROM f WHERE coalesce(confidence, 1) >= 0.5)"
    f" SELECT type AS check_id, regexp_replace(p, '^(\\./)+', '') AS path, line, CASE lower(severity) WHEN 'critical' THEN 'ERROR' WHEN 'high' THEN 'ERROR' WHEN 'medium' THEN 'WARNING' ELSE 'INFO' END AS severity, {_case('type', families.NUMBERS)} AS cwe FROM r WHERE type IN ({', '.join(repr(k) for k in families.NUMBERS)})"
)
def benchmark_rows(spark, d):
    rows, _ = reporting.benchmark_rows(findings(spark, d), F.col("repo"), 0.5)
    return rows.select("check_id", "path", F.col("start.line").alias("line"), F.col("extra.severity").alias("severity"), F.get("extra.metadata.cwe", F.lit(0)).alias("cwe"))


@query(f"WITH {_F} SELECT s.severity, count(f.finding_key) AS findings FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) s LEFT JOIN f ON lower(f.severity) = s.severity GROUP BY s.severity")
def severity_block(spark, d):
    return reporting.severity_block(findings(spark, d), "severity")


@query(
    f"WITH {_SCANS}, c AS (SELECT model_used AS model, CAST(sum((filtering).total_findings) AS BIGINT) AS tokens, round(coalesce(sum(total_cost), 0), 6) AS cost FROM sc GROUP BY 1),"
    " n AS (SELECT model_used AS model, count(*) AS chunks FROM (SELECT * FROM sc WHERE total_cost IS NOT NULL) GROUP BY 1)"
    " SELECT c.model, coalesce(n.chunks, 0) AS chunks, coalesce(c.tokens, 0) AS tokens, c.cost FROM c LEFT JOIN n ON n.model IS NOT DISTINCT FROM c.model"
)
def model_report(spark, d):
    s = scans(spark, d).withColumnRenamed("model_used", "model")
    spent = s.select("model", F.col("filtering.total_findings").cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), F.col("total_cost").alias("cost"))
    return usage.model_report(s.where("total_cost IS NOT NULL"), spent)


@query(f"WITH {_RUN}, w AS (SELECT * FROM b WHERE cost_before >= 0.8 * 20 AND cost_before < 20 ORDER BY scanned_at, scan_id LIMIT 1) SELECT scanned_at, scan_id, cost_before, round(20 - cost_before, 6) AS remaining, round(cost_before / 20 * 100, 6) AS percent FROM w")
def soft_cap(spark, d):
    return usage.soft_cap(scans(spark, d).select("scan_id", "scanned_at", "total_cost"), ["scanned_at", "scan_id"], "total_cost", 20.0)


@query(
    f"WITH {_F}, {_FILES}, j AS (SELECT finding_key, file, f.type, message, line, string_split(content, chr(10)) AS ls FROM f JOIN fl ON f.repo = fl.repo AND f.file = fl.path),"
    " b AS (SELECT *, greatest(line - 15, 1) AS lo, least(line + 15, len(ls)) AS hi FROM j), x AS (SELECT *, array_to_string(list_transform(CASE WHEN hi >= lo THEN ls[lo:hi] ELSE [] END, lambda x, i: CAST(lo + i - 1 AS VARCHAR) || ': ' || x), chr(10)) AS code FROM b)"
    " SELECT finding_key, sha256('Verify: ' || type || ' at line ' || line || chr(10) || 'File: ' || file || chr(10) || 'Code:' || chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10) || 'Note: ' || coalesce(message, '') || chr(10) ||"
    """ 'Does the code shown have this weakness at this line? Count only checks that are shown. Answer with JSON alone: {"applies": true, "confidence": 0.0, "reason": "..."}') AS prompt FROM x"""
)
def verification_prompts(spark, d):
    src = files(spark, d).select("repo", F.col("path").alias("file"), "content")
    j = findings(spark, d).join(src, ["repo", "file"])
    prompt = prompts.verification(F.col("file"), tx.excerpt(F.col("content"), F.col("line")), F.col("type"), F.col("line"), F.col("message"))
    return j.select("finding_key", F.sha2(prompt, 256).alias("prompt"))


def _review_sides(spark, d):
    src = files(spark, d).select(F.concat_ws("/", "repo", "path").alias("file"), "content")
    f = findings(spark, d).where("line IS NOT NULL").select(F.concat_ws("/", "repo", "file").alias("file"), "line", "type", "confidence", "message", F.col("finding_key").alias("ord"))
    return f, src


@query()
def judge_counts(spark, d):
    f, src = _review_sides(spark, d)
    return review.judge_sites(f, src, "file", review.RuleReviewer)[1]


@query()
def verify_counts(spark, d):
    f, src = _review_sides(spark, d)
    return review.verify(f, src, "file", review.RuleReviewer)[1]


@query(
    f"WITH {_PAIRS}, x AS (SELECT id, {_WHOLE} AS file, line, type FROM a WHERE id NOT IN (SELECT actual_id FROM p)), t AS (SELECT id, {_WHOLE} AS file, line, type FROM e WHERE line IS NOT NULL AND type IS NOT NULL),"
    " w AS (SELECT x.id, x.type AS said, arg_min(t.type, t.id) AS truth FROM x JOIN t ON t.file = x.file AND t.type <> x.type AND abs(t.line - x.line) <= 10 GROUP BY ALL) SELECT said, truth, count(*) AS findings FROM w GROUP BY ALL ORDER BY findings DESC, said, truth LIMIT 8"
)
def wrong_type_pairs(spark, d):
    e, a = _sides(spark, d)
    whole = lambda df: df.withColumn("file", F.concat("repo", F.lit("/"), "file"))
    e, a = whole(e).withColumn("vulnerable", F.lit(True)), whole(a)
    kinds = matching.false_positive_kinds(a, e, matching.greedy_match(*_sides(spark, d), KEY, 20))
    return evaluation.wrong_type_pairs(a, e.where("line IS NOT NULL AND type IS NOT NULL"), kinds)


@query()
def replayed_sample(spark, d):
    return evaluation.replayed_sample(findings(spark, d).select("finding_key", "type"), "finding_key", 30)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
