"""Findings after the analysis: snapping to quotes, sites, filters, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.text import normalize_line
from scanloom.operators.ordered import islands

SEVERITIES = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    """1 for low to 4 for critical, null for others; case does not matter."""
    return F.create_map(*[F.lit(x) for k, s in enumerate(SEVERITIES, 1) for x in (s, k)])[F.lower(F.trim(severity))]


def snap_to_quotes(findings: DataFrame, files: DataFrame, file_key: str, line: str, quote: str, text: str, max_distance: int = 40) -> DataFrame:
    """``findings`` with snapped_line, and outcome: confirmed, snapped, too_far, quote_not_found, file_unreadable or without_quote.

    A quote equals a line after normalization, or, from 12 bytes on, one contains the other (the line then has 12 too).
    The nearest such line wins, the lower one of two.  ``files`` has one row a file.  Candidates are found inside the
    row of the join; lines and findings are never multiplied.
    """
    q = normalize_line(F.col(quote))
    blank = F.coalesce(q == "", F.lit(True))
    src = files.select(file_key, F.transform(F.split(F.col(text), "\n"), lambda x: normalize_line(x)).alias("__lines"))
    rows = findings.withColumn("__q", q).join(src, file_key, "left")
    at = F.transform("__lines", lambda x, i: F.struct(x.alias("t"), (i + 1).alias("n")))
    exact = F.filter(at, lambda p: p["t"] == F.col("__q"))
    long_q = F.octet_length("__q") >= 12
    part = F.filter(at, lambda p: p["t"].contains(F.col("__q")) | ((F.octet_length(p["t"]) >= 12) & F.col("__q").contains(p["t"])))
    rows = rows.withColumn("__hits", F.when(blank | F.col("__lines").isNull(), F.lit(None)).otherwise(F.when(F.size(exact) > 0, exact).when(long_q, part).otherwise(F.filter(at, lambda p: F.lit(False)))))
    best = F.array_min(F.transform("__hits", lambda p: F.struct(F.abs(p["n"] - F.col(line)).alias("d"), p["n"].alias("n"))))
    rows = rows.withColumn("__best", best)
    outcome = (
        F.when(blank, "without_quote").when(F.col("__lines").isNull(), "file_unreadable").when(F.col("__best").isNull(), "quote_not_found")
        .when(F.col("__best.d") == 0, "confirmed").when(F.col("__best.d") <= max_distance, "snapped").otherwise("too_far")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("snapped_line", F.when(F.col("outcome") == "snapped", F.col("__best.n")).otherwise(F.col(line))).drop("__q", "__lines", "__hits", "__best")


def best_of_key(df: DataFrame, key: list[str], confidence: str, order: str) -> DataFrame:
    """One row a key: strictly highest confidence, earliest order on ties; ``position`` is the first order of the key."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(confidence, F.lit(-1.0)), -F.col(order)))
    return df.groupBy(*key).agg(best.alias("x"), F.min(order).alias("position")).select(*key, "x.*", "position")


def sites(df: DataFrame, key: list[str], line: str, gap: int = 3) -> DataFrame:
    """(key, site, site_lines, findings, center): groups of lines at most ``gap`` from the one before; center rounds half up."""
    per_line = df.dropna(subset=[*key, line]).groupBy(*key, line).agg(F.count("*").alias("n"))
    cut = islands(per_line, key, line, gap, "site").groupBy(*key, "site")
    total, n = F.sum(F.col(line).cast("long") * F.col("n")), F.sum("n")
    return cut.agg(F.count("*").alias("site_lines"), n.alias("findings"), F.floor((total + F.floor(n / 2)) / n).cast("long").alias("center"))


def with_sites(df: DataFrame, key: list[str], line: str, gap: int = 3) -> DataFrame:
    """``df`` with the first line of each row's site; the site is found over distinct lines and joined back."""
    per_line = df.dropna(subset=[*key, line]).select(*key, line).distinct()
    return df.join(islands(per_line, key, line, gap, "site"), [*key, line])


def confidence_filter(df: DataFrame, confidence: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of counts); threshold 0 keeps all and counts as switched off."""
    keep = F.lit(True) if threshold == 0 else F.coalesce(F.col(confidence) >= threshold, F.lit(False))
    stats = df.agg(F.lit(threshold > 0).alias("enabled"), F.lit(threshold).alias("threshold_used"), F.count("*").alias("total_findings"), F.count_if(~keep).alias("filtered_findings"), F.count_if(keep).alias("kept_findings"))
    return df.where(keep), stats


def suppressions(df: DataFrame, id_col: str, language_col: str, text_col: str, marker: str = "[a-z][a-z0-9_]*:ignore") -> DataFrame:
    """(id, line, type, justification, applies_to, source_line): directives in whole-line comments.

    ``marker`` (a pattern: any tool's name and :ignore) speaks for its own line, with -next-line behind it for the next;
    a directive without a type is for all.
    Only lines that begin with // (Python: #) count; C and C++ have none.
    """
    ls = F.posexplode(F.split(F.col(text_col), "\n")).alias("i", "raw")
    rows = df.select(id_col, F.col(language_col).alias("lang"), ls).withColumn("t", F.regexp_replace("raw", r"^[ \t\r\f]+|[ \t\r\f]+$", ""))
    rows = rows.where((F.col("lang").isin("javascript", "typescript", "java") & F.col("t").startswith("//")) | ((F.col("lang") == "python") & F.col("t").startswith("#")))
    tail = r"(?:[ \t]+([a-z_]+))?(?:[ \t]*-[ \t]*(.+))?"
    nxt, same = f"(?:^|[^a-zA-Z0-9_]){marker}-next-line{tail}", f"(?:^|[^a-zA-Z0-9_]){marker}{tail}"
    is_next = F.col("t").rlike(nxt)
    rows = rows.where(is_next | F.col("t").rlike(same)).withColumn("nx", is_next)
    pick = lambda g: F.when(F.col("nx"), F.regexp_extract("t", nxt, g)).otherwise(F.regexp_extract("t", same, g))
    kind, why = pick(1), F.trim(pick(2))
    n = (F.col("i") + 1).cast("int")
    return rows.select(
        id_col, F.when(F.col("nx"), n + 1).otherwise(n).alias("line"), F.when(kind == "", "all").otherwise(kind).alias("type"), F.when(why != "", why).alias("justification"),
        F.when(F.col("nx"), "next").otherwise("same").alias("applies_to"), n.alias("source_line"),
    )


def drop_suppressed(findings: DataFrame, directives: DataFrame, key: list[str], line: str, kind: str) -> DataFrame:
    """Findings without those on a directive's line whose type it names or which it silences altogether.

    ``directives`` has the key, line and type; a key of function names alone is the lenient reading, file and function
    the strict one.  An anti join on key and line with the type as a residual condition.
    """
    d = directives.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("line").alias("__line"), F.col("type").alias("__type")).distinct()
    on = (F.col(line) == F.col("__line")) & ((F.col("__type") == "all") | (F.col("__type") == F.col(kind)))
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return findings.join(d, on, "left_anti")


def valid_findings(df: DataFrame) -> Column:
    """Whether a row can stand in a report: type, known severity, file, positive line, message, confidence in 0 to 1."""
    full = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return full("type") & F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)) & full("file") & F.coalesce(F.col("line") > 0, F.lit(False)) & full("message") & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))


def contested_sites(df: DataFrame, key: list[str], line: str, kind: str, confidence: str, order: str, gap: int = 3) -> DataFrame:
    """(key, site, types, best): sites with two types or more, with the best finding of each type.

    What a judge is asked about; a site's types are bounded by the types there are.
    """
    best = best_of_key(with_sites(df, key, line, gap).select(*key, "site", line, kind, confidence, order), [*key, "site", kind], confidence, order)
    out = best.groupBy(*key, "site").agg(F.count("*").alias("types"), F.array_sort(F.collect_list(F.struct(F.col(kind).alias("type"), F.col(confidence).alias("confidence"), F.col(line).alias("line"), F.col(order).alias("order")))).alias("best"))
    return out.where("types >= 2")


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
