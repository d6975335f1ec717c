"""Summaries, report rows, dashboards, and writing sources with notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(findings: DataFrame, severity: str, kind: str) -> DataFrame:
    """(facet, value, findings): counts by severity, by type and in all, in one pass by grouping sets."""
    rows = findings.select(F.explode(F.array(F.struct(F.lit("severity").alias("facet"), F.col(severity).alias("value")), F.struct(F.lit("type").alias("facet"), F.col(kind).alias("value")), F.struct(F.lit("total").alias("facet"), F.lit("all").alias("value")))).alias("x"))
    return rows.select("x.*").groupBy("facet", "value").agg(F.count("*").alias("findings"))


def severity_block(findings: DataFrame, severity: str) -> DataFrame:
    """(severity, findings) of the four severities from critical to low, those that nothing has with 0; others aren't counted."""
    n = findings.groupBy(F.lower(F.col(severity)).alias("severity")).agg(F.count("*").alias("findings"))
    order = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(s).alias("severity")) for k, s in enumerate(("critical", "high", "medium", "low"))])
    four = findings.sparkSession.range(1).select(F.explode(order).alias("x")).select("x.*")
    return four.join(n, "severity", "left").select("at", "severity", F.coalesce("findings", F.lit(0)).alias("findings")).orderBy("at").drop("at")


def top(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(column, n): the k most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def search(findings: DataFrame, text: str, severity: str | None = None) -> DataFrame:
    """Findings whose file, type or message contains a text, in any case, and of one severity if it is given."""
    hay = F.lower(F.concat_ws("\n", "file", "type", "message"))
    hit = hay.contains(text.lower())
    return findings.where(hit & (F.col("severity") == severity) if severity else hit)


def benchmark_rows(findings: DataFrame, target: Column, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(result rows with cwe, (type, findings) skipped): findings of a benchmark run; types without a number are skipped and counted.

    Paths are made relative to ``target``; severities become ERROR, WARNING and INFO; findings below ``least`` confidence are dropped.
    """
    from scanloom.functions.paths import lookup, relative
    from scanloom.operators.families import with_numbers

    known, skipped = with_numbers(findings.where(F.coalesce(F.col("confidence"), F.lit(1.0)) >= least), "type")
    level = F.coalesce(lookup({"critical": "ERROR", "high": "ERROR", "medium": "WARNING", "low": "INFO"}, F.lower("severity")), F.lit("INFO"))
    at = F.struct("line", F.lit(1).alias("col"))
    extra = F.struct("message", level.alias("severity"), F.struct(F.array("cwe").alias("cwe"), "confidence").alias("metadata"))
    return known.select(F.col("type").alias("check_id"), relative(F.col("file"), target).alias("path"), at.alias("start"), at.alias("end"), extra.alias("extra")), skipped


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings as an external scanner's result rows: check_id, path, start, end, extra; invalid ones are dropped."""
    from scanloom.operators.findings import valid_findings

    at = F.struct(F.col("line").alias("line"), F.coalesce("col_number", F.lit(1)).alias("col"))
    extra = F.struct("message", F.upper("severity").alias("severity"), F.struct("confidence", F.col("type").alias("kind"), F.col("function_name").alias("function")).alias("metadata"))
    return findings.where(valid_findings(findings)).select(F.col("type").alias("check_id"), F.col("file").alias("path"), at.alias("start"), at.alias("end"), extra.alias("extra"))


def labels_from_report(findings: DataFrame) -> DataFrame:
    """(file, line, type, severity, confidence_min, code_pattern): a report's rows as labels, with base names and 0.1 less confidence."""
    return findings.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line", "type", "severity", F.round(F.col("confidence") - 0.1, 6).alias("confidence_min"), F.col("code_snippet").alias("code_pattern"))


def annotated(files: DataFrame, notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source): files with notes (key, line, note) put before their lines; line numbers of the file hold throughout.

    Notes of a file are gathered as an array; a line's notes stand in order of their text.
    """
    n = notes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "note"))).alias("ns"))
    j = files.select(key, text).join(n, key, "left")
    ls = F.split(F.col(text), "\n")
    out = F.flatten(F.transform(ls, lambda x, i: F.concat(F.transform(F.filter(F.coalesce("ns", F.array().cast("array<struct<line:int,note:string>>")), lambda m: m["line"] == i + 1), lambda m: m["note"]), F.array(x))))
    return j.select(key, F.array_join(out, "\n").alias("source"))


def patch_name(file: Column, line: Column, kind: Column) -> Column:
    """File name of a patch: the path without separators, line and type."""
    return F.concat(F.regexp_replace(file, r"[/.\\]", "_"), F.lit("_"), line.cast("string"), F.lit("_"), kind, F.lit(".patch"))


def scaling(runs: DataFrame, group: list[str], size: str, seconds: str) -> DataFrame:
    """``runs`` with the ratios of size and time to the smallest run of the group (lowest time on ties)."""
    base = runs.groupBy(*group).agg(F.min(F.struct(F.col(size).alias("s"), F.col(seconds).alias("t"))).alias("b"))
    out = runs.join(base, group)
    return out.withColumns({"size_ratio": F.round(F.col(size) / F.nullif(F.col("b.s"), F.lit(0)), 6), "time_ratio": F.round(F.col(seconds) / F.nullif(F.col("b.t"), F.lit(0)), 6)}).drop("b")


def components(edges: DataFrame, a: str, b: str, rounds: int = 1_000) -> DataFrame:
    """(node, component): connected components, named by their smallest node.

    Each round takes the smallest label around and that label's own label, until nothing changes; it combines before the shuffle and is
    settled, so neither nodes nor links reach the driver.  Nulls link nothing.
    """
    from scanloom.session import release, settle

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = e.select("u").union(e.select("v")).distinct()
    label = settle(nodes.select(F.col("u").alias("node"), F.col("u").alias("component")))
    both = settle(e.union(e.select("v", "u")).distinct())
    for _ in range(rounds):
        near = both.join(label, both["u"] == label["node"]).groupBy("v").agg(F.min("component").alias("m"))
        nxt = label.join(near, label["node"] == near["v"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        jump = nxt.select(F.col("node").alias("component"), F.col("component").alias("further"))
        # a large component is one hot key, so its nodes meet its label in parts
        parts = F.lit(32)
        nxt = nxt.withColumn("part", F.pmod(F.xxhash64("node"), parts))
        jump = jump.join(nxt.select("component").distinct(), "component", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
        nxt = settle(nxt.join(jump, ["component", "part"], "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        release(label)
        if nxt.where("component <> was").limit(1).count() == 0:
            release(both)
            return nxt.select("node", "component")
        label = nxt.drop("was")
        label._settled = nxt._settled
    raise RuntimeError("components did not settle")
