"""Command line: scan a source tree, write documentation, tests and repairs, check a knowledge base, keep a cache."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scanloom import config
from scanloom.operators import analysis, cache, chunking, generate, manifests
from scanloom.operators.review import RuleReviewer
from scanloom.plans.scan import DOCUMENT_ROWS, scan
from scanloom.session import ship
from scanloom.sources import readers, writers

VERSION = "0.2"


def run_scan(spark: SparkSession, root: str, out: str, languages: tuple[str, ...] = (), threshold: float = 0.5, settings: config.Settings | None = None, knowledge: str | None = None, review: bool = False, model: str = "rules") -> int:
    """Findings of a tree as JSON lines below ``out``, and a report document; the number of findings.

    The document has scan_metadata and summary at every size, its list of findings up to DOCUMENT_ROWS.
    """
    began = datetime.now(timezone.utc)
    settings = (settings or config.Settings(threshold=threshold)).checked()
    ignore_file = os.path.join(root, ".scanignore")
    ignore = readers.ignore_patterns(open(ignore_file, encoding="utf-8").read()) if os.path.exists(ignore_file) else ()
    files = readers.source_tree(spark, root, languages, ignore)
    entries = readers.knowledge_base(spark, knowledge) if knowledge else None
    named = readers.manifest_files(spark, root, ignore)
    found, calls = scan(files, settings=settings, knowledge=entries, manifest_files=named, reviewer=RuleReviewer if review else None)
    writers.write_findings(found, os.path.join(out, "findings"))
    n = found.count()
    count = lambda k: {r[k]: r["n"] for r in found.groupBy(k).agg(F.count("*").alias("n")).collect()}
    steps = calls.first().asDict(recursive=True)
    meta = {"timestamp": began.isoformat(), "target_path": root, "model_used": model, "total_cost": 0.0, "languages": sorted(r[0] for r in files.select("language").distinct().collect()), "frameworks": sorted(r[0] for r in manifests.detect(named, "path", "content").select("framework").distinct().collect())}
    meta["analysis"] = {k: steps.pop(k) for k in ("attempted_calls", "failed_calls")}
    meta |= steps | {"scan_duration_seconds": int((datetime.now(timezone.utc) - began).total_seconds())}
    doc: dict = {"scan_metadata": meta}
    if n <= DOCUMENT_ROWS:
        doc["findings"] = [r.asDict() for r in found.orderBy("file", "line", "type").collect()]
    else:
        doc["findings_directory"] = "findings"
    doc["summary"] = {"total_findings": n, "by_severity": count("severity"), "by_type": count("type")}
    writers.write_report(doc, out)
    return n


def main(argv: list[str] | None = None, make=analysis.RuleAnalyzer) -> int:
    p = argparse.ArgumentParser(prog="scanloom")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan a source tree")
    s.add_argument("root")
    s.add_argument("--out", default="reports")
    s.add_argument("--languages", default=",".join(config.LANGUAGES), help="comma-separated")
    s.add_argument("--threshold", type=float, default=0.5)
    s.add_argument("--knowledge", help="folder of a knowledge base")
    s.add_argument("--review", action="store_true", help="judge contested places and verify findings")
    s.add_argument("--without", default="", help=f"parts to switch off: {', '.join(config.PARTS)}")
    for name, text in (("doc", "write documentation"), ("testgen", "write tests")):
        s = sub.add_parser(name, help=f"{text} of a source tree's files")
        s.add_argument("root")
        s.add_argument("--out", default=name)
    s = sub.add_parser("fix", help="write patches for a report's findings")
    s.add_argument("root")
    s.add_argument("report")
    s.add_argument("--out", default="patches")
    s.add_argument("--least", default="high", choices=("low", "medium", "high", "critical"))
    k = sub.add_parser("kb", help="check a knowledge base")
    k.add_argument("directory")
    c = sub.add_parser("cache", help="keep a table of responses")
    c.add_argument("action", choices=("stats", "clean", "clear"))
    c.add_argument("path")
    a = p.parse_args(argv)
    try:
        languages = config.wanted_languages(a.languages) if a.command == "scan" else ()
        settings = config.ablated(config.Settings(languages=languages, root=a.root, out=a.out, threshold=a.threshold), a.without).checked() if a.command == "scan" else None
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("scanloom").getOrCreate()
    ship(spark)
    if a.command == "scan":
        print(run_scan(spark, a.root, a.out, settings.names(), settings=settings, knowledge=a.knowledge, review=a.review), "findings")
    elif a.command == "kb":
        print(readers.knowledge_base(spark, a.directory).count(), "entries")
    elif a.command == "doc":
        print(writers.write_texts(generate.documents(readers.source_tree(spark, a.root), make).withColumn("name", F.concat(F.translate("path", "/", "_"), F.lit(".md"))), "name", "text", a.out), "files")
    elif a.command == "testgen":
        src = readers.source_tree(spark, a.root).where("NOT is_test")
        owner = chunking.function_chunks(src.select(F.struct("path", "language").alias("owner"), "language", "content"), "owner", "language", "content")
        made = generate.tests(owner.select("owner.path", "owner.language", F.col("function_name").alias("name"), "start_line", "source"), make)
        print(writers.write_texts(made.withColumn("name", F.concat(F.lit("test_"), F.translate("path", "/", "_"))), "name", "text", a.out), "files")
    elif a.command == "fix":
        found = readers.report_findings(readers.reports(spark, a.report)).select("file", "line", "type", "severity", "message")
        src = readers.source_tree(spark, a.root).select(F.col("path").alias("file"), "content")
        print(writers.write_texts(generate.repairs(found, src, make, a.least), "patch_name", "patch", a.out), "patches")
    elif a.action == "clear":
        cache.clear(spark, a.path)
    elif a.action == "clean":
        print(cache.clean(spark, a.path, F.current_timestamp()), "entries dropped")
    else:
        print(cache.statistics(cache.load(spark, a.path), F.current_timestamp()).first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
