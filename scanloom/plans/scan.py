"""The main plan: files to functions, functions to questions, replies to findings, findings to a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.config import Settings
from scanloom.functions import prompts
from scanloom.functions import text as tx
from scanloom.operators import analysis, chunking, manifests, ordered, retrieval, review
from scanloom.operators import findings as fd
from scanloom.session import fixed_side, settle

#: Findings up to which one JSON document is written; more are written as lines alone.
DOCUMENT_ROWS = 100_000
_HINTS = "map<string,array<string>>"
_ENTRIES = "array<struct<id:string,title:string,description:string,patterns:array<string>>>"


def chunks_of(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(chunk, path, language, name, start_line, end_line, source), settled: outermost functions, oversized ones in parts.

    ``files``: path, language, content, one row a path.  Without the part ``functions`` every file is cut into windows.
    Path and language travel with the source, so nothing is joined back to it.
    """
    src = files.select(F.struct("path", "language").alias("owner"), F.col("language").alias("lang"), "content")
    if settings.uses("functions"):
        whole = chunking.function_chunks(src, "owner", "lang", "content")
    else:
        whole = chunking.windows(src, "owner", "content").withColumn("function_name", F.concat(F.lit("window_"), F.col("part").cast("string")))
    parts = chunking.split_chunks(whole.withColumn("key", F.struct("owner", "function_name", "start_line")), "key", "source", "start_line", "function_name", settings.max_tokens)
    rows = parts.select(F.col("key.owner.path").alias("path"), F.col("key.owner.language").alias("language"), "name", "start_line", "end_line", "source")
    return settle(rows.withColumn("chunk", F.to_json(F.struct("path", "start_line", "end_line", "name"))))


def passages(chunks: DataFrame, knowledge: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(chunk, entries): the three entries of a knowledge base that fit a chunk best, cut to the text budget.

    ``knowledge``: id, title, description, code_patterns.  Equal questions are answered once; ``index`` is its posting
    table, built here if it is not given.
    """
    if index is None:
        index = retrieval.postings(knowledge, "id", F.concat_ws(" ", "title", "description", F.array_join("code_patterns", " ")))
    top = retrieval.top_k(chunks, "chunk", retrieval.query_text(F.col("name"), F.col("language"), F.col("source")), index)
    entry = F.struct("rank", "id", "title", "description", F.col("code_patterns").alias("patterns"))
    got = top.join(fixed_side(knowledge, 10_000), F.col("kb") == F.col("id")).groupBy("chunk").agg(F.array_sort(F.collect_list(entry)).alias("es"))  # at most 3 a chunk
    return got.select("chunk", retrieval.within_budget(F.transform("es", lambda e: F.struct(*[e[k].alias(k) for k in ("id", "title", "description", "patterns")]))).alias("entries"))


def questions(chunks: DataFrame, settings: Settings = Settings(), knowledge: DataFrame | None = None, frameworks: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """(item, prompt): a question for each chunk and kind of its language.

    What belongs to a chunk (entries, hints) is gathered beside it and joined once; the kinds are exploded inside the
    row, so no source is shuffled for a kind.
    """
    rows = chunks
    if frameworks is not None and settings.uses("frameworks"):
        rows = analysis.with_frameworks(rows, frameworks, "language")
    else:
        rows = rows.withColumn("frameworks", F.array().cast("array<string>"))
    beside = None
    if knowledge is not None and settings.uses("retrieval"):
        beside = passages(chunks, knowledge)
    if hints is not None and frameworks is not None and settings.uses("frameworks"):
        per_kind = analysis.hints(rows.select("chunk", "frameworks"), hints, "chunk").groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("type", "hints"))).alias("hints"))  # kinds are few
        beside = per_kind if beside is None else beside.join(per_kind, "chunk", "full_outer")
    if beside is not None:
        rows = rows.join(beside, "chunk", "left")
    for name, kind in (("entries", _ENTRIES), ("hints", _HINTS)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    kinds = F.when(F.coalesce(F.col("language").isin("c", "cpp"), F.lit(False)), F.array(*map(F.lit, analysis.NATIVE_TYPES))).otherwise(F.array(*map(F.lit, analysis.WEB_TYPES)))
    rows = rows.withColumn("type", F.explode(kinds))
    item = F.to_json(F.struct("path", "name", "start_line", "end_line", F.sha2("source", 256).alias("chunk_id"), "type"))
    prompt = prompts.analysis(F.col("type"), F.col("path"), F.col("name"), F.col("source"), F.col("start_line"), F.col("end_line"), F.col("frameworks"), F.col("entries"), F.col("hints")[F.col("type")])
    return rows.select(item.alias("item"), prompt.alias("prompt"))


def raw_findings(asked: DataFrame, make: Callable[[], analysis.Analyzer]) -> tuple[DataFrame, DataFrame]:
    """(findings with file, function_name, chunk_id and their place in the scan's order ``ord``; one row of call counts).

    The calls run once and are settled, because they may cost and differ; they are counted before their findings are
    taken apart.
    """
    replies = settle(analysis.analyze(asked, "item", "prompt", make))
    ddl = "path string, name string, start_line int, end_line int, chunk_id string, type string"
    rows = replies.where("success").select(F.from_json("item", ddl).alias("i"), F.posexplode("findings").alias("p", "f"))
    rows = rows.select(
        F.col("i.path").alias("file"), F.col("i.name").alias("function_name"), "i.chunk_id", "i.start_line", "i.end_line", F.col("i.type").alias("asked"), "p", "f.type", "f.severity", "f.confidence",
        tx.absolute_line(F.col("f.line"), F.col("i.start_line"), F.col("i.end_line")).alias("line"), "f.quote", "f.message", "f.recommendation",
    )
    placed = ordered.running_total(rows, ["file", "start_line", "end_line", "function_name", "asked", "p"], {"ord": F.lit(1)}).withColumn("ord", F.col("ord").cast("long"))
    calls = replies.agg(F.count("*").alias("attempted_calls"), F.count_if(~F.col("success")).alias("failed_calls"))
    return placed.drop("start_line", "end_line", "asked", "p"), calls


def refine(raw: DataFrame, files: DataFrame, settings: Settings = Settings(), reviewer: Callable[[], analysis.Analyzer] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, one row of counts): folding, snapping to quotes, one per place and type, judge, verification, confidence filter, suppression, in this order.

    Without a ``reviewer`` nothing is judged or verified.
    """
    kept = ordered.near_line_fold(raw, ["file", "type"], "line", "confidence", "ord", settings.within).select("ord")
    src = files.select(F.col("path").alias("file"), "language", "content")
    snapped = settle(fd.snap_to_quotes(raw.join(kept, "ord", "left_semi"), src.select("file", "content"), "file", "line", "quote", "content", settings.max_distance))
    outcomes = ("without_quote", "file_unreadable", "quote_not_found", "confirmed", "snapped", "too_far")
    moved = snapped.withColumn("reported_line", F.when(F.col("outcome") == "snapped", F.col("line"))).withColumn("line", F.col("snapped_line").cast("int")).drop("snapped_line", "outcome")
    best = settle(fd.best_of_key(moved, ["file", "type", "line"], "confidence", "ord").drop("position"))
    snap = snapped.agg(F.lit(settings.max_distance).alias("max_distance"), F.count("*").alias("total_findings"), *[F.count_if(F.col("outcome") == k).alias(k) for k in outcomes]).crossJoin(F.broadcast(best.agg(F.count("*").alias("kept_findings"))))
    stats = {"line_snap": snap.withColumn("duplicates_removed", F.col("total_findings") - F.col("kept_findings"))}
    if reviewer is not None and settings.uses("judge"):
        best, stats["judge"] = review.judge_sites(best, src.select("file", "content"), "file", reviewer)
    if reviewer is not None and settings.uses("verify"):
        best, stats["verify"] = review.verify(best, src.select("file", "content"), "file", reviewer)
    strong, stats["filtering"] = fd.confidence_filter(best, "confidence", settings.threshold)
    strong = settle(strong)
    out = settle(fd.drop_suppressed(strong, fd.suppressions(src, "file", "language", "content"), ["file"], "line", "type"))
    stats["suppression"] = strong.agg(F.count("*").alias("total_findings")).crossJoin(F.broadcast(out.agg(F.count("*").alias("kept_findings")))).withColumn("suppressed_findings", F.col("total_findings") - F.col("kept_findings"))
    row = None
    for name, one in stats.items():  # one row each
        one = one.select(F.struct("*").alias(name))
        row = one if row is None else row.crossJoin(F.broadcast(one))
    found = out.select(tx.finding_id(F.col("chunk_id"), F.col("type"), F.col("line")).alias("id"), "type", "severity", "confidence", "file", "line", "function_name", "message", "recommendation", "quote", "reported_line")
    return found, row


def scan(
    files: DataFrame, make: Callable[[], analysis.Analyzer] = analysis.RuleAnalyzer, threshold: float = 0.5, settings: Settings | None = None, reviewer: Callable[[], analysis.Analyzer] | None = None,
    knowledge: DataFrame | None = None, manifest_files: DataFrame | None = None, hints: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, one row of counts): the whole plan over files (path, language, content).

    ``knowledge``: entries to retrieve; ``manifest_files`` (path, content): where frameworks are named; ``hints``:
    framework, type, hint.  The row has attempted_calls, failed_calls, and a struct for each step.
    """
    settings = settings or Settings(threshold=threshold)
    frameworks = None if manifest_files is None else manifests.project_context(manifests.detect(manifest_files, "path", "content"))
    raw, calls = raw_findings(questions(chunks_of(files, settings), settings, knowledge, frameworks, hints), make)
    found, row = refine(raw, files, settings, reviewer)
    return found, calls.crossJoin(F.broadcast(row))
