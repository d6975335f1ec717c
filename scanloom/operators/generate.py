"""Texts that a model writes about code: documentation, tests, repairs, and scans of whole files."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import prompts
from scanloom.functions import text as tx
from scanloom.operators import analysis
from scanloom.operators.findings import severity_rank
from scanloom.operators.reporting import patch_name
from scanloom.session import settle

#: Tokens of a whole file up to which it is asked about at once.
WHOLE_FILE_TOKENS = 6000


def _written(rows: DataFrame, prompt: Column, make: Callable[[], analysis.Analyzer]) -> DataFrame:
    """``rows`` with text (what stands in a reply's fence, else the reply) and error."""
    said = settle(analysis.replies(rows.withColumn("__prompt", prompt), "__prompt", make))
    return said.withColumn("text", F.btrim(tx.fenced(F.col("reply")), F.lit(" \t\r\n"))).drop("__prompt", "reply")


def documents(files: DataFrame, make: Callable[[], analysis.Analyzer]) -> DataFrame:
    """(path, text, error): documentation of each file (path, content); null and blank files are not asked about."""
    rows = files.where(F.col("content").rlike(r"\S")).select("path", "content")
    return _written(rows, prompts.documentation(F.col("path"), F.col("content")), make).select("path", "text", "error")


def tests(functions: DataFrame, make: Callable[[], analysis.Analyzer]) -> DataFrame:
    """(path, text, functions, failed): tests of a file's functions (path, language, name, start_line, source) one behind the other.

    A file's functions are gathered as an array in order of their lines; failed ones are counted and left out.
    """
    rows = functions.select("path", "language", "name", "start_line", "source")
    said = _written(rows, prompts.tests(F.col("path"), F.col("name"), F.col("language"), F.col("source")), make)
    good = F.when(F.col("error").isNull(), F.struct("start_line", "name", "text"))
    grouped = said.groupBy("path").agg(F.array_sort(F.collect_list(good)).alias("ts"), F.count("*").alias("functions"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return grouped.select("path", F.array_join(F.transform("ts", lambda t: t["text"]), "\n\n").alias("text"), "functions", "failed")


def repairs(findings: DataFrame, files: DataFrame, make: Callable[[], analysis.Analyzer], least: str = "high") -> DataFrame:
    """(file, line, type, patch_name, patch, error): a unified difference for each finding of severity ``least`` or more.

    ``findings``: file, line, type, severity, message; ``files``: file, content.  A reply equal to the source gives an
    empty patch; findings of unreadable files and unknown severities give nothing.
    """
    rows = findings.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least))).select("file", "line", "type", "message").join(files.select("file", "content"), "file")
    said = _written(rows, prompts.repair(F.col("file"), F.col("type"), F.col("line"), F.col("message"), F.col("content")), make)
    said = said.select("file", "line", "type", patch_name(F.col("file"), F.col("line"), F.col("type")).alias("patch_name"), "error", "content", F.when(F.col("error").isNull(), F.col("text")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            patches = [None if t is None else "".join(difflib.unified_diff((c or "").splitlines(True), (t.rstrip("\n") + "\n").splitlines(True), f"a/{f}", f"b/{f}")) for f, c, t in zip(d["file"], d["content"], d["text"])]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(patches, pa.string()), batch.column(4)], names=["file", "line", "type", "patch_name", "patch", "error"])

    fields = {f.name: f for f in said.schema.fields}
    schema = T.StructType([*[fields[n] for n in ("file", "line", "type", "patch_name")], T.StructField("patch", T.StringType()), T.StructField("error", T.StringType())])
    return said.mapInArrow(work, schema)


def whole_files(files: DataFrame, make: Callable[[], analysis.Analyzer], most: int = WHOLE_FILE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(findings, one row of counts): one question a file (path, language, content), without chunks, retrieval or hints.

    Files over ``most`` tokens are not asked about but counted.  Findings: file, type, severity, confidence, line, message.
    """
    rows = files.where(F.col("content").rlike(r"\S")).select("path", "language", "content", (tx.tokens(F.col("content")) > most).alias("large"))
    asked = rows.where("NOT large").select("path", prompts.whole_file(F.col("path"), F.col("language"), F.col("content")).alias("prompt"))
    said = settle(analysis.analyze(asked, "path", "prompt", make))
    found = said.select(F.col("path").alias("file"), F.explode("findings").alias("f")).select("file", "f.type", "f.severity", "f.confidence", "f.line", "f.message")
    sizes = rows.agg(F.count("*").alias("files"), F.count_if("large").alias("too_large"))
    return found, sizes.crossJoin(F.broadcast(said.agg(F.count_if(~F.col("success")).alias("failed"))))  # one row each
