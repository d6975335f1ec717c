"""Readers: source trees, labels, reports and the results of other tools.  All schemas are explicit."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import paths

LABEL = "file string, line int, type string, severity string, confidence_min double, pattern string, description string, code_pattern string, owasp string, bandit_detected boolean, bandit_rule string"
FINDING = "id string, type string, severity string, confidence double, file string, line int, column int, function_name string, message string, recommendation string, code_snippet string, quote string, reported_line int"


def _struct(ddl: str) -> str:
    return "struct<" + ",".join(":".join(x.strip().split(" ", 1)) for x in ddl.split(",")) + ">"


LABELS = f"description string, scan_metadata struct<target_path:string,total_expected_findings:int>, expected_findings array<{_struct(LABEL)}>"
REPORT = (
    "scan_metadata struct<timestamp:string,target_path:string,languages:array<string>,frameworks:array<string>,model_used:string,total_cost:double,scan_duration_seconds:int>,"
    f" findings array<{_struct(FINDING)}>, summary struct<total_findings:int,by_severity:map<string,int>,by_type:map<string,int>>"
)
SARIF = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"


def source_tree(spark: SparkSession, root: str, languages: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, is_test, content) of the source files below ``root``; excluded and other files are never decoded.

    The filters stand on the path, which Spark evaluates before it decodes a file's bytes.  Bytes that are no UTF-8
    become U+FFFD.  Symbolic links are followed as the file system does.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit("file:" + os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root), "^file:/+", "/")
    path = paths.relative(F.regexp_replace("path", "^file:/+", "/"), base)
    rows = raw.select(path.alias("path"), "content")
    rows = rows.where(~paths.excluded(F.col("path"), ignore)).withColumn("language", paths.language(F.col("path")))
    rows = rows.where(F.col("language").isin(*languages) if languages else F.col("language").isNotNull())
    return rows.select("path", "language", paths.is_test(F.col("path")).alias("is_test"), F.decode("content", "UTF-8").alias("content"))


def manifest_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the files below ``root`` that name a project's dependencies; other files are never decoded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit("file:" + os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root), "^file:/+", "/")
    rows = raw.select(paths.relative(F.regexp_replace("path", "^file:/+", "/"), base).alias("path"), "content")
    named = paths.base_name(F.col("path")).isin("package.json", "requirements.txt", "setup.py", "pom.xml", "build.gradle")
    return rows.where(named & ~paths.excluded(F.col("path"), ignore)).select("path", F.decode("content", "UTF-8").alias("content"))


def ignore_patterns(text: str) -> tuple[str, ...]:
    """Patterns of an ignore file: trimmed, without blank lines and comments."""
    return tuple(x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#"))


def knowledge_base(spark: SparkSession, directory: str) -> DataFrame:
    """(id, title, description, code_patterns, schema_version) of a folder's YAML files; the first bad or repeated entry fails the load.

    A knowledge base is written by hand and read on the driver.  Needs PyYAML.
    """
    rows, seen = [], set()
    for name in sorted(os.listdir(directory)):
        if not name.endswith((".yaml", ".yml")):
            continue
        row = entry_file(os.path.join(directory, name))
        if row[0] in seen:
            raise ValueError(f"{name}: id {row[0]} comes twice")
        seen.add(row[0])
        rows.append(row)
    return spark.createDataFrame(rows, "id string, title string, description string, code_patterns array<string>, schema_version int")


def entry_file(path: str) -> tuple[str, str, str, list[str], int]:
    """(id, title, description, code_patterns, schema_version) of one YAML file; raises ValueError for a bad one."""
    import yaml

    with open(path, encoding="utf-8") as f:
        e = yaml.safe_load(f) or {}
    if problems := entry_problems(e):
        raise ValueError(f"{os.path.basename(path)}: {'; '.join(problems)}")
    return e["id"], e["title"], e["description"], list(e["code_patterns"]), int(e.get("schema_version") or 1)


def kept_postings(spark: SparkSession, entries: DataFrame, folder: str) -> DataFrame:
    """The posting table of a knowledge base, kept below ``folder`` under the digest of its texts; built anew only where that has changed."""
    from scanloom.operators.retrieval import postings

    text = F.concat_ws(" ", "title", "description", F.array_join("code_patterns", " "))
    digest = corpus_hash(entries.withColumn("__text", text), "id", "__text").first()[0]
    path = f"{folder.rstrip('/')}/postings-{digest}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        postings(entries, "id", text).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report_path(directory: str, name: str) -> str:
    """The path of a report in a folder; other names than scan-*.json and ways out of the folder are refused."""
    path = os.path.realpath(os.path.join(directory, name))
    if not re.fullmatch(r"scan-[\w.-]+\.json", name) or os.path.dirname(path) != os.path.realpath(directory):
        raise ValueError(f"no report: {name}")
    return path


def entry_problems(e: dict) -> list[str]:
    """What is wrong with a knowledge-base entry."""
    out = []
    if not re.fullmatch(r"[a-z0-9-]+", str(e.get("id") or "")):
        out.append("id must be lower-case letters, digits and -")
    out += [f"{k} is blank" for k in ("title", "description") if not str(e.get(k) or "").strip()]
    if not e.get("code_patterns") or not all(str(p).strip() for p in e["code_patterns"]):
        out.append("code_patterns must have entries, none blank")
    return out


def labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Ground-truth labels of JSON documents, one row each.  ``strict`` keeps documents whose declared number is wrong or missing out."""
    docs = spark.read.schema(LABELS).option("multiLine", True).json(path)
    if strict:
        docs = docs.where("size(expected_findings) > 0 AND scan_metadata.total_expected_findings = size(expected_findings)")
    return docs.select(F.explode("expected_findings").alias("e")).select("e.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Scan reports, one row a document, newest file name first; a folder is read by its scan-*.json."""
    where = path if path.endswith(".json") else f"{path.rstrip('/')}/scan-*.json"
    docs = spark.read.schema(REPORT).option("multiLine", True).json(where)
    return docs.select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("report")).orderBy(F.desc("report"))


def report_findings(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """Findings of reports, one row each, of one type if it is given; null arrays count as empty."""
    rows = docs.select("report", F.explode("findings").alias("f")).select("report", "f.*")
    return rows.where(F.col("type") == kind) if kind else rows


def report_history(docs: DataFrame) -> DataFrame:
    """(report, target, seconds, findings, files, cost) of reports that took time."""
    rows = docs.where("scan_metadata.scan_duration_seconds > 0")
    return rows.select("report", F.col("scan_metadata.target_path").alias("target"), F.col("scan_metadata.scan_duration_seconds").alias("seconds"), F.size(F.coalesce("findings", F.array())).alias("findings"), F.size(F.array_distinct(F.coalesce("findings.file", F.array().cast("array<string>")))).alias("files"), F.col("scan_metadata.total_cost").alias("cost"))


def labelled_functions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(idx, code, vulnerable) of JSON lines with func or code and target or label, ``limit`` of them if given; broken lines are dropped."""
    raw = spark.read.schema("idx long, func string, code string, target int, label int").option("mode", "DROPMALFORMED").json(path)
    return raw.select("idx", F.coalesce("func", "code").alias("code"), (F.coalesce("target", "label") == 1).alias("vulnerable")).where("code IS NOT NULL").limit(limit if limit is not None else (1 << 31) - 1)


def sarif(spark: SparkSession, path: str) -> DataFrame:
    """(rule, level, message, file, line) of SARIF results, one row a location."""
    docs = spark.read.schema(SARIF).option("multiLine", True).json(path)
    r = docs.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r")).select("r.*", F.explode("r.locations").alias("loc"))
    return r.select(F.col("ruleId").alias("rule"), "level", F.col("message.text").alias("message"), F.col("loc.physicalLocation.artifactLocation.uri").alias("file"), F.coalesce("loc.physicalLocation.region.startLine", F.lit(0)).alias("line"))


def issue_list(spark: SparkSession, path: str) -> DataFrame:
    """(rule, file, line) of an issue tracker's JSON: base name of the component, the line or the text range's start, else 0."""
    ddl = "issues array<struct<component:string,rule:string,line:int,textRange:struct<startLine:int>>>"
    i = spark.read.schema(ddl).option("multiLine", True).json(path).select(F.explode("issues").alias("i")).select("i.*")
    return i.select("rule", F.element_at(F.split("component", "[/:]"), -1).alias("file"), F.coalesce("line", "textRange.startLine", F.lit(0)).alias("line"))


def external_results(spark: SparkSession, path: str) -> DataFrame:
    """(rule, severity, file, line, message) of a scanner's JSON with results (path or filename, start.line or line_number)."""
    ddl = "results array<struct<check_id:string,test_id:string,path:string,filename:string,start:struct<line:int>,line_number:int,issue_severity:string,issue_text:string,extra:struct<message:string,severity:string>>>"
    r = spark.read.schema(ddl).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    sev = F.lower(F.coalesce("extra.severity", "issue_severity"))
    named = F.when(sev.isin("error", "high"), "high").when(sev.isin("warning", "medium"), "medium").otherwise("low")
    return r.select(F.coalesce("check_id", "test_id").alias("rule"), named.alias("severity"), F.coalesce("path", "filename").alias("file"), F.coalesce("start.line", "line_number").alias("line"), F.coalesce("extra.message", "issue_text").alias("message"))


def corpus_hash(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """One row: a digest of all (path, content digest) that no order of rows changes, for telling whether an index is fresh.

    Digests are summed as numbers in parts, so the rows are never gathered.
    """
    h = F.sha2(F.concat_ws(":", path_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return files.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[p.cast("string") for p in parts]), 256).alias("digest"))


def schema_of(ddl: str) -> T.StructType:
    """A schema from its text."""
    return T.StructType.fromDDL(ddl)
