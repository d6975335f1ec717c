import json
import sys
from datetime import datetime

import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scanloom.operators import analysis, manifests, reporting
from scanloom.sources import readers, writers
from scanloom.streaming import findings as streaming

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find test modules


def test_manifests(spark):
    pom = "<project><dependencies><dependency><groupId>org.springframework</groupId><artifactId>spring-data-jpa</artifactId></dependency><!-- <dependency><artifactId>spring-boot</artifactId></dependency> --></dependencies></project>"
    data = [
        ("a/package.json", '{"dependencies": {"express": "1", "Prisma": "2"}, "devDependencies": {"sequelize": "3"}}'), ("b/package.json", "{broken"), ("requirements.txt", "# x\nDjango==4\nflask[async]==2\nSQLAlchemy>=1 ; y\n"),
        ("setup.py", "setup(install_requires=[\n 'flask>=1', \"other\"])"), ("pom.xml", pom), ("build.gradle", "implementation 'org.spring-boot:x:1'"), ("x.py", "flask"), ("c/pom.xml", None),
    ]
    df = spark.createDataFrame(data, "path string, content string")
    found = manifests.detect(df, "path", "content")
    assert set(rows(found)) == {("javascript", "express"), ("javascript", "sequelize"), ("typescript", "express"), ("typescript", "sequelize"), ("python", "django"), ("python", "flask"), ("python", "sqlalchemy"), ("java", "spring-data-jpa"), ("java", "spring-boot")}
    assert ("python", ["django", "flask", "sqlalchemy"]) in rows(manifests.project_context(found))


class Flaky:
    def __init__(self):
        self.n = 0

    def complete(self, prompt):
        self.n += 1
        if "down" in prompt or "once" in prompt and self.n % 2:
            raise OSError("no line")
        good = {"type": "xss", "severity": "high", "confidence": 1, "line": 3, "quote": "q", "message": "m", "recommendation": ""}
        return {"bad": '{"findings": [{"type": "other"}]}', "fence": "so:\n```json\n" + json.dumps({"findings": [good]}) + "\n```", "none": "{}"}.get(prompt.rpartition("\n")[2], json.dumps({"findings": [good]}))


def test_analyze(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fence"), (4, "none"), (5, "down"), (6, "once"), (7, None)], "id long, prompt string").repartition(1)
    got = {r["id"]: r for r in analysis.analyze(df, "id", "prompt", Flaky, retries=2, sleep=lambda s: None).collect()}
    assert {k for k, r in got.items() if r["success"]} == {1, 3, 6, 7}
    assert got[1]["findings"][0]["line"] == 3 and got[2]["findings"] == [] and "OSError" in got[5]["error"]
    assert analysis.backoff(0) == 2 and analysis.backoff(9) == 64
    assert analysis.salvage('{"findings": [{"type": "a", "m": "}"}, {"type": "b"}, {"type": "c", "x') == [{"type": "a", "m": "}"}, {"type": "b"}]


def test_work_and_rules(spark):
    c = spark.createDataFrame([(1, "python", "x"), (2, "c", "y"), (3, None, "z")], "id long, language string, source string")
    assert analysis.work_items(c, "id", "language").count() == 39 and analysis.work_items(c.where("id = 2"), "id", "language").count() == 4
    assert analysis.work_items(c, "id", "language", per_language=True).count() == 22 and analysis.work_items(c.limit(0), "id", "language").count() == 0
    fw = spark.createDataFrame([("python", ["flask"])], "language string, frameworks array<string>")
    got = analysis.with_frameworks(c, fw, "language")
    assert rows(got.select("id", "frameworks")) == [(1, ["flask"]), (2, []), (3, [])]
    table = spark.createDataFrame([("flask", "xss", "look"), ("flask", "xss", "look"), ("django", "xss", "no")], "framework string, type string, hint string")
    assert rows(analysis.hints(got, table, "id")) == [(1, "xss", ["look"])]
    reply = analysis.parse_reply(analysis.RuleAnalyzer().complete("buffer_overflow\n 9: strcpy(a, b);\n10: x"))
    assert [(f["line"], f["type"]) for f in reply] == [(9, "buffer_overflow")]


def test_judge(spark):
    sites = spark.createDataFrame([("f", 1, [("xss", 0.5), ("ssrf", 0.4)]), ("g", 2, [("ssrf", 0.5), ("xss", 0.1)])], "file string, site int, best array<struct<type:string,confidence:double>>")

    class Picks:
        def complete(self, prompt):
            if prompt.startswith('["ssrf"'):
                raise OSError
            return 'I say {"selected_types": ["other", "ssrf"]}'

    assert rows(analysis.judge(sites, ["file"], Picks).select("file", "kept")) == [("f", "ssrf"), ("g", "*")]


def test_source_tree(spark, tmp_path):
    for p, t in {"src/a.py": "x = 1\n", "src/a_test.js": "y", "vendor/b.py": "no", "c.txt": "no", "lib/d.min.js": "no", "lib/e.ts": "z", "skip/f.py": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = rows(readers.source_tree(spark, str(tmp_path), ignore=readers.ignore_patterns("# c\n\nskip/\n")))
    assert got == [("lib/e.ts", "typescript", False, "z"), ("src/a.py", "python", False, "x = 1\n"), ("src/a_test.js", "javascript", True, "y")]
    assert readers.source_tree(spark, str(tmp_path), languages=("python",)).count() == 2
    df = spark.createDataFrame([("a", "1"), ("b", None)], "path string, content string")
    one = readers.corpus_hash(df, "path", "content").first()[0]
    assert one == readers.corpus_hash(df.orderBy(F.desc("path")), "path", "content").first()[0] != readers.corpus_hash(df.limit(1), "path", "content").first()[0]


def test_json_readers(spark, tmp_path):
    w = lambda name, doc: (tmp_path / name).write_text(json.dumps(doc, indent=1)) and str(tmp_path / name)
    lab = {"scan_metadata": {"total_expected_findings": 2}, "expected_findings": [{"file": "a.py", "line": 3, "type": "xss"}, {"file": "b.py", "line": 4, "type": "ssrf", "owasp": "A1"}]}
    assert readers.labels(spark, w("l.json", lab)).count() == 2
    lab["scan_metadata"]["total_expected_findings"] = 3
    assert readers.labels(spark, w("m.json", lab)).count() == 0 and readers.labels(spark, str(tmp_path / "m.json"), strict=False).count() == 2
    (tmp_path / "r").mkdir()
    report = {"scan_metadata": {"scan_duration_seconds": 9, "target_path": "t"}, "findings": [{"file": "a", "line": 1, "type": "xss"}, {"file": "a", "line": 2, "type": "ssrf"}], "summary": {"total_findings": 2}}
    w("r/scan-20250101-000000.json", report)
    w("r/scan-20250102-000000.json", {"scan_metadata": {"scan_duration_seconds": 0}, "findings": None})
    docs = readers.reports(spark, str(tmp_path / "r"))
    assert [r["report"] for r in docs.collect()][0].startswith("scan-20250102") and rows(readers.report_findings(docs, "xss").select("file", "line")) == [("a", 1)]
    assert [tuple(r)[1:5] for r in readers.report_history(docs).collect()] == [("t", 9, 2, 1)]
    sarif = {"runs": [{"results": [{"ruleId": "r", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.js"}, "region": {"startLine": 7}}}, {"physicalLocation": {"artifactLocation": {"uri": "b.js"}}}]}]}]}
    assert [tuple(r)[3:] for r in sorted(readers.sarif(spark, w("s.json", sarif)).collect(), key=lambda r: r["file"])] == [("a.js", 7), ("b.js", 0)]
    issues = {"issues": [{"component": "p:src/a.js", "rule": "x", "textRange": {"startLine": 5}}, {"component": "p:b.js", "rule": "y"}]}
    assert rows(readers.issue_list(spark, w("i.json", issues))) == [("x", "a.js", 5), ("y", "b.js", 0)]
    bandit = {"results": [{"test_id": "B1", "filename": "a.py", "line_number": 3, "issue_severity": "HIGH", "issue_text": "t"}, {"check_id": "c", "path": "b.py", "start": {"line": 4}, "extra": {"severity": "WARNING", "message": "u"}}]}
    assert rows(readers.external_results(spark, w("b.json", bandit))) == [("B1", "high", "a.py", 3, "t"), ("c", "medium", "b.py", 4, "u")]
    (tmp_path / "f.jsonl").write_text('{"idx": 1, "func": "f", "target": 1}\nbroken\n{"idx": 2, "code": "g", "label": 0}\n')
    assert rows(readers.labelled_functions(spark, str(tmp_path / "f.jsonl"))) == [(1, "f", True), (2, "g", False)]


def test_knowledge_base(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("id: a-1\ntitle: t\ndescription: d\ncode_patterns: [x, y]\n")
    assert rows(readers.knowledge_base(spark, str(tmp_path))) == [("a-1", "t", "d", ["x", "y"], 1)]
    (tmp_path / "b.yml").write_text("id: a-1\ntitle: t\ndescription: d\ncode_patterns: [x]\n")
    with pytest.raises(ValueError, match="twice"):
        readers.knowledge_base(spark, str(tmp_path))
    assert len(readers.entry_problems({"id": "A b", "title": " "})) == 4


def test_writers(spark, tmp_path):
    name = writers.report_name(datetime(2025, 1, 2, 3, 4, 5))
    assert name == "scan-20250102-030405.json"
    path = writers.write_report({"findings": None, "summary": {"total_findings": 0}}, str(tmp_path / "out"), name)
    assert json.loads(open(path).read())["findings"] == [] and len(list((tmp_path / "out").iterdir())) == 1
    with pytest.raises(ValueError):
        writers.write_report({"findings": [{"m": "�"}]}, str(tmp_path / "out"))
    df = spark.createDataFrame([("a", "t1"), ("b", "t2")], "file string, text string")
    writers.write_by_file(df, "file", "text", str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m/csv")).count() == 2
    f = spark.createDataFrame([("xss", "high", "a.py", 3, 0.5, "m", None, "f", "c"), ("xss", "odd", "a.py", 3, 0.5, "m", 1, "f", "c")], "type string, severity string, file string, line int, confidence double, message string, col_number int, function_name string, code_snippet string")
    assert rows(reporting.report_rows(f).select("check_id", "start.col", "extra.severity")) == [("xss", 1, "HIGH")]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "xss", 0.9, datetime(2025, 1, 1, 0, 5)), (1, "xss", 0.9, datetime(2025, 1, 1, 0, 5)), (2, "xss", 0.2, datetime(2025, 1, 1, 0, 6)), (3, "ssrf", 0.8, datetime(2025, 1, 1, 1, 5)), (4, "xss", 0.9, datetime(2025, 3, 1))], "key long, type string, confidence double, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    s = streaming.once_each(streaming.stream_table(spark, str(tmp_path / "in"), df.schema), ["key"], "at")
    out = streaming.windowed_summary(streaming.confident(s, "confidence", 0.5), "at", ["type"], late=None)
    streaming.write_batches(out, str(tmp_path / "out"), str(tmp_path / "cp"), "q").awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("type", "findings")) == [("ssrf", 1), ("xss", 1)]
