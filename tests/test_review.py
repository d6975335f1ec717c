import json
import random
import sys

import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scanloom import cli, config
from scanloom.functions import prompts
from scanloom.functions import text as tx
from scanloom.operators import analysis, cache, evaluation, families, generate, reporting, review, usage
from scanloom.plans import scan as plan
from scanloom.sources import readers, writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find test modules

FOUND = "file string, line int, type string, confidence double, message string, ord long"
CODE = "\n".join(f"line {k}" for k in range(1, 41))


class Says:
    """Replies by a word of the prompt."""

    table: dict = {}

    def complete(self, prompt):
        for word, reply in type(self).table.items():
            if word in prompt:
                if isinstance(reply, Exception):
                    raise reply
                return reply
        return "{}"


def saying(**table):
    return type("Told", (Says,), {"table": table})


def test_judge_keeps_one_kind_of_a_contested_place(spark):
    f = spark.createDataFrame([
        ("pick.py", 10, "xss", 0.5, "m", 1), ("pick.py", 12, "ssrf", 0.4, "m", 2), ("pick.py", 12, "ssrf", 0.9, "m", 3), ("one.py", 3, "xss", 0.5, "m", 4), ("none.py", 3, "xss", 0.5, "m", 5), ("none.py", 3, "ssrf", 0.5, "m", 6),
        ("down.py", 3, "xss", 0.5, "m", 7), ("down.py", 3, "ssrf", 0.5, "m", 8), ("gone.py", 3, "xss", 0.5, "m", 9), ("gone.py", 4, "ssrf", 0.5, "m", 10), ("far.py", 20, "xss", 0.5, "m", 11), ("far.py", 21, "ssrf", 0.5, "m", 12), (None, 1, "xss", 0.5, "m", 13), ("word.py", 9, "xss", 0.1, None, 14), ("word.py", 9, "ssrf", 0.1, None, 15),
    ], FOUND)
    files = spark.createDataFrame([(n, CODE) for n in ("pick.py", "one.py", "none.py", "down.py", "far.py", "word.py")], "file string, content string")
    told = saying(**{"pick.py": 'so: {"selected_types": ["other", " ssrf "], "line": "14: here"}', "none.py": '{"selected_types": []}', "down.py": analysis.ClientError("no"), "far.py": '{"selected_types": ["xss"], "line": 33}', "word.py": "{no json}"})
    out, stats = review.judge_sites(f, files, "file", told)
    assert rows(out.select("ord", "line", "reported_line")) == sorted([(3, 14, 12), (4, 3, None), (7, 3, None), (8, 3, None), (9, 3, None), (10, 4, None), (11, 20, None), (13, 1, None), (14, 9, None), (15, 9, None)], key=repr)
    got = stats.first().asDict()
    assert got == {"total_findings": 15, "sites_uncontested": 1, "sites_contested": 6, "calls": 3, "selected_one": 2, "selected_none": 1, "errors": 3, "removed": 5, "kept_findings": 10} and out.count() == got["kept_findings"]
    empty, none = review.judge_sites(f.limit(0), files, "file", told)
    assert empty.count() == 0 and none.first()["kept_findings"] == 0


def test_verify_drops_only_what_is_rejected(spark):
    f = spark.createDataFrame([("yes.py", 10, "xss", 0.5, "m", 1), ("no.py", 12, "ssrf", 0.4, "m", 2), ("down.py", 12, "ssrf", 0.9, "m", 3), ("gone.py", 3, "xss", 0.5, "m", 4), ("odd.py", 3, "xss", 0.5, "m", 5), ("mute.py", 3, "xss", 0.5, None, 6)], FOUND)
    files = spark.createDataFrame([(n, CODE) for n in ("yes.py", "no.py", "down.py", "odd.py", "mute.py")], "file string, content string")
    told = saying(**{"yes.py": '{"applies": true}', "no.py": 'well {"applies": false, "reason": "x"}', "down.py": analysis.ClientError("no"), "odd.py": "I can't say", "mute.py": "{}"})
    out, stats = review.verify(f, files, "file", told)
    assert [r[0] for r in rows(out.select("ord"))] == [1, 3, 4, 5] and out.columns == f.columns
    assert stats.first().asDict() == {"total_findings": 6, "calls": 3, "confirmed": 1, "rejected": 2, "errors": 3, "kept_findings": 4}


def test_rule_reviewer_and_votes(spark):
    p = spark.range(1).select(prompts.judgement(F.lit("a.py"), F.lit(2), tx.excerpt(F.lit("x = 1\nos.system(a)\n"), F.lit(2)), F.array(F.struct(F.lit("ssrf").alias("type"), F.lit("m").alias("message")), F.struct(F.lit("command_injection").alias("type"), F.lit(None).cast("string").alias("message")))).alias("p")).first()[0]
    assert json.loads(review.RuleReviewer().complete(p)) == {"selected_types": ["command_injection"], "line": 2}
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    assert rows(review.votes(s, ["k"], "p", saying(a='{"selected_types": ["xss"]}', b="{}"))) == [(1, "xss", 1.0), (2, "", 1.0)]


def test_prompts(spark):
    e = F.array(F.struct(F.lit("T").alias("title"), F.lit("é" * 150).alias("description")))
    row = spark.range(1).select(
        prompts.analysis(F.lit("xss"), F.lit("a.js"), F.lit("f"), F.lit("a\nb"), F.lit(9), F.lit(10), F.array(F.lit("express")), e, F.array(F.lit("look here"))).alias("full"),
        prompts.analysis(F.lit("format_string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("a"), F.lit(1), F.lit(1), F.array().cast("array<string>"), F.lit(None).cast("array<struct<title:string,description:string>>"), F.array(F.lit("look here"))).alias("bare"),
    ).first()
    assert row["full"].startswith("Kind: xss\n") and " 9: a\n10: b" in row["full"] and "express" in row["full"] and "look here" in row["full"] and "é" * 98 + "..." in row["full"] and "é" * 99 not in row["full"]
    assert "No frameworks detected" in row["bare"] and "Hints" not in row["bare"] and "Known patterns" not in row["bare"] and "function unknown" in row["bare"]
    assert set(prompts.QUESTIONS) == set(analysis.WEB_TYPES + analysis.NATIVE_TYPES)


def test_hopeless_calls_are_not_repeated_and_the_second_prompt_is_stricter(spark):
    calls = []

    class Refuses:
        def complete(self, prompt):
            calls.append(prompt)
            e = OSError("refused")
            e.status = 429 if "busy" in prompt else 401
            raise e

    for prompt, n in (("x", 1), ("busy", 3)):
        calls.clear()
        with pytest.raises(OSError):
            analysis.call(Refuses(), prompt, 2, lambda s: None)
        assert len(calls) == n
    good = '{"findings": []}'
    df = spark.createDataFrame([(1, "first")], "id long, prompt string")
    told = saying(**{prompts.STRICTER[:20]: good, "first": "no json"})
    assert analysis.analyze(df, "id", "prompt", told).first()["success"]
    now, waits = [0.0], []
    made = analysis.spaced(saying(), 2.0, clock=lambda: now[0], sleep=waits.append)()
    made.complete("a"), made.complete("b")
    assert waits == [0.0, 2.0]


def test_generated_texts(spark):
    files = spark.createDataFrame([("a.py", "python", "x = 1\ny = 2\n"), ("b.py", "python", None), ("c.py", "python", " ")], "path string, language string, content string")
    told = saying(Document="```\nall of it\n```", Write="```\nassert f()\n```", Repair="```\nx = 1\ny = 3\n```")
    assert rows(generate.documents(files, told)) == [("a.py", "all of it", None)]
    fs = spark.createDataFrame([("a.py", "python", "g", 9, "def g(): pass"), ("a.py", "python", "f", 1, "def f(): pass")], "path string, language string, name string, start_line int, source string")
    assert rows(generate.tests(fs, told)) == [("a.py", "assert f()\n\nassert f()", 2, 0)]
    f = spark.createDataFrame([("a.py", 2, "xss", "High", "m"), ("a.py", 1, "xss", "low", "m"), ("z.py", 1, "xss", "high", "m")], "file string, line int, type string, severity string, message string")
    got = generate.repairs(f, files.withColumnRenamed("path", "file"), told).collect()
    assert len(got) == 1 and got[0]["patch_name"] == "a_py_2_xss.patch" and "-y = 2\n+y = 3\n" in got[0]["patch"]
    big = files.union(spark.createDataFrame([("big.py", "python", "x" * 30_000)], files.schema))
    found, counts = generate.whole_files(big, analysis.RuleAnalyzer)
    assert counts.first().asDict() == {"files": 2, "too_large": 1, "failed": 0} and found.count() == 0


def test_families_reports_and_pairs(spark):
    f = spark.createDataFrame([("xss", "t/a.py", 3, 0.9, "m", "high"), ("use_after_free", "t/a.py", 3, 0.9, "m", "high"), ("xss", "t/b.py", 3, 0.1, "m", None)], "type string, file string, line int, confidence double, message string, severity string")
    known, skipped = reporting.benchmark_rows(f, F.lit("t"), 0.5)
    assert rows(known.select("path", "extra.severity")) == [("a.py", "ERROR")] and rows(skipped) == [("use_after_free", 1)]
    n = spark.createDataFrame([("CWE-94",), ("CWE-1",), (None,)], "n string").select(families.family_of(F.col("n")))
    got = [r[0] for r in n.collect()]
    assert "CWE-78" in got[0] and got[1:] == [["CWE-1"], None]
    assert rows(families.in_scope(spark.createDataFrame([("CWE-1", 1), ("CWE-2", 2), (None, 3)], "cwe string, k long"), "cwe", spark.createDataFrame([("CWE-2",), ("CWE-2",)], "cwe string"))) == [("CWE-2", 2)]
    assert [tuple(r) for r in reporting.severity_block(f, "severity").collect()] == [("critical", 0), ("high", 2), ("medium", 0), ("low", 0)]
    c = spark.createDataFrame([("a", 6), ("b", 3)], "category string, findings long")
    assert [(r["category"], r["precision"]) for r in evaluation.upper_bounds(c, 1, 9, 1).orderBy("running").collect()] == [("a", 0.25), ("b", 1.0)]


def test_usage_samples_and_context(spark):
    u = spark.createDataFrame([("a", 10, 5, 0.5), ("a", None, 1, None), ("b", 1, 1, 0.1), (None, 1, 1, 0.2)], "model string, prompt_tokens long, completion_tokens long, cost double")
    c = spark.createDataFrame([("a",), ("c",), (None,)], "model string")
    assert set(rows(usage.model_report(c, u))) == {("a", 1, 16, 0.5), ("b", 0, 2, 0.1), ("c", 1, 0, 0.0), (None, 1, 2, 0.2)}
    s = spark.createDataFrame([(k, 1.0) for k in range(1, 12)], "id long, cost double")
    assert [tuple(r) for r in usage.soft_cap(s, ["id"], "cost", 10.0).collect()] == [(9, 8.0, 2.0, 80.0)] and usage.soft_cap(s.limit(3), ["id"], "cost", 10.0).count() == 0
    at = spark.range(25).select("id", F.timestamp_seconds(F.col("id") * 4).alias("at"))
    assert [r["done"] for r in usage.progress(at, ["id"], "at").orderBy("done").collect()] == [1, 9, 10, 16, 20, 24]
    ids = spark.range(100).select(F.col("id"))
    want = sorted(random.Random(7).sample(range(100), 30))
    assert [r[0] for r in rows(evaluation.replayed_sample(ids.repartition(5), "id", 30))] == sorted(want, key=lambda k: repr((k,))) and evaluation.replayed_sample(ids.limit(3), "id", 30).count() == 3
    f = spark.createDataFrame([("go", "a.py", 1, "go(x); help(y)"), ("help", "b.py", 1, "pass")], "name string, file string, start_line int, source string")
    assert rows(evaluation.callees(f)) == [("go", "a.py", "help", "b.py")]
    p = spark.createDataFrame([(1, 1, "a" * 10), (1, 2, "b" * 30), (1, 3, "c" * 5)], "k long, o int, t string")
    assert rows(evaluation.context(p, ["k"], "t", ["o"], budget=20)) == [(1, 2, "a" * 10 + "\n" + "c" * 5)]


def test_cache_table(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert cache.load(spark, path).count() == 0
    e = spark.sql("SELECT 'k1' AS key, TIMESTAMP'2025-01-20' AS stored_at, 'old' AS response UNION ALL SELECT 'k1', TIMESTAMP'2025-01-30', 'new' UNION ALL SELECT 'x2', TIMESTAMP'2024-01-01', 'gone'")
    cache.save(e, path)
    now = F.lit("2025-02-01").cast("timestamp")
    assert cache.clean(spark, path, now) == 2 and rows(cache.load(spark, path).select("key", "response")) == [("k1", "new")]
    cache.clear(spark, path)
    assert cache.load(spark, path).count() == 0 and cache.clean(spark, path, now) == 0
    log = spark.createDataFrame([(True,), (False,), (None,), (True,)], "hit boolean")
    assert tuple(cache.hit_rate(log, "hit").first()) == (4, 2, 2, 0.5) and cache.hit_rate(log.limit(0), "hit").first()["rate"] == 0.0


def test_settings_and_guards(tmp_path):
    assert config.wanted_languages("JS, cobol,py thon,cpp,js") == ("js", "cpp")
    with pytest.raises(ValueError):
        config.wanted_languages("cobol")
    assert config.Settings().problems() == [] and len(config.Settings(languages=("x",), threshold=2, budget=0, root="/nowhere", out="", off=frozenset({"y"})).problems()) == 6
    assert not config.ablated(config.Settings(), "judge, retrieval").uses("judge")
    assert cli.main(["scan", str(tmp_path), "--languages", "cobol"]) == 2 and cli.main(["scan", str(tmp_path), "--threshold", "7"]) == 2
    (tmp_path / "INCOMPLETE").write_text("")
    with pytest.raises(ValueError):
        evaluation.refuse_incomplete([str(tmp_path)])
    evaluation.refuse_incomplete([str(tmp_path / "other")])
    assert readers.report_path(str(tmp_path), "scan-1.json").endswith("scan-1.json")
    for bad in ("../scan-1.json", "x.json", "scan-../a.json"):
        with pytest.raises(ValueError):
            readers.report_path(str(tmp_path), bad)
    assert writers.document_problems({"scan_metadata": {"timestamp": "2025-01-01T00:00:00Z"}, "findings": []}) == []
    assert len(writers.document_problems({"scan_metadata": {"timestamp": "2025-01-01"}, "findings": [{"type": "xss"}]})) == 2


def test_scan_with_everything(spark, tmp_path):
    pytest.importorskip("yaml")
    files = {
        "t/app.py": "def find(name):\n    sql = \"SELECT a FROM b WHERE c = \" + name\n    return db.execute(sql)\n\ndef run(cmd):\n    os.system(cmd)\n    data = open(cmd)\n", "t/requirements.txt": "flask==2\n", "kb/a.yaml": "id: a-1\ntitle: python execute sql\ndescription: sql text from values\ncode_patterns: [x]\n",
    }
    for p, text in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    src, kb = readers.source_tree(spark, str(tmp_path / "t")), readers.knowledge_base(spark, str(tmp_path / "kb"))
    frameworks = spark.createDataFrame([("python", ["flask"])], "language string, frameworks array<string>")
    hints = spark.createDataFrame([("flask", "xss", "escape in templates")], "framework string, type string, hint string")
    asked = {json.loads(r["item"])["name"] + "/" + json.loads(r["item"])["type"]: r["prompt"] for r in plan.questions(plan.chunks_of(src), knowledge=kb, frameworks=frameworks, hints=hints).collect()}
    assert len(asked) == 18 and "python execute sql: sql text" in asked["find/xss"] and "escape in templates" in asked["run/xss"] and "escape in templates" not in asked["run/ssrf"]
    assert cli.run_scan(spark, str(tmp_path / "t"), str(tmp_path / "out"), knowledge=str(tmp_path / "kb"), review=True) == 2
    doc = json.loads(next((tmp_path / "out").glob("scan-*.json")).read_text())
    meta = doc["scan_metadata"]
    assert [(f["line"], f["type"]) for f in doc["findings"]] == [(2, "sql_injection"), (6, "command_injection")]
    assert meta["analysis"] == {"attempted_calls": 18, "failed_calls": 0} and meta["frameworks"] == ["flask"] and meta["judge"]["sites_contested"] == 1 and meta["judge"]["removed"] == 1 and meta["verify"]["confirmed"] == 2 and meta["line_snap"]["confirmed"] == 3 and meta["suppression"]["kept_findings"] == 2
    postings = readers.kept_postings(spark, kb, f"file://{tmp_path}/index")
    assert postings.count() > 0 and readers.kept_postings(spark, kb, f"file://{tmp_path}/index").count() == postings.count() and len(list((tmp_path / "index").iterdir())) == 1


def test_chunks_are_assembled_with_their_directives(spark):
    from scanloom.operators import chunking

    text = "def f():\n    # tool:ignore-next-line xss\n    return 1\n\ndef g():\n    return 1\n"
    files = spark.createDataFrame([("a.py", "python", text), ("b.py", "python", None)], "path string, language string, content string")
    fs = chunking.function_chunks(files.select(F.struct("path", "language").alias("o"), "language", "content"), "o", "language", "content").select("o.*", "function_name", "start_line", "source")
    big = spark.createDataFrame([("b.py", "python", "h", 1, "xxxx = 1234\n" * 400)], fs.schema)
    got = {r["function_name"]: r for r in chunking.assembled(fs.union(big), files, "path", "language", "content").collect()}
    assert set(got) == {"f", "g", "h_part1", "h_part2"} and [s["line"] for s in got["f"]["suppressed_lines"]] == [3] and got["g"]["suppressed_lines"] == []
    assert got["f"]["id"] != got["g"]["id"] and got["h_part1"]["id"] != got["h_part2"]["id"] and got["h_part1"]["tokens"] > got["h_part2"]["tokens"] and got["f"]["end_line"] == 3
