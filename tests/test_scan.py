import json
import os

from scanloom.cli import run_scan
from scanloom.plans import scan as plan


def test_scan_of_a_tree(spark, tmp_path):
    files = {
        "src/db.py": "def find(name):\n    sql = \"SELECT a FROM b WHERE c = \" + name\n    return db.execute(sql)\n\ndef hush(name):\n    # tool:ignore-next-line sql_injection\n    sql = \"DELETE FROM b WHERE c = \" + name\n    return sql\n",
        "src/run.js": "function go(a) {\n  el.innerHTML = a\n}\n", "src/mem.c": "int f(char *a) {\n  strcpy(b, a);\n  return 0;\n}\n", "vendor/x.py": "def f():\n    os.system(a)\n", "src/broken.py": "def f(:\n    os.system(a)\n",
    }
    for p, t in files.items():
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text(t)
    assert run_scan(spark, str(tmp_path / "t"), str(tmp_path / "out")) == 3
    name = next(x for x in os.listdir(tmp_path / "out") if x.endswith(".json"))
    doc = json.loads((tmp_path / "out" / name).read_text())
    assert [(f["file"], f["line"], f["type"]) for f in doc["findings"]] == [("src/db.py", 2, "sql_injection"), ("src/mem.c", 2, "buffer_overflow"), ("src/run.js", 2, "xss")]
    assert doc["summary"]["by_type"] == {"sql_injection": 1, "buffer_overflow": 1, "xss": 1} and doc["scan_metadata"]["analysis"]["failed_calls"] == 0


def test_large_scans_keep_metadata_and_summary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("scanloom.cli.DOCUMENT_ROWS", 0)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "run.js").write_text("function go(a) {\n  el.innerHTML = a\n}\n")
    assert run_scan(spark, str(tmp_path / "t"), str(tmp_path / "out")) == 1
    doc = json.loads(next((tmp_path / "out").glob("*.json")).read_text())
    assert doc["summary"] == {"total_findings": 1, "by_severity": doc["summary"]["by_severity"], "by_type": {"xss": 1}} and sum(doc["summary"]["by_severity"].values()) == 1
    assert doc["scan_metadata"]["analysis"]["failed_calls"] == 0 and "findings" not in doc and doc["findings_directory"] == "findings"


def test_empty_tree(spark):
    files = spark.createDataFrame([], "path string, language string, content string")
    found, calls = plan.scan(files)
    assert found.count() == 0 and calls.first()["failed_calls"] == 0
