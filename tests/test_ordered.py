from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanloom.operators import chunking, ordered

SCHEMA = "key string, line int, conf double, ord long, l int, island int"


def fold(data, within=3):
    """The fold as a loop."""
    out = []
    for key in sorted({r[0] for r in data if r[0] is not None and r[1] is not None}):
        kept = None
        for _, line, conf, o, *_ in sorted((r for r in data if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[3])):
            c = -1.0 if conf is None else conf
            if kept is None or line - kept[0] > within:
                kept and out.append((key, *kept))
                kept = (line, o, conf)
            elif c > (-1.0 if kept[2] is None else kept[2]):
                kept = (line, o, conf)
        kept and out.append((key, *kept))
    return sorted(out, key=repr)


def test_fold_example(spark):
    data = [("a", 1, 0.5, 1, 0, 0), ("a", 3, 0.4, 2, 0, 0), ("a", 5, 0.9, 3, 0, 0), ("a", 7, 0.95, 4, 0, 0), ("a", 20, 0.1, 5, 0, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert [r[1] for r in rows(ordered.near_line_fold(df, ["key"], "line", "conf", "ord"))] == [1, 20, 7]


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(1, 25)), st.one_of(st.none(), st.sampled_from([0.1, 0.5, 0.9]))), max_size=30))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_fold_equals_loop(spark, data):
    full = [(*r, i, 0, 0) for i, r in enumerate(data)]
    df = spark.createDataFrame(full, SCHEMA)
    got = rows(ordered.near_line_fold(df, ["key"], "line", "conf", "ord").select("key", "line", "ord", "conf"))
    assert got == fold(full)


def test_running_total_and_runs(spark):
    data = [(i, (i * 7) % 13, None if i % 5 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "id long, t int, cost double")
    got = {r["id"]: r["total"] for r in ordered.running_total(df, ["t", "id"], {"total": F.col("cost")}).collect()}
    acc = 0.0
    for i, _, c in sorted(data, key=lambda r: (r[1], r[0])):
        acc += c or 0
        assert got[i] == acc
    flags = [1, 0, 0, 1, 0, 0, 0, 1, 0]
    runs = ordered.failure_runs(spark.createDataFrame(list(enumerate(flags)), "id long, ok int"), ["id"], F.col("ok") == 0, 2)
    assert rows(runs) == [(1, 1, 2), (2, 4, 3)]
    assert ordered.running_total(df.limit(0), ["t", "id"], {"total": F.col("cost")}).count() == 0


def test_windows_and_packing(spark):
    text = "\n".join(["a" * 40] * 3 + [""] * 60 + ["b"] * 70)
    df = spark.createDataFrame([(1, text, 5, "f"), (2, None, None, None), (3, "", 1, "g")], "id long, source string, start int, name string")
    assert [r[1:4] for r in rows(chunking.windows(df, "id", "source"))] == [(1, 1, 60), (2, 61, 120), (3, 121, 133)]

    def packed(lines, most):
        parts, cur, t = [], [], 0
        for x in lines:
            n = len(x.encode()) // 4
            if cur and t + n > most:
                parts.append("\n".join(cur))
                cur, t = [], 0
            cur.append(x)
            t += n
        return [*parts, "\n".join(cur)]

    lines = ["x" * (k * 37 % 90) + "é" for k in range(120)]
    big = spark.createDataFrame([(1, "\n".join(lines), 10, "f"), (2, "short", None, "g"), (3, "y" * 900, 1, "h")], "id long, source string, start int, name string")
    got = rows(chunking.split_chunks(big, "id", "source", "start", "name", 100))
    assert [r[5] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1])] == packed(lines, 100)
    one = [r for r in got if r[0] == 2][0]
    assert one[1:5] == (1, 1, 1, "g") and [r[4] for r in got if r[0] == 3] == ["h_part1"]


def test_functions_of_languages():
    py = "class A:\n    def f(self):\n        def g(): pass\n        return 1\nasync def h():\n    pass\n"
    assert [(n, a, b) for n, a, b, _ in chunking.functions_of(py, "python")] == [("f", 2, 4), ("h", 5, 6)]
    js = "const f = (a) => {\n  return `}`\n}\nfunction g(a) { if (a) { return 1 } }\nclass C { m() { return 2 } }\n"
    assert [n for n, *_ in chunking.functions_of(js, "javascript")] == ["f", "g", "m"]
    assert [n for n, *_ in chunking.functions_of("int f(void) { /* } */ return 1; }\nstatic int g(int a) {\n}\n", "c")] == ["f", "g"]
    assert chunking.functions_of("def f(:\n", "python") == [] and chunking.functions_of("int f() {", "c") == [] and chunking.functions_of("", "java") == []


def test_once_moves_only_what_comes_again(spark):
    from scanloom.session import once

    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "c"), (3, "d"), (None, "c")], "k long, t string")
    for most in (10, 0):
        assert sorted(rows(once(df, "k", most)), key=repr) == sorted([(1, "a"), (2, "b"), (3, "d"), (None, "c")], key=repr)
    assert once(df.limit(0), "k").count() == 0
