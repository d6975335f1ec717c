import random

from conftest import rows
from pyspark.sql import functions as F

from scanloom.functions import paths, stats
from scanloom.functions import text as tx
from scanloom.operators import findings as fd
from scanloom.operators import matching, redaction, reporting, retrieval, usage
from scanloom.plans import catalog


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_paths(spark):
    df = spark.createDataFrame([(x,) for x in ["src/a.test.js", "latest.js", "tests/x.py", "a/__tests__/b.c", "src/b.cpp", "test_x.py", "Makefile", None, "vendor/a.js", "x/vendor", "a.min.js", "lib\\b.TS"]], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(paths.language(p), paths.is_test(p), paths.excluded(p, ("x/", "# no", "*.cpp"))).collect()]
    assert [r[0] for r in got] == ["javascript", "javascript", "python", "c", "cpp", "python", None, None, "javascript", None, "javascript", "typescript"]
    assert [r[1] for r in got] == [True, True, True, True, False, True, False, None, False, False, False, False]
    assert [r[2] for r in got][4] is True and [r[2] for r in got][8:11] == [True, True, True]
    assert col(spark, "C:\\a\\b", lambda x: paths.base_name(paths.slashes(x))) == "b" and col(spark, "/r/s/a.py", lambda x: paths.relative(x, F.lit("/r/"))) == "s/a.py"


def test_texts(spark):
    assert col(spark, "12345678901", tx.tokens) == 2 and col(spark, None, tx.tokens) is None
    assert col(spark, "a\nb", lambda x: tx.numbered(x, F.lit(9))) == " 9: a\n10: b"
    assert col(spark, "  12: foo   bar ", tx.normalize_line) == "foo bar"
    assert col(spark, "x ```json\n{\"a\": 1}\n``` y", lambda x: tx.json_object(tx.fenced(x))) == '{"a": 1}'
    assert col(spark, "no json", tx.json_object) is None and col(spark, "line 42", tx.lenient_int) == 42
    assert col(spark, "sql_injection", tx.title) == "Sql Injection" and col(spark, 125, tx.duration, "int") == "2m 5s"
    assert col(spark, "a\n\n\n\nb=1 // c\r\n", lambda x: tx.normalize_source(x, F.lit("java"))) == "a\n\nb = 1"
    assert [col(spark, n, lambda x: tx.absolute_line(x, F.lit(10), F.lit(20)), "int") for n in (12, 3)] == [12, 12]
    assert col(spark, "1\n2\n3\n4", lambda x: tx.excerpt(x, F.lit(2), 1)) == "1: 1\n2: 2\n3: 3" and col(spark, "a\nb\nc", lambda x: tx.line_at(x, F.lit(5))) == 3


def test_snap(spark):
    src = "one\n  const  x = compute(1);\ny\nz\n7: const x = compute(1);\nabc"
    files = spark.createDataFrame([("f", src)], "file string, content string")
    data = [(1, "f", 3, "const x = compute(1);"), (2, "f", 2, "const x = compute(1);"), (3, "f", 90, "y"), (4, "f", 1, "nowhere"), (5, "g", 1, "y"), (6, "f", 1, " "), (7, "f", 1, None), (8, "f", 1, "x = compute(1);")]
    df = spark.createDataFrame(data, "id long, file string, line int, quote string")
    got = {r["id"]: (r["outcome"], r["snapped_line"]) for r in fd.snap_to_quotes(df, files, "file", "line", "quote", "content").collect()}
    assert got == {1: ("snapped", 2), 2: ("confirmed", 2), 3: ("too_far", 90), 4: ("quote_not_found", 1), 5: ("file_unreadable", 1), 6: ("without_quote", 1), 7: ("without_quote", 1), 8: ("snapped", 2)}


def test_sites_and_filters(spark):
    df = spark.createDataFrame([("a", n, "t", 0.5, i) for i, n in enumerate([1, 4, 7, 11, 11])] + [("a", None, "t", 0.9, 9), (None, 1, "t", 0.9, 10)], "file string, line int, type string, confidence double, ord long")
    assert rows(fd.sites(df, ["file"], "line")) == [("a", 1, 3, 3, 4), ("a", 11, 1, 2, 11)]
    kept, stats_row = fd.confidence_filter(df, "confidence", 0.6)
    assert kept.count() == 2 and tuple(stats_row.first()) == (True, 0.6, 7, 5, 2)
    kept, stats_row = fd.confidence_filter(df.limit(0), "confidence", 0.0)
    assert tuple(stats_row.first()) == (False, 0.0, 0, 0, 0)
    best = fd.best_of_key(df.dropna(), ["file", "line"], "confidence", "ord").orderBy("line").collect()
    assert [(r["line"], r["ord"]) for r in best] == [(1, 0), (4, 1), (7, 2), (11, 3)]


def test_suppression(spark):
    src = "// tool:ignore\na // tool:ignore xss\n  // tool:ignore-next-line sql_injection - checked by hand\nb\n# tool:ignore\n"
    df = spark.createDataFrame([(1, "javascript", src), (2, "python", src), (3, "c", src), (4, "java", None)], "id long, lang string, text string")
    d = fd.suppressions(df, "id", "lang", "text")
    assert rows(d) == [(1, 1, "all", None, "same", 1), (1, 4, "sql_injection", "checked by hand", "next", 3), (2, 5, "all", None, "same", 5)]
    f = spark.createDataFrame([(1, 1, "xss"), (1, 4, "xss"), (1, 4, "sql_injection"), (1, None, "xss"), (9, 1, "xss")], "id long, line int, type string")
    assert rows(fd.drop_suppressed(f, d, ["id"], "line", "type")) == [(1, 4, "xss"), (1, None, "xss"), (9, 1, "xss")]


def greedy(e, a, tol, nearest):
    used, out = set(), []
    for i, k, n in sorted(e):
        ok = [(abs(m - n), j) for j, kk, m in sorted(a) if kk == k and j not in used and abs(m - n) <= tol]
        if ok:
            j = min(ok)[1] if nearest else min(ok, key=lambda x: x[1])[1]
            used.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_matching_equals_loop(spark):
    rng = random.Random(5)
    e = [(i, rng.choice("ab"), rng.randrange(80)) for i in range(25)]
    a = [(i, rng.choice("ab"), rng.randrange(80)) for i in range(60)] + [(100 + i, "a", 40) for i in range(20)]
    schema = "id long, file string, line long"
    E, A = spark.createDataFrame(e + [(99, None, 1)], schema), spark.createDataFrame(a + [(999, "a", None)], schema)
    for nearest in (False, True):
        assert sorted(rows(matching.greedy_match(E, A, ["file"], 6, nearest))) == greedy(e, a, 6, nearest)
    pairs = matching.greedy_match(E, A, ["file"], 6)
    bad = A.withColumn("severity", F.when(F.col("id") % 2 == 0, "High").otherwise("low"))
    s = matching.scores(matching.match_counts(E, bad, pairs, ["file"])).first()
    used = {j for _, j in rows(pairs)}
    assert s["tp"] == len(used) and s["tp"] + s["fn"] == 26 and s["fp"] == len([1 for i, *_ in a if i % 2 == 0 and i not in used])


def test_matching_by_path_ends_and_by_thresholds(spark):
    rng = random.Random(8)
    paths_ = ["a.py", "src/a.py", "x/src/a.py", "ba.py", "lib/b.py", "b.py", "c.py"]
    e = [(i, rng.choice(paths_), rng.randrange(60), 0.0) for i in range(20)]
    a = [(i, rng.choice(paths_), rng.randrange(60), rng.choice([0.2, 0.5, 0.8, None])) for i in range(60)]
    schema = "id long, file string, line long, confidence double"
    E, A = spark.createDataFrame(e, schema).withColumn("repo", F.lit("r")), spark.createDataFrame(a, schema).withColumn("repo", F.lit("r"))

    def loop(found, tails):
        used, out = set(), []
        for i, f, n, _ in e:
            for j, g, m, _ in found:
                if j not in used and abs(m - n) <= 6 and (f == g or tails and (f.endswith(g) or g.endswith(f))):
                    used.add(j)
                    out.append((i, j))
                    break
        return out

    assert sorted(rows(matching.greedy_match(E, A, ["repo"], 6, tails=True))) == loop(a, True)
    got = rows(matching.greedy_match(E, A, ["repo", "file"], 6, thresholds=[0.5, 0.1]))
    assert sorted(got) == sorted((t, *p) for t in (0.1, 0.5) for p in loop([x for x in a if x[3] and x[3] >= t], False))


def test_path_ends_are_matched_in_few_jobs(spark):
    rng = random.Random(11)
    names = ["a.py", "ba.py", "b/a.py", "x/b/a.py", "y/b/a.py", "xb/a.py", "c.py", "/c.py", "q/c.py", "", "é.py", "aé.py", "z/é.py"]
    keys = [("r", "s"), ("r", "t"), ("q", None)]
    e = [(i, *rng.choice(keys), rng.choice(names), rng.randrange(90)) for i in range(60)]
    a = [(i, *rng.choice(keys), rng.choice(names), rng.randrange(90)) for i in range(150)]
    schema = "id long, repo string, type string, file string, line long"
    used, want = set(), []
    for i, *k, f, n in e:
        for j, *m, g, o in a:
            if j not in used and k == m and None not in k and f and g and abs(n - o) <= 6 and (f.endswith(g) or g.endswith(f)):
                used.add(j)
                want.append((i, j))
                break
    sc = spark.sparkContext
    sc.setJobGroup("path ends", "")
    try:
        pairs = matching.greedy_match(spark.createDataFrame(e, schema), spark.createDataFrame(a, schema), ["repo", "type"], 6, tails=True)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        got = rows(pairs)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == want
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # the size of a file says little of a path's memory
    # families are looked up, not spread from path to path round by round
    assert len(sc.statusTracker().getJobIdsForGroup("path ends")) <= 40


def test_kinds_of_false_positives(spark):
    f = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y"), (3, "a", 30, "x"), (4, "a", 200, "z"), (5, "a", 200, "z"), (6, "a", 300, "x"), (7, "b", 1, "x"), (8, "a", 500, "t"), (9, None, 1, "x")], "id long, file string, line long, type string")
    t = spark.createDataFrame([(10, "a", 5, "x", True), (11, "a", 500, "t", False)], "id long, file string, line long, type string, vulnerable boolean")
    pairs = spark.createDataFrame([(10, 1), (11, 8)], "expected_id long, actual_id long")
    assert rows(matching.false_positive_kinds(f, t, pairs)) == [(2, "wrong_type"), (3, "line_off"), (4, "duplicate_site"), (5, "duplicate_site"), (6, "gt_claimed_or_far"), (7, "no_nearby_gt"), (8, "fp_trap"), (9, "no_nearby_gt")]


def test_claims_and_components(spark):
    f = spark.createDataFrame([(1, "r", "a", 5, ["x"]), (2, "r", "a", 6, ["x", "y"]), (3, "r", "b", 5, ["x"])], "id long, repo string, file string, line int, kinds array<string>")
    t = spark.createDataFrame([(10, "r", "a", 4, None, ["x"], False), (11, "r", "a", 7, 9, ["x"], True)], "id long, repo string, file string, start_line int, end_line int, kinds array<string>, vulnerable boolean")
    assert rows(matching.claim_match(f, t, 3)) == [(1, 11), (2, 10)]
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7), (None, 1), (9, 8), (8, 6)], "a long, b long")
    assert rows(reporting.components(e, "a", "b")) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7), (8, 5), (9, 5)]


def test_statistics(spark):
    assert stats.sign_test(3, 0) == 0.25 and stats.sign_test(0, 0) == 1.0
    lo, hi = spark.range(1).select(*stats.wilson(F.lit(42), F.lit(55))).first()
    assert abs(lo - 0.6365) < 2e-3 and abs(hi - 0.8559) < 3e-3
    assert spark.range(1).select(stats.f_beta(F.lit(0), F.lit(0), F.lit(0))).first()[0] == 0.0
    assert list(stats.resamples(2, 2, 7)) == list(stats.resamples(2, 2, 7)) and {s for *_, s in stats.sign_flips(3, 9, 1)} == {1, -1}


def test_resamples_in_blocks(spark):
    for units, iterations in ((3, 5), (64, 40), (397, 600), (1, 3)):
        assert rows(stats.resample_table(spark, units, iterations, 7)) == sorted(stats.resamples(units, iterations, 7), key=repr)
    assert len(list(stats.resample_blocks(397, 600, 7))) > 1 and stats.resample_table(spark, 0, 5, 7).count() == 0


def test_bootstrap_takes_ten_thousand_draws_and_order_statistics(spark):
    d = "/root/testdata/sf0.001"
    e, a = catalog._sides(spark, d)
    counts = [tuple(r)[1:] for r in matching.match_counts(e, a, matching.greedy_match(e, a, catalog.KEY, 20), ["repo"]).orderBy("repo").collect()]
    rng, f1 = random.Random(7), []
    for _ in range(10_000):
        drawn = [counts[rng.randrange(len(counts))] for _ in counts]
        tp, fp, fn = (sum(x) for x in zip(*drawn))
        f1.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    f1.sort()
    assert tuple(catalog.bootstrap_f1(spark, d).first()) == (10_000, round(f1[250], 6), round(f1[9750], 6))


def test_retrieval(spark):
    kb = spark.createDataFrame([("a", "sql injection query"), ("b", "cross site script"), ("c", "sql sql"), ("d", None), ("e", "")], "kb string, text string")
    idx = retrieval.postings(kb, "kb", F.col("text"))
    q = spark.createDataFrame([(1, "SQL query"), (2, "SQL query"), (3, "none"), (4, None)], "id long, q string")
    got = rows(retrieval.top_k(q, "id", F.col("q"), idx, 2))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "a", 1), (1, "c", 2), (2, "a", 1), (2, "c", 2)]
    kind = "es array<struct<id:string,title:string,description:string,patterns:array<string>>>"
    es = spark.createDataFrame([([("i", "t", "d" * 300, ["p" * 50, "q" * 50]), (None, None, "e" * 150, ["r" * 80])],), ([("i", "t", None, ["p" * 400, "q" * 300])],), ([],), ([("", "", "é" * 3500, [])],)], kind)
    cut = [r[0] for r in es.select(retrieval.within_budget(F.col("es"), 520)).collect()]
    assert cut[0][0]["description"] == "d" * 222 + "..." and cut[0][1]["description"] == "e" * 110 + "..." and len(cut[0][0]["patterns"]) == 2
    assert cut[1][0]["patterns"] == ["p" * 400] and cut[2] == [] and cut[3][0]["description"] == "é" * 258 + "..."
    assert [r[0] for r in spark.createDataFrame([("é" * 150,), ("a" * 9,), (None,)], "t string").select(tx.truncated(F.col("t"), 200)).collect()] == ["é" * 98 + "...", "a" * 9, None]
    assert spark.createDataFrame([("a€b",)], "t string").select(*[tx.first_bytes(F.col("t"), F.lit(k)) for k in range(6)]).first()[:] == ("", "a", "a", "a", "a€", "a€b")


def test_redaction(spark):
    src = "a = 1 # api_key = 'aaaabbbbccccdddd1'\napi_key = 'abcdefgh12345678'\npassword: \"hunter2secret\"\nu = 'postgresql://u:pw@h/db'\npassword = '${X}'\n"
    df = spark.createDataFrame([(1, "python", src, 10), (2, "c", None, None), (3, "c", "", 1)], "id long, lang string, text string, start int")
    got = {r["id"]: r for r in redaction.redact(df, "id", "lang", "text", "start").collect()}
    assert [(e["line"], e["type"]) for e in got[1]["events"]] == [(11, "api_key"), (12, "password"), (13, "connection_string")]
    assert "aaaabbbb" in got[1]["redacted_source"] and "abcdefgh" not in got[1]["redacted_source"] and got[2]["redacted_source"] is None and got[3]["redacted_source"] == ""
    assert rows(redaction.counts(redaction.redact(df, "id", "lang", "text"))) == [("api_key", 1, 1), ("connection_string", 1, 1), ("password", 1, 1)]


def test_usage_and_reports(spark):
    u = spark.createDataFrame([(1, "a", 1_000_000, 0), (2, "b", 0, 500_000), (3, "llama-x", 5, 5), (4, "z", 1_000_000, 0)], "id long, model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("a", 2.0, 4.0), ("b", 1.0, 3.0)], "model string, input_price double, output_price double")
    c = usage.call_cost(u, prices, (9.0, 9.0), ("llama",))
    assert [r["cost"] for r in c.orderBy("id").collect()] == [2.0, 1.5, 0.0, 9.0]
    choice = {r["id"]: r["choice"] for r in usage.model_choice(c, ["id"], "cost", 2.0, 3.5).collect()}
    assert choice == {1: "primary", 2: "fallback", 3: "stopped", 4: "stopped"}
    assert rows(usage.milestones(c, ["id"], "cost", 4.0)) == [(0.5, 1), (0.8, 2), (1.0, 4)]
    files = spark.createDataFrame([("f", "a\nb"), ("g", "x")], "file string, text string")
    notes = spark.createDataFrame([("f", 2, "# two"), ("f", 1, "# one")], "file string, line int, note string")
    assert rows(reporting.annotated(files, notes, "file", "text")) == [("f", "# one\na\n# two\nb"), ("g", "x")]
    votes = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "b", 3), (1, "a", 4)], "site long, vote string, ord long")
    assert rows(matching.plurality(votes, ["site"], "vote", "ord")) == [(1, "b", 0.5)]
