from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from scanloom.operators import cache, evaluation

C = "unit string, run int, tp int, fp int, fn int"


def test_confusion_and_means(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0), (None, 1)], "t int, s int")
    assert tuple(evaluation.confusion(df, F.col("t"), F.col("s")).first()) == (1, 1, 1, 2, 0.6, 0.5, 0.5)
    c = spark.createDataFrame([("a", 1, 1, 0, 0), ("a", 1, 1, 0, 0), ("a", 2, 0, 1, 0), ("b", 1, 0, 0, 3)], C)
    assert rows(evaluation.mean_over_runs(c, "unit", "run")) == [("a", 2, 1.0, 0.5, 0.0), ("b", 1, 0.0, 0.0, 3.0)]
    assert evaluation.micro(c).first()["tp"] == 2


def test_permutation(spark):
    a = spark.createDataFrame([(f"u{k}", 0, 9, 0, 1) for k in range(8)], C)
    b = spark.createDataFrame([(f"u{k}", 0, 2, 5, 8) for k in range(7)], C)
    p = evaluation.paired(a, b, "unit")
    assert p.where("unit = 'u7'").first()["b_tp"] == 0
    r = evaluation.permutation_test(p, "unit", 400, 7).first()
    assert r["f1_a"] > r["f1_b"] and r["p"] < 0.05
    assert evaluation.permutation_test(evaluation.paired(a, a, "unit"), "unit", 50, 7).first()["p"] == 1.0


def test_shares_callers_samples(spark):
    c = spark.createDataFrame([("x", 1), ("y", 3), ("z", 4)], "kind string, n long")
    assert [tuple(r)[2:] for r in evaluation.cumulative_share(c, "kind", "n").orderBy("running").collect()] == [(4, 0.5), (7, 0.875), (8, 1.0)]
    f = spark.createDataFrame([("go", "a.py", 1, 2)], "name string, file string, start_line int, end_line int")
    t = spark.createDataFrame([("a.py", "def go():\n  go()\nx = go(1)"), ("b.py", "go()\nlong_go()"), ("c.py", "go()"), ("d.py", None)], "file string, content string")
    assert rows(evaluation.callers(f, t)) == [("go", "a.py", "a.py", 3), ("go", "a.py", "b.py", 1)]
    ids = spark.range(100)
    assert rows(evaluation.seeded_sample(ids, "id", 5, 1)) == rows(evaluation.seeded_sample(ids.repartition(7), "id", 5, 1)) != rows(evaluation.seeded_sample(ids, "id", 5, 2))


def test_cache(spark):
    now = F.lit(datetime(2025, 2, 1))
    e = spark.createDataFrame([("k1", datetime(2025, 1, 20), "old"), ("k1", datetime(2025, 1, 30), "new"), ("k2", datetime(2024, 1, 1), "stale")], "key string, stored_at timestamp, response string")
    w = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, None)], "id long, key string")
    hit, miss = cache.lookup(w, e, now)
    assert rows(hit.select("id", "response")) == [(1, "new")] and rows(miss.select("id")) == [(2,), (3,)]
    assert tuple(cache.statistics(e, now).first())[:3] == (3, 1, 11)
    assert tuple(cache.hits_if_cached(w.union(w), "key").first()) == (6, 3, 3) and tuple(cache.hits_if_cached(w.limit(0), "key").first()) == (0, 0, 0)
    k = spark.range(1).select(cache.shard(cache.response_key(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0]
    assert len(k) == 2
