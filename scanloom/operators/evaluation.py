"""Comparing runs: confusion, means over runs, resampling, cumulative shares, callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.stats import precision, ratio, recall, sign_flips
from scanloom.operators.matching import scores


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall; rows with a null on either side don't count."""
    t, s = truth.cast("boolean"), said.cast("boolean")
    n = {"tp": F.count_if(t & s), "fp": F.count_if(~t & s), "fn": F.count_if(t & ~s), "tn": F.count_if(~t & ~s)}
    out = df.where(t.isNotNull() & s.isNotNull()).agg(*[v.alias(k) for k, v in n.items()])
    c = F.col
    all_ = c("tp") + c("fp") + c("fn") + c("tn")
    return out.withColumns({"accuracy": F.round(ratio(c("tp") + c("tn"), all_), 6), "precision": F.round(precision(c("tp"), c("fp")), 6), "recall": F.round(recall(c("tp"), c("fn")), 6)})


def mean_over_runs(counts: DataFrame, unit: str, run: str) -> DataFrame:
    """(unit, runs, tp, fp, fn as means): counts are summed in a run, then averaged over the unit's runs."""
    per = counts.groupBy(unit, run).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return per.groupBy(unit).agg(F.count("*").alias("runs"), *[F.round(F.avg(k), 6).alias(k) for k in ("tp", "fp", "fn")])


def micro(counts: DataFrame) -> DataFrame:
    """Scores of all counts together."""
    return scores(counts)


def paired(a: DataFrame, b: DataFrame, unit: str) -> DataFrame:
    """(unit, a_tp, a_fp, a_fn, b_tp, b_fp, b_fn): two runs side by side, a unit that one lacks counts as zeros."""
    side = lambda df, p: df.select(unit, *[F.col(k).alias(f"{p}_{k}") for k in ("tp", "fp", "fn")])
    j = side(a, "a").join(side(b, "b"), unit, "full_outer")
    return j.select(unit, *[F.coalesce(f"{p}_{k}", F.lit(0)).alias(f"{p}_{k}") for p in "ab" for k in ("tp", "fp", "fn")])


def permutation_test(pairs: DataFrame, unit: str, iterations: int = 10_000, seed: int = 7) -> DataFrame:
    """One row: f1_a, f1_b, delta, p of a paired sign-flip test: in each iteration units swap sides at random.

    Flips come from the standard library's generator, so that a run can be replayed; units are numbered in their order.
    They are evaluation units (repositories of a benchmark), whose number is checked.
    """
    spark = pairs.sparkSession
    units = [r[0] for r in pairs.select(unit).distinct().orderBy(unit).limit(10_001).collect()]
    if len(units) > 10_000:
        raise ValueError("more than 10,000 units: resample groups of them")
    numbered = spark.createDataFrame(list(enumerate(units)), f"__u int, {unit} {dict(pairs.dtypes)[unit]}")
    flips = spark.createDataFrame(list(sign_flips(len(units), iterations, seed)) or [(0, 0, 1)], "it int, __u int, sign int")
    pick = lambda k, s: F.sum(F.when(F.col("sign") == s, F.col(f"a_{k}")).otherwise(F.col(f"b_{k}"))).alias(f"{'x' if s == 1 else 'y'}_{k}")
    f1 = lambda p: ratio(2.0 * F.col(f"{p}_tp"), 2.0 * F.col(f"{p}_tp") + F.col(f"{p}_fp") + F.col(f"{p}_fn"))
    drawn = flips.join(pairs.join(numbered, unit), "__u").groupBy("it").agg(*[pick(k, s) for s in (1, -1) for k in ("tp", "fp", "fn")])
    real = pairs.agg(*[F.sum(f"{p}_{k}").alias(f"{p}_{k}") for p in "ab" for k in ("tp", "fp", "fn")]).select(f1("a").alias("f1_a"), f1("b").alias("f1_b"))
    d = F.abs(f1("x") - f1("y"))
    both = drawn.select(d.alias("d")).crossJoin(F.broadcast(real))  # one row
    return both.groupBy("f1_a", "f1_b").agg((F.count_if(F.col("d") >= F.abs(F.col("f1_a") - F.col("f1_b")) - 1e-12) / F.count("*")).alias("p")).select("f1_a", "f1_b", (F.col("f1_a") - F.col("f1_b")).alias("delta"), "p")


def cumulative_share(counts: DataFrame, name: str, n: str) -> DataFrame:
    """(name, n, running, share) in order of n: how far the most frequent kinds alone go.  Kinds are few."""
    w = Window.orderBy(F.desc(n), name)
    total = counts.agg(F.sum(n).alias("__all"))
    out = counts.withColumn("running", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    return out.withColumn("share", F.round(ratio(F.col("running"), F.col("__all")), 6)).drop("__all")


def callers(functions: DataFrame, files: DataFrame, most: int = 2) -> DataFrame:
    """(function, file, line): lines of other places that call a function by name, the first ``most`` of each function.

    ``functions``: name, file, start_line, end_line.  ``files``: file, content.  Names of calls are taken out of the
    lines once and joined by name; a function's own lines don't count.
    """
    ls = files.select("file", F.posexplode(F.split("content", "\n")).alias("i", "t"))
    calls = ls.select("file", (F.col("i") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("name"))
    f = functions.select("name", F.col("file").alias("own"), "start_line", "end_line")
    j = calls.join(f, "name").where((F.col("file") != F.col("own")) | ~F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = j.groupBy("name", "own", "start_line", "file").agg(F.min("line").alias("line"))
    w = Window.partitionBy("name", "own", "start_line").orderBy("file", "line")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select(F.col("name").alias("function"), "own", "file", "line")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows for reading, the same for a seed whatever the partitions: those with the least salted digests of their id."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def replayed_sample(df: DataFrame, id_col: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows as the standard library's generator draws them from the rows in order of their id; all where there are fewer.

    The drawn positions are few and go to the executors; the rows are numbered by a running total and stay there.
    """
    import random

    from scanloom.operators.ordered import running_total

    numbered = running_total(df.withColumn("__one", F.lit(1)), [id_col], {"__at": F.col("__one")}).drop("__one")
    total = df.count()
    picked = random.Random(seed).sample(range(total), min(n, total))
    drawn = df.sparkSession.createDataFrame([(float(p + 1),) for p in picked], "__at double")
    return numbered.join(F.broadcast(drawn), "__at", "left_semi").drop("__at")  # n positions


def wrong_type_pairs(findings: DataFrame, truth: DataFrame, kinds: DataFrame, near: int = 10, k: int = 8) -> DataFrame:
    """(said, truth, findings): the k most frequent pairs of types among findings of the category wrong_type.

    ``kinds`` (id, category) as of ``false_positive_kinds``; a finding counts with the first label of another type within ``near`` lines.
    """
    f = kinds.where("category = 'wrong_type'").select("id").join(findings.select("id", "file", "line", F.col("type").alias("said")), "id")
    cell = lambda c: F.floor(c / (near + 1)).cast("long")
    t = truth.select(F.col("id").alias("t"), "file", F.col("line").alias("tl"), F.col("type").alias("tt")).withColumn("cell", F.explode(F.array(*[cell(F.col("tl")) + d for d in (-1, 0, 1)])))
    j = f.withColumn("cell", cell(F.col("line"))).join(t, ["file", "cell"]).where((F.col("tt") != F.col("said")) & (F.abs(F.col("tl") - F.col("line")) <= near))
    first = j.groupBy("id", "said").agg(F.min_by("tt", "t").alias("truth"))
    return first.groupBy("said", "truth").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "said", "truth").limit(k)


def upper_bounds(categories: DataFrame, tp: int, fp: int, fn: int) -> DataFrame:
    """(category, findings, running, precision, f1) if the most frequent categories were gone, one after the other, recall held."""
    out = cumulative_share(categories, "category", "findings").drop("share")
    left = F.greatest(F.lit(fp) - F.col("running"), F.lit(0))
    rec = tp / (tp + fn) if tp + fn else 0.0
    p = ratio(F.lit(float(tp)), F.lit(tp) + left)
    return out.withColumns({"precision": F.round(p, 6), "f1": F.round(ratio(2 * p * rec, p + rec), 6)})


def callees(functions: DataFrame, most: int = 2) -> DataFrame:
    """(function, own, callee, file): functions of other names that a function's source calls by name, the first ``most`` of each.

    ``functions``: name, file, start_line, source.  Names of calls are taken out of each source once and joined by name.
    """
    called = F.array_distinct(F.regexp_extract_all("source", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))
    calls = functions.select(F.col("name").alias("function"), F.col("file").alias("own"), "start_line", F.explode(called).alias("name"))
    where = functions.groupBy("name").agg(F.min("file").alias("file"))
    j = calls.where(F.col("name") != F.col("function")).join(where, "name")
    w = Window.partitionBy("own", "start_line", "function").orderBy("name")
    return j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("function", "own", F.col("name").alias("callee"), "file")


def context(parts: DataFrame, key: list[str], text: str, order: list[str], most: int = 4, budget: int = 2400) -> DataFrame:
    """(key, parts, text): the first ``most`` texts of each key that fit a budget of characters together, one behind the other."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = parts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    packed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", F.col(text).alias("t")))).alias("ps"))  # at most ``most``
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    fold = F.aggregate("ps", zero, lambda a, p: F.when(a["n"] + F.length(p["t"]) <= budget, F.struct((a["n"] + F.length(p["t"])).alias("n"), F.concat(a["out"], F.array(p["t"])).alias("out"))).otherwise(a))
    return packed.select(*key, F.size(fold["out"]).alias("parts"), F.array_join(fold["out"], "\n").alias("text"))


def refuse_incomplete(folders: list[str], marker: str = "INCOMPLETE") -> None:
    """Raise if a run's folder holds the marker of failed calls: its figures must not be compared."""
    import os

    bad = [f for f in folders if os.path.exists(os.path.join(f, marker))]
    if bad:
        raise ValueError(f"incomplete runs: {', '.join(bad)}")
