"""Findings against labels: greedy one-to-one matching and the metrics of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scanloom.functions.stats import f_beta, precision, ratio, recall
from scanloom.operators.ordered import islands
from scanloom.session import release, settle

#: Parts of a line's findings that are cut by themselves first, so that a hot line is no single task.
SALTS = 32
#: F1 from which a comparison of one type passes.
LEAST_F1 = 0.45


def _first(df: DataFrame, place: list[str], most: str) -> DataFrame:
    """The rows of each place with the lowest ids, as many as its column ``most`` says; parts of a place are cut first."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in ([*place, "__salt"], place):
        salted = salted.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("__r") <= F.col(most)).drop("__r")
    return salted.drop("__salt")


def _ends(paths: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """(key, file, tail): the ends of each path that are known paths of its key; only ends as long as one of these are looked up."""
    sizes = known.groupBy(*key).agg(F.collect_set(F.length("file")).alias("__sizes"))
    tails = F.transform(F.filter("__sizes", lambda n: n <= F.length("file")), lambda n: F.right(F.col("file"), n))
    return paths.join(sizes.hint("merge"), key).select(*key, "file", F.explode(tails).alias("tail")).join(known.withColumnRenamed("file", "tail").hint("merge"), [*key, "tail"])


def path_families(labels: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(key, file, family): paths of labels and of findings (both: key, file), so that of one key those of which one is the end of the other share a family.

    The ends of a path are ends of each other, so the shortest known one names the family and nothing is followed from
    path to path.  Known are the labels' paths and the findings' that are ends of these; a finding without a known end
    can meet no label and stays out, as does an empty path.
    """
    labels, found = (df.select(*key, "file").where("file <> ''").distinct() for df in (labels, found))
    known = settle(labels.union(_ends(labels, found, key).select(*key, F.col("tail").alias("file"))).distinct())
    return _ends(labels.union(found).distinct(), known, key).groupBy(*key, "file").agg(F.min_by("tail", F.length("tail")).alias("family"))


def greedy_match(
    expected: DataFrame, actual: DataFrame, key: list[str], tolerance: int, nearest: bool = False, tails: bool = False, thresholds: list[float] | None = None
) -> DataFrame:
    """([threshold,] expected_id, actual_id): labels in order of id each take one finding of their key within ``tolerance`` lines.

    Both sides have id, key and line.  A label takes the free finding with the lowest id, or, if ``nearest``, the one
    with the least distance (then the lowest id).  Greedy, not the largest matching.  Rows with nulls match nothing.
    ``tails``: both sides have ``file`` beside the key, and one path must be the end of the other.
    ``thresholds``: findings have confidence, and the matching is done anew among those that reach each threshold.

    Lines further apart than the tolerance can't meet, so a key falls into islands that are matched alone.  Of
    findings on one line (of one file and reaching the same thresholds) at most as many as the island has labels can be taken, so
    the rest never leave their partition: that cut is exact.
    """
    bars = sorted(thresholds or [0.0])
    band = F.size(F.filter(F.array(*[F.lit(float(t)) for t in bars]), lambda t: F.col("confidence") >= t)) if thresholds else F.lit(1)
    whole = ["id", "line", *key, *["file"] * tails]
    path = F.col("file") if tails else F.lit("")
    e = expected.dropna(subset=whole).select("id", "line", *key, path.alias("__path"), F.lit(0).alias("band"))
    a = actual.dropna(subset=whole).select("id", "line", *key, path.alias("__path"), band.alias("band")).where("band > 0")
    if tails:
        both = settle(e.unionByName(a))
        family = path_families(*(both.where(side).withColumnRenamed("__path", "file") for side in ("band = 0", "band > 0")), key).withColumnRenamed("file", "__path")
        placed = settle(both.join(family.hint("merge"), [*key, "__path"]))
        release(both)
        e, a, key = placed.where("band = 0"), placed.where("band > 0"), [*key, "family"]
    # settled paths take several times their files' bytes in memory, so no side is broadcast on the size of its files
    side = lambda df: df.hint("merge") if tails else df
    lines = side(islands(e.select(*key, "line").union(a.select(*key, "line")).distinct(), key, "line", tolerance))
    e = e.join(lines, [*key, "line"])
    labels = side(e.groupBy(*key, "island").agg(F.count("*").alias("labels")))
    a = _first(a.join(lines, [*key, "line"]).join(labels, [*key, "island"]), [*key, "line", "__path", "band"], "labels")
    cols = [*key, "island", "line", "id", "__path", "band"]
    schema = T.StructType([T.StructField("bar", T.IntegerType()), T.StructField("expected_id", expected.schema["id"].dataType), T.StructField("actual_id", actual.schema["id"].dataType)])
    pick = lambda side: F.array_sort(F.collect_list(F.when((F.col("band") == 0) == F.lit(side == 0), F.struct("id", "line", F.col("__path").alias("file"), "band"))))
    rows = e.select(*cols).unionByName(a.select(*cols)).groupBy(*key, "island").agg(pick(0).alias("e"), pick(1).alias("a")).where("size(e) > 0 AND size(a) > 0").select("e", "a")
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    n_bars = len(bars)

    def fold(labels: list[dict], found: list[dict]) -> Iterator[tuple]:
        free = [(x["line"], x["id"], x["file"]) for x in found]
        for x in labels:
            best = None
            for k, (line, _, file) in enumerate(free):
                d = abs(line - x["line"])
                if d <= tolerance and (best is None or d < best[0]) and (file.endswith(x["file"]) or x["file"].endswith(file)):
                    best = (d, k)
                    if not nearest:
                        break
            if best is not None:
                yield x["id"], free.pop(best[1])[1]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for labels, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for bar in range(1, n_bars + 1):
                    out += [(bar - 1, *p) for p in fold(labels, [x for x in found if x["band"] >= bar])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["bar", "expected_id", "actual_id"])

    pairs = rows.mapInArrow(match, schema)
    if not thresholds:
        return pairs.select("expected_id", "actual_id")
    return pairs.select(F.element_at(F.array(*[F.lit(float(t)) for t in bars]), F.col("bar") + 1).alias("threshold"), "expected_id", "actual_id")


def claim_match(findings: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """(finding_id, truth_id): findings in order of id each claim one free entry of their repo and file whose kinds overlap.

    ``findings``: id, repo, file, line, kinds (array).  ``truth``: id, repo, file, start_line, end_line, kinds,
    vulnerable.  An entry spans its lines, widened by ``tolerance``; vulnerable entries are preferred, then lower ids.
    Spans that don't overlap are claimed apart; of findings on one line with equal kinds only as many as there are
    entries in their stretch can claim one, so the rest stay behind.
    """
    key = ["repo", "file"]
    kinds = F.array_sort(F.array_distinct("kinds"))
    f = findings.dropna(subset=["id", "repo", "file", "line", "kinds"]).select("id", *key, F.col("line").alias("lo"), F.col("line").alias("hi"), kinds.alias("kinds"))
    end = F.greatest(F.coalesce("end_line", "start_line"), F.col("start_line"))
    t = truth.dropna(subset=["id", "repo", "file", "start_line", "kinds"]).select(
        "id", *key, (F.col("start_line") - tolerance).alias("lo"), (end + tolerance).alias("hi"), kinds.alias("kinds"), F.coalesce("vulnerable", F.lit(False)).alias("v")
    )
    w = Window.partitionBy(*key).orderBy("lo", "hi")
    spans = f.select(*key, "lo", "hi").union(t.select(*key, "lo", "hi")).distinct()
    spans = spans.withColumn("reach", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("head", F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), F.col("lo")))
    spans = spans.withColumn("stretch", F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*key, "lo", "hi", "stretch")
    t = t.join(spans, [*key, "lo", "hi"])
    most = t.groupBy(*key, "stretch").agg(F.count("*").alias("entries"))
    f = _first(f.join(spans, [*key, "lo", "hi"]).join(most, [*key, "stretch"]), [*key, "lo", "kinds"], "entries")
    ts = t.groupBy(*key, "stretch").agg(F.array_sort(F.collect_list(F.struct((~F.col("v")).alias("n"), "id", "lo", "hi", "kinds"))).alias("t"))
    fs = f.groupBy(*key, "stretch").agg(F.array_sort(F.collect_list(F.struct("id", "lo", "kinds"))).alias("f"))
    schema = T.StructType([T.StructField("finding_id", findings.schema["id"].dataType), T.StructField("truth_id", truth.schema["id"].dataType)])
    types = [to_arrow_type(x.dataType) for x in schema.fields]

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for found, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in found:
                    at = next((k for k, y in enumerate(entries) if y["lo"] <= x["lo"] <= y["hi"] and not set(x["kinds"]).isdisjoint(y["kinds"])), None)
                    if at is not None:
                        left.append(x["id"])
                        right.append(entries.pop(at)["id"])
            yield pa.RecordBatch.from_arrays([pa.array(left, types[0]), pa.array(right, types[1])], names=["finding_id", "truth_id"])

    return fs.join(ts, [*key, "stretch"]).select("f", "t").mapInArrow(claim, schema)


def scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and F2 (times 100) from summed columns tp, fp, fn, for each group of ``by``."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    out = df.groupBy(*(by or [])).agg(tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": F.round(precision(t, p), 6), "recall": F.round(recall(t, n), 6), "f1": F.round(f_beta(t, p, n), 6), "f2": F.round(f_beta(t, p, n, 2) * 100, 6)})


def severe(severity: Column) -> Column:
    """Whether an unmatched finding counts against a scan: high or critical, in any case."""
    return F.coalesce(F.lower(severity).isin("high", "critical"), F.lit(False))


def match_counts(expected: DataFrame, actual: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn): hits and misses of labels and ``severe`` findings without a label, for each group of ``by``."""
    hit = pairs.select(F.col("expected_id").alias("id"), F.lit(1).alias("hit"))
    e = expected.join(hit, "id", "left").select(*by, F.coalesce("hit", F.lit(0)).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("hit").isNull(), 1).otherwise(0).alias("fn"))
    used = pairs.select(F.col("actual_id").alias("id"))
    a = actual.where(severe(F.col("severity"))).join(used, "id", "left_anti").select(*by, F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    return e.unionByName(a).groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def threshold_sweep(expected: DataFrame, actual: DataFrame, key: list[str], tolerance: int, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, scores): the matching is done anew for each threshold, all in one pass over the islands."""
    spark = expected.sparkSession
    pairs = greedy_match(expected, actual, key, tolerance, thresholds=thresholds)
    mine = actual.where(severe(F.col("severity"))).select(F.col("id").alias("actual_id"), F.lit(1).alias("bad"))
    hits = pairs.join(mine, "actual_id", "left").groupBy("threshold").agg(F.count("*").alias("tp"), F.count("bad").alias("spent"))
    all_ = actual.where(severe(F.col("severity"))).agg(*[F.count_if(F.col("confidence") >= float(t)).alias(str(k)) for k, t in enumerate(thresholds)])
    bad = all_.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(str(k)).alias("bad")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")
    wanted = expected.agg(F.count("*").alias("labels"))
    rows = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double").join(hits, "threshold", "left").join(bad, "threshold").crossJoin(F.broadcast(wanted))  # one row
    tp, spent = F.coalesce("tp", F.lit(0)), F.coalesce("spent", F.lit(0))
    return scores(rows.select("threshold", tp.alias("tp"), (F.col("bad") - spent).alias("fp"), (F.col("labels") - tp).alias("fn")), ["threshold"])


def confidence_mismatches(expected: DataFrame, actual: DataFrame, pairs: DataFrame) -> DataFrame:
    """(expected_id, actual_id, expected_confidence, actual_confidence) of pairs whose finding is less sure than its label asks."""
    e = expected.select(F.col("id").alias("expected_id"), F.col("confidence_min").alias("expected_confidence"))
    a = actual.select(F.col("id").alias("actual_id"), F.col("confidence").alias("actual_confidence"))
    return pairs.join(e, "expected_id").join(a, "actual_id").where("actual_confidence < expected_confidence").select("expected_id", "actual_id", "expected_confidence", "actual_confidence")


def comparison(expected: DataFrame, actual: DataFrame, pairs: DataFrame, unit: str) -> DataFrame:
    """(unit, expected, actual, matched, missing, extra, extra_typed, mismatches, scores, typed scores, success) of each unit.

    Extra findings are severe ones without a label; typed ones have the type of the unit's first label, since other
    types are outside what a benchmark of one type labels.  A comparison passes from LEAST_F1 on without mismatches.
    Units of either side come out; a null unit is none.
    """
    first = expected.groupBy(unit).agg(F.min_by("type", "id").alias("kind"), F.count("*").alias("expected"))
    seen = actual.groupBy(unit).agg(F.count("*").alias("actual"))
    hits = expected.join(pairs.select(F.col("expected_id").alias("id")), "id", "left_semi").groupBy(unit).agg(F.count("*").alias("matched"))
    low = confidence_mismatches(expected, actual, pairs).select(F.col("expected_id").alias("id"))
    low = expected.join(low, "id", "left_semi").groupBy(unit).agg(F.count("*").alias("mismatches"))
    free = actual.where(severe(F.col("severity"))).join(pairs.select(F.col("actual_id").alias("id")), "id", "left_anti")
    free = free.groupBy(unit, "type").agg(F.count("*").alias("n")).join(first.select(unit, "kind"), unit, "left")
    extra = free.groupBy(unit).agg(F.sum("n").alias("extra"), F.sum(F.when(F.col("kind").isNull() | (F.col("type") == F.col("kind")), F.col("n")).otherwise(0)).alias("extra_typed"))
    out = first.drop("kind").join(seen, unit, "full_outer")
    for side in (hits, extra, low):
        out = out.join(side, unit, "left")
    numbers = ("expected", "actual", "matched", "extra", "extra_typed", "mismatches")
    out = out.where(F.col(unit).isNotNull()).select(unit, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers]).withColumn("missing", F.col("expected") - F.col("matched"))
    t, n = F.col("matched"), F.col("missing")
    made = {}
    for tag, p in (("", F.col("extra")), ("_typed", F.col("extra_typed"))):
        made |= {f"precision{tag}": F.round(precision(t, p), 6), f"f1{tag}": F.round(f_beta(t, p, n), 6)}
    out = out.withColumns(made | {"recall": F.round(recall(t, n), 6)})
    return out.withColumn("success", (f_beta(t, F.col("extra_typed"), n) >= LEAST_F1) & (F.col("mismatches") == 0))


def false_positive_kinds(findings: DataFrame, truth: DataFrame, pairs: DataFrame, near: int = 10, far: int = 30) -> DataFrame:
    """(id, category) of findings without a real label: fp_trap, wrong_type, line_off, duplicate_site, gt_claimed_or_far or no_nearby_gt, in this order.

    ``findings``: id, file, line, type, all of them; ``truth``: id, file, line, type, vulnerable; ``pairs``: expected_id,
    actual_id.  A finding matched to a label that is not vulnerable fell into a trap.  A real label of another type
    within ``near`` lines makes a wrong type, one of the type beyond ``near`` and within ``far`` a wrong line, another finding on
    the line a duplicate, one of the type anywhere in the file a claimed or far one.  Labels are reduced to distinct
    file, type and line, and only those within ``far`` lines meet a finding.  Findings without file, line or type have
    no neighbours; a null ``vulnerable`` counts as real.
    """
    real = truth.where(F.coalesce("vulnerable", F.lit(True)))
    matched = pairs.join(truth.select(F.col("id").alias("expected_id"), F.coalesce("vulnerable", F.lit(True)).alias("real")), "expected_id").select(F.col("actual_id").alias("id"), "real")
    f = findings.select("id", "file", "line", "type").join(matched, "id", "left").where("NOT coalesce(real, false)").withColumn("trap", F.col("real").isNotNull()).drop("real")
    t = real.dropna(subset=["file", "line", "type"]).select("file", F.col("line").alias("tl"), F.col("type").alias("tt")).distinct()
    cell = lambda c: F.floor(c / (far + 1)).cast("long")
    cells = t.withColumn("cell", F.explode(F.array(cell(F.col("tl")) - 1, cell(F.col("tl")), cell(F.col("tl")) + 1)))
    places = f.select("file", "line", "type").dropna().distinct().withColumn("cell", cell(F.col("line")))
    d, same = F.abs(F.col("tl") - F.col("line")), F.col("tt") == F.col("type")
    flags = places.join(cells, ["file", "cell"]).groupBy("file", "line", "type").agg(F.max(~same & (d <= near)).alias("wrong"), F.max(same & (d > near) & (d <= far)).alias("off"))
    crowd = findings.groupBy("file", "line").agg((F.count("*") > 1).alias("crowd"))
    kinds = t.select("file", F.col("tt").alias("type"), F.lit(True).alias("claimed")).distinct()
    j = f.join(flags, ["file", "line", "type"], "left").join(crowd, ["file", "line"], "left").join(kinds, ["file", "type"], "left")
    name = F.when(F.col("trap"), "fp_trap")
    for c, label in (("wrong", "wrong_type"), ("off", "line_off"), ("crowd", "duplicate_site"), ("claimed", "gt_claimed_or_far")):
        name = name.when(F.coalesce(c, F.lit(False)), label)
    return j.select("id", name.otherwise("no_nearby_gt").alias("category"))


def file_detection(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: labelled_files, found_files, rate, other_files, from the distinct ``file`` of both sides; null files don't count."""
    e = expected.select("file").dropna().distinct().withColumn("e", F.lit(1))
    a = actual.select("file").dropna().distinct().withColumn("a", F.lit(1))
    n, hit = F.count("e"), F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull())
    return e.join(a, "file", "full_outer").agg(n.alias("labelled_files"), hit.alias("found_files"), F.round(ratio(hit, n), 6).alias("rate"), F.count_if(F.col("e").isNull()).alias("other_files"))


def plurality(votes: DataFrame, key: list[str], vote: str, order: str) -> DataFrame:
    """(key, vote, agreement): the most frequent vote, the earliest on ties, and its share."""
    n = votes.groupBy(*key, vote).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    best = n.groupBy(*key).agg(F.max_by(F.struct(vote, "n"), F.struct("n", -F.col("at"))).alias("x"), F.sum("n").alias("all"))
    return best.select(*key, F.col(f"x.{vote}").alias(vote), F.round(F.col("x.n") / F.col("all"), 6).alias("agreement"))


def tenth(value: Column) -> Column:
    """A value in 0 to 1 in tenths, by whole thousandths, so that every engine agrees."""
    return (F.floor(F.floor(value * 1000 + F.lit(0.5)) / 100) / 10).cast("double")
