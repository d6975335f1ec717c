"""One best record per defect: grouping of reports, a latent two-sided quality model, survivors and merged records.

Every analysis model is a source with an unknown sensitivity (how often it states a value that is true) and
specificity (how rarely it states one that is false).  A fact is a value of one optional field of one defect.
Expectation-maximisation alternates between the probability that each fact is true, given how many records of
each source state it or state something else, and the sources' two rates.  Facts are judged one by one, so a
field can keep several values.  Facts with equal counts have equal odds: the iterations run on the table of
count patterns, not on the records.

Records of one file and type meet in one pass over sorted rows, which finds the defects and their facts; files and
types with very many records go through aggregations and joins instead, with the same results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.session import fixed_side, settle

FIELDS = ("col_number", "function_name", "recommendation", "code_snippet", "quote")
# Stand-ins for a missing text, in lower case.
STAND_INS = ("", "-", "n/a", "none", "null", "unknown")
#: Sensitivity and specificity of a source of which nothing is known.
START = (0.7, 0.8)
#: Lines of one defect are at most this far apart.
LINE_GAP = 3
#: Records of one file and type that one worker may hold at once; more go through joins.
PLACE_ROWS = 50_000
#: Count patterns up to which the iterations run on the driver; more stay in a table.
LOCAL_PATTERNS = 50_000
#: The iterations end when no rate moves further than this, or after so many rounds.
STILL, ROUNDS = 1e-4, 100


def one_path(file: Column, repo: Column) -> Column:
    """A path relative to its repository: slashes one way, no leading ./ and no scan folder up to the repository's name."""
    p = F.translate(F.trim(file), "\\", "/")
    rooted = p.startswith("/") | ((F.substring(p, 2, 2) == ":/") & F.substring(p, 1, 1).rlike("[A-Za-z]"))
    at = F.instr(p, F.concat(F.lit("/"), repo, F.lit("/")))
    cut = F.when(rooted & (at > 0), F.substring(p, at + F.length(repo) + 2, 1 << 30)).otherwise(p)
    return F.when(cut.startswith("./"), F.regexp_replace(cut, r"^(\./)+", "")).otherwise(cut)


def one_type(kind: Column) -> Column:
    """A finding type without case, blanks and joiners."""
    return F.regexp_replace(F.lower(kind), "[^a-z0-9]", "")


def filled(field: str) -> Column:
    """The value of an optional field as text, null where it only stands in for nothing."""
    if field == "col_number":
        return F.when(F.col(field) > 0, F.col(field).cast("string"))
    t = F.btrim(F.col(field), F.lit(" \t\n\x0b\f\r"))
    return F.when(~F.lower(t).isin(*STAND_INS), t)


def clean_records(findings: DataFrame, scans: DataFrame, digests: bool = False) -> DataFrame:
    """One row per finding_key (redelivery removed) with the cleaned fields, the scan's time and its model.

    Of rows with one key any stays, since they are the same record.  ``digests`` keeps 64-bit digests of the fields,
    and 96 bits of repo, file and type together: enough to tell values and places apart.
    """
    when = scans.groupBy("scan_id").agg(F.min("scanned_at").alias("scanned_at"), F.min("model_used").alias("source"))
    conf = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    place = ["repo", "file", "type"]
    rows = findings.where("finding_key IS NOT NULL").select(
        "finding_key", "scan_id", "repo", one_path(F.col("file"), F.col("repo")).alias("file"), one_type(F.col("type")).alias("type"), F.col("line").cast("long").alias("line"), F.coalesce(conf, F.lit(-1.0)).alias("confidence"), *[filled(f).alias(f) for f in FIELDS]
    )
    if digests:  # columns of fixed width, which a hash aggregate takes
        whole = F.col("repo").isNotNull() & F.col("file").isNotNull() & F.col("type").isNotNull()
        place = [F.when(whole, h).alias(n) for h, n in zip((F.xxhash64(*place), F.hash(*place), F.lit(0)), place)]
        rows = rows.select("finding_key", "scan_id", *place, "line", "confidence", *[F.when(F.col(f).isNotNull(), F.xxhash64(f)).alias(f) for f in FIELDS])
    rows = rows.dropDuplicates(["finding_key"])
    full = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    return rows.join(when, "scan_id", "left").withColumns({"n_filled": full, "source": F.coalesce("source", F.lit("?"))})


def defect_groups(records: DataFrame) -> DataFrame:
    """Records with their defect: ``group`` (hash of repo, file, type and first line) where at least two share it.

    Islands of near lines are found over the distinct lines of a file and type, so a place that is reported
    ever so often still counts as one line in the window.  Records without repo, file, type or line stay alone.
    """
    key = ["repo", "file", "type"]
    known = records.dropna(subset=[*key, "line"])
    lines = known.groupBy(*key, "line").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("line")
    start = F.when(F.coalesce(F.col("line") - F.lag("line").over(w) <= LINE_GAP, F.lit(False)), F.lit(None)).otherwise(F.col("line"))
    lines = lines.withColumn("start", start)
    lines = lines.withColumn("first", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum("n").over(Window.partitionBy(*key, "first"))
    lines = lines.withColumn("size", size).where("size > 1")
    ident = F.struct(F.xxhash64(*key, "first").alias("h"), F.hash(*key, "first").alias("i"))
    return known.join(lines.select(*key, "line", ident.alias("group")), [*key, "line"])


def stated(grouped: DataFrame) -> DataFrame:
    """(finding_key, group, source, field, value): one row per filled field of a record."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    return grouped.select("finding_key", "group", "source", F.explode(pairs).alias("s")).select("finding_key", "group", "source", "s.*").where("value IS NOT NULL")


def fact_counts(claims: DataFrame) -> DataFrame:
    """(group, field, value, counts): for each source with an opinion on the field, records for the value and in all."""
    yes = claims.groupBy("group", "field", "value", "source").agg(F.count("*").alias("c"))
    by_fact = yes.groupBy("group", "field", "value").agg(F.map_from_entries(F.collect_list(F.struct("source", "c"))).alias("yes"))
    by_field = yes.groupBy("group", "field", "source").agg(F.sum("c").alias("n")).groupBy("group", "field").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("total"))
    counts = F.transform("total", lambda t: F.struct(t["source"].alias("source"), F.coalesce(F.col("yes")[t["source"]], F.lit(0)).alias("c"), t["n"].alias("n")))
    return by_fact.join(by_field, ["group", "field"]).select("group", "field", "value", counts.alias("counts"))


def probability(quality: dict[str, tuple[float, float]]) -> Column:
    """Probability that a fact with ``counts`` is true under the sources' (sensitivity, specificity), even odds before."""
    rate = lambda f: F.create_map(*[F.lit(x) for s, q in (quality | {"\0": START}).items() for x in (s, f(*q))])
    for_yes, for_no = rate(lambda a, b: math.log(a / (1 - b))), rate(lambda a, b: math.log((1 - a) / b))
    pick = lambda m, s: F.coalesce(m[s], m[F.lit("\0")])
    odds = F.aggregate("counts", F.lit(0.0), lambda acc, t: acc + t["c"] * pick(for_yes, t["source"]) + (t["n"] - t["c"]) * pick(for_no, t["source"]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def _rates(quality: dict[str, tuple[float, float]], sums) -> float:
    """Put the rates of (source, ty, t, fy, f) into ``quality``; how far the one that moved most moved."""
    moved = 0.0
    for source, ty, t, fy, f in sums:
        w = 10 + (t + f) / 10
        rates = ((ty + w * START[0]) / (t + w), 1 - (fy + w * (1 - START[1])) / (f + w))
        new = tuple(min(0.99, max(0.01, x)) for x in rates)
        moved = max(moved, *(abs(x - y) for x, y in zip(new, quality.get(source, START))))
        quality[source] = new
    return moved


def odds_of(weights: dict[str, tuple[float, float]], sources: list[str], c: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """What each (source, records for a value, records in all) adds to the log odds of a fact."""
    rates = np.array([weights.get(x, START) for x in sources]).reshape(-1, 2)
    yes, no = np.log(rates[:, 0] / (1 - rates[:, 1])), np.log((1 - rates[:, 0]) / rates[:, 1])
    return c * yes[which] + (n - c) * no[which]


def source_quality(facts: DataFrame, weight: str | None = None) -> dict[str, tuple[float, float]]:
    """Expectation-maximisation over the count patterns until it settles: {source: (sensitivity, specificity)}.

    ``facts`` has counts, and ``weight`` facts a row.  The rates start at START, which also counts like a tenth of
    the source's own facts, so that it can't drift to calling everything true; they stay within 0.01 and 0.99.
    Patterns are few, as their number is checked; where they are not, the rounds are aggregations and the driver gets
    one row a source.
    """
    n = F.sum(weight).cast("long") if weight else F.count("*")
    patterns = settle(facts.groupBy("counts").agg(n.alias("facts")))
    quality: dict[str, tuple[float, float]] = {}
    local = patterns.limit(LOCAL_PATTERNS + 1).collect()
    if len(local) <= LOCAL_PATTERNS:
        sources = sorted({t["source"] for r in local for t in r["counts"]})
        code = {x: k for k, x in enumerate(sources)}
        flat = np.array([(k, code[t["source"]], t["c"], t["n"]) for k, r in enumerate(local) for t in r["counts"]], np.float64).reshape(-1, 4)
        fact, which, c, total = flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64), flat[:, 2], flat[:, 3]
        times = np.array([r["facts"] for r in local], np.float64)[fact] if local else np.empty(0)
        for _ in range(ROUNDS if sources else 0):
            odds = np.bincount(fact, odds_of(quality, sources, c, total, which), len(local))
            p = (1 / (1 + np.exp(-np.clip(odds, -500, 500))))[fact]
            sums = [np.bincount(which, times * x, len(sources)) for x in (p * c, p * total, (1 - p) * c, (1 - p) * total)]
            if _rates(quality, zip(sources, *sums)) < STILL:
                break
        return quality
    for _ in range(ROUNDS):
        judged = patterns.select("facts", probability(quality).alias("p"), F.explode("counts").alias("t"))
        sums = judged.groupBy("t.source").agg(*[F.sum(F.expr(f"facts * {x}")).alias(k) for k, x in (("ty", "p * t.c"), ("t", "p * t.n"), ("fy", "(1 - p) * t.c"), ("f", "(1 - p) * t.n"))]).collect()
        if _rates(quality, (tuple(r) for r in sums)) < STILL:
            break
    return quality


def judged_groups(findings: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grouped records, facts with probability ``p``), settled or cheap to read again."""
    grouped = settle(defect_groups(settle(clean_records(findings, scans))))
    facts = settle(fact_counts(stated(grouped)))
    return grouped, facts.withColumn("p", probability(source_quality(facts)))


PLACE = ["repo", "file", "type"]
_COUNT = T.StructType([T.StructField("source", T.StringType()), T.StructField("c", T.LongType()), T.StructField("n", T.LongType())])
_CLAIM = T.StructType([T.StructField("record", T.IntegerType()), T.StructField("fact", T.IntegerType())])
#: A defect: its records side by side, the facts they state, and who states what.
DEFECT = T.StructType([
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("filled", T.ArrayType(T.IntegerType())), T.StructField("confidence", T.ArrayType(T.DoubleType())), T.StructField("at", T.ArrayType(T.LongType())),
    T.StructField("claims", T.ArrayType(_CLAIM)), T.StructField("facts", T.ArrayType(T.ArrayType(_COUNT))),
])


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def defects(rows: pa.Table) -> pa.RecordBatch:
    """The defects of whole places, whose rows are sorted by place and line."""
    col = lambda name: rows.column(name).combine_chunks()
    h, i, line = (col(x).to_numpy(zero_copy_only=False) for x in ("repo", "file", "line"))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (line[1:] - line[:-1] > LINE_GAP)
    group = np.cumsum(new) - 1
    keep = np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)
    rows = rows.filter(pa.array(keep))
    group = np.unique(group[keep], return_inverse=True)[1]
    n = int(group[-1]) + 1 if len(group) else 0
    sizes = np.bincount(group, minlength=n)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = col("source").dictionary_encode()
    names, source = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    said = []
    for f, name in enumerate(FIELDS):
        value = col(name)
        there = np.nonzero(np.asarray(value.is_valid()))[0]
        said.append(np.stack((group[there] * len(FIELDS) + f, value.drop_null().to_numpy(zero_copy_only=False), there)))
    slot, value, record = np.concatenate(said, axis=1)
    order = np.lexsort((value, slot))
    slot, value, record = slot[order], value[order], record[order]
    first = np.ones(len(slot), bool)
    first[1:] = (slot[1:] != slot[:-1]) | (value[1:] != value[:-1])
    fact = np.cumsum(first) - 1
    n_facts, width = int(first.sum()), max(1, len(names))
    fact_slot = slot[first]
    for_value = np.unique(fact * width + source[record], return_counts=True)
    in_all = np.unique(slot * width + source[record], return_counts=True)
    # every fact with every source that has an opinion on its field
    opinion = in_all[0] // width
    lo, hi = np.searchsorted(opinion, fact_slot), np.searchsorted(opinion, fact_slot, "right")
    many = hi - lo
    at = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    which, of = in_all[0][at] % width, np.repeat(np.arange(n_facts), many)
    want = of * width + which
    pos = np.searchsorted(for_value[0], want)
    pos_ok = pos < len(for_value[0])
    hit = np.zeros(len(want), bool)
    hit[pos_ok] = for_value[0][pos[pos_ok]] == want[pos_ok]
    c = np.where(hit, for_value[1][np.minimum(pos, max(0, len(for_value[1]) - 1))] if len(for_value[1]) else 0, 0)
    # names in order, so that equal counts are equal arrays
    rank = np.argsort(np.argsort(np.array(names.to_pylist(), dtype=object))) if len(names) else np.empty(0, np.int64)
    order = np.lexsort((rank[which], of)) if len(of) else np.empty(0, np.int64)
    counts = pa.StructArray.from_arrays([names.take(pa.array(which[order])), pa.array(c[order], pa.int64()), pa.array(in_all[1][at][order], pa.int64())], names=_COUNT.names)
    facts_of = np.bincount(fact_slot // len(FIELDS), minlength=n)
    start = np.cumsum(facts_of) - facts_of
    by_group = np.argsort(slot // len(FIELDS), kind="stable")
    claim_group = (slot // len(FIELDS))[by_group]
    claims = pa.StructArray.from_arrays([pa.array(inside[record[by_group]], pa.int32()), pa.array(fact[by_group] - start[claim_group], pa.int32())], names=_CLAIM.names)
    return pa.RecordBatch.from_arrays(
        [
            _lists(sizes, col("finding_key")), _lists(sizes, col("n_filled").cast(pa.int32())), _lists(sizes, col("confidence")), _lists(sizes, col("at")),
            _lists(np.bincount(claim_group, minlength=n), claims), _lists(facts_of, _lists(many, counts)),
        ],
        names=DEFECT.names,
    )


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows to defects; the rows of a batch's last place wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h, i = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("repo", "file"))
        other = np.nonzero((h != h[-1]) | (i != i[-1]))[0]
        at = int(other[-1]) + 1 if len(other) else 0
        if not at and held:
            before = held[0]
            if before.column(before.schema.get_field_index("repo"))[0].as_py() == h[-1] and before.column(before.schema.get_field_index("file"))[0].as_py() == i[-1]:
                held.append(batch)
                continue
        done = [*held, *([batch.slice(0, at)] if at else [])]
        if done:
            yield defects(pa.Table.from_batches(done))
        held = [batch.slice(at)]
    if held:
        yield defects(pa.Table.from_batches(held))


def _chosen(quality: dict[str, tuple[float, float]], check: bool):
    """Map of defects to (finding_key, survivor_key)."""

    def flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        return np.diff(column.offsets.to_numpy()), column.flatten()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = flat(batch.column(0))
            keys = keys.to_numpy(zero_copy_only=False)
            filled, conf, when = (flat(batch.column(k))[1].to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            group, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            facts_of, facts = flat(batch.column(5))
            many, counts = flat(facts)
            coded = counts.field("source").dictionary_encode()
            add = odds_of(quality, coded.dictionary.to_pylist(), counts.field("c").to_numpy(), counts.field("n").to_numpy(), coded.indices.to_numpy(zero_copy_only=False)) if len(counts) else np.empty(0)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(np.repeat(np.arange(len(many)), many), add, len(many)), -500, 500)))
            claims_of, claims = flat(batch.column(4))
            fact = claims.field("fact").to_numpy() + np.repeat(np.cumsum(facts_of) - facts_of, claims_of)
            record = claims.field("record").to_numpy() + np.repeat(start, claims_of)
            trust = np.round(np.bincount(record, p[fact], len(keys)), 9)
            # the model's proposal, unless the check finds a record that no other exceeds
            peak = lambda x: np.maximum.reduceat(x, start)[group] if len(start) else x
            peerless = (filled == peak(filled)) & (conf == peak(conf)) & (when == peak(when)) if check else np.zeros(len(keys), bool)
            order = np.lexsort((-keys, when, conf, filled, trust, peerless, group))
            stays = keys[order[np.cumsum(sizes) - 1]][group] if len(sizes) else keys
            gives = keys != stays
            yield pa.RecordBatch.from_arrays([pa.array(keys[gives], pa.int64()), pa.array(stays[gives], pa.int64())], names=["finding_key", "survivor_key"])

    return work


def _micros(df: DataFrame, name: str) -> Column:
    """A time in microseconds; times without zone are counted as they stand, whatever the session's zone."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    t = F.col(name)
    return F.unix_date(t.cast("date")).cast("long") * 86_400_000_000 + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def survivors(findings: DataFrame, scans: DataFrame, check: bool = True) -> DataFrame:
    """(finding_key, survivor_key): each record that gives way, with the record that stays.

    A record's trust is the sum of its values' probabilities under the quality model, its completeness as judged: a
    false value adds little.  The most trusted record is proposed (ties: filled fields, confidence, time, lower key).  The
    ``check`` that follows keeps a proposal unless the group has a record that no other exceeds in filled fields,
    confidence and time of scan; then the most trusted of those stays.
    Redelivered rows count once; confidence in percent is brought to one scale, missing confidence and time rank
    last; records without repo, file, type or line neither give way nor stay for another; empty tables give no rows.
    Places (repo, file and type) of more than PLACE_ROWS records go through ``crowded_survivors``.
    """
    known = settle(clean_records(findings, scans, digests=True).dropna(subset=[*PLACE, "line"]))
    rows = known.select("repo", "file", "line", "finding_key", "source", "confidence", "n_filled", F.coalesce(_micros(known, "scanned_at"), F.lit(-(1 << 62))).alias("at"), *FIELDS)
    crowds = settle(known.groupBy("repo", "file").agg(F.count("*").alias("n")).where(F.col("n") > PLACE_ROWS).select("repo", "file"))
    crowded = crowds.limit(1).count() > 0
    if crowded:
        side = fixed_side(crowds, 1_000_000)
        rows, crowd = rows.join(side, ["repo", "file"], "left_anti"), rows.join(side, ["repo", "file"], "left_semi")
    parts = max(1, int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = settle(rows.repartition(parts, "repo", "file").sortWithinPartitions("repo", "file", "line", "finding_key").mapInArrow(_by_place, DEFECT))
    patterns = found.select(F.explode("facts").alias("counts")).groupBy("counts").agg(F.count("*").alias("facts"))
    if crowded:
        grouped, facts = crowded_groups(crowd)
        patterns = patterns.unionByName(facts.groupBy("counts").agg(F.count("*").alias("facts")))
    quality = source_quality(patterns, "facts")
    out = found.mapInArrow(_chosen(quality, check), "finding_key long, survivor_key long")
    return out.unionByName(crowded_survivors(grouped, facts, quality, check)) if crowded else out


def crowded_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grouped records, facts) of places with very many records, both settled."""
    grouped = settle(defect_groups(rows.withColumn("type", F.lit(0))))
    return grouped, settle(fact_counts(stated(grouped)))


def crowded_survivors(grouped: DataFrame, facts: DataFrame, quality: dict[str, tuple[float, float]], check: bool) -> DataFrame:
    """``survivors`` of grouped records by aggregations and joins; what is known of a group or value is small where groups are hot, and is broadcast if measured so."""
    judged = facts.select("group", "field", "value", probability(quality).alias("p"))
    trust = stated(grouped).join(fixed_side(judged, 500_000), ["group", "field", "value"]).groupBy("finding_key").agg(F.sum("p").alias("trust"))
    best = grouped.groupBy("group").agg(F.max("n_filled").alias("m1"), F.max("confidence").alias("m2"), F.max("at").alias("m3"))
    slim = grouped.select("finding_key", "group", "n_filled", "confidence", "at")
    scored = slim.join(trust, "finding_key", "left").join(fixed_side(best, 500_000), "group")
    peerless = F.expr("n_filled = m1 AND confidence = m2 AND at = m3") if check else F.lit(False)
    rank = F.struct(peerless, F.round(F.coalesce("trust", F.lit(0.0)), 9), "n_filled", "confidence", "at", -F.col("finding_key"))
    chosen = scored.groupBy("group").agg(F.max_by("finding_key", rank).alias("survivor_key"))
    return slim.join(fixed_side(chosen, 500_000), "group").where("finding_key <> survivor_key").select("finding_key", "survivor_key")


def merged_records(findings: DataFrame, scans: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """One built record per defect: (repo, file, type, first_line, n_records, confidence, best, kept).

    ``best`` maps each field to its most probable value (ties: the smaller text); ``kept`` maps it to every value
    of probability ``keep_from`` or more, in order, so that a field may hold several true values.
    """
    grouped, facts = judged_groups(findings, scans)
    head = grouped.groupBy("group").agg(F.min("repo").alias("repo"), F.min("file").alias("file"), F.min("type").alias("type"), F.min("line").alias("first_line"), F.count("*").alias("n_records"), F.max("confidence").alias("confidence"))
    by_field = facts.groupBy("group", "field").agg(
        F.min(F.struct(-F.round("p", 9), "value"))["value"].alias("best"), F.array_sort(F.collect_set(F.when(F.col("p") >= keep_from, F.col("value")))).alias("kept")
    )
    both = by_field.groupBy("group").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "best")))).alias("best"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "kept")))).alias("kept"))
    return head.join(both, "group", "left").drop("group")
