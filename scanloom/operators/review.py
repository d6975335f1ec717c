"""A second look at findings: one kind for each contested place, and a check of each finding by itself.

What a model says is a column; everything before and behind the call is joins and expressions.  A failed call keeps
what it was asked about, so an outage costs precision and no findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import prompts
from scanloom.functions import text as tx
from scanloom.operators import analysis
from scanloom.operators import findings as fd
from scanloom.session import fixed_side, settle

#: Lines around a place that are shown, and how far a judge may move a finding.
AROUND, MOVE = 15, 6


def _parsed(reply: Column, ddl: str) -> tuple[Column, Column]:
    """(whether a reply holds one JSON object, its fields)."""
    body = tx.json_object(reply)
    return F.try_parse_json(body).isNotNull(), F.from_json(body, ddl)


def judge_sites(findings: DataFrame, files: DataFrame, file: str, make: Callable[[], analysis.Analyzer], gap: int = 3) -> tuple[DataFrame, DataFrame]:
    """(findings left, one row of counts): of each place with two kinds or more at most one finding stays.

    ``findings``: file, line, type, confidence, message, ord and any others; ``files``: file, content, one row each.
    The candidate of a kind is its most confident finding.  The first selected kind that is a candidate stays; its
    line moves to the judge's, if that is shown and at most MOVE lines away, and reported_line keeps the old one.
    Places of one kind, unreadable files and failed calls keep all.  Rows without file or line pass untouched.
    """
    if "reported_line" not in findings.columns:
        findings = findings.withColumn("reported_line", F.lit(None).cast("int"))
    placed = settle(fd.with_sites(findings, [file], "line", gap))
    size = placed.groupBy(file, "site").agg(F.sum(F.col("line").cast("long")).alias("sum"), F.count("*").alias("n"))
    cand = fd.best_of_key(placed.select(file, "site", "type", "line", "confidence", "message", "ord"), [file, "site", "type"], "confidence", "ord")
    cand = cand.groupBy(file, "site").agg(F.array_sort(F.collect_list(F.struct("type", "message", "line", "ord"))).alias("cands"))  # kinds are few
    contested = cand.where("size(cands) > 1").join(size, [file, "site"]).withColumn("center", F.floor((F.col("sum") + F.floor(F.col("n") / 2)) / F.col("n")).cast("int"))
    asked = contested.join(files.select(file, "content"), file, "left")
    lo = F.greatest(F.col("center") - AROUND, F.lit(1))
    hi = F.least(F.col("center") + AROUND, F.size(F.split("content", "\n")))
    asked = asked.select(file, "site", "n", "cands", lo.alias("lo"), hi.alias("hi"), F.when(F.col("content").isNotNull(), prompts.judgement(F.col(file), F.col("center"), tx.excerpt(F.col("content"), F.col("center"), AROUND), F.col("cands"))).alias("prompt"))
    said = settle(analysis.replies(asked, "prompt", make))
    good, body = _parsed(F.col("reply"), "selected_types array<string>, line string")
    named = F.transform(F.coalesce(body["selected_types"], F.array().cast("array<string>")), lambda t: F.trim(t))
    picks = F.filter(F.transform(named, lambda t: F.get(F.filter("cands", lambda c: c["type"] == t), F.lit(0))), lambda c: c.isNotNull())
    judged = said.select(file, "site", "n", "lo", "hi", F.coalesce(good, F.lit(False)).alias("good"), F.get(picks, F.lit(0)).alias("pick"), F.regexp_extract(body["line"], r"^\s*(-?[0-9]+)", 1).try_cast("int").alias("to"))
    near = (F.col("to") >= F.col("lo")) & (F.col("to") <= F.col("hi")) & (F.abs(F.col("to") - F.col("pick.line")) <= MOVE)
    judged = judged.select(file, "site", "n", "good", F.col("pick.ord").alias("stays"), F.when(near, F.col("to")).alias("to"))
    rows = placed.join(fixed_side(judged, 200_000), [file, "site"], "left")
    keep = ~F.coalesce("good", F.lit(False)) | F.coalesce(F.col("ord") == F.col("stays"), F.lit(False))
    moved = F.coalesce(F.col("good") & F.col("to").isNotNull(), F.lit(False))
    kept = rows.where(keep).withColumns({"reported_line": F.when(moved, F.col("line")).otherwise(F.col("reported_line")), "line": F.when(moved, F.col("to").cast(findings.schema["line"].dataType)).otherwise(F.col("line"))})
    loose = findings.where(F.col(file).isNull() | F.col("line").isNull())
    out = kept.select(*findings.columns).unionByName(loose)
    total = findings.agg(F.count("*").alias("total_findings")).crossJoin(F.broadcast(cand.agg(F.count_if(F.size("cands") < 2).alias("sites_uncontested"), F.count_if(F.size("cands") > 1).alias("sites_contested"))))  # one row each
    count = judged.agg(
        F.count_if("good").alias("calls"), F.count_if(F.col("good") & F.col("stays").isNotNull()).alias("selected_one"), F.count_if(F.col("good") & F.col("stays").isNull()).alias("selected_none"), F.count_if(~F.col("good")).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n") - F.col("stays").isNotNull().cast("int"))), F.lit(0)).alias("removed"),
    )
    return out, total.crossJoin(F.broadcast(count)).withColumn("kept_findings", F.col("total_findings") - F.col("removed"))


def verify(findings: DataFrame, files: DataFrame, file: str, make: Callable[[], analysis.Analyzer]) -> tuple[DataFrame, DataFrame]:
    """(findings that were not rejected, one row of counts): each finding is checked by itself against its excerpt.

    ``findings``: file, line, type, message and any others; ``files``: file, content.  Only a readable reply that does
    not say the finding applies rejects it; unreadable files, failed calls and findings without a line stay.
    """
    asked = findings.join(files.select(file, F.col("content").alias("__content")), file, "left")
    code = tx.excerpt(F.col("__content"), F.col("line"), AROUND)
    asked = asked.withColumn("__prompt", prompts.verification(F.col(file), code, F.col("type"), F.col("line"), F.col("message"))).drop("__content")
    said = settle(analysis.replies(asked, "__prompt", make))
    good, body = _parsed(F.col("reply"), "applies boolean")
    said = said.withColumn("__good", F.coalesce(good, F.lit(False))).withColumn("__applies", F.coalesce(body["applies"], F.lit(False)))
    out = said.where("NOT __good OR __applies").select(*findings.columns)
    n = lambda c: F.count_if(F.expr(c))
    return out, said.agg(F.count("*").alias("total_findings"), n("__good").alias("calls"), n("__good AND __applies").alias("confirmed"), n("__good AND NOT __applies").alias("rejected"), n("NOT __good").alias("errors"), n("NOT __good OR __applies").alias("kept_findings"))


def votes(sites: DataFrame, key: list[str], prompt: str, make: Callable[[], analysis.Analyzer], times: int = 3) -> DataFrame:
    """(key, vote, agreement): the kind that most of ``times`` independent replies to a prompt select, the earliest on ties; '' for none."""
    from scanloom.operators.matching import plurality

    rows = sites.select(*key, F.col(prompt).alias("p"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("round"))
    said = settle(analysis.replies(rows, "p", make))
    good, body = _parsed(F.col("reply"), "selected_types array<string>")
    said = said.where(good).withColumn("vote", F.coalesce(F.trim(F.get(body["selected_types"], F.lit(0))), F.lit("")))
    return plurality(said, key, "vote", "round")


class RuleReviewer:
    """Answers judgements and verifications offline: by the signs of the rule analyzer in the lines that are shown."""

    def complete(self, prompt: str) -> str:
        import json
        import re

        code = re.findall(r"(?m)^ *(\d+): (.*)$", prompt.partition("```\n")[2].partition("\n```")[0])
        signs = analysis.RuleAnalyzer.SIGNS
        if m := re.match(r"Verify: (\w+) at line (\d+)", prompt):
            sign = re.compile(signs.get(m[1], "$^"))
            return json.dumps({"applies": any(sign.search(t) and abs(int(n) - int(m[2])) <= 3 for n, t in code)})
        for kind in re.findall(r"(?m)^- (\w+):", prompt.rpartition("Candidates:\n")[2]):
            sign = re.compile(signs.get(kind, "$^"))
            if line := next((int(n) for n, t in code if sign.search(t)), None):
                return json.dumps({"selected_types": [kind], "line": line})
        return json.dumps({"selected_types": []})
