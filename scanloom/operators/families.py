"""Weakness numbers: of finding types, their families, and what lies in a benchmark's scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.paths import lookup

# The weakness number that stands for a finding type.
NUMBERS = {
    "sql_injection": "CWE-89", "xss": "CWE-79", "command_injection": "CWE-78", "ssrf": "CWE-918", "path_traversal": "CWE-22",
    "insecure_deserialization": "CWE-502", "xxe_injection": "CWE-611", "auth_issue": "CWE-284", "crypto_issue": "CWE-327",
}
# The numbers that count as one family.
FAMILIES = {
    "sql_injection": ("CWE-89", "CWE-564", "CWE-943"), "xss": ("CWE-79", "CWE-80", "CWE-87", "CWE-116"), "command_injection": ("CWE-78", "CWE-77", "CWE-94", "CWE-95"),
    "ssrf": ("CWE-918", "CWE-441"), "path_traversal": ("CWE-22", "CWE-23", "CWE-36", "CWE-73", "CWE-434"), "insecure_deserialization": ("CWE-502",), "xxe": ("CWE-611", "CWE-827", "CWE-776"),
    "auth_issue": ("CWE-284", "CWE-285", "CWE-862", "CWE-863", "CWE-639", "CWE-306", "CWE-287", "CWE-613", "CWE-384", "CWE-347"), "crypto_issue": ("CWE-327", "CWE-328", "CWE-330", "CWE-338", "CWE-916", "CWE-256", "CWE-312"),
}


def number_of(kind: Column) -> Column:
    """The weakness number of a finding type, null for types without one."""
    return lookup(NUMBERS, kind)


def family_of(number: Column) -> Column:
    """All numbers of a number's family, itself alone where it has none; null for null."""
    same = F.create_map(*[x for cs in FAMILIES.values() for c in cs for x in (F.lit(c), F.array(*map(F.lit, cs)))])
    return F.when(number.isNotNull(), F.coalesce(same[number], F.array(number)))


def in_scope(findings: DataFrame, number: str, scope: DataFrame) -> DataFrame:
    """Findings whose number stands in a set (one column of the same name); null numbers are out of scope."""
    return findings.join(scope.select(number).distinct(), number, "left_semi")


def with_numbers(findings: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(findings with cwe, (type, findings) of those without a number, which are left out)."""
    rows = findings.withColumn("cwe", number_of(F.col(kind)))
    return rows.where("cwe IS NOT NULL"), rows.where("cwe IS NULL").groupBy(kind).agg(F.count("*").alias("findings"))


def claims(findings: DataFrame, truth: DataFrame, tolerance: int = 10) -> DataFrame:
    """(finding_id, truth_id) of findings (id, repo, file, line, type) and entries (id, repo, file, start_line, end_line, kinds, vulnerable) by family."""
    from scanloom.operators.matching import claim_match

    f = findings.withColumn("kinds", family_of(number_of(F.col("type")))).where("kinds IS NOT NULL")
    return claim_match(f, truth, tolerance)
