"""Writers: one report document, per-file outputs, tables."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_name(at: datetime | None = None) -> str:
    """scan-YYYYMMDD-HHMMSS.json"""
    return (at or datetime.now(timezone.utc)).strftime("scan-%Y%m%d-%H%M%S.json")


_SEVERITIES = ("low", "medium", "high", "critical")


def document_problems(doc: dict) -> list[str]:
    """What is wrong with a report: its time, and findings without what every finding has; findings named elsewhere aren't looked at."""
    said = []
    at = (doc.get("scan_metadata") or {}).get("timestamp")
    if at is not None:
        try:
            if datetime.fromisoformat(str(at).replace("Z", "+00:00")).tzinfo is None:
                said.append("the time has no zone")
        except ValueError:
            said.append(f"no time: {at}")
    for k, f in enumerate(doc.get("findings") or []):
        full = all(str(f.get(c) or "").strip() for c in ("type", "file", "message"))
        confidence = f.get("confidence")
        if not (full and f.get("severity") in _SEVERITIES and (f.get("line") or 0) > 0 and confidence is not None and 0 <= confidence <= 1):
            said.append(f"finding {k} is not whole")
    return said


def write_report(doc: dict, directory: str, name: str | None = None) -> str:
    """One JSON document, written beside its place and moved there; text with U+FFFD is refused, missing findings become [].

    A document that names its ``findings_directory`` has its findings there instead of a list.
    """
    apart = "findings_directory" in doc
    doc = doc if apart else doc | {"findings": doc.get("findings") or []}
    if said := document_problems(doc):
        raise ValueError("; ".join(said))
    text = json.dumps(doc, ensure_ascii=False, indent=2)
    if "�" in text:
        raise ValueError("the report holds bytes that are no UTF-8")
    if not apart and (doc.get("summary") or {}).get("total_findings", len(doc["findings"])) != len(doc["findings"]):
        raise ValueError("the summary does not count the findings")
    os.makedirs(directory, exist_ok=True)
    path = os.path.join(directory, name or report_name())
    fd, part = tempfile.mkstemp(dir=directory, suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(part, 0o644)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return path


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, as many files as there are partitions; the commit protocol makes them appear together."""
    findings.write.mode("overwrite").json(path)


def write_by_file(rows: DataFrame, key: str, text: str, path: str) -> None:
    """(key, text) rows as parquet, clustered by key within files: what per-file outputs are generated from at any size."""
    rows.select(key, text).repartition(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_texts(rows: DataFrame, name: str, text: str, directory: str) -> int:
    """One file a row below ``directory``, of the rows' own names; how many.  For outputs that a person reads, row by row on the driver."""
    os.makedirs(directory, exist_ok=True)
    n = 0
    for r in rows.select(name, text).where(F.col(text).isNotNull()).toLocalIterator():
        path = os.path.join(directory, os.path.basename(r[0]))
        with open(path, "w", encoding="utf-8") as f:
            f.write(r[1])
        n += 1
    return n


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines and CSV."""
    metrics.write.mode("overwrite").json(f"{path}/json")
    flat = [F.col(c) if not t.startswith(("array", "struct", "map")) else F.to_json(c).alias(c) for c, t in metrics.dtypes]
    metrics.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
