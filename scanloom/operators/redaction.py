"""Masking of secrets by an ordered list of patterns.

Each pattern works on the text that the patterns before it left, which no bounded column expression holds (it would
double with every pattern); so texts go through Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Pattern:
    """``regex`` has three groups: before the value, the value, after it."""

    kind: str
    regex: str
    mask: str


# What is looked for, in order, and the masks; shorter values than 8 bytes are left.
PATTERNS = (
    Pattern("aws_key", r"(?<![A-Za-z0-9_])()(AKIA[0-9A-Z]{16})()(?![A-Za-z0-9_])", "[REDACTED_AWS_ACCESS_KEY]"),
    Pattern("aws_key", r"(?<![A-Za-z0-9_/+=])()([A-Za-z0-9/+=]{40})()(?![A-Za-z0-9_/+=])", "[REDACTED_AWS_SECRET_KEY]"),
    Pattern("api_key", r"((?i:api[_-]?key|apikey)['\"]?\s*[:=]\s*['\"])([a-zA-Z0-9_\-]{16,})(['\"])", "[REDACTED_API_KEY]"),
    Pattern("bearer_token", r"(?<![A-Za-z0-9_])()(Bearer\s+[a-zA-Z0-9\-._~+/]+=*)()", "[REDACTED_BEARER_TOKEN]"),
    Pattern("jwt_token", r"(?<![A-Za-z0-9_])()(eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+)()", "[REDACTED_JWT_TOKEN]"),
    Pattern("password", r"((?i:password|passwd|pwd|secret)['\"]?\s*[:=]\s*['\"])([^'\";\n]{3,})(['\"])", "[REDACTED_PASSWORD]"),
    Pattern("connection_string", r"(?<![A-Za-z0-9_])()([a-z]+://[^:\s]+:[^@\s]+@[^\s'\"]+)()", "[REDACTED_CONNECTION_STRING]"),
    Pattern("password", r"((?i:password|pwd)=)([^\s;'\"&]+)()", "[REDACTED_PASSWORD]"),
    Pattern("private_key", r"()(-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----)()", "[REDACTED_PRIVATE_KEY]"),
    Pattern("generic_secret", r"((?i:secret[_-]?(?:key|token|code))['\"]?\s*[:=]\s*['\"])([a-zA-Z0-9_\-]{8,})(['\"])", "[REDACTED_SECRET]"),
    Pattern("api_key", r"((?i:client_secret|oauth[_-]?token)['\"]?\s*[:=]\s*['\"])([a-zA-Z0-9_\-]{16,})(['\"])", "[REDACTED_OAUTH_TOKEN]"),
    Pattern("api_key", r"(?<![A-Za-z0-9_])()(gh[pousr]_[a-zA-Z0-9]{20,})()", "[REDACTED_GITHUB_TOKEN]"),
    Pattern("api_key", r"(?<![A-Za-z0-9_])()(xox[baprs]-[a-zA-Z0-9-]+)()", "[REDACTED_SLACK_TOKEN]"),
)
_COMPILED = tuple((p, re.compile(p.regex)) for p in PATTERNS)
# Texts that stand in for a secret.
STAND_INS = ("your_api_key_here", "your-api-key", "xxx", "placeholder", "dummy", "test123", "password123", "changeme", "<api_key>", "${api_key}", "{{api_key}}", "$api_key", "process.env", "os.getenv")


_COMMENT = {True: re.compile(r"#[^\n]*"), False: re.compile(r"(?<!:)//[^\n]*|/\*[\s\S]*?\*/")}


def is_stand_in(v: str) -> bool:
    """Whether a value is a placeholder: a known text, a template, a short constant name or one repeated character."""
    return v.lower() in STAND_INS or v.startswith(("${", "{{", "<")) or bool(re.fullmatch("[A-Z_]+", v) and len(v) < 16) or len(set(v)) <= 1


def redact_text(text: str, python: bool, first: int = 1) -> tuple[str, list[tuple[int, str, int]]]:
    """The text with its secrets masked, and (line, kind, bytes) of each in order of the patterns.

    Comments are blanked to equal length in a copy that is searched, so that offsets hold in the text; both copies
    take each mask, and a pattern's values are replaced from left to right.
    """
    seen = _COMMENT[python].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    events: list[tuple[int, str, int]] = []
    for p, regex in _COMPILED:
        out, out_seen, at, line, counted = [], [], 0, first, 0
        for m in regex.finditer(seen):
            a, b = m.span(2)
            value = text[a:b]
            size = len(value.encode("utf-8", "surrogatepass"))
            if a < at or size < 8 or "[REDACTED" in value or is_stand_in(value):
                continue
            line += text.count("\n", counted, a)
            counted = a
            events.append((line, p.kind, size))
            out += [text[at:a], p.mask]
            out_seen += [seen[at:a], p.mask]
            at = b
        if at:
            text, seen = "".join([*out, text[at:]]), "".join([*out_seen, seen[at:]])
    return text, events


def redact(df: DataFrame, id_col: str, language_col: str, text_col: str, shift_col: str | None = None) -> DataFrame:
    """(id, redacted_source, events ARRAY<STRUCT<line, type, original_length>>, total_redactions); a map without a shuffle.

    Values under 8 bytes, already masked ones and placeholders stay.  Lines count from 1, or from ``shift_col``.
    A null text gives null and no events; an empty one stays empty.
    """
    first = F.coalesce(F.col(shift_col).cast("int"), F.lit(1)) if shift_col else F.lit(1)
    rows = df.select(F.col(id_col).alias("k"), F.coalesce(F.col(language_col) == "python", F.lit(False)).alias("py"), first.alias("first"), F.col(text_col).alias("t"))
    event = pa.struct([("line", pa.int32()), ("type", pa.string()), ("original_length", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, events = [], []
            for py, n, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                got, found = redact_text(t, py, n) if t else (t, [])
                texts.append(got)
                events.append([{"line": a, "type": b, "original_length": c} for a, b, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(events, pa.list_(event)), pa.array(map(len, events), pa.int32())], names=[id_col, "redacted_source", "events", "total_redactions"])

    kinds = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("original_length", T.IntegerType())])
    return rows.mapInArrow(work, T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("redacted_source", T.StringType()), T.StructField("events", T.ArrayType(kinds)), T.StructField("total_redactions", T.IntegerType())]))


def counts(redacted: DataFrame) -> DataFrame:
    """(type, redactions, chunks): how often each kind was masked."""
    kinds = F.transform("events", lambda e: e["type"])
    per = redacted.select(F.explode(F.transform(F.array_distinct(kinds), lambda k: F.struct(k.alias("type"), F.size(F.filter(kinds, lambda x: x == k)).alias("n")))).alias("x"))
    return per.groupBy("x.type").agg(F.sum("x.n").alias("redactions"), F.count("*").alias("chunks"))
