"""Work items and the pluggable analyzer.

A model is any object with ``complete(prompt) -> str``.  It runs once a partition, in batches, with retries; what it
says is parsed strictly, then leniently.  ``RuleAnalyzer`` answers offline by rules, so that a run needs no network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions.prompts import stricter
from scanloom.session import fixed_side

# Kinds of findings, for web languages and for C and C++.
WEB_TYPES = ("sql_injection", "xss", "path_traversal", "insecure_deserialization", "auth_issue", "crypto_issue", "command_injection", "ssrf", "xxe_injection")
NATIVE_TYPES = ("buffer_overflow", "format_string", "use_after_free", "integer_overflow")
SEVERITIES = ("low", "medium", "high", "critical")

FINDING = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("line", T.IntegerType()),
    T.StructField("quote", T.StringType()), T.StructField("message", T.StringType()), T.StructField("recommendation", T.StringType()),
])


class Analyzer(Protocol):
    def complete(self, prompt: str) -> str: ...


def selected_types(chunks: DataFrame, language_col: str) -> list[str]:
    """The kinds a repository is asked about: web kinds if it has any other language, native ones if it has C or C++."""
    native = F.coalesce(F.col(language_col).isin("c", "cpp"), F.lit(False))
    row = chunks.agg(F.max(native.cast("int")).alias("native"), F.max((~native).cast("int")).alias("web")).first()
    return [*(WEB_TYPES if row["web"] else ()), *(NATIVE_TYPES if row["native"] else ())]


def work_items(chunks: DataFrame, id_col: str, language_col: str, per_language: bool = False) -> DataFrame:
    """(id, type): every chunk with every selected kind, by exploding a constant array inside the row.

    ``per_language`` asks each chunk only about the kinds of its own language.
    """
    if per_language:
        arr = F.when(F.coalesce(F.col(language_col).isin("c", "cpp"), F.lit(False)), F.array(*map(F.lit, NATIVE_TYPES))).otherwise(F.array(*map(F.lit, WEB_TYPES)))
    else:
        kinds = selected_types(chunks, language_col)
        if not kinds:
            return chunks.select(id_col, F.lit("").alias("type")).limit(0)
        arr = F.array(*map(F.lit, kinds))
    return chunks.select(id_col, F.explode(arr).alias("type"))


def with_frameworks(chunks: DataFrame, frameworks: DataFrame, language_col: str) -> DataFrame:
    """Chunks with the frameworks of their language (language, frameworks), [] where there are none."""
    side = fixed_side(frameworks.withColumnRenamed("language", language_col), 1000)
    return chunks.join(side, language_col, "left").withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<string>")))


def hints(chunks: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """(id, type, hints): texts of a table (framework, type, hint) for a chunk's frameworks, without repetition."""
    f = chunks.select(id_col, F.posexplode("frameworks").alias("p", "framework"))
    j = f.join(fixed_side(table, 10_000), "framework").groupBy(id_col, "type")
    return j.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", "hint"))), lambda x: x["hint"])).alias("hints"))


class RuleAnalyzer:
    """Answers a prompt (its kind, then numbered source) by looking for the kind's signs."""

    # Signs of each kind, as patterns over one line.
    SIGNS = {
        "sql_injection": r"(?i)\b(select|update|delete|insert)\b.*(\"\s*\+|\$\{|%s\"\s*%|f\")", "xss": r"innerHTML|document\.write|res\.send\(", "path_traversal": r"\.\./|readFile\(|open\(", "insecure_deserialization": r"pickle\.loads|yaml\.load\(|ObjectInputStream|unserialize",
        "auth_issue": r"(?i)verify\s*=\s*false|jwt\.decode\(", "crypto_issue": r"(?i)\b(md5|sha1)\b", "command_injection": r"os\.system|exec\(|popen\(|shell=True", "ssrf": r"requests\.get\(|fetch\(|urlopen\(", "xxe_injection": r"DocumentBuilderFactory|parseXmlString|noent",
        "buffer_overflow": r"\b(strcpy|strcat|gets|sprintf)\s*\(", "format_string": r"\bprintf\s*\(\s*\w+\s*\)", "use_after_free": r"\bfree\s*\(", "integer_overflow": r"\bmalloc\s*\(.*\*",
    }

    def complete(self, prompt: str) -> str:
        head, _, source = prompt.partition("\n")
        said = re.search(r"(?m)^Kind: (\w+)$", prompt)
        asked = said[1] if said else head
        found = []
        for n, text in re.findall(r"(?m)^ *(\d+): (.*)$", source):
            for kind in self.SIGNS if asked == "all" else [asked]:
                if not re.search(self.SIGNS.get(kind, "$^"), text):
                    continue
                found.append({"type": kind, "severity": "high", "confidence": 0.6, "line": int(n), "quote": text.strip(), "message": f"possible {kind.replace('_', ' ')}", "recommendation": ""})
        return json.dumps({"findings": found})


def valid(f: object) -> bool:
    """Whether one finding of a reply is whole: known kind and severity, confidence in 0 to 1, a positive line, a message."""
    return (
        isinstance(f, dict) and f.get("type") in WEB_TYPES + NATIVE_TYPES and f.get("severity") in SEVERITIES and isinstance(f.get("confidence"), (int, float)) and 0 <= f["confidence"] <= 1
        and isinstance(f.get("line"), int) and f["line"] > 0 and bool(str(f.get("message") or "").strip())
    )


def parse_reply(reply: str) -> list[dict]:
    """Findings of a reply: plain JSON, else what stands in a fence; one bad finding or a missing list spoils it all."""
    texts = [reply]
    if m := re.search(r"```json\s*(.*?)```", reply, re.S) or re.search(r"```\s*(.*?)```", reply, re.S):
        texts.append(m[1])
    for t in texts:
        try:
            doc = json.loads(t)
        except ValueError:
            continue
        if isinstance(doc, dict) and isinstance(doc.get("findings"), list) and all(map(valid, doc["findings"])):
            return doc["findings"]
    raise ValueError("no valid findings")


def salvage(reply: str) -> list[dict]:
    """Whole objects with a type out of a reply that was cut off: balanced braces, strings minded."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    at = reply.find("[")
    for i in range(max(at, 0), len(reply)):
        c = reply[i]
        if quoted:
            escaped = c == "\\" and not escaped
            quoted = not (c == '"' and not (i and reply[i - 1] == "\\" and escaped is False and reply[i - 2 : i] != "\\\\"))
        elif c == '"':
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    doc = json.loads(reply[start : i + 1])
                    if isinstance(doc, dict) and doc.get("type"):
                        out.append(doc)
                except ValueError:
                    pass
    return out


class ClientError(Exception):
    """A refused request: asking again can't help.  Clients raise it, or any error with a ``status``."""


def hopeless(error: Exception) -> bool:
    """Whether a call must not be repeated: errors of the request itself, but neither too many nor too slow ones."""
    status = getattr(error, "status", getattr(error, "status_code", None))
    return isinstance(error, ClientError) or isinstance(status, int) and 400 <= status < 500 and status not in (408, 429)


def call(model: Analyzer, prompt: str, retries: int, sleep: Callable[[float], None]) -> str:
    """A model's reply; failing calls are repeated with growing waits unless that is hopeless."""
    for k in range(retries + 1):
        try:
            return model.complete(prompt)
        except Exception as e:
            if k == retries or hopeless(e):
                raise
            sleep(backoff(k))
    raise AssertionError


def replies(rows: DataFrame, prompt_col: str, make: Callable[[], Analyzer], retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with reply, and error where the call failed or there is no prompt.  Settle the result: calls may cost and differ."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            said, errors = [], []
            for prompt in batch.column(batch.schema.get_field_index(prompt_col)).to_pylist():
                try:
                    if prompt is None:
                        raise ClientError("nothing to ask")
                    said.append(call(model, prompt, retries, sleep))
                    errors.append(None)
                except Exception as e:  # the row's failure is its result
                    said.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield batch.append_column("reply", pa.array(said, pa.string())).append_column("error", pa.array(errors, pa.string()))

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))


def spaced(make: Callable[[], Analyzer], seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[], Analyzer]:
    """A maker of analyzers whose calls begin at least ``seconds`` apart, in each partition."""

    class Spaced:
        def __init__(self):
            self.inner, self.next = make(), clock()

        def complete(self, prompt: str) -> str:
            slot = max(clock(), self.next)
            self.next = slot + seconds
            sleep(max(0.0, slot - clock()))
            return self.inner.complete(prompt)

    return Spaced


def backoff(attempt: int, base: float = 2.0, most: float = 64.0) -> float:
    """Seconds before the next attempt: doubled each time, up to ``most``."""
    return min(most, base * 2**attempt)


def analyze(prompts: DataFrame, id_col: str, prompt_col: str, make: Callable[[], Analyzer], retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, success, error, findings): the analyzer's reply to each prompt.

    One analyzer a partition.  A call that raises is tried again with growing waits, unless the request itself is at
    fault; a reply that doesn't parse is asked for once more by a stricter prompt; then the row fails and the others go on.  Settle the result: calls may cost and differ.
    """
    finding = pa.struct([("type", pa.string()), ("severity", pa.string()), ("confidence", pa.float64()), ("line", pa.int32()), ("quote", pa.string()), ("message", pa.string()), ("recommendation", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            ok, errors, found = [], [], []
            for prompt in batch.column(1).to_pylist():
                error, got = None, []
                for ask in (prompt or "", stricter(prompt or "")):
                    try:
                        got, error = parse_reply(call(model, ask, retries, sleep)), None
                        break
                    except Exception as e:  # the row's failure is its result
                        error = f"{type(e).__name__}: {e}"[:500]
                ok.append(error is None)
                errors.append(error)
                found.append([{k: f.get(k) for k in ("type", "severity", "confidence", "line", "quote", "message", "recommendation")} | {"confidence": float(f["confidence"])} for f in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok, pa.bool_()), pa.array(errors, pa.string()), pa.array(found, pa.list_(finding))], names=[id_col, "success", "error", "findings"])

    schema = T.StructType([T.StructField(id_col, prompts.schema[id_col].dataType), T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("findings", T.ArrayType(FINDING))])
    return prompts.select(id_col, prompt_col).mapInArrow(work, schema)


def judge(sites: DataFrame, key: list[str], make: Callable[[], Analyzer]) -> DataFrame:
    """``sites`` (from contested_sites) with kept: the type the judge selects, null for none, '*' if it failed (all stay).

    The prompt is a JSON list of the site's types; the reply a JSON object with selected_types.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            kept = []
            for text in batch.column("prompt").to_pylist():
                try:
                    reply = model.complete(text)
                    picked = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])["selected_types"]
                    kept.append(next((t for t in picked if t in json.loads(text)), None))
                except Exception:
                    kept.append("*")
            yield batch.append_column("kept", pa.array(kept, pa.string()))

    rows = sites.withColumn("prompt", F.to_json(F.transform("best", lambda b: b["type"])))
    return rows.mapInArrow(ask, T.StructType([*rows.schema.fields, T.StructField("kept", T.StringType())])).drop("prompt")
