"""Sources into chunks: windows, greedy line packing, outermost functions."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windows(df: DataFrame, id_col: str, text_col: str, size: int = 60) -> DataFrame:
    """(id, part, start_line, end_line, source): windows of ``size`` lines; blank ones are dropped, numbers stay.

    Cut inside the row, without a shuffle.  Null texts give nothing.
    """
    ls = F.split(F.col(text_col), "\n")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / size).cast("int")), lambda p: F.struct((p + 1).alias("part"), F.slice(ls, p * size + 1, F.lit(size)).alias("ls")))
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(cut).alias("w")).select(id_col, "w.part", "w.ls")
    first = (F.col("part") - 1) * size + 1
    out = rows.select(id_col, "part", first.cast("int").alias("start_line"), (first + F.size("ls") - 1).cast("int").alias("end_line"), F.array_join("ls", "\n").alias("source"))
    return out.where(F.col("source").rlike(r"[^ \t\n\r\f\x0B]"))


def packed_parts(text: Column, max_tokens: int) -> Column:
    """Array of (first, last) line indices from 0: lines packed greedily, each counting its bytes over 4 rounded down.

    A part is closed before a line that would take it over the limit; a single line is never cut.
    """
    ls = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("t"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        t = F.floor(F.octet_length(line) / 4).cast("int")
        flush = (acc["t"] + t > max_tokens) & (acc["i"] > acc["first"])
        return F.struct(
            F.when(flush, t).otherwise(acc["t"] + t).alias("t"), (acc["i"] + 1).alias("i"), F.when(flush, acc["i"]).otherwise(acc["first"]).alias("first"),
            F.when(flush, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last"))))).otherwise(acc["done"]).alias("done"),
        )

    end = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last"))))
    return F.aggregate(ls, start, step, end)


def split_chunks(df: DataFrame, id_col: str, text_col: str, start_col: str, name_col: str, max_tokens: int = 600) -> DataFrame:
    """(id, part, start_line, end_line, name, source): chunks over the limit in greedy parts, others whole.

    Names of parts end in _partN; a null start counts as 1.  Null texts give nothing.
    """
    t = F.col(text_col)
    big = F.floor(F.octet_length(t) / 4) > max_tokens
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.size(F.split(t, "\n")) - 1).alias("last")))
    rows = df.where(t.isNotNull()).select(id_col, F.coalesce(F.col(start_col), F.lit(1)).alias("s"), F.col(name_col).alias("n"), big.alias("big"), F.split(t, "\n").alias("ls"), F.posexplode(F.when(big, packed_parts(t, max_tokens)).otherwise(whole)).alias("p", "x"))
    part = F.col("p") + 1
    return rows.select(
        id_col, part.alias("part"), (F.col("s") + F.col("x.first")).cast("int").alias("start_line"), (F.col("s") + F.col("x.last")).cast("int").alias("end_line"),
        F.when(F.col("big"), F.concat("n", F.lit("_part"), part.cast("string"))).otherwise(F.col("n")).alias("name"),
        F.array_join(F.slice("ls", F.col("x.first") + 1, F.col("x.last") - F.col("x.first") + 1), "\n").alias("source"),
    )


def assembled(functions: DataFrame, files: DataFrame, file: str, language: str, text: str, max_tokens: int = 600) -> DataFrame:
    """(file, language, function_name, start_line, end_line, source, tokens, id, suppressed_lines): whole chunk rows.

    ``functions``: file, language, function_name, start_line, source; ``files``: file, language, text, one row each.
    Oversized functions come in parts.  A function's id is the digest of its normalized source, which equal functions
    share; a part's is of its place too.  Directives are found once a file, gathered (they are few) and those of a chunk's
    lines kept inside its row.  Null sources give nothing; files without directives give [].
    """
    from scanloom.functions import text as tx
    from scanloom.operators.findings import suppressions

    parts = split_chunks(functions.withColumn("key", F.struct(file, language)), "key", "source", "start_line", "function_name", max_tokens)
    rows = parts.select(F.col(f"key.{file}").alias(file), F.col(f"key.{language}").alias(language), F.col("name").alias("function_name"), "start_line", "end_line", "source", F.coalesce(F.col("name").rlike("_part[0-9]+$"), F.lit(False)).alias("cut"))
    said = suppressions(files, file, language, text).groupBy(file).agg(F.array_sort(F.collect_list(F.struct("line", "type", "justification", "applies_to", "source_line"))).alias("said"))
    rows = rows.join(said, file, "left")
    plain = tx.normalize_source(F.col("source"), F.col(language))
    number = F.when(F.col("cut"), tx.part_id(F.col(file), F.col("start_line"), plain)).otherwise(tx.chunk_id(plain))
    mine = F.coalesce(F.filter("said", lambda s: s["line"].between(F.col("start_line"), F.col("end_line"))), F.array().cast("array<struct<line:int,type:string,justification:string,applies_to:string,source_line:int>>"))
    return rows.withColumns({"tokens": tx.tokens(F.col("source")), "id": number, "suppressed_lines": mine}).drop("said", "cut")


def last_by_name(chunks: DataFrame, name_col: str, order: list[str]) -> DataFrame:
    """For each function name the chunk that comes last in ``order``; names collide across files."""
    rest = [c for c in chunks.columns if c != name_col]
    return chunks.where(F.col(name_col).isNotNull()).groupBy(name_col).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(name_col, "x.*")


_HEAD = {
    "js": re.compile(r"(?:\bfunction\b\s*\*?\s*(?P<a>[\w$]*)\s*\(|(?:\b(?:const|let|var)\s+)?(?P<b>[\w$]+)\s*[=:]\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*)?\([^()]*\)\s*(?::[^={;]+)?=>|(?P<c>[\w$]+)\s*\([^()]*\)\s*(?::\s*[^={;]+)?(?=\{))"),
    "java": re.compile(r"(?P<c>[\w$]+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{)"),
    "c": re.compile(r"(?P<c>~?[\w:]+)\s*\([^()]*\)\s*(?:const|noexcept|override|\s)*(?=\{)"),
}
_WORDS = frozenset("if for while switch catch return do else synchronized try with function".split())
_TEXTS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")


def functions_of(text: str, language: str) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, source) of the outermost functions; [] for a text that does not parse.

    Python goes through its own parser; the other languages through balanced braces behind a function's head, with
    strings and comments blanked.  Nested functions are part of the outer one.
    """
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        out, lines = [], text.split("\n")

        def visit(node: ast.AST) -> None:
            for n in ast.iter_child_nodes(node):
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    src = "\n".join([lines[n.lineno - 1][n.col_offset :], *lines[n.lineno : n.end_lineno]])
                    out.append((n.name, n.lineno, n.end_lineno, src))
                else:
                    visit(n)

        visit(tree)
        return out
    blank = _TEXTS.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    if blank.count("{") != blank.count("}"):
        return []
    kind = {"javascript": "js", "typescript": "js", "java": "java"}.get(language, "c")
    out, at = [], 0
    for m in _HEAD[kind].finditer(blank):
        if m.start() < at:
            continue
        name = next((g for g in m.groupdict().values() if g), "")
        if name in _WORDS:
            continue
        i = blank.find("{", m.end())
        if i < 0 or ";" in blank[m.end() : i]:
            continue
        depth, j = 1, i + 1
        while depth and j < len(blank):
            depth += (blank[j] == "{") - (blank[j] == "}")
            j += 1
        if depth:
            return []
        start = text.rfind("\n", 0, m.start()) + 1
        start += len(text[start : m.start()]) - len(text[start : m.start()].lstrip())
        out.append((name or ("anonymous" if kind in ("js", "c") else "unknown"), text.count("\n", 0, start) + 1, text.count("\n", 0, j) + 1, text[start:j]))
        at = j
    return out


def function_chunks(df: DataFrame, id_col: str, language_col: str, text_col: str) -> DataFrame:
    """(id, function_name, start_line, end_line, source): outermost functions of each file that parses."""
    fields = [("function_name", T.StringType(), pa.string()), ("start_line", T.IntegerType(), pa.int32()), ("end_line", T.IntegerType(), pa.int32()), ("source", T.StringType(), pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for row in functions_of(text or "", lang or ""):
                    owner.append(i)
                    rows.append(row)
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, k) for c, (_, _, k) in zip(cols, fields)]], names=[id_col, *[f[0] for f in fields]])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, t) for n, t, _ in fields]])
    return df.select(id_col, language_col, text_col).mapInArrow(work, schema)
