"""Prompts as columns: one for each question, put together inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions import text as tx

# What each kind means, for the analyzer's instructions.
QUESTIONS = {
    "sql_injection": "values from outside that become part of an SQL statement instead of being bound to it",
    "xss": "values from outside that reach a page or response without being escaped for it",
    "path_traversal": "values from outside that choose a file without being held below a fixed directory",
    "insecure_deserialization": "objects rebuilt from data that the caller may have written",
    "auth_issue": "missing, weak or avoidable checks of who may do something",
    "crypto_issue": "weak algorithms, keys, modes or random numbers where secrecy or integrity is meant",
    "command_injection": "values from outside that become part of a command line",
    "ssrf": "requests whose target the caller chooses",
    "xxe_injection": "XML parsers that resolve external entities of foreign documents",
    "buffer_overflow": "writes or reads beyond the end of an object",
    "format_string": "format strings that the caller may have written",
    "use_after_free": "memory used, or freed again, after it was freed",
    "integer_overflow": "sizes or indices whose arithmetic can wrap",
}
#: Bytes of a passage's description that are shown.
DESCRIPTION_BYTES = 200
NATIVE = ("buffer_overflow", "format_string", "use_after_free", "integer_overflow")

_REPLY = 'Answer with JSON alone: {"findings": [{"type": "...", "severity": "low|medium|high|critical", "confidence": 0.0, "line": 1, "quote": "the line", "message": "...", "recommendation": "..."}]}. Without findings the list is empty.'
STRICTER = "The last answer could not be read. Write one JSON object and nothing else: it begins with { and ends with }, without a fence and without words around it.\n\n"


def _pick(kind: Column, texts: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[kind], F.lit(""))


def framework_list(frameworks: Column) -> Column:
    """Names of frameworks in a line; a sentence where there are none."""
    return F.coalesce(F.nullif(F.array_join(frameworks, ", "), F.lit("")), F.lit("No frameworks detected"))


def passages(entries: Column) -> Column:
    """Title and shortened description of each retrieved entry, a line each; '' without entries."""
    shown = F.transform(entries, lambda e: F.concat(F.lit("- "), F.coalesce(e["title"], F.lit("")), F.lit(": "), F.coalesce(tx.truncated(e["description"], DESCRIPTION_BYTES), F.lit(""))))
    return F.coalesce(F.array_join(shown, "\n"), F.lit(""))


def analysis(kind: Column, path: Column, name: Column, source: Column, first: Column, last: Column, frameworks: Column, entries: Column, hints: Column) -> Column:
    """The question about one kind in one chunk.

    Sections without content are left out, and kinds of C and C++ have no hints; null arrays count as empty.
    """
    section = lambda title, body: F.when(F.length(body) > 0, F.concat(F.lit(f"\n{title}:\n"), body, F.lit("\n"))).otherwise("")
    hint_lines = F.coalesce(F.array_join(F.transform(hints, lambda h: F.concat(F.lit("- "), h)), "\n"), F.lit(""))
    return F.concat(
        F.lit("Kind: "), kind, F.lit("\nLook for "), _pick(kind, QUESTIONS), F.lit(".\nFile: "), F.coalesce(path, F.lit("")), F.lit(", function "), F.coalesce(name, F.lit("unknown")), F.lit(", lines "), first.cast("string"), F.lit("-"), last.cast("string"),
        F.lit("\nFrameworks: "), framework_list(frameworks), F.lit("\n"), section("Hints", F.when(kind.isin(*NATIVE), "").otherwise(hint_lines)), section("Known patterns", passages(entries)), F.lit("\nCode:\n```\n"), tx.numbered(source, first), F.lit("\n```\n"), F.lit(_REPLY),
    )


def stricter(prompt: str) -> str:
    """The prompt of the second attempt."""
    return STRICTER + prompt


def judgement(path: Column, center: Column, code: Column, candidates: Column) -> Column:
    """Which one of several kinds a place shows; ``candidates``: array of struct<type, message>."""
    lines = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("- "), c["type"], F.lit(": "), F.coalesce(c["message"], F.lit("")))), "\n")
    return F.concat(F.lit("Judge: one place, several kinds.\nFile: "), path, F.lit(", around line "), center.cast("string"), F.lit("\nCode:\n```\n"), code, F.lit("\n```\nCandidates:\n"), lines, F.lit('\nName the one kind that the code shows, or none. Answer with JSON alone: {"selected_types": ["..."], "line": 1}'))


def verification(path: Column, code: Column, kind: Column, line: Column, message: Column) -> Column:
    """Whether one finding holds."""
    return F.concat(F.lit("Verify: "), kind, F.lit(" at line "), line.cast("string"), F.lit("\nFile: "), path, F.lit("\nCode:\n```\n"), code, F.lit("\n```\nNote: "), F.coalesce(message, F.lit("")), F.lit('\nDoes the code shown have this weakness at this line? Count only checks that are shown. Answer with JSON alone: {"applies": true, "confidence": 0.0, "reason": "..."}'))


def documentation(path: Column, source: Column) -> Column:
    """A request for documentation of a source."""
    return F.concat(F.lit("Document the functions of this source: what each does, its parameters, what it returns.\nFile: "), path, F.lit("\n```\n"), tx.numbered(source, F.lit(1)), F.lit("\n```"))


def tests(path: Column, name: Column, language: Column, source: Column) -> Column:
    """A request for tests of a function, in one fence."""
    return F.concat(F.lit("Write tests in "), language, F.lit(" for the function "), F.coalesce(name, F.lit("unknown")), F.lit(" of "), path, F.lit(", in one fence.\n```\n"), source, F.lit("\n```"))


def repair(path: Column, kind: Column, line: Column, message: Column, code: Column) -> Column:
    """A request for a source without a finding, in one fence."""
    return F.concat(F.lit("Repair "), kind, F.lit(" at line "), line.cast("string"), F.lit(" of "), path, F.lit(" and change nothing else.\nNote: "), F.coalesce(message, F.lit("")), F.lit("\nGive the whole source in one fence.\n```\n"), code, F.lit("\n```"))


def whole_file(path: Column, language: Column, source: Column) -> Column:
    """The question without chunks, retrieval or hints: one file, all kinds."""
    kinds = F.when(language.isin("c", "cpp"), ", ".join(NATIVE)).otherwise(", ".join(k for k in QUESTIONS if k not in NATIVE))
    return F.concat(F.lit("Kind: all\nLook for "), kinds, F.lit(".\nFile: "), path, F.lit("\nCode:\n```\n"), tx.numbered(source, F.lit(1)), F.lit("\n```\n"), F.lit(_REPLY))
