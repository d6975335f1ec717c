"""Paths: language, test files, exclusion, match keys.  A null path gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and languages; other names of languages.
EXTENSIONS = {".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp"}
ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "c++": "cpp"}
# Directories and files that are left out.
EXCLUDED_DIRS = ("node_modules", "vendor", ".git", "dist", "build", "__pycache__")
EXCLUDED_FILES = ("*.min.js", "*.bundle.js")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of a fixed map, null where it has none."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def slashes(path: Column) -> Column:
    """A path with forward slashes."""
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The extension in lower case with its dot, '' where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """Language by extension, null for others."""
    return lookup(EXTENSIONS, extension(path))


def language_name(name: Column) -> Column:
    """A language under its one name; unknown names stay, in lower case."""
    low = F.lower(name)
    return F.coalesce(lookup(ALIASES, low), low)


def is_test(path: Column) -> Column:
    """Whether a path looks like a test: parts of the base name, its stem's ends, or a test directory."""
    p = F.lower(slashes(path))
    base = base_name(p)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return base.rlike(r"[._](test|spec)\.") | stem.rlike(r"(test|spec)$") | stem.startswith("test_") | p.rlike(r"(^|/)(tests?|__tests__)/")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over a whole string; * and ? never cross a slash."""
    out = ""
    for c in glob:
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
    return f"^{out}$"


def excluded(path: Column, ignore: tuple[str, ...] = ()) -> Column:
    """Whether a file lies in an excluded directory or matches an excluded or ignored pattern.

    A pattern ending in / and a bare name mean directories anywhere; a bare name also a file in the root; a pattern
    with * or ? is held against the base name and the whole path; one with a slash against the path and what is below.
    """
    p = slashes(path)
    folders = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    hit = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in EXCLUDED_DIRS]))
    for g in EXCLUDED_FILES:
        hit = hit | base_name(p).rlike(glob_pattern(g))
    for g in ignore:
        g = g.strip().removeprefix("./")
        name = g.rstrip("/")
        if not name or g.startswith("#"):
            continue
        if "*" in name or "?" in name:
            hit = hit | base_name(p).rlike(glob_pattern(name)) | p.rlike(glob_pattern(name))
        elif "/" in name:
            hit = hit | (p == name) | p.startswith(name + "/")
        else:
            hit = hit | F.array_contains(folders, name) | (F.lit(not g.endswith("/")) & (p == name))
    return hit


def relative(path: Column, root: Column) -> Column:
    """A path below a root, without the root and leading ./ ."""
    p = slashes(path)
    r = F.concat(F.regexp_replace(slashes(root), "/+$", ""), F.lit("/"))
    return F.regexp_replace(F.when(p.startswith(r), F.substring(p, F.length(r) + 1, 1 << 30)).otherwise(p), r"^(\./)+", "")
