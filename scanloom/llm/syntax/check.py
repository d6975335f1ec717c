"""Which source files do not parse, and what they are instead.

Every file goes through the grammars of all languages; those that read it are ranked by its tokens.  Its own grammar
decides whether it is valid; where it fails, another that reads it means a wrong extension, and none means corruption.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.syntax.core import Undecided
from scanloom.llm.syntax.java import Java
from scanloom.llm.syntax.native import Native
from scanloom.llm.syntax.script import Script, Typed

LANGUAGES = ("python", "javascript", "typescript", "java", "c", "cpp")
# Extension to language.
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "cpp": "cpp"}
# Words and signs that speak for a language.
SIGNS = {
    "python": "def elif self None True False import from lambda except pass raise with as not and or",
    "javascript": "function const let var => === require module exports undefined async await typeof new this",
    "typescript": "interface : any string number boolean unknown export import readonly => const let type as",
    "java": "package import public private protected class static final void new throws extends implements String boolean @",
    "c": "# include define struct const char int void static size_t NULL -> * unsigned typedef",
    "cpp": "# include namespace std :: auto class template nullptr const -> using public virtual string",
}
# The languages that read most texts of a language.
LIKELY = {k: (k,) for k in LANGUAGES} | {"javascript": ("javascript", "typescript"), "c": ("c", "cpp")}
_SIGNS = {k: v.split() for k, v in SIGNS.items()}
_ALL_SIGNS = frozenset().union(*_SIGNS.values())
_WORD = re.compile(r"[A-Za-z_]\w*|=>|===|::|->|[#@*:]")


class Python:
    """Python 3, by the interpreter's own parser and compiler, which also refuses a return outside a function and the like."""

    def parses(self, text: str, lender: object = None, likely: bool = True) -> bool:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                compile(text, "", "exec", dont_inherit=True)
                return True
            except (SyntaxError, ValueError):
                return False
            except (RecursionError, MemoryError) as e:
                raise Undecided from e


@lru_cache(maxsize=None)
def grammar(language: str):
    """The grammar of a language, one per worker."""
    return {"python": Python, "javascript": Script, "typescript": Typed, "java": Java, "c": lambda: Native(False), "cpp": lambda: Native(True)}[language]()


def parses(text: str | None, language: str, lender: object = None, likely: bool = True) -> bool | None:
    """Whether a text is valid in a language; nothing, blanks and comments are; None where the interpreter's depth does not suffice to tell.

    ``lender`` and ``likely``: see Grammar.parses.
    """
    if not text or text.isspace():
        return True
    try:
        return _parses(text, language, lender, likely)
    except Undecided:
        return None


def _parses(text: str, language: str, lender: object, likely: bool) -> bool:
    return grammar(language).parses(text[1:] if text[0] == "﻿" else text, lender, likely)


def ranked(text: str) -> list[str]:
    """All languages, the likeliest by tokens first; ties in the order of LANGUAGES."""
    count = Counter(_WORD.findall(text))
    some = {w: min(count[w], 20) for w in _ALL_SIGNS if w in count}
    score = {k: sum(some[w] for w in signs if w in some) / len(signs) for k, signs in _SIGNS.items()}
    return sorted(LANGUAGES, key=lambda k: -score[k])


def asked(text: str | None, language: str | None = None) -> dict[str, bool | None]:
    """What each language's grammar says of a text, the likeliest language by its tokens first if several read it; ``language``: what it should be."""
    likely = LIKELY[language or (ranked(text) if text else LANGUAGES)[0]]
    said = {k: parses(text, k, grammar("javascript"), k in likely) for k in LANGUAGES}
    if text and sum(map(bool, said.values())) > 1:  # fewer have no order
        said = {k: said[k] for k in ranked(text)}
    return said


def readers(text: str | None) -> list[str]:
    """All languages whose grammars read a text, the likeliest by its tokens first."""
    return [k for k, ok in asked(text).items() if ok]


def verdict(text: str | None, language: str) -> tuple[bool | None, str | None, list[str]]:
    """(valid, the language it counts as, all that read it): its own if that reads it, else the likeliest other, else none.

    A text that is too deep for its own grammar is not judged: null, and no language.
    """
    said = asked(text, language)
    found = [k for k, ok in said.items() if ok]
    if said[language] is None:
        return None, None, found
    return said[language], language if said[language] else next(iter(found), None), found


def language_of(path: Column) -> Column:
    """Language by extension, null for others."""
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def check_syntax(df: DataFrame, id_col: str, path_col: str, text_col: str, invalid_only: bool = False) -> DataFrame:
    """(id, language, valid, parses_as, read_by, verdict) of every row; a map without a shuffle.

    ``read_by`` lists every language whose grammar reads the text; ``verdict`` is valid, wrong extension, corrupt or, for
    rules nested deeper than the interpreter allows, not judged (then ``valid`` is null).
    Rows whose path is null or has another extension get null in all these columns, null and empty contents are valid, repeated rows stay repeated, other columns aren't read.
    ``invalid_only`` keeps the failing rows.
    """
    rows = df.select(F.col(id_col).alias("k"), language_of(F.col(path_col)).alias("lang"), F.col(text_col).alias("t"))
    if invalid_only:
        rows = rows.where("lang IS NOT NULL AND length(t) > 0")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, langs, valid, reads, all_, said = [], [], [], [], [], []
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                ok, other, found = (None, None, None) if lang is None else verdict(text, lang)
                if invalid_only and ok is not False:
                    continue
                keep.append(i)
                langs.append(lang)
                valid.append(ok)
                reads.append(other)
                all_.append(found)
                said.append(None if lang is None else "not judged" if ok is None else "valid" if ok else "wrong extension" if other else "corrupt")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(langs, pa.string()), pa.array(valid, pa.bool_()), pa.array(reads, pa.string()), pa.array(all_, pa.list_(pa.string())), pa.array(said, pa.string())],
                names=[id_col, "language", "valid", "parses_as", "read_by", "verdict"],
            )

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("language", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("parses_as", T.StringType()), T.StructField("read_by", T.ArrayType(T.StringType())), T.StructField("verdict", T.StringType())])
    return rows.mapInArrow(work, schema)


def invalid_rates(df: DataFrame, id_col: str, group_col: str, path_col: str, text_col: str) -> DataFrame:
    """(group, language, files, invalid, wrong_extension, corrupt, rate) over distinct ids, with partial aggregation.

    Files of no known language aren't counted; a null group is a group.
    """
    found = check_syntax(df, id_col, path_col, text_col, invalid_only=True).select(id_col, "verdict").distinct()
    files = df.select(id_col, F.col(group_col).alias("g"), language_of(F.col(path_col)).alias("language")).where("language IS NOT NULL").dropDuplicates([id_col])
    both = files.join(found, id_col, "left").groupBy(F.col("g").alias(group_col), "language")
    bad = F.count("verdict")
    return both.agg(
        F.count("*").alias("files"), bad.alias("invalid"), F.count_if(F.col("verdict") == "wrong extension").alias("wrong_extension"), F.count_if(F.col("verdict") == "corrupt").alias("corrupt"), F.round(bad / F.count("*"), 6).alias("rate")
    )
