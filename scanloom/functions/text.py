"""Texts of code and of model replies.  Nulls give null; lengths are in bytes of UTF-8 where said so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f\\x0B]"


def tokens(text: Column) -> Column:
    """Estimated tokens: bytes over 4, rounded down."""
    return (F.octet_length(text) / 4).cast("int")


def strip_comments(text: Column, language: Column) -> Column:
    """Code without comments; C and C++ keep theirs."""
    slash = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?d)//.*", "")
    quotes = F.regexp_replace(F.regexp_replace(text, r'(?s)""".*?"""', ""), r"(?s)'''.*?'''", "")
    hashes = F.regexp_replace(quotes, r"(?d)#.*", "")
    return F.when(language.isin("javascript", "typescript", "java"), slash).when(language == "python", hashes).otherwise(text)


def normalize_source(text: Column, language: Column) -> Column:
    """Code in a comparable layout: one kind of line end, no comments, one blank line at most, spaced operators."""
    s = strip_comments(F.regexp_replace(text, "\r\n", "\n"), language)
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    s = F.regexp_replace(s, r"([^=!><])[ \t\n\f\r]*=[ \t\n\f\r]*([^=])", "$1 = $2")
    s = F.regexp_replace(s, r"[ \t\n\f\r]*([+\-*/%])[ \t\n\f\r]*", " $1 ")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, "[ \t]+\n", "\n")
    return F.regexp_replace(s, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")


def chunk_id(normalized: Column) -> Column:
    """SHA-256 of the normalized source; equal functions share it."""
    return F.sha2(normalized, 256)


def part_id(path: Column, start: Column, normalized: Column) -> Column:
    """SHA-256 of a part of a split chunk, by place and source."""
    return F.sha2(F.concat_ws(":", path, start.cast("string"), normalized), 256)


def finding_id(chunk: Column, kind: Column, line: Column) -> Column:
    """First 8 characters of the chunk, type and line; not unique."""
    return F.concat_ws("-", F.substring(chunk, 1, 8), kind, line.cast("string"))


def lines(text: Column) -> Column:
    """The lines of a text."""
    return F.split(text, "\n")


def numbered(text: Column, first: Column) -> Column:
    """Lines with their numbers, right-aligned to the last number's width."""
    ls = lines(text)
    width = F.length((first + F.size(ls) - 1).cast("string"))
    return F.array_join(F.transform(ls, lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, " "), F.lit(": "), x)), "\n")


def excerpt(text: Column, line: Column, around: int = 15) -> Column:
    """Numbered lines around a line, as far as the text goes."""
    ls = lines(text)
    lo = F.greatest(line - around, F.lit(1))
    hi = F.least(line + around, F.size(ls))
    part = F.slice(ls, lo, F.greatest(hi - lo + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda x, i: F.concat((lo + i).cast("string"), F.lit(": "), x)), "\n")


def first_bytes(text: Column, n: Column) -> Column:
    """The longest beginning of at most ``n`` bytes that ends between characters; '' for n below 1."""
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.hex(F.substring(raw, n + 1 - k, F.lit(1))).between("80", "BF")  # noqa: E731  (the byte behind n - k goes on with a character)
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(n < 1, F.when(text.isNotNull(), "")).when(F.octet_length(text) <= n, text).otherwise(F.decode(F.substring(raw, F.lit(1), n - back), "UTF-8"))


def truncated(text: Column, limit: int) -> Column:
    """A text of more than ``limit`` bytes cut to that size, ... included, between characters."""
    return F.when(F.octet_length(text) > limit, F.concat(first_bytes(text, F.lit(max(0, limit - 3))), F.lit("..."))).otherwise(text)


def normalize_line(line: Column) -> Column:
    """A line without a leading line number, trimmed, with single blanks."""
    s = F.regexp_replace(line, r"^[ \t\n\f\r]*[0-9]+[ \t\n\f\r]*[:|][ \t\n\f\r]?", "")
    s = F.regexp_replace(s, r"^[ \t\n\f\r\x0B]+|[ \t\n\f\r\x0B]+$", "")
    return F.regexp_replace(s, r"[ \t\n\f\r]+", " ")


def line_at(text: Column, offset: Column) -> Column:
    """The number of the line that holds a character (both from 1)."""
    before = F.substring(text, F.lit(1), offset - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def absolute_line(line: Column, start: Column, end: Column) -> Column:
    """A line that lies in the chunk stays, another counts from the chunk's start."""
    return F.when((line >= start) & (line <= end), line).otherwise(start + line - 1)


def json_object(reply: Column) -> Column:
    """The text from the first { to the last }, null where there is none."""
    s = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(s != "", s)


def fenced(reply: Column) -> Column:
    """What stands in a json fence, else in any fence, else the reply."""
    a = F.regexp_extract(reply, r"(?s)```json\s*(.*?)```", 1)
    b = F.regexp_extract(reply, r"(?s)```\s*(.*?)```", 1)
    return F.trim(F.when(a != "", a).when(b != "", b).otherwise(reply))


def lenient_int(value: Column) -> Column:
    """A number, or the first digits of a text."""
    digits = F.regexp_extract(value, "[0-9]+", 0)
    return F.coalesce(value.try_cast("int"), digits.try_cast("int"))


def duration(seconds: Column) -> Column:
    """Minutes and seconds."""
    return F.when(seconds < 60, F.format_string("%ds", seconds)).otherwise(F.format_string("%dm %ds", (seconds / 60).cast("int"), seconds % 60))


def cost(amount: Column) -> Column:
    """An amount with two digits and its sign."""
    return F.format_string("$%.2f", amount.cast("double"))


def title(snake: Column) -> Column:
    """Words of a snake_case name, each with a capital, tails as they are."""
    return F.array_join(F.transform(F.split(snake, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def plain_terminal(text: Column) -> Column:
    """A text without terminal colours."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")
