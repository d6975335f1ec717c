"""Splitting of oversized sources into balanced pieces at natural boundaries.

The least number of pieces is computed, equal-length targets are placed, and each target snaps to the strongest
boundary near it.  If a piece with the lines it shares with its neighbour breaks the limit, a piece is added and
the targets are placed anew.  A line over the limit is a row of small fragments to this search.  Where lines near the
limit let no equal targets succeed, they are placed anew for the rest of the text after each cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens a piece may have: bytes of UTF-8 over 4, rounded down.
MAX_TOKENS = 600
#: Lines that neighbours share.
OVERLAP = 2
#: A target may move by this share of a piece's length.
SNAP = 0.25
#: Part of the limit that a fragment of an over-long line fills; words up to half the limit stay whole.
FRAGMENT = 16

_CLOSER = re.compile(r"\s*(?:[}\])]|else\b|elif\b|except\b|catch\b|finally\b|case\b|end\b)")
_CLOSED = re.compile(r"\s*[}\])]+[;,]?\s*$")
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|@)")
_SOFT = re.compile(r"(?<=[;,{}()\s])")
_SEPARATED = re.compile(r"[;,{}()\s]\Z")


def tokens(text: str) -> int:
    """Tokens of a text as the limit counts them."""
    return len(text.encode("utf-8", "surrogatepass")) // 4


def _units(text: str, most: int) -> tuple[list[str], list[int], list[bool]]:
    """Lines with their ends; a line over ``most`` bytes is cut behind separators, long words between characters.

    The fragments are small, so that pieces have room for shared lines and targets find a place within the line.
    """
    units, line_of, ends = [], [], []
    part, word_most = max(4, most // FRAGMENT), max(4, most // 2)
    lines = [x for x in re.split(r"(?<=\n)", text) if x]
    for k, line in enumerate(lines):
        if len(line) * 4 > most and len(line.encode("utf-8", "surrogatepass")) > most:
            parts, cur, size = [], [], 0
            for word in _SOFT.split(line):
                n = len(word.encode("utf-8", "surrogatepass"))
                if size + n > part and cur:
                    parts.append("".join(cur))
                    cur, size = [], 0
                if n > word_most:
                    step = part // 4
                    parts += [word[i : i + step] for i in range(0, len(word) - step, step)]
                    word = word[(len(word) - 1) // step * step :]
                    n = len(word.encode("utf-8", "surrogatepass"))
                cur.append(word)
                size += n
            parts.append("".join(cur))
            parts = [p for p in parts if p]
        else:
            parts = [line]
        units += parts
        line_of += [k] * len(parts)
        ends += [False] * (len(parts) - 1) + [True]
    return units, line_of, ends


def _strength(units: list[str], ends: list[bool], i: int) -> int:
    """How natural a cut behind unit i is: low indentation, blank lines and closed blocks count for it."""
    if not ends[i]:  # within a line: behind a separator rather than within a word
        return 0 if _SEPARATED.search(units[i]) else -1
    j = i + 1
    while j < len(units) - 1 and not units[j].strip():
        j += 1
    here, nxt = units[i], units[j]
    indent = len(nxt.expandtabs(4)) - len(nxt.expandtabs(4).lstrip())
    score = 100 - min(indent, 60)
    score += 20 * (not here.strip()) + 10 * bool(_CLOSED.match(here))
    score -= 25 * bool(_CLOSER.match(nxt)) + 15 * bool(_COMMENT.match(here))
    return max(score, 1)


def cuts(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """Pieces (start_line, end_line, shared, tokens, text) of a text, lines from 0; ``shared`` lines repeat from the piece before.

    A text within the limit is one piece; the empty text is one empty piece.  Without their shared lines the
    pieces add up to the text.  Where the shared lines don't fit (lines near the limit), fewer are shared; a line over
    the limit, or a part of it, is never shared.
    """
    limit = max_tokens * 4 + 3
    size = len(text.encode("utf-8", "surrogatepass"))
    if size <= limit:
        return [(0, max(0, text.count("\n") - text.endswith("\n")), 0, size // 4, text)]
    units, line_of, ends = _units(text, limit)
    at = [0, *accumulate(len(u.encode("utf-8", "surrogatepass")) for u in units)]

    def back(cut: int, want: int) -> int:
        """First unit of ``want`` shared lines before a cut; whole lines only, so none that is cut itself."""
        k = cut
        while want and k and ends[k - 1] and (k == 1 or ends[k - 2]):
            k -= 1
            want -= 1
        return k

    def strength(cut: int) -> int:
        s = known.get(cut)
        if s is None:
            s = known[cut] = _strength(units, ends, cut - 1)
        return s

    n, known = -(-size // limit), {}
    found = None
    while n < len(units) and n <= 4 * (size // limit + 1):
        places, last = [], 0
        for k in range(1, n):
            goal, slack = size * k / n, size / n * SNAP
            lo, hi = max(last + 1, bisect_left(at, goal - slack)), min(len(units) - 1, bisect_right(at, goal + slack) - 1)
            if hi < lo:
                lo = hi = max(last + 1, min(len(units) - 1, bisect_left(at, goal)))
            if lo >= len(units):
                places = None
                break
            last = max(range(lo, hi + 1), key=lambda c: (strength(c), -abs(at[c] - goal)))
            places.append(last)
        edges = [0, *(places or ()), len(units)]
        if places is not None and all(b > a and at[b] - at[back(a, overlap) if a else 0] <= limit for a, b in zip(edges, edges[1:])):
            found = [(back(a, overlap) if a else 0, a, b) for a, b in zip(edges, edges[1:])]
            break
        n += 1
    if found is None:  # lines near the limit: equal targets for what is left after each cut, sharing what fits
        found, a = [], 0
        while a < len(units):
            first = next(f for w in range(overlap if a else 0, -1, -1) if at[a + 1] - at[f := back(a, w)] <= limit or w == 0)
            top = bisect_right(at, at[first] + limit) - 1
            b = len(units)
            if top < b:
                left, room = size - at[a], limit - min(at[a] - at[first], limit // 2)
                step = left / -(-left // room)
                goal, slack = at[a] + step, step * SNAP
                lo, hi = max(a + 1, bisect_left(at, goal - slack)), min(top, bisect_right(at, goal + slack) - 1)
                if hi < lo:  # a line fills the window: before it, but not far from what fits
                    hi = min(top, max(a + 1, bisect_left(at, goal)))
                    lo = min(hi, max(a + 1, bisect_left(at, (at[a] + at[hi]) / 2)))
                b = max(range(lo, hi + 1), key=lambda c: (at[c] - at[back(c, overlap)] <= limit // 2, strength(c), -abs(at[c] - goal)))
            found.append((first, a, b))
            a = b
    return [
        (line_of[f], line_of[b - 1], line_of[a] - line_of[f] if ends[a - 1] or not a else 0, (at[b] - at[f]) // 4, "".join(units[f:b]))
        for f, a, b in found
    ]


def split_oversized(df: DataFrame, id_col: str, text_col: str, line_col: str | None = None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(id, piece, n_pieces, start_line, end_line, shared_lines, piece_tokens[, piece_text]) of each text over the limit.

    The size is measured, never read from a column, and short texts are dropped before any reaches Python.  Lines
    count from ``line_col`` (1 where it is null or not given).  Null and empty texts have no pieces; a row that is
    delivered again gives its pieces again unless the caller drops them; other columns are not read.
    """
    from pyspark.sql import types as T

    start = F.coalesce(F.col(line_col).cast("int"), F.lit(1)) if line_col else F.lit(1)
    big = df.select(F.col(id_col).alias("k"), start.alias("first"), F.col(text_col).alias("t")).where(F.expr(f"octet_length(t) div 4 > {int(max_tokens)}"))
    fields = [("piece", T.IntegerType(), pa.int32()), ("n_pieces", T.IntegerType(), pa.int32()), ("start_line", T.IntegerType(), pa.int32()), ("end_line", T.IntegerType(), pa.int32()), ("shared_lines", T.IntegerType(), pa.int32()), ("piece_tokens", T.IntegerType(), pa.int32())]
    fields += [("piece_text", T.StringType(), pa.string())] * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, (first, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                pieces = cuts(text, max_tokens, overlap)
                for p, (a, b, shared, n, piece) in enumerate(pieces, 1):
                    owner.append(i)
                    rows.append((p, len(pieces), first + a, first + b, shared, n, piece))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, kind) for c, (_, _, kind) in zip(cols, fields)]], names=[id_col, *[f[0] for f in fields]])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, t) for n, t, _ in fields]])
    return big.mapInArrow(work, schema)
