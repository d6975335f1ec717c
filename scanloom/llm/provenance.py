"""Who wrote a source file: by hand, a generator, a minifier, a third party, or is it data?

Each file gives evidence (its head, the period of its lines, data, copies of marked third-party files).  Siblings, the
files of one kind in a directory, hang in a group; groups hang in their directories and these in theirs.  A group and a
directory have a hidden label of their own: files of a group go together by the group's factor, groups and directories
by their parent's.  Belief propagation over these trees, upward and downward, is exact; a level is one aggregation or
join, so no tree is ever gathered in one place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.syntax.check import language_of
from scanloom.session import fixed_side, settle

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GENERATED, MINIFIED, VENDORED, BLOB = range(5)
#: Usual shares of the labels, the potential of each directory of its own.
PRIOR = (0.8, 0.05, 0.05, 0.05, 0.05)
#: How far a child keeps its directory's label (the rest is spread evenly): a file, and a directory.
FILE_KEEPS, DIR_KEEPS = (0.8, 0.7, 0.7, 0.8, 0.7), (0.6, 0.75, 0.75, 0.85, 0.75)
#: What plain code takes off each label.
PLAIN = (0.0, 3.0, 4.0, 0.7, 4.0)
#: Share of a file's lines that stand in marked third-party files, from which it counts as a copy.
COPY_SHARE = 0.8
#: Evidence of a copy: what a library holds may look generated, but its copy is a library's file.
COPIED = 8.0
#: Shorter lines, like brackets and imports of one word, say nothing about copies.
LINE_CHARS = 25
#: Lines of marked files up to which they are broadcast, and the parts of a line's files beyond it.
LOCAL_LINES, LINE_PARTS = 2_000_000, 16
#: Lines after which statements of generated code repeat, at most.
PERIOD = 12
#: How the group of a directory's siblings is called, before their extension.
GROUP = "*"
EV = [f"e{k}" for k in range(5)]

# What generators write at the head or the end of a file, in English, German, French and Spanish.
_GENERATOR = re.compile(
    r"@generated\b|<auto-generated|\bauto[- ]?generated\b|\bcode generated (?:by|from)\b|\bautomatically (?:generated|created)\b|\b(?:do not|don't) (?:edit|modify)(?: (?:by hand|manually|this file|directly))?[\s.!*/>-]*$|\bdo not modify by hand\b"
    r"|\bmachine[- ](?:written|generated)\b|\bedits? (?:is|are|will be) (?:overwritten|lost)\b|\bchanges will be (?:lost|overwritten)\b|^\W*generated (?:by|from|on|with|using)\b|\boutput, rerun\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht (?:bearbeiten|ändern)\b|\bne pas (?:modifier|éditer)\b|\bgénéré automatiquement\b|\bno (?:editar|modificar)\b|\bgenerado automáticamente\b",
    re.I | re.M,
)
# How a library names itself at the head of its files.
_LIBRARY = re.compile(
    r"^\W*(?P<n>[a-z][\w.-]{2,40}) (?:v?\d+\.\d+(?:\.\d+)*\b(?:\s*\||\s*$)|- copyright\b)|\(c\) the (?P<m>[a-z][\w.-]{2,40}) (?:authors|contributors)\b|\bcopyright \(c\) \d{4}(?:-\d{4})? (?:the )?(?P<k>[a-z][\w.-]{2,40}) (?:contributors|authors|project)\b|^\W*@license\b|^/\*! ", re.I | re.M
)
_COMMENT = re.compile(r"\A(?:\s*(?:#(?!include|define|if|pragma)[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->))+")
_COMMENT_LINE = re.compile(r"\s*(?:#(?!include|define|if|pragma|endif|else|undef)|//)")
_COMMENT_START = re.compile(r"(?:#(?!include|define|if|pragma|endif|else|undef)|//|/\*|\*(?:[\s/]|$)|<!--)")
_BLOCKS = {"*/": "/*", "-->": "<!--"}
_DATA = re.compile(
    r"(?<![\w.])(?:[-+]?(?:0[xX][0-9a-fA-F]++|\d[\d.]*+(?:[eE][-+]?\d++)?+)[uUlLfF]*+[\s,;\]\[{}()]++){8,}+|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{60,}+"
    r"|(?<![\w\"'])(?:[\"']?\w++[\"']?\s*+:\s*+[-+]?\d[\d.]*+\s*+,\s*+){8,}+"
)
_BINARY = re.compile(r"[\x00-\x08\x0e-\x1a\x7f\ufffd]")
# The tables of parser generators.
_TABLES = re.compile(r"\b(?:static\s+)?(?:const\s+)?(?:unsigned\s+)?(?:short|int|char|yy\w*)\s+yy_?\w+\[[^\]]*\]\s*=|\byy(?:table|check|pact|defact)\b")
_NAMES = {i: None for i in range(128) if chr(i).isalnum() or chr(i) in "_ \t\r"}
# Directories that say what is in them.
_DIR_SAYS = {
    VENDORED: re.compile(r"^(?:node_modules|third[_-]?party|3rdparty|extern|externals?|deps|bower_components|site-packages|vendored|.*-\d+\.\d+(?:\.\d+)+)$", re.I),
    GENERATED: re.compile(r"^(?:__generated__|generated(?:[_-](?:src|sources))?|gen|autogen)$", re.I),
    MINIFIED: re.compile(r"^(?:dist|public|bundles?)$", re.I),
    BLOB: re.compile(r"^(?:assets|fixtures|blobs?)$", re.I),
}
DIR_WEIGHT = {VENDORED: 2.5, GENERATED: 2.5, MINIFIED: 1.5, BLOB: 1.5}
_NAME_SAYS = {
    GENERATED: re.compile(r"(?:_pb2?(?:_grpc)?|\.pb|\.gen|\.g|\.generated|_generated|_gen|\.designer)\.\w+$", re.I),
    MINIFIED: re.compile(r"(?:[.-]min|\.bundle|\.chunk|[.-][0-9a-f]{8,20})\.\w+$", re.I),
}


def _tail(text: str) -> str:
    """The comments that end a text.  Behind the last code there is no open string, so none of them is a literal's line."""
    at = begin = len(text.rstrip())
    while at:
        start = text.rfind("\n", 0, at) + 1
        if not _COMMENT_LINE.match(text, start, at):
            closer = next((c for c in _BLOCKS if text.endswith(c, start, at)), None)
            opened = text.rfind(_BLOCKS[closer], 0, at - len(closer)) if closer else -1
            if opened < 0 or text.find(closer, opened + 2, at) != at - len(closer):
                break
            start = text.rfind("\n", 0, opened) + 1
            if text[start:opened].strip():
                break
        begin = at = start
        while at and text[at - 1].isspace():
            at -= 1
    return text[begin:].rstrip()


def periodic(lines: list[str]) -> float:
    """Share of lines in stretches where statements of one form come again and again in one order, three times at least.

    A line's form is what is left without names, numbers and blanks; a stretch of equal forms has no order, in one that
    repeats its very lines nothing is filled in, and one without a bracket is a list of settings.
    """
    n = len(lines)
    if n < 6:
        return 0.0
    names: dict[str, int] = {}
    form = np.array([names.setdefault(x, len(names)) for x in "\n".join(lines).translate(_NAMES).split("\n")])
    bracket = np.array(["(" in x for x in names])[form]
    covered = np.zeros(n, bool)
    for p in range(2, min(PERIOD, n // 3) + 1):
        same = form[:-p] == form[p:]
        if not same.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= 2 * p and (form[a : a + p] != form[a]).any() and bracket[a : a + p].any() and 2 * len(set(lines[a : b + p])) > b - a + p:
                covered[a : b + p] = True
    return float(covered.mean())


def evidence(path: str | None, text: str | None) -> tuple[list[float], bool]:
    """Log evidence of a file for each label, and whether it is marked as a third party's."""
    e = [0.0] * 5  # what is usual is up to the directory
    marked = False
    for label, name in _NAME_SAYS.items():
        if path and name.search(path):
            e[label] += 2.0
    if not text or text.isspace():
        return e, False
    head = m.group() if (m := _COMMENT.match(text)) else ""
    tail = _tail(text[len(head) :])
    said = [x for x in (head, tail) if x]
    if any(map(_GENERATOR.search, said)):
        e[GENERATED] += 8.0
    if any(map(_LIBRARY.search, said)):
        e[VENDORED] += 8.0
        marked = True
    size = len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = lambda x: sum(1 for y in x.split("\n") if y and not y.isspace())
    share = periodic(lines[count(head) : len(lines) - count(tail)])
    e[GENERATED] += 7.0 if share > 0.65 else 1.0 if share > 0.5 else 0.0
    if "yy" in text and _TABLES.search(text):
        e[GENERATED] += 9.0
    data = sum(b - a for a, b in (m.span() for m in _DATA.finditer(text))) / size
    e[BLOB] += 9.0 if data > 0.9 else 0.0
    mean = size / max(1, len(lines))
    if data < 0.65 and mean > 180 and not _BINARY.search(text):
        blanks = sum(map(text.count, (" ", "\t", "\n"))) / size
        if blanks < 0.2:
            e[MINIFIED] += 9.0 if blanks < 0.12 else 2.5
            marked = False
    if max(e) < 2:  # code that shows nothing of the kind is seldom generated, minified or data; third parties write such code
        e = [x - y for x, y in zip(e, PLAIN)]
    return e, marked


def line_digests(text: str | None) -> np.ndarray:
    """64-bit digests of a text's different lines of LINE_CHARS or more, trimmed.

    A text of fewer than four such lines has one digest of the whole, without its lines of comment, unless that is no
    longer than a line that says nothing.
    """
    lines = [x.strip() for x in text.split("\n")] if text else []
    long = {x for x in lines if len(x) >= LINE_CHARS}
    if len(long) < 4:
        whole = "\n".join(x for x in lines if x and not _COMMENT_START.match(x))
        long = {"whole\n" + whole} if len(whole) >= LINE_CHARS else set()
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in long], np.uint64).view(np.int64)


def file_evidence(df: DataFrame, id_col: str, repo_col: str, path_col: str, text_col: str) -> DataFrame:
    """(k, repo, path, marked, e0..e4, h) of every row, ``h`` its digests of lines; content is read once and stays behind."""
    names = ["k", "repo", "path", "marked", *EV, "h"]
    schema = T.StructType([T.StructField("k", df.schema[id_col].dataType), T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), T.StructField("marked", T.BooleanType()), *[T.StructField(x, T.DoubleType()) for x in EV], T.StructField("h", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            rows = [evidence(p, t) for p, t in zip(batch.column(2).to_pylist(), texts)]
            cols = [pa.array([r[0][k] for r in rows], pa.float64()) for k in range(5)]
            digests = [line_digests(t) for t in texts]
            at = np.concatenate(([0], np.cumsum([len(x) for x in digests])))
            h = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *digests])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r[1] for r in rows], pa.bool_()), *cols, h], names=names)

    src = df.select(F.col(id_col).alias("k"), F.coalesce(F.col(repo_col), F.lit("")).alias("repo"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("t"))
    return src.mapInArrow(work, schema)


def sibling_group(path: Column) -> Column:
    """The place of a file's group: its directory, and below it the files of its extension."""
    parts = F.split(path, "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    kind = F.concat(F.lit(GROUP), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))
    return F.when(folder == "", kind).otherwise(F.concat_ws("/", folder, kind))


def copies(seen: DataFrame) -> DataFrame:
    """(k, share): share of a file's lines that stand in marked files, where it reaches COPY_SHARE.

    ``seen`` has k, marked and h, one row a delivery; each delivery is compared by itself.  Marked files are compared
    too.  The lines of marked files are broadcast if they are counted few; else they meet the others' lines in parts, since
    some lines stand in a great many files.
    """
    known = settle(seen.where("marked").select(F.explode("h").alias("x")).distinct())
    each = seen.where("size(h) > 0").select(F.monotonically_increasing_id().alias("r"), "k", F.size("h").alias("n"), "h").select("r", "k", "n", F.explode("h").alias("x"))
    side = fixed_side(known, LOCAL_LINES)
    if side is known:
        some = F.lit(LINE_PARTS).cast("long")
        each = each.withColumn("part", F.pmod("r", some))
        hit = each.join(known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), some - 1))), ["x", "part"])
    else:
        hit = each.join(side, "x")
    share = hit.groupBy("r", "k", "n").agg(F.count("*").alias("hits")).groupBy("k").agg(F.max(F.col("hits") / F.col("n")).alias("share"))
    return share.where(F.col("share") >= COPY_SHARE)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scaled(vec: Column, body) -> Column:
    """log(body(x)) for the probabilities x of log values ``vec``, scaled by the largest."""
    return _let(vec, lambda v: _let(F.array_max(v), lambda m: F.transform(_let(F.transform(v, lambda y: F.exp(y - m)), body), lambda y: F.log(y) + m)))


def _pass_up(vec: Column, keeps: tuple[float, ...]) -> Column:
    """Message to a parent: for each of its labels, how well the child's labels fit it."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    return _scaled(vec, lambda x: _let(total(x), lambda t: F.array(*[x[i] * keeps[i] + (t - x[i]) * ((1 - keeps[i]) / 4) for i in range(5)])))


def _pass_down(vec: Column, keeps: tuple[float, ...]) -> Column:
    """Message to a child: for each of its labels, how well the parent's labels expect it."""
    rest = [(1 - k) / 4 for k in keeps]
    others = lambda x: sum((x[i] * rest[i] for i in range(1, 5)), x[0] * rest[0])
    return _scaled(vec, lambda x: _let(others(x), lambda o: F.array(*[x[j] * (keeps[j] - rest[j]) + o for j in range(5)])))


def _plus(a: Column | str, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * sign)


def _named(vec: Column, folder: Column) -> Column:
    """A directory's sums with its own potential: the usual shares, and what its name says; a group has none."""
    base = F.element_at(F.split(folder, "/"), -1)
    says = [F.when(base.rlike("(?i)" + _DIR_SAYS[k].pattern), F.lit(DIR_WEIGHT[k])).otherwise(0.0) if k in _DIR_SAYS else F.lit(0.0) for k in range(5)]
    return F.when(base.startswith(GROUP), vec).otherwise(_plus(vec, F.array(*[F.lit(math.log(PRIOR[k])) + says[k] for k in range(5)])))


def beliefs(files: DataFrame) -> DataFrame:
    """(k, label, confidence) from ``files`` (k, repo, dir, ev): upward and downward over all directory levels."""
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    sums = F.array(*[F.sum(F.col("ev")[k]) for k in range(5)]).alias("ev")
    parent = F.regexp_replace("dir", "/?[^/]*$", "")
    own = settle(files.select("repo", "dir", _pass_up(F.col("ev"), FILE_KEEPS).alias("ev")).groupBy("repo", "dir").agg(sums).withColumn("depth", depth))
    deepest = own.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("k", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence")).limit(0)
    levels: list[DataFrame] = []
    up = None
    for d in range(deepest, -1, -1):
        here = own.where(F.col("depth") == d).select("repo", "dir", "ev")
        here = (here.union(up) if up is not None else here).groupBy("repo", "dir").agg(sums)
        here = here.select("repo", "dir", _named(F.col("ev"), F.col("dir")).alias("ev"))
        here = settle(here.withColumn("sent", _pass_up(F.col("ev"), DIR_KEEPS)))
        levels.append(here)
        up = here.select("repo", parent.alias("dir"), F.col("sent").alias("ev"))
    levels.reverse()
    done = [levels[0].select("repo", "dir", "ev")]
    for here in levels[1:]:
        above = done[-1].select("repo", F.col("dir").alias("up"), F.col("ev").alias("above"))
        both = here.withColumn("up", parent).join(above, ["repo", "up"])
        done.append(settle(both.select("repo", "dir", _plus("ev", _pass_down(_plus("above", F.col("sent"), -1), DIR_KEEPS)).alias("ev"))))
    folders = done[0]
    for x in done[1:]:
        folders = folders.union(x)
    both = files.join(folders.select("repo", "dir", F.col("ev").alias("above")), ["repo", "dir"])
    heard = _pass_down(_plus("above", _pass_up(F.col("ev"), FILE_KEEPS), -1), FILE_KEEPS)
    both = both.select("k", _plus("ev", heard).alias("ev"))
    top = F.array_max("ev")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("ev", top).cast("int"))
    total = F.aggregate("ev", F.lit(0.0), lambda acc, y: acc + F.exp(y - top))
    return both.select("k", label.alias("label"), F.round(1 / total, 6).alias("confidence"))


def label_files(df: DataFrame, id_col: str, repo_col: str, path_col: str, text_col: str) -> DataFrame:
    """(id, label, confidence), one row per id.

    A null or empty content gives no evidence of its own (its place decides), a null path hangs in the root of its
    repository, a null repository is one of its own; of rows with one id any is taken, since they are the same file;
    an empty table gives no rows.  Ties between labels go to the first of LABELS.
    """
    seen = settle(file_evidence(df, id_col, repo_col, path_col, text_col))
    files = seen.select("k", "repo", sibling_group(F.col("path")).alias("dir"), *EV).dropDuplicates(["k"])
    copy = copies(seen)
    ev = [F.col(x) + (F.when(F.col("share").isNotNull(), COPIED).otherwise(0.0) if k == VENDORED else 0.0) for k, x in enumerate(EV)]
    files = settle(files.join(copy, "k", "left").select("k", "repo", "dir", F.array(*ev).alias("ev")))
    return beliefs(files).withColumnRenamed("k", id_col)


def label_report(df: DataFrame, id_col: str, repo_col: str, path_col: str, text_col: str, test_col: str) -> DataFrame:
    """(language, is_test, label, files): what the corpus is made of; null flags and other extensions count as null."""
    labels = label_files(df, id_col, repo_col, path_col, text_col)
    facts = df.select(id_col, language_of(F.col(path_col)).alias("language"), F.col(test_col).alias("is_test")).dropDuplicates([id_col])
    return facts.join(labels, id_col).groupBy("language", "is_test", "label").agg(F.count("*").alias("files"))
