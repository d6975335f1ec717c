"""One consistent form for texts that look alike, by DuckDB SQL inside Arrow partitions.

Alike: width forms, composed and decomposed letters, ligatures and their letters, look-alike letters of
other scripts, kinds of single space, text with or without invisible characters.  Kept apart: accents,
dots, letter case, raised digits, tabs, the number of spaces, line breaks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.session import fixed_side, settle

#: Parts of the rows of a spelling, where there are too many spellings to broadcast.
SALTS = 32

# Letters of other scripts that are drawn like a Latin letter, in alphabetic order of the letter.
CYRILLIC = "АA ВB ЕE ҒF ԌG НH ІI ЈJ КK МM ОO РP ԚQ ЅS ТT УY ҮY ХX ԜW СC аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ѵv ԝw хx уy үy"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj"
OTHER = "ՕO ՍU օo ոn սu հh ցg ΄´ ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᎳW ᏃZ"
# Ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
# Spaces that show as one blank.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Characters without a shape of their own, as a character class of RE2.
INVISIBLE = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}]+"


def letter_map() -> dict[str, str]:
    """Single characters and the one character each is brought to; accented look-alikes follow from their base letter."""
    out = {p[0]: p[1] for p in f"{CYRILLIC} {GREEK} {OTHER}".split()}
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in out:
            one = unicodedata.normalize("NFC", out[parts[0]] + parts[1:])
            if len(one) == 1:
                out[chr(code)] = one
    for code in range(0xFF01, 0xFFEF):  # width forms
        wide = unicodedata.normalize("NFKC", chr(code))
        if len(wide) == 1 and wide != chr(code):
            out[chr(code)] = wide
    out |= {"ﾞ": "゙", "ﾟ": "゚", "￣": "¯"}  # sound marks join the kana before them
    out |= dict.fromkeys(SPACES, " ")
    return out


def one_form_sql(column: str) -> str:
    """The SQL expression that brings ``column`` to its one form."""
    letters = letter_map()
    quote = lambda s: s.replace("'", "''")
    inner = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    for ligature, parts in LIGATURES.items():
        inner = f"replace({inner}, '{ligature}', '{parts}')"
    src, dst = "".join(letters), "".join(letters.values())
    inner = f"translate(nfc_normalize({inner}), '{quote(src)}', '{quote(dst)}')"
    # a mark may follow a letter that was only just brought to its Latin form
    return f"nfc_normalize({inner})"


def _run(sql: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for batch in batches:
            if batch.num_rows:
                con.register("rows", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("rows")

    return work


def one_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with every text in its one form: a map without a shuffle.

    Null stays null and empty stays empty; a text in its one form is returned unchanged (the mapping is
    idempotent); repeated rows stay repeated; other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return source.mapInArrow(_run(f'SELECT k AS "{id_col}", {one_form_sql("t")} AS text FROM rows'), schema)


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, look, exact): digests of the one form and of the characters themselves, for texts that are not blank."""
    schema = T.StructType([T.StructField("k", df.schema[id_col].dataType), T.StructField("look", T.StringType()), T.StructField("exact", T.StringType())])
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"\S"))
    sql = f"SELECT k, sha256(f) AS look, sha256(t) AS exact FROM (SELECT k, t, {one_form_sql('t')} AS f FROM rows) WHERE trim(f, ' \t\r\n') <> ''"
    return source.mapInArrow(_run(sql), schema)


def mixed_spellings(marks: DataFrame) -> DataFrame:
    """(look, exact, n, spellings): the spellings of each look that has two or more, with their rows; counted before the shuffle."""
    spelled = marks.groupBy("look", "exact").agg(F.count("*").alias("n"))
    mixed = spelled.groupBy("look").agg(F.count("*").alias("spellings")).where("spellings > 1")
    return spelled.join(mixed, "look")


def _members(marks: DataFrame, spelled: DataFrame) -> DataFrame:
    """The rows of ``marks`` of given spellings, with their columns.

    Few spellings are broadcast, as counted; more are repeated for parts of a spelling's rows, so that copies of one
    text, which may be a third of all rows, never meet in one task.
    """
    spelled = spelled.drop("look")
    side = fixed_side(spelled, 200_000)
    if side is not spelled:
        return marks.join(side, "exact")
    some = F.lit(SALTS).cast("long")
    marks = marks.withColumn("salt", F.pmod(F.xxhash64("k"), some))
    return marks.join(spelled.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), some - 1))), ["exact", "salt"]).drop("salt")


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, rows_per_part: int = 20_000) -> DataFrame:
    """(id_a, id_b), a < b: pairs of rows whose texts look the same but differ in their characters.

    Spellings of a look are paired first, so plain copies of one text never meet; then each pair of spellings gets its
    rows, a spelling of more than ``rows_per_part`` in parts.  The work grows with the rows and the pairs that come out.  Null and
    blank texts pair with nothing; an id that comes twice with one text counts once; ids are compared by their order.
    """
    marks = settle(fingerprints(df, id_col, text_col).distinct())
    spelled = settle(mixed_spellings(marks).withColumn("parts", F.ceil(F.col("n") / rows_per_part).cast("int")))
    rows = _members(marks, spelled.select("look", "exact", "parts")).select("exact", "k", F.pmod(F.hash("k"), F.col("parts")).alias("part"))
    some = F.ceil(F.col("spellings") / rows_per_part).cast("int")
    side = lambda x: spelled.select("look", F.col("exact").alias(f"x{x}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"p{x}"), "spellings")
    left = side("a").withColumn("at", F.pmod(F.hash("xa"), some)).drop("spellings")
    right = side("b").withColumn("at", F.explode(F.sequence(F.lit(0), some - 1))).drop("spellings")
    pairs = left.join(right, ["look", "at"]).where("xa < xb").select("xa", "pa", "xb", "pb")
    for x in "ab":
        pairs = pairs.join(rows.select(F.col("exact").alias(f"x{x}"), F.col("part").alias(f"p{x}"), F.col("k").alias(x)), [f"x{x}", f"p{x}"])
    out = pairs.where("a <> b").select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))
    return out.distinct()


def lookalike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class, spellings, links): one row for each row that looks like another with other characters.

    ``class`` is the digest of the one form, ``links`` counts the rows of the class with another spelling; copies are
    not expanded into pairs.  The same cases as in ``lookalike_pairs`` are left out.
    """
    marks = settle(fingerprints(df, id_col, text_col).distinct())
    spelled = mixed_spellings(marks)
    size = spelled.groupBy("look").agg(F.sum("n").alias("all"))
    spelled = settle(spelled.join(size, "look").select("look", "exact", "spellings", (F.col("all") - F.col("n")).alias("links")))
    return _members(marks, spelled).select(F.col("k").alias(id_col), F.col("look").alias("class"), "spellings", "links")
