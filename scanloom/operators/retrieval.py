"""Ranked retrieval of reference passages for chunks: BM25 over posting tables, and the text budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.text import first_bytes
from scanloom.session import fixed_side

K1, B = 1.2, 0.75
#: Tokens of context for a chunk, four bytes each; a description is not cut below this many bytes.
BUDGET_TOKENS, FLOOR = 1500, 100
DOTS = "..."
#: Posting rows up to which the index is broadcast, and the parts of a term beyond it.
SMALL_INDEX, TERM_PARTS = 500_000, 16


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, length, df, docs, avg_length): one row for each document and term."""
    words = docs.select(F.col(id_col).alias("kb"), terms(text).alias("ws")).where(F.col("ws").isNotNull())
    stats = words.agg(F.count("*").alias("docs"), F.avg(F.size("ws")).alias("avg_length"))
    tf = words.select("kb", F.size("ws").alias("length"), F.explode("ws").alias("term")).groupBy("kb", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row


def query_text(name: Column, language: Column, source: Column) -> Column:
    """Name (unless it says nothing), language and the first 200 characters with single blanks."""
    n = F.when(~F.coalesce(name, F.lit("")).isin("", "anonymous", "unknown"), name)
    return F.concat_ws(" ", n, language, F.regexp_replace(F.trim(F.substring(source, 1, 200)), r"[ \t\n\r\f]+", " "))


def top_k(queries: DataFrame, query_id: str, query: Column, index: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, kb, score, rank): the k best documents by BM25, ties by id.

    Equal queries are scored once.  Scores are summed before the shuffle by query; a row is one matching term of one
    query and document, and a query's documents are reduced to k by a window that stops at rank k.
    A small index, as counted, is broadcast; terms of a larger one, which can be in every query, meet their postings in parts.
    A null query or one without known words has no rows.
    """
    q = queries.select(F.col(query_id).alias("q"), terms(query).alias("ws")).withColumn("sig", F.xxhash64(F.array_join("ws", " ")))
    distinct = q.groupBy("sig").agg(F.first("ws").alias("ws"))
    wanted = distinct.select("sig", F.explode(F.array_distinct("ws")).alias("term"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    side = fixed_side(index, SMALL_INDEX)
    if side is index:
        wanted = wanted.withColumn("part", F.pmod("sig", F.lit(TERM_PARTS)))
        side = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TERM_PARTS - 1).cast("long"))))
    scored = wanted.join(side, ["term", *(["part"] if "part" in side.columns else [])]).groupBy("sig", "kb").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("sig").orderBy(F.desc("score"), "kb")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return q.select("q", "sig").join(best, "sig").select(F.col("q").alias(query_id), "kb", "score", "rank")


def within_budget(entries: Column, budget: int = BUDGET_TOKENS * 4) -> Column:
    """Entries (array of struct<id, title, description, patterns array<string>>) cut to ``budget`` bytes in all.

    Ids and titles stay.  Descriptions give way in order, each by its share of what is over in proportion to its
    length, rounded up and by no more than is still over, the ... of a cut one included; none is cut below FLOOR bytes.
    Only where there are no descriptions at all, patterns are dropped from each entry's end, one stays each.
    Cuts fall between characters.  Null texts and arrays count as empty.
    """
    kind = "array<struct<id:string,title:string,description:string,patterns:array<string>>>"
    none = F.array().cast("array<string>")
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    listed = lambda e: F.aggregate(F.coalesce(e["patterns"], none), F.lit(0), lambda a, p: a + length(p))
    total = F.aggregate(entries, F.lit(0), lambda a, e: a + length(e["id"]) + length(e["title"]) + length(e["description"]) + listed(e))
    described = F.aggregate(entries, F.lit(0), lambda a, e: a + length(e["description"]))
    excess = F.greatest(total - budget, F.lit(0))
    put = lambda acc, e, text, ps: F.concat(acc["out"], F.array(F.struct(e["id"].alias("id"), e["title"].alias("title"), text.alias("description"), ps.alias("patterns"))))
    start = F.struct(excess.alias("over"), F.array().cast(kind).alias("out"))

    def shorten(acc: Column, e: Column) -> Column:
        n = length(e["description"])
        share = F.least(F.ceil(excess * n / described).cast("int"), acc["over"])
        raw = F.when(n - share - len(DOTS) < FLOOR, F.greatest(n - FLOOR, F.lit(0))).otherwise(share + len(DOTS))
        cut = (acc["over"] > 0) & (n > 0) & (raw > 0)
        text = F.when(cut, F.concat(first_bytes(e["description"], n - raw), F.lit(DOTS))).otherwise(e["description"])
        return F.struct((acc["over"] - n + length(text)).alias("over"), put(acc, e, text, e["patterns"]).alias("out"))

    def drop(acc: Column, e: Column) -> Column:
        sizes = F.transform(F.coalesce(e["patterns"], none), lambda p: length(p))
        fold = F.aggregate(F.reverse(sizes), F.struct(acc["over"].alias("over"), F.size(sizes).alias("keep")), lambda a, x: F.when((a["over"] > 0) & (a["keep"] > 1), F.struct((a["over"] - x).alias("over"), (a["keep"] - 1).alias("keep"))).otherwise(a))
        return F.struct(fold["over"].alias("over"), put(acc, e, e["description"], F.slice(F.coalesce(e["patterns"], none), F.lit(1), fold["keep"])).alias("out"))

    return F.when(excess == 0, entries).when(described > 0, F.aggregate(entries, start, shorten)["out"]).otherwise(F.aggregate(entries, start, drop)["out"])
