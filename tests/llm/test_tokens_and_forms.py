import os

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.llm import bpe, lookalike

VOCAB = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files here")
DOCS = "doc_id long, text string, k string, ids string"


def merge_by_rank(model, word):
    """Byte-pair merging as defined: always the earliest merge, leftmost first."""
    parts = [bytes([b]) for b in word]
    ids = {s: i for i, s in enumerate(model.spelling) if s}
    while True:
        best = min(((model.merged_at[key], i) for i in range(len(parts) - 1) if (key := ids[parts[i]] << 20 | ids[parts[i + 1]]) in model.merged_at), default=None)
        if best is None:
            return [ids[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@needs_vocabulary
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab =\n<|endoftx>", max_size=60)))
@settings(max_examples=150, deadline=None)
def test_automaton_equals_merging_and_round_trips(text):
    model = bpe.automaton(VOCAB)
    ids = model.encode(text)
    assert ids == [i for w in model.split(text) for i in merge_by_rank(model, w.encode("utf-8", "surrogatepass"))]
    assert model.decode(ids) == text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


@needs_vocabulary
def test_automaton_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    texts = ["", " ", "<|endoftext|>", "Hello  world's\n\n\tcode == 3.14", "naïve 日本語 🚀🔧", "=" * 3000, "a" * 500, " " * 700, "\r\n" * 5]
    model = bpe.automaton(VOCAB)
    assert [model.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@needs_vocabulary
def test_encode_corpus_defines_empty_and_null(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y"), (2, "", None, None), (3, None, None, None), (1, "a b", "x", "y")], DOCS)
    got = rows(bpe.encode_corpus(df, "doc_id", "text"))
    ids = bpe.automaton(VOCAB).encode("a b")
    assert got == sorted([(1, ids), (1, ids), (2, []), (3, [])], key=repr)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def one(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in lookalike.one_form(df, "doc_id", "text").orderBy("doc_id").collect()]


def test_one_form_brings_alike_texts_together(spark):
    alike = [("café", "cafe\u0301"), ("ｔｈｅ１", "the1"), ("ﬁle", "file"), ("сору", "copy"), ("a\u00a0b", "a b"), ("a\u200bb\ufeff", "ab"), ("Τοр", "Top"), ("ｶﾞ", "ガ"), ("ё", "ë"), ("a\u3000b", "a b"), ("soft\u00adhyphen", "softhyphen"), (";", "\u037e")]
    got = one(spark, *[x for p in alike for x in p])
    assert all(a == b for a, b in zip(got[::2], got[1::2])), [(a, b) for a, b in zip(got[::2], got[1::2]) if a != b]
    assert one(spark, *got) == got  # a second time changes nothing


def test_one_form_keeps_different_texts_apart(spark):
    for a, b in [("résumé", "resume"), ("ı", "i"), ("x²", "x2"), ("a  b", "a b"), ("a\nb", "a b"), ("a\tb", "a b"), ("A", "a"), ("ö", "o"), ("a\r\nb", "a\nb"), ("й", "и")]:
        x, y = one(spark, a, b)
        assert x != y
    assert one(spark, None, "") == [None, ""]


def test_lookalike_pairs(spark):
    data = [(1, "copy it"), (2, "сopy it"), (3, "copy it"), (4, "copy\u200b it"), (5, None), (6, " "), (7, "\u00a0"), (8, ""), (9, "other"), (2, "сopy it")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, look string, part int")
    expected = [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    for per_part in (20_000, 1):  # whole groups, and groups cut into parts
        assert rows(lookalike.lookalike_pairs(df, "doc_id", "text", per_part)) == expected
    assert lookalike.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_copies_meet_only_other_spellings(spark, monkeypatch):
    from pyspark.sql import functions as F

    n = 30_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n - 2, "plain copy").when(F.col("id") == n - 2, "plaｉn copy").otherwise("other").alias("text"))
    for few in (True, False):
        if not few:
            monkeypatch.setattr(lookalike, "fixed_side", lambda side, most: side)
        got = lookalike.lookalike_pairs(df, "doc_id", "text", 1000)
        assert got.count() == n - 2 and got.where(f"doc_id_b <> {n - 2}").count() == 0
        classes = lookalike.lookalike_classes(df, "doc_id", "text")
        assert rows(classes.groupBy("spellings", "links").count()) == [(2, 1, n - 2), (2, n - 2, 1)]
