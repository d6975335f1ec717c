"""Evaluation texts inside training texts: an FM-index per shard, searched for test phrases.

Texts are brought to plain words (encodings, markup, line prefixes, letter case, look-alikes undone).  A shard's
words become one sequence, whose Burrows-Wheeler transform is held in a wavelet matrix.  Every phrase of the test
items goes through backward search at once; its occurrences are located by sampled suffix positions, neighbouring ones
on one diagonal are runs of equal words, and runs with changed, added or missing words between them are merged into spans,
which are brought back to places in the original text.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.lookalike import letter_map

#: Words of an item that a document must hold in a row.
MIN_WORDS = 20
#: Words of a phrase that is searched for.
PHRASE = 4
#: A sentence shorter than the passages looked for is stock from this share of the different item texts on, and two of them.
STOCK_SHARE = 0.01
#: Words between two runs of one span, in the item and in the document; among them only single words may differ.
ITEM_GAP, DOC_GAP = 7, 10
#: Symbols of a shard; a longer text goes through several, which overlap.
SHARD_SYMBOLS = 400_000
#: One suffix in so many text positions is kept.
SAMPLE = 8
#: Bytes of items sent to the workers at once; more are searched block by block.
ITEM_BYTES = 8 << 20
#: Places of phrases looked at together; a document with more is one step.
PLACES = 4_000_000

_FOLD = str.maketrans({k: v for k, v in letter_map().items()} | {chr(c): None for c in (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF)})
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_PREFIX = re.compile(r"(?m)^[ \t]*(?:(?:[>|*#;]+|//+|--+|[-+](?=\s)|\[?\d{1,5}[:.)\]|](?=\s|$)|\d{1,5}[ \t]*\||L\d+:)[ \t]*)+")
_WORD = re.compile(r"[^\W_]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{60,}={0,2}")


def _decoded(m: re.Match) -> str:
    try:
        raw = base64.b64decode(m.group() + "=" * (-len(m.group()) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return m.group()
    return f" {raw} " if raw and sum(c.isprintable() or c.isspace() for c in raw) == len(raw) else m.group()


def plain(text: str) -> str:
    """A text without encodings, markup, line prefixes, case and look-alikes."""
    if "\\" in text:
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
        text = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text)
        text = re.sub(r"\\[rn]", "\n", text).replace("\\t", " ").replace('\\"', '"')
    if "%" in text and len(re.findall(r"%[0-9A-Fa-f]{2}", text)) >= 3:
        text = unquote(text, errors="replace")
    if "=" in text and re.search(r"=(?:20|3D|0A|\r?\n)", text):
        text = re.sub(r"=\r?\n", "", text)
        text = re.sub(r"(?:=[0-9A-F]{2})+", lambda m: bytes.fromhex(m.group().replace("=", "")).decode("utf-8", "replace"), text)
    if _BASE64.search(text):
        text = _BASE64.sub(_decoded, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    text = re.sub(r"([A-Za-z])[-‐]\r?\n[ \t]*([a-z])", r"\1\2", text)
    return _PREFIX.sub(" ", text).lower()


def words(text: str | None) -> list[str]:
    """The plain words of a text."""
    return _WORD.findall(plain(text)) if text else []


def sentences(text: str) -> list[str]:
    """The sentences and paragraphs of an item."""
    return [s for s in re.split(r"(?<=[.!?])\s+(?=\S)|\n\s*\n", text) if s.strip()]


def item_segments(items: list[tuple[object, str, frozenset[str]]]) -> list[tuple[object, list[str], list[int]]]:
    """(item, words, number of the white-space word of each) of the parts between an item's stock sentences."""
    out = []
    for i, text, stock in items:
        seg, num, at = [], [], 0
        for p in sentences(text):
            if stock and " ".join(words(p)) in stock:
                if seg:
                    out.append((i, seg, num))
                seg, num, at = [], [], 0
                continue
            for w in p.split():
                got = words(w)
                seg += got
                num += [at] * len(got)
                at += 1
        if seg:
            out.append((i, seg, num))
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with running counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(np.int32)
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            zeros = len(seq) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c[k] stands before position i[k], for all k."""
        i, start = i.astype(np.int64), np.zeros(len(i), np.int64)
        for b, ones, zeros in self.levels:
            set_ = ((c >> b) & 1).astype(bool)
            one_i, one_s = ones[i], ones[start]
            i = np.where(set_, zeros + one_i, i - one_i)
            start = np.where(set_, zeros + one_s, start - one_s)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions i."""
        i, out = i.astype(np.int64), np.zeros(len(i), np.int64)
        for b, ones, zeros in self.levels:
            bit = ones[i + 1] - ones[i]
            out |= bit.astype(np.int64) << b
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Backward search over a sequence of symbols 1..sigma-1; 0 is the gap and the end."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.concatenate((text, [0])).astype(np.int64)
        n = len(text)
        order = self._suffixes(text)
        bits = max(1, int(sigma - 1).bit_length())
        self.n, self.text = n, text
        self.bwt = WaveletMatrix(text[order - 1], bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:sigma]
        keep = order % SAMPLE == 0
        self.kept = np.concatenate(([0], np.cumsum(keep)))
        self.sample = order[keep]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Cyclic suffix order by doubling."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            key = rank * (n + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
            rank = new
            step *= 2
            if rank[order[-1]] == n - 1 or step >= 2 * n:
                return order

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, last) rows of each phrase (one row of symbols each)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            lo, hi = self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled one."""
        out, steps, left = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            at = rows[left]
            hit = self.kept[at + 1] > self.kept[at]
            done = left[hit]
            out[done] = (self.sample[self.kept[rows[done]]] + steps[done]) % self.n
            left = left[~hit]
            if len(left):
                c = self.bwt.access(rows[left])
                rows[left] = self.before[c] + self.bwt.rank(c, rows[left])
                steps[left] += 1
        return out


def single_edits(item: list[int], number: list[int], doc: list[int]) -> bool:
    """Whether the words between two runs differ in single words only: between two edits stands an equal word.

    An edit takes one white-space word of the item at most, and puts two words at most.
    """
    states = {(0, 0)}  # words read on both sides, the last of them equal
    seen = set(states)
    while states:
        nxt = set()
        for x, y in states:
            one = x
            while one < len(item) and number[one] == number[x]:
                one += 1
            for a in {x, one}:
                for b in range(y, min(len(doc), y + 2) + 1):
                    if a == len(item) and b == len(doc):
                        return True
                    if a < len(item) and b < len(doc) and item[a] == doc[b]:
                        nxt.add((a + 1, b + 1))
        states = nxt - seen
        seen |= states
    return False


class LeakFinder:
    """Searches shards of documents for a fixed set of items (id, text, stock sentences)."""

    def __init__(self, items: list[tuple[object, str, frozenset[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.segments = item_segments(items)
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, seg, _ in self.segments for w in seg}), 1)}
        self.coded = [np.array([self.vocab[w] for w in seg], np.int64) for _, seg, _ in self.segments]
        self.number = [np.array(num, np.int64) for _, _, num in self.segments]
        long = [(s, code) for s, code in enumerate(self.coded) if len(code) >= PHRASE]
        grams = [np.lib.stride_tricks.sliding_window_view(code, PHRASE) for _, code in long]
        all_ = np.concatenate(grams) if grams else np.empty((0, PHRASE), np.int64)
        self.phrases, which = np.unique(all_, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        self.place_seg = np.concatenate([np.full(len(g), s) for (s, _), g in zip(long, grams)])[order] if grams else np.empty(0, np.int64)
        self.place_pos = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.place_at = np.concatenate(([0], np.cumsum(np.bincount(which.ravel(), minlength=len(self.phrases)))))

    def search(self, docs: list[tuple[object, np.ndarray, int]]) -> list[tuple[object, object, int, int, int]]:
        """(document, item, words of the item in a row, first and last word in the document) of a shard of (document, codes, first word's number)."""
        text, doc_of, word_of = [], [], []
        for k, (_, codes, _) in enumerate(docs):
            codes = np.asarray(codes, np.int64)
            keep = np.nonzero((codes != 0) | (np.concatenate(([0], codes[:-1])) != 0))[0]  # words of no item shrink to one gap
            text += [codes[keep], np.zeros(1, np.int64)]
            doc_of.append(np.full(len(keep) + 1, k))
            word_of += [keep, np.full(1, -1)]
        if not len(self.phrases) or not any(t.any() for t in text):
            return []
        doc_of, word_of = np.concatenate(doc_of), np.concatenate(word_of)
        index = FMIndex(np.concatenate(text), len(self.vocab) + 1)
        lo, hi = index.find(self.phrases)
        hit = np.nonzero(hi > lo)[0]
        counts = (hi - lo)[hit]
        rows = np.repeat(lo[hit], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at, phrase = index.locate(rows), np.repeat(hit, counts)
        order = np.argsort(at, kind="stable")
        at, phrase = at[order], phrase[order]
        places = self.place_at[phrase + 1] - self.place_at[phrase]
        out: list[tuple[object, object, int, int, int]] = []
        done, total = 0, np.cumsum(places)
        while done < len(at):  # whole documents, as many as PLACES allows, one at least
            base = total[done - 1] if done else 0
            upto = int(np.searchsorted(total, base + PLACES, "right"))
            if upto < len(at):
                first = int(np.searchsorted(doc_of[at], doc_of[at[upto]], "left"))
                upto = first if first > done else int(np.searchsorted(doc_of[at], doc_of[at[done]], "right"))
            part = slice(done, upto)
            out += self._passages(docs, at[part], phrase[part], places[part], doc_of, word_of)
            done = upto
        return out

    def _passages(self, docs, at, phrase, places, doc_of, word_of) -> list[tuple[object, object, int, int, int]]:
        within = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
        slot = np.repeat(self.place_at[phrase], places) + within
        seg, j = self.place_seg[slot], self.place_pos[slot]
        k, i = np.repeat(doc_of[at], places), np.repeat(word_of[at], places)
        order = np.lexsort((i, i - j, seg, k))
        k, seg, i, j = k[order], seg[order], i[order], j[order]
        # phrases that follow each other on a diagonal are one run of equal words
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (seg[1:] != seg[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)
        start = np.nonzero(new)[0]
        length = np.diff(np.append(start, len(k))) + PHRASE - 1
        k, seg, i, j = k[start], seg[start], i[start], j[start]
        order = np.lexsort((length, j, i, seg, k))
        k, seg, i, j, length = k[order], seg[order], i[order], j[order], length[order]
        edge = np.nonzero(np.append(True, (k[1:] != k[:-1]) | (seg[1:] != seg[:-1])))[0] if len(k) else np.empty(0, np.int64)
        out = []
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(k)).tolist()):
            s, d = int(seg[a]), int(k[a])
            number = self.number[s]
            if number[(j[a:b] + length[a:b] - 1)].max() - number[j[a:b]].min() + 1 < self.min_words:
                continue
            runs = list(zip(i[a:b].tolist(), j[a:b].tolist(), length[a:b].tolist()))
            name, base = docs[d][0], docs[d][2]
            for n, first, last in self._spans(runs, number.tolist(), self.coded[s].tolist(), docs[d][1].tolist()):
                if n >= self.min_words:
                    out.append((name, self.segments[s][0], n, base + first, base + last))
        return out

    @staticmethod
    def _spans(runs: list[tuple[int, int, int]], number: list[int], item: list[int], doc: list[int]) -> list[tuple[int, int, int]]:
        """Longest chains of runs: (words of the item, first, last word of the document), one for each last run."""
        best: list[tuple[int, int, int]] = []
        out = []
        reach: list[int] = []  # furthest end of the runs up to here
        for x, (i, j, n) in enumerate(runs):
            start = (number[j], i, j)
            for y in range(x - 1, -1, -1):
                if reach[y] < i - DOC_GAP:
                    break
                i2, j2, n2 = runs[y]
                skip_doc, skip_item = i - (i2 + n2), j - (j2 + n2)
                if -2 <= skip_doc <= DOC_GAP and -2 <= skip_item and number[j] - number[j2 + n2 - 1] - 1 <= ITEM_GAP and j > j2 and best[y][0] < start[0]:
                    lap = max(0, -skip_doc, -skip_item)  # words that both runs claim
                    if lap < n and single_edits(item[j2 + n2 : j + lap], number[j2 + n2 : j + lap], doc[i2 + n2 : i + lap]):
                        start = best[y]
            best.append(start)
            reach.append(max(i + n, reach[-1] if reach else 0))
            out.append((number[j + n - 1] - start[0] + 1, start[1], i + n - 1))
        return out

    def windows(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """A text in parts of SHARD_SYMBOLS at most, which overlap by more than any span can have, with each part's first word."""
        lap = 3 * max((len(c) for c in self.coded), default=0) + 64
        step = max(SHARD_SYMBOLS - lap, lap)
        for a in range(0, max(1, len(codes) - lap), step):
            yield codes[a : a + step + lap], a

    def code(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words(text)], np.int64)


def original_span(text: str, first: int, last: int) -> tuple[int, int]:
    """[begin, end) in a text of its plain words first..last (from 0): the ends are searched among the text's beginnings.

    Words of an encoded passage lie within its code, so the ends fall between the characters that give them.
    """
    count = lambda p: len(words(text[:p]))
    end = bisect_left(range(len(text) + 1), last + 1, key=count)
    while end < len(text) and (text[end].isalnum() or text[end] == "_") and not text[end - 1 : end].isspace():
        end += 1
    begin = bisect_left(range(len(text) + 1), first + 1, key=count) - 1 if first else 0
    while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
        begin -= 1
    while begin < end and text[begin].isspace():
        begin += 1
    return begin, end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_stock(items: DataFrame, min_words: int) -> DataFrame:
    """``items`` (i, t) with stock: the item's sentences that are stock among all items.

    Texts count once whatever their ids, so an item under two ids makes no sentence stock, nor do near copies of few.
    """
    kind = items.schema["i"].dataType
    fields = [T.StructField("i", kind), T.StructField("whole", T.StringType()), T.StructField("said", T.StringType()), T.StructField("n", T.IntegerType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                said = [words(x) for x in sentences(text)]
                rows += [(k, " ".join(sum(said, [])), " ".join(x), len(x)) for x in said]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["i", "whole", "said", "n"])

    parts = items.select("i", "t").mapInArrow(work, T.StructType(fields)).select("i", F.sha2("whole", 256).alias("whole"), "said", "n")
    texts = parts.select("whole").distinct().count()
    stock = parts.where(F.col("n") < min_words).select("said", "whole").distinct().groupBy("said").agg(F.count("*").alias("texts")).where(F.col("texts") >= max(2, STOCK_SHARE * texts))
    own = parts.join(stock.select("said"), "said", "left_semi").groupBy("i").agg(F.collect_set("said").alias("stock"))
    return items.join(own, "i", "left")


def leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, min_words: int = MIN_WORDS, spans: bool = False) -> DataFrame:
    """(id, item, words): documents that hold at least ``min_words`` words in a row of an item, with the most of them.

    With ``spans`` also ARRAY<STRUCT<begin, end>>: where the item's passages stand in the text, in characters from 0,
    merged, for removal.  Every document goes through an index; the documents are never shuffled.  The items are the
    stated query set: they go to the workers in blocks of ITEM_BYTES, one pass over the documents for each block.  Null
    and empty texts hold nothing; items shorter than ``min_words`` or of stock sentences alone are never found; copies
    of a document are found each; an item under two ids is found under both, one that comes twice counts once; other
    columns aren't read.
    """
    spark = docs.sparkSession
    once = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").groupBy("i").agg(F.min("t").alias("t"))
    once = with_stock(once, min_words)
    doc_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    place = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField(id_col, doc_type), T.StructField(item_col, item_type), T.StructField("words", T.IntegerType()), *[T.StructField("spans", place)] * spans])
    total = once.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_BYTES))
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("length(t) > 0")
    out = None
    for b in range(blocks):
        part = once if blocks == 1 else once.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        block = [(r["i"], r["t"], frozenset(r["stock"] or ())) for r in part.collect()]
        shared = spark.sparkContext.broadcast(sorted(block, key=lambda x: str(x[0])))
        found = slim.mapInArrow(_searcher(shared, min_words, schema.names, pa_type(slim, "k"), pa_type(once, "i"), spans), schema)
        out = found if out is None else out.union(found)
    both = [F.max("words").alias("words")] + [F.max_by("spans", F.struct("words", F.size("spans"))).alias("spans")] * spans
    return out.groupBy(id_col, item_col).agg(*both)


def pa_type(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _searcher(shared, min_words: int, names: list[str], doc_type, item_type, spans: bool):
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = LeakFinder(shared.value, min_words)
        texts: dict[int, str] = {}  # of the documents that a shard still looks at

        def flush(*shards: list) -> pa.RecordBatch:
            best: dict[tuple, list] = {}
            for shard in shards:
                for (n, k), item, count, first, last in finder.search(shard):
                    best.setdefault((n, k, item), []).append((count, first, last))
            rows = []
            for (n, k, item), got in best.items():
                rows.append((k, item, max(c for c, _, _ in got), [{"begin": a, "end": b} for a, b in merged([original_span(texts[n], f, x) for f, x in merged([(f, x) for _, f, x in got])])] if spans else None))
            cols = [pa.array([r[0] for r in rows], doc_type), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.int32())]
            return pa.RecordBatch.from_arrays(cols + [pa.array([r[3] for r in rows], span)] * spans, names=names)

        shard, size, n = [], 0, 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += 1
                codes = finder.code(text)
                if spans:
                    texts[n] = text
                if len(codes) > SHARD_SYMBOLS and shard:  # a text of several parts has shards of its own
                    yield flush(shard)
                    shard, size, texts = [], 0, {n: text}
                for part, base in finder.windows(codes):
                    shard.append(((n, k), part, base))
                    size += len(part)
                    if size >= SHARD_SYMBOLS and len(codes) <= SHARD_SYMBOLS:
                        yield flush(shard)
                        shard, size, texts = [], 0, {}
                if len(codes) > SHARD_SYMBOLS:
                    yield flush(*[[part] for part in shard])
                    shard, size, texts = [], 0, {}
        if shard:
            yield flush(shard)

    return work

