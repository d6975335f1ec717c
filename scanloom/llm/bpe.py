"""Corpus encoding by a token automaton compiled from byte-pair merges.

The automaton accepts exactly the token sequences that merging would produce.  It starts as one
state with an arc per byte; merge number k, (u, v) -> w, changes it by one gadget:

* every state that (still) has an arc u gets an arc w, which leads where u and then v led;
* the state behind u loses its arc v, since that pair is now always merged.

All arcs with one label lead to one state, so a state is named by the last token read and the
automaton is held by three tables: when an arc's label was born, what it was made of, and when a
pair was merged.  ``has_arc`` replays the gadgets for one pair of (state, label) from these tables,
newest first, and the answer is kept in a transition table that fills as words are met.

A word has exactly one path whose labels spell its bytes; ``encode_word`` finds it from left to
right over a byte trie, and ``decode`` emits the labels' bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("SCANLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published word pattern of the byte-level vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START = -1
#: Entries kept per worker; beyond it a table is emptied, which costs time only.
CACHE_ENTRIES = 300_000


def _byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: shown bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenAutomaton:
    """Deterministic automaton over tokens, built from an ordered list of merges."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocab.values()) + 1
        self.born = [-1] * size
        self.left = [-1] * size
        self.right = [-1] * size
        self.spelling: list[bytes] = [b""] * size
        for spelled, i in vocab.items():
            self.spelling[i] = spelled
        self.merged_at: dict[int, int] = {}
        for k, (u, v) in enumerate(merges):
            self._gadget(k, vocab[u], vocab[v], vocab[u + v])
        self._trie(vocab, {vocab[u + v] for u, v in merges})
        self.table: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(WORD_PATTERN).findall

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        self.merged_at[u << 20 | v] = k
        if self.born[w] < 0:
            self.born[w], self.left[w], self.right[w] = k, u, v

    def _trie(self, vocab: dict[bytes, int], made: set[int]) -> None:
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        for spelled, i in vocab.items():
            if i not in made and len(spelled) != 1:
                continue  # kept as special by other tools; no merge makes it
            node = 0
            for b in spelled:
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i

    def has_arc(self, state: int, label: int) -> bool:
        """Whether ``label`` may follow in ``state`` after all gadgets."""
        key = state << 20 | label
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= 4 * CACHE_ENTRIES:
                self.table.clear()
            known = self.table[key] = self._replay(state, label)
        return known

    def _replay(self, p: int, x: int) -> bool:
        before = len(self.merged_at) + 1
        while True:
            if self.merged_at.get(p << 20 | x, before) < before:
                return False
            bp, bx = self.born[p], self.born[x]
            if bp < 0 and bx < 0:
                return True
            if bx >= bp:  # arc x was added beside an arc left(x) that had survived gadget bx itself
                x, before = self.left[x], bx + 1
            else:  # state p began as a copy of the state behind right(p), just before gadget bp
                p, before = self.right[p], bp

    def encode_word(self, spelled: bytes) -> list[int]:
        n = len(spelled)
        last: list[int | None] = [None] * (n + 1)
        last[0] = START
        step, token_at = self.step, self.token_at
        for i in range(n):
            state = last[i]
            if state is None:
                continue
            node = 0
            for j in range(i, n):
                node = step.get(node << 8 | spelled[j], -1)
                if node < 0:
                    break
                t = token_at[node]
                if t >= 0 and last[j + 1] is None and (state == START or self.has_arc(state, t)):
                    last[j + 1] = t
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.spelling[last[i]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; [] for null and empty text."""
        out: list[int] = []
        if not text:
            return out
        words = self.words
        for w in self.split(text):
            try:
                out += words[w]
            except KeyError:
                if len(words) >= CACHE_ENTRIES:
                    words.clear()
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    words[w] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a path: the arcs' labels, spelled out."""
        return b"".join(self.spelling[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> TokenAutomaton:
    """Compile the automaton of a byte-level BPE file (once per Python worker)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    spell = lambda s: bytes(letters[c] for c in s)
    vocab = {}
    for shown, i in model["vocab"].items():
        if all(c in letters for c in shown):
            vocab[spell(shown)] = i
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return TokenAutomaton(vocab, [(spell(a), spell(b)) for a, b in pairs])


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row, without special tokens and without a shuffle.

    Null and empty texts give []; strings that tools keep as special tokens are ordinary text; repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    path = f"{directory}/{vocabulary}.json"
    id_type = df.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automaton(path)
        for batch in batches:
            lists = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=[id_col, "ids"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(encode, schema)
