"""Token ids of a public byte-level BPE vocabulary, exact, without merging from the bottom up.

For every prefix of a pre-token there is one last token with which its encoding ends. A scan of an Aho-Corasick
automaton over the vocabulary (the suffix links of its trie) yields the tokens that end at a position, longest first;
the first that is compatible with the last token of the prefix before it is the one, and is stored. Back-pointers from
the end give the ids. Two tokens are compatible if the bytes of both together encode to just these two. Pre-tokens and
pairs met before come from bounded caches, which are emptied when full and never drop a result.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; read by the driver only and sent to the executors (0.8 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pre-tokenisation pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each cache.
CACHE = 400_000


class Encoder:
    """Encodes texts with the ranks of a vocabulary file (lines of base64 and rank)."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.split = regex.compile(pattern).findall
        self.tokens = {r: b for b, r in self.ranks.items()}
        self.trie = ahocorasick.Automaton()
        for b, r in self.ranks.items():
            self.trie.add_word(b.decode("latin-1"), (len(b), r))
        self.trie.make_automaton()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """The ids of a few bytes by the definition: merge the lowest rank until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        last = [0] * (n + 1)
        size = [0] * (n + 1)
        ending: list[tuple[int, int]] = []
        at = -1

        def settle(end: int) -> None:
            for length, rank in sorted(ending, reverse=True):
                start = end - length
                if start == 0 or (size[start] and self.compatible(last[start], rank)):
                    last[end], size[end] = rank, length
                    return

        for pos, found in self.trie.iter(raw.decode("latin-1")):
            if pos != at:
                if at >= 0:
                    settle(at + 1)
                ending, at = [], pos
            ending.append(found)
        settle(at + 1)
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words = self.words
        for w in self.split(text):
            known = words.get(w)
            if known is None:
                if len(words) >= CACHE:
                    words.clear()
                known = self.word(w)
                if len(w) <= 64:
                    words[w] = known
            ids += known
        return ids


def kept(key: str, make):  # noqa: ANN001, ANN201
    """What `make` returns, once a Python worker: workers are used again by later tasks."""
    store = sys.modules.setdefault("_lorekeep_kept", types.ModuleType("_lorekeep_kept"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Every document's ids: doc_id, ids. No special tokens: their strings are ordinary text.

    A null and an empty text give an empty list; a blank one is encoded. Rows are neither moved nor dropped, so
    repeated rows stay. Other columns are ignored. Texts are encoded whole, in the partitions they are read in.
    """
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"encoder:{vocabulary}:{pattern}", lambda: Encoder(sent.value, pattern))
        for batch in batches:
            start, rows = 0, batch.num_rows
            texts = batch.column(1)
            while start < rows:
                offsets, ids, end = [0], [], start
                while end < rows and len(ids) < 4_000_000:
                    if text := texts[end].as_py():
                        ids += encoder.encode(text)
                    offsets.append(len(ids))
                    end += 1
                lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(ids, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], names=["doc_id", "ids"])
                start = end

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")
