"""Held-out evaluation items in training text, verbatim or with other numbers, names and units.

Words are canonicalised by their lower-cased form alone: anything with a digit, units of measure, and words that stand
in no item as plain words (names) become typed placeholders; all others stay. Windows of canonical words (templates)
are hashed on both sides and hash-joined; of each pair that meets, the words themselves are laid side by side, run by
run, and the fillings of the slots are checked: all alike is a verbatim leak, one consistent exchange of fillings is a
re-parameterised one. As a window's template depends on its words only, every verbatim run is among the hits.

Nothing of items or documents reaches the driver but two bitmaps of fixed size: which words are plain, and which window
hashes occur in items. By the second a document's windows are cut where it lies, before the join; where items are so
many that it fills up, more windows are joined, and the result is the same.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.scratch import materialise

WINDOW = 12
#: A template window says something if this many of its words are plain; others are joined by their words alone.
PLAIN = 5
#: Bits of the bitmaps of plain words (two words in one bit are plain or not together, on both sides) and of window hashes.
WORD_BITS, WINDOW_BITS = 20, 24
#: Units of measure.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years ms kb mb gb tb byte bytes percent meter meters metre metres km kg gram grams mile miles dollar dollars euro euros "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen segundo segundos minuto minutos hora horas dia dias semana semanas seconde secondes heure heures jour jours semaine semaines".split()
)
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NUMBER, _NAME, _UNIT = (1 << 60) + 11, (1 << 60) + 22, (1 << 60) + 33


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class _Codes:
    """Template and literal code of a word; the cache is emptied when it is full."""

    def __init__(self, plain: np.ndarray) -> None:
        self.plain, self.known = plain.tobytes(), {}

    def __call__(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in set(ws):
            if w not in known:
                h = _hash(w)
                known[w] = (h if (t := self.kind(w)) == 0 else t, h)
        both = np.array([known[w] for w in ws], dtype=np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def kind(self, w: str) -> int:
        if (found := self.known.get(w)) is not None:
            return 0 if found[0] == found[1] else found[0]
        at = _hash(w) & ((1 << WORD_BITS) - 1)
        return _UNIT if w in UNITS else _NUMBER if any(c.isdigit() for c in w) else 0 if self.plain[at >> 3] >> (at & 7) & 1 else _NAME

    def windows(self, ws: list[str]) -> np.ndarray:
        """Hashes of the windows of a text: of their templates, or of their words where fewer than PLAIN are plain."""
        template, exact = self(ws)
        plainly = np.concatenate([[0], np.cumsum(template == exact)])
        plainly = plainly[WINDOW:] - plainly[:-WINDOW] if len(ws) >= WINDOW else np.zeros(0, dtype=np.int64)
        return np.where(plainly >= PLAIN, _rolled(template), _rolled(exact) ^ np.uint64(1))


def _has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes & np.uint64((1 << bits) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the lowest bits of `hash`, built on the executors in pieces of 32,768 bits; its size is fixed by `bits`."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # positions of a piece count from 1
    pieces = hashes.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in pieces.toLocalIterator():  # at most 2 ** (bits - 15) rows
        part = np.frombuffer(r.bits, dtype=np.uint8)
        out[(r.piece - 1) * 4096 : (r.piece - 1) * 4096 + len(part)] = part
    return out


def _rolled(codes: np.ndarray) -> np.ndarray:
    """Hashes of all windows; windows across texts are hashed too and left to the caller."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out += (codes[k : k + n] ^ (codes[k : k + n] >> np.uint64(29))) * power
            power = power * _BASE
    return out


_PLAIN = re.compile(r"(?<![\w/.\-])[^\W\d_]+(?![\w/\-]|\.\w)")


def plain_words(text: str) -> set[str]:
    """Words that stand in a text as plain words: letters only, not capitalised, no part of an identifier or path."""
    return {w for w in _PLAIN.findall(text) if w == w.lower()} - UNITS


def _compare(doc: list[str], item: list[str], shift: int, starts: list[int], kind) -> tuple[int, int, int]:  # noqa: ANN001
    """Longest verbatim run, longest consistent run and its exchanged slots along one diagonal of hit windows."""
    exact = consistent = slots = 0
    i = 0
    while i < len(starts):
        j = i
        while j + 1 < len(starts) and starts[j + 1] - starts[j] <= WINDOW:
            j += 1
        low, high = starts[i], starts[j] + WINDOW
        run = 0
        there: dict[str, tuple[str, int]] = {}  # the last filling of each word of the item, and its place
        back: dict[str, tuple[str, int]] = {}
        changed: dict[str, int] = {}  # places of each exchanged slot in the run
        start = low
        for p in range(low, high):
            d, t = doc[p], item[p - shift]
            run = run + 1 if d == t else 0
            exact = max(exact, run)
            first = start
            if d != t and (kind(d) == 0 or kind(d) != kind(t)):
                first = p + 1
            else:
                for other, (filling, q) in ((d, there.get(t, (d, -1))), (t, back.get(d, (t, -1)))):
                    if filling != other:
                        first = max(first, q + 1)
            for q in range(start, min(first, p)):  # these leave the run
                x = item[q - shift]
                if doc[q] != x:
                    changed[x] -= 1
                    if not changed[x]:
                        del changed[x]
            start = first
            if start > p:
                continue
            there[t], back[d] = (d, p), (t, p)
            if d != t:
                changed[t] = changed.get(t, 0) + 1
            if (p + 1 - start, -len(changed)) > (consistent, -slots):
                consistent, slots = p + 1 - start, len(changed)
        i = j + 1
    return exact, consistent, slots


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents and the held-out items whose passages they hold: doc_id, item_id, verbatim, consistent, slots.

    `documents`: doc_id, text. `items`: item_id, split, text; only split test or dev (any case) is held out.
    `verbatim` is the longest run of equal words (case aside), `consistent` the longest run that equals the item's up
    to one consistent exchange of its numbers, names and units, of which there are `slots`. A pair comes out if either
    reaches 12 words; a consistent run counts if one of its windows has five plain words. Null, empty and short texts
    match nothing, null ids have no row. One row a pair of row of `documents` and distinct text of an item.
    """
    spark = documents.sparkSession
    held = items.where(F.lower(F.trim("split")).isin("test", "dev") & F.col("text").isNotNull() & F.col("item_id").isNotNull())
    held = materialise(held.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("item")).distinct().select("*", F.xxhash64("item_id", "item").alias("key")))

    def plain_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for t in batch.column(0) for w in plain_words(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_hash(w) for w in found], dtype=np.uint64).view(np.int64))], names=["hash"])

    plain = spark.sparkContext.broadcast(_bitmap(held.select("item").mapInArrow(plain_hashes, "hash bigint"), WORD_BITS))

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(plain.value)
        for batch in batches:
            found = [np.unique(codes.windows(words(t.as_py()))) for t in batch.column(1)]
            keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(np.concatenate(found).view(np.int64) if found else [], type=pa.int64())], names=["key", "hash"])

    windows = materialise(held.select("key", "item").mapInArrow(item_windows, "key bigint, hash bigint"))
    occurs = spark.sparkContext.broadcast(_bitmap(windows, WINDOW_BITS))

    def document_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(plain.value)
        for batch in batches:
            ids, texts, start = batch.column(0), batch.column(1), 0
            while start < batch.num_rows:  # texts are taken together up to a size, so short ones cost no call each
                flat: list[str] = []
                rows, ends = [], []
                while start < batch.num_rows and len(flat) < 1_000_000:
                    if ids[start].is_valid and (t := texts[start].as_py()) and len(ws := words(t)) >= WINDOW:
                        rows.append(start)
                        flat += ws
                        ends.append(len(flat))
                    start += 1
                hashes, at = codes.windows(flat), np.array(ends, dtype=np.int64)
                hit = np.nonzero(_has(occurs.value, hashes, WINDOW_BITS))[0]
                doc = np.searchsorted(at, hit, "right")
                whole = hit + WINDOW <= at[np.minimum(doc, len(at) - 1)] if len(at) else np.zeros(0, dtype=bool)
                pairs = np.unique(np.stack([np.array(rows, dtype=np.int64)[doc[whole]], hashes[hit[whole]].view(np.int64)], axis=1), axis=0) if len(at) else np.zeros((0, 2), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], names=["doc_id", "hash"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.mapInArrow(document_windows, "doc_id bigint, hash bigint").join(windows, "hash").select("doc_id", "key").distinct()
    met = materialise(met)
    both = texts.where("text is not null").join(met, "doc_id").join(held, "key").select("doc_id", "text", "item_id", "item")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(plain.value)
        for batch in batches:
            rows = []
            for d, t, i, it in zip(*(batch.column(k) for k in range(4))):
                if best := _best(codes, words(t.as_py()), words(it.as_py())):
                    rows.append((d.as_py(), i.as_py(), *best))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "item_id", "verbatim", "consistent", "slots"])

    return both.mapInArrow(compared, "doc_id bigint, item_id bigint, verbatim bigint, consistent bigint, slots bigint")


def _best(codes: _Codes, doc: list[str], item: list[str]) -> tuple[int, int, int] | None:
    """The longest verbatim and consistent runs of two texts along all diagonals on which windows are equal; None if both are short."""
    mine, theirs = codes.windows(doc), codes.windows(item)
    order = np.argsort(theirs, kind="stable")
    low, high = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
    diagonals: dict[int, list[int]] = defaultdict(list)
    for p in np.nonzero(high > low)[0]:
        for q in order[low[p] : high[p]]:
            diagonals[int(p - q)].append(int(p))
    found = [_compare(doc, item, shift, starts, codes.kind) for shift, starts in diagonals.items()]
    verbatim = max((f[0] for f in found), default=0)
    consistent, slots = max(((f[1], -f[2]) for f in found), default=(0, 0))
    return (verbatim, consistent, -slots) if max(verbatim, consistent) >= WINDOW else None
