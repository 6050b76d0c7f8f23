"""Near-duplicate records: all pairs whose word sets share 0.7 of their union, without comparing all pairs.

A prefix-tree join. Words have one global order, rarest first (the most frequent words by their counts, before them all
others by hash). In this order two similar sets must share several words of their beginnings, so they lie below common
branches of a tree of the sets. The tree is cut at its second level: a branch is a pair of words of a set's beginning
that fall in the same of `COLOURS` classes of words. With beginnings of n - t + COLOURS + 1 words (t the least overlap
that can do) similar sets share COLOURS + 1 of them, hence two of one class: every similar pair meets in some branch.
The branches lie flat, as sorted arrays, in buckets of bounded size; within a branch sets are pruned by the bounds that
their remaining lengths put on the overlap (sizes, and 128-bit parity sketches that bound the difference from below);
what is left is verified on the words. Equal sets collapse to one class before, so a mass of copies costs no pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.hierarchy import components
from lorekeep.sources.scratch import materialise, shared_folder

#: Least similarity as a fraction, least words of a set, least characters of a word.
SIMILAR, WORDS, CHARS = (7, 10), 20, 3
COLOURS = 8
#: Words whose counts order them; the bound of what is broadcast. All others count as rare and are ordered by hash.
FREQUENT = 65_536
#: Bytes of branches in a bucket; rows of one word's branches beyond which they are spread over more buckets.
BUCKET_BYTES, SPREAD = 8_000_000, 100_000
_WORD = re.compile(r"[^\W_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sets:
    """Word sets of texts as hashes; the cache of words is emptied when it is full."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the sets' words one after the other, and the sets' sizes."""
        from xxhash import xxh64_intdigest

        flat: list[int] = []
        sizes = []
        for text in texts:
            known = self.known
            words = {w for w in _WORD.findall(text.lower()) if len(w) >= CHARS}
            try:
                flat += [known[w] for w in words]
            except KeyError:
                if len(known) > 1_000_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                del flat[sum(sizes) :]
                flat += [known[w] for w in words]
            sizes.append(len(words))
        return np.array(flat, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs, 0 of empty ones."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


def _keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its words."""
    return _mix(_sums(_mix(flat ^ np.uint64(0xA0761D6478BD642F)), sizes) ^ sizes.astype(np.uint64))


def _texts(batch: pa.RecordBatch, first: int) -> list[str]:
    columns = [batch.column(k).to_pylist() for k in range(first, batch.num_columns)]
    return [" ".join(x if isinstance(x, str) else " ".join(y for y in x if y) for x in row if x) for row in zip(*columns)]


def _scan(rows: DataFrame) -> DataFrame:
    """Of each row id, at, key, size (sets of enough words); with id null, counts of words: word, n. Counted a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        counts: Counter[int] = Counter()

        def counted() -> pa.RecordBatch:
            n = len(counts)
            words = np.fromiter(counts.keys(), dtype=np.uint64, count=n).view(np.int64)
            out = [pa.nulls(n, pa.string()), pa.nulls(n, pa.timestamp("us")), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(words), pa.array(list(counts.values()), type=pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        names = ["id", "at", "key", "size", "word", "n"]
        for batch in batches:
            flat, sizes = sets.of(_texts(batch, 2))
            keys = _keys(flat, sizes)
            use = sizes >= WORDS
            found, times = np.unique(flat[np.repeat(use, sizes)], return_counts=True)
            counts.update(dict(zip(found.tolist(), times.tolist())))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(use, keys, 0).view(np.int64), mask=~use), pa.array(sizes), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            if len(counts) > 500_000:
                yield counted()
        yield counted()

    return rows.mapInArrow(run, "id string, at timestamp_ntz, key bigint, size bigint, word bigint, n bigint")


def _spans(counts: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all i and i < j <= i + counts[i], about `chunk` at a time, so that temporaries stay in the cache."""
    total = np.cumsum(counts)
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + chunk, "right")))
        part = counts[low:high]
        i = np.repeat(np.arange(low, high), part)
        if len(i):
            yield i, i + 1 + (np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part))
        low = high


def _runs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs within runs that stand one after the other."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    return _spans(ends - np.arange(len(ends)) - 1, 4_000_000)


def _beginnings(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words to take of each set as the larger and as the smaller of a pair."""
    a, b = SIMILAR
    larger = sizes - -(-a * sizes // b) + COLOURS + 1
    smaller = sizes - -(-2 * a * sizes // (a + b)) + COLOURS + 1
    return np.minimum(larger, sizes), np.minimum(smaller, sizes)


def _branches(flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ranks: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> list[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
    """The branches of some distinct sets, by bucket: bucket, keys, sizes, sketches, branch hashes, places with role."""
    words, order, spread = ranks
    rec = np.repeat(np.arange(len(sizes)), sizes)
    bit = _mix(flat ^ np.uint64(0x2545F4914F6CDD1D))
    sketch = np.zeros((len(sizes), 2), dtype=np.uint64)
    np.bitwise_xor.at(sketch, (rec, ((bit >> np.uint64(6)) & np.uint64(1)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
    known = words[at] == flat if len(words) else np.zeros(len(flat), dtype=bool)
    place = np.where(known, np.uint64(1 << 63) | order[at], flat >> np.uint64(1)) if len(words) else flat >> np.uint64(1)
    sort = np.lexsort((place, rec))
    rec, flat, known, at = rec[sort], flat[sort], known[sort], at[sort]
    pos = np.arange(len(rec)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    larger, smaller = _beginnings(sizes)
    use = pos < larger[rec]
    rec, flat, pos = rec[use], flat[use], pos[use]
    parts = np.where(known[use], spread[at[use]], 1) if len(words) else np.ones(len(rec), dtype=np.int64)
    mixed = _mix(flat ^ np.uint64(0x632BE59BD9B4E019))
    colour = (mixed % np.uint64(COLOURS)).astype(np.int64)
    sort = np.lexsort((pos, colour, rec))
    rec, mixed, pos, parts, colour = rec[sort], mixed[sort], pos[sort], parts[sort], colour[sort]
    _, counts = np.unique(rec * COLOURS + colour, return_counts=True)
    found = list(_runs(counts))
    if not found:
        return []
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    with np.errstate(over="ignore"):
        branch = _mix(mixed[i] * np.uint64(3) + mixed[j])
        bucket = _mix(mixed[i] + (mixed[j] >> np.uint64(20)) % parts[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
    role = pos[j] < smaller[rec[j]]
    sort = np.argsort(bucket, kind="stable")
    bucket, branch, owner, role = bucket[sort], (branch[sort] >> np.uint64(32)).astype(np.uint32), rec[i][sort], role[sort]
    edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        mine, local = np.unique(owner[a:b], return_inverse=True)
        packed = local.astype(np.uint16) | (role[a:b].astype(np.uint16) << 15)
        out.append((int(bucket[a]), keys[mine].tobytes(), sizes[mine].astype(np.uint32).tobytes(), sketch[mine].tobytes(), branch[a:b].tobytes(), packed.tobytes()))
    return out


def _branch_rows(rows: DataFrame, ranks: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(ranks)
    names = ["bucket", "keys", "sizes", "sketches", "branches", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()

        def emit(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            flat, sizes, keys = (np.concatenate([h[k] for h in held]) for k in range(3))
            _, first = np.unique(keys, return_index=True)
            keep = np.zeros(len(keys), dtype=bool)
            keep[first] = True
            for low in range(0, len(keys), 30_000):  # places have 15 bits
                part = np.zeros(len(keys), dtype=bool)
                part[low : low + 30_000] = keep[low : low + 30_000]
                if part.any():
                    for row in _branches(flat[np.repeat(part, sizes)], sizes[part], keys[part], sent.value, buckets):
                        yield pa.RecordBatch.from_arrays([pa.array([row[0]], type=pa.int32()), *[pa.array([x], type=pa.binary()) for x in row[1:]]], names=names)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            flat, sizes = sets.of(_texts(batch, 0))
            use = sizes >= WORDS
            held.append((flat[np.repeat(use, sizes)], sizes[use], _keys(flat, sizes)[use]))
            if sum(len(h[0]) for h in held) > 2_000_000:
                yield from emit(held)
                held = []
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, "bucket int, keys binary, sizes binary, sketches binary, branches binary, places binary")


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of sets of one bucket that lie in a common branch and whose remaining lengths allow the similarity."""
    a, b = SIMILAR
    keys = [np.frombuffer(x, dtype=np.int64) for x in pdf["keys"]]
    sizes = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in pdf["sizes"]]).astype(np.int64)
    sketches = np.concatenate([np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in pdf["sketches"]])
    branch = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in pdf["branches"]])
    places = [np.frombuffer(x, dtype=np.uint16) for x in pdf["places"]]
    start = np.cumsum([0, *[len(k) for k in keys]])
    rec = np.concatenate([(p & 0x7FFF).astype(np.int64) + s for p, s in zip(places, start)])
    small = np.concatenate([p >> 15 for p in places]).astype(bool)
    keys = np.concatenate(keys)
    # by branch and size; of one size those come first that may be the smaller set
    code = (branch.astype(np.uint64) << np.uint64(32)) | np.minimum(sizes[rec], (1 << 31) - 1).astype(np.uint64) << np.uint64(1) | (~small).astype(np.uint64)
    sort = np.argsort(code)
    code, rec, small = code[sort], rec[sort], small[sort]
    n = sizes[rec]
    top = (code >> np.uint64(32) << np.uint64(32)) | np.minimum(b * n // a, (1 << 31) - 1).astype(np.uint64) << np.uint64(1) | np.uint64(1)
    counts = np.where(small, np.searchsorted(code, top, "right") - np.arange(len(code)) - 1, 0)
    one, two = sketches[rec, 0], sketches[rec, 1]
    most = (b - a) * np.arange(2 * int(n.max()) + 1) // (a + b) if len(n) else np.zeros(1, dtype=np.int64)
    found: list[np.ndarray] = []
    for i, j in _spans(counts, 200_000):  # i is the smaller set, or as large
        limit = most[n[i] + n[j]]
        apart = np.bitwise_count(one[i] ^ one[j])
        ok = np.nonzero(apart <= limit)[0]
        i, j = i[ok], j[ok]
        ok = apart[ok].astype(np.int64) + np.bitwise_count(two[i] ^ two[j]) <= limit[ok]
        if ok.any():
            ends = np.sort(np.stack([keys[rec[i[ok]]], keys[rec[j[ok]]]], axis=1), axis=1)
            found.append(np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _meet_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition is a bucket, of bounded size."""
    held = [b for b in batches if len(b)]
    if held:
        yield _meet(pd.concat(held, ignore_index=True))


def _word_sets(rows: DataFrame) -> DataFrame:
    """key, words (hashes) of rows (key, texts...) whose set has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            flat, sizes = sets.of(_texts(batch, 1))
            own = batch.column(0).to_numpy(zero_copy_only=False) == _keys(flat, sizes).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "words"]).filter(pa.array(own))

    return rows.mapInArrow(run, "key bigint, words array<bigint>")


def similar_sets(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members and links of the near-duplicate classes of `rows` (id, at, and the text columns).

    A row is a delivery; of an id the one latest in `at` holds (equal times: the larger set key). Columns are texts or
    lists of texts; null and empty ones count as nothing. Members: id, key (its set's class; sets of fewer than 20
    words have none). Links: a, b, classes of different sets with similarity >= 0.7, each pair once. Equal sets are one
    class. Empty in, empty out.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    rows = rows.where(F.col("id").isNotNull())
    scanned = materialise(_scan(rows.select("id", F.col("at").cast("timestamp_ntz"), *columns)))
    seen = scanned.where("id is not null")
    members = materialise(seen.groupBy("id").agg(F.max_by(F.struct("key", "size"), F.struct("at", "key")).alias("x")).where("x.key is not null").select("id", F.col("x.key").alias("key")))
    top = scanned.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    top["rank"] = np.arange(len(top), 0, -1)  # the most frequent comes last in the order
    top["word"] = top["word"].to_numpy(np.int64).view(np.uint64)
    top = top.sort_values("word")
    spread = np.maximum(1, top["n"].to_numpy(np.int64) // SPREAD)
    ranks = (top["word"].to_numpy(np.uint64), top["rank"].to_numpy(np.uint64), spread)
    weight = seen.where("key is not null").agg(F.sum(F.col("size"))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight * 14 // BUCKET_BYTES)))

    branches = _branch_rows(rows.select(*columns), ranks, buckets)
    met = materialise(branches.repartitionById(buckets, "bucket").mapInPandas(_meet_all, "a bigint, b bigint").distinct())
    ends = met.select(F.col("a").alias("key")).union(met.select("b")).distinct()
    shown = seen.join(ends, "key", "left_semi").groupBy("key").agg(F.min(F.struct("id", "at")).alias("x")).select("key", "x.id", "x.at")
    delivered = rows.select(F.col("id").alias("_id"), F.col("at").cast("timestamp_ntz").alias("_at"), *columns)
    texts = delivered.join(shown, (F.col("_id") == F.col("id")) & F.col("_at").eqNullSafe(F.col("at"))).select("key", *[delivered[c] for c in columns])
    sets = materialise(_word_sets(texts).groupBy("key").agg(F.first("words").alias("words")))
    sa, sb = sets.select(F.col("key").alias("a"), F.col("words").alias("wa")), sets.select(F.col("key").alias("b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    close = (SIMILAR[0] + SIMILAR[1]) * both >= SIMILAR[0] * (F.size("wa") + F.size("wb"))
    links = materialise(met.join(sa, "a").join(sb, "b").where(close).select("a", "b"))
    return members, links


def similar_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of different ids with similar sets, equal ones too: id_a < id_b."""
    members, links = similar_sets(rows, columns)
    ma, mb = members.select(F.col("id").alias("x"), F.col("key").alias("a")), members.select(F.col("id").alias("y"), F.col("key").alias("b"))
    across = links.join(ma, "a").join(mb, "b").select("x", "y")
    within = ma.join(mb, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_groups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row an id with a set: id, class_id, group_id, links.

    class_id is the smallest id with an equal set, group_id the smallest id in the connected component, links the
    number of other classes similar to its class. Copies are not expanded into pairs.
    """
    members, links = similar_sets(rows, columns)
    names = members.groupBy("key").agg(F.min("id").alias("class_id"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("links"))
    named = links.join(names.select(F.col("key").alias("a"), F.col("class_id").alias("na")), "a").join(names.select(F.col("key").alias("b"), F.col("class_id").alias("nb")), "b")
    parts = components(named.select(F.col("na").alias("a"), F.col("nb").alias("b"))).select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    rich = names.join(degree, "key", "left").join(parts, "class_id", "left")
    return members.join(rich, "key").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
