import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from lorekeep.llm import near_duplicates as N

ROWS = "id string, at timestamp_ntz, title string, description string, details array<string>, key string, size int, a string"
T = datetime(2026, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], ROWS)


def sets(rows):
    last = {}
    for i, at, t, d, ds in rows:
        if i is not None and (i not in last or at > last[i][0]):
            last[i] = (at, {w for w in re.findall(r"[^\W_]+", " ".join([t or "", d or "", *[x or "" for x in ds or []]]).lower()) if len(w) >= 3})
    return {i: s for i, (_, s) in last.items() if len(s) >= 20}


def brute(rows):
    s = sets(rows)
    return {(a, b) for a in s for b in s if a < b and 17 * len(s[a] & s[b]) >= 7 * (len(s[a]) + len(s[b]))}


def corpus(seed, n, vocabulary):
    rnd = random.Random(seed)
    words = [f"w{i:04d}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            base = rows[rnd.randrange(len(rows))][3].split()
            for _ in range(rnd.randrange(0, 1 + len(base) // 5)):
                k = rnd.randrange(len(base))
                base[k : k + 1] = rnd.choice([[], [rnd.choice(words)], [base[k], rnd.choice(words)]])
            rnd.shuffle(base)
        else:
            base = rnd.sample(words, rnd.randrange(12, 90))
        rows.append((f"r{i:04d}", T, "Title", " ".join(base), [rnd.choice(words)]))
    return rows


def test_all_pairs_on_dense_vocabularies(spark):
    for seed, vocabulary in ((1, 120), (2, 900)):
        rows = corpus(seed, 260, vocabulary)
        got = [tuple(r) for r in N.similar_pairs(frame(spark, rows), ["title", "description", "details"]).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_small_buckets_and_spread_branches(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(N, "SPREAD", 10)
    rows = corpus(5, 200, 150)
    assert {tuple(r) for r in N.similar_pairs(frame(spark, rows), ["title", "description", "details"]).collect()} == brute(rows)


def test_copies_versions_nulls(spark):
    text = " ".join(f"word{i}" for i in range(30))
    copies = [(f"c{i}", T, None, text, None) for i in range(40)]
    rows = copies + [("v", T, "x", text, []), ("v", datetime(2026, 2, 1), "now short", None, None), (None, T, "n", text, None), ("e", T, "", "", [None, ""]), ("t", T, text, None, [None]), ("long", T, None, text + " extra" * 5000, None)]
    df = frame(spark, rows)
    got = {tuple(r) for r in N.similar_pairs(df.unionByName(df), ["title", "description", "details"]).collect()}
    assert got == brute(rows) and len(got) == 42 * 41 // 2
    groups = {r.id: r for r in N.similar_groups(df, ["title", "description", "details"]).collect()}
    assert set(groups) == {*(f"c{i}" for i in range(40)), "t", "long"}
    assert {r.group_id for r in groups.values()} == {"c0"} and groups["t"].class_id == "c0" and groups["long"].class_id == "long" and groups["c5"].links == 1


def test_deliveries_without_a_time(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [("a", None, None, text, None), ("b", T, None, text, None), ("c", T, None, text + " another", None), ("d", None, None, text + " third", None)]
    got = {tuple(r) for r in N.similar_pairs(frame(spark, rows), ["title", "description", "details"]).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    groups = {r.id: r for r in N.similar_groups(frame(spark, rows), ["title", "description", "details"]).collect()}
    assert {r.group_id for r in groups.values()} == {"a"} and groups["b"].links == 2


def test_empty(spark):
    df = frame(spark, [])
    assert N.similar_pairs(df, ["title", "description", "details"]).count() == 0 and N.similar_groups(df, ["title", "description", "details"]).count() == 0
    one = frame(spark, [("a", T, "few words", None, None)])
    assert N.similar_pairs(one.withColumn("x", F.lit(1)), ["title", "description", "details"]).count() == 0
