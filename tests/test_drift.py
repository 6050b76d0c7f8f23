import json
from datetime import datetime

from lorekeep.operators import drift as D

FEEDS = "series string, file_name string, exported_at timestamp, format_version string, line_no bigint, payload string, path string, kind string, at bigint"


def feeds(spark, files):
    rows = []
    for (series, name, day), lines in files.items():
        for n, line in enumerate(lines):
            rows.append((series, name, datetime(2026, 1, day), "1", n, line if line is None or isinstance(line, str) else json.dumps(line), "clash", "clash", 1))
    return spark.createDataFrame(rows, FEEDS)


def changes(df):
    return {(r.file_name, r.change, r.old_path, r.new_path) for r in D.drift(df).collect()}


def rec(i, **more):
    return {"id": f"r{i}", "title": f"title {i}", **more}


def test_kinds_of_change(spark):
    f = {
        ("s", "b.jsonl", 1): [rec(1, a=1, kind="x1", c={"t": "q", "u": 1}, l=[{"n": "m1"}]), rec(2, a=2, kind="x2", c={"t": "w", "u": 2}, l=[{"n": "m2"}]), "{cut", None],
        ("s", "a.jsonl", 2): [rec(1, a="1", sort="x1", d={"t": "q", "u": 1}, l=[{"m": "m1"}], e={"new": 1}), rec(2, a="2", sort="x2", d={"u": 2, "t": "w"}, l=[{"m": "m2"}]), rec(3, a=3, sort="x3")],
        ("t", "z.jsonl", 1): [rec(9, other=1)],
    }
    assert changes(feeds(spark, f)) == {("a.jsonl", "retyped", "a", "a"), ("a.jsonl", "renamed", "kind", "sort"), ("a.jsonl", "renamed", "c", "d"), ("a.jsonl", "renamed", "l.n", "l.m"), ("a.jsonl", "added", "", "e")}


def test_values_decide_between_rename_and_exchange(spark):
    f = {("s", "1", 1): [rec(i, old=f"v{i}", same=None) for i in range(4)], ("s", "2", 2): [rec(i, new=f"w{i}") for i in range(4)]}
    assert changes(feeds(spark, f)) == {("2", "removed", "old", ""), ("2", "added", "", "new"), ("2", "removed", "same", "")}


def test_wrapped_values_and_sessions(spark):
    one = {"session": {"id": "s", "name": "n", "incremental_updates": [{"id": "r1", "author": "x"}, None, {"id": "r2", "author": None}]}}
    two = {"session": {"id": "s", "incremental_updates": {"id": "r1", "author": {"value": "x"}}}}
    assert changes(feeds(spark, {("s", "1", 1): [one, one], ("s", "2", 2): [two]})) == {("2", "retyped", "session.incremental_updates.author", "session.incremental_updates.author")}


def test_nothing(spark):
    assert D.drift(feeds(spark, {("s", "1", 1): [rec(1)]})).count() == 0
    empty = spark.createDataFrame([], FEEDS)
    assert D.drift(empty).count() == 0 and D.lifespans(empty).count() == 0
    unread = feeds(spark, {("s", "1", 1): ["{"], ("s", "2", 2): [None]})
    assert D.drift(unread).count() == 0


def test_islands_and_one_table(spark):
    f = {("s", "1", 1): [rec(1, a=1, update_type="qa")], ("s", "2", 2): [rec(1, kind="qa")], ("s", "3", 3): [rec(1, a=2, kind="qa")]}
    df = feeds(spark, f)
    isles = {(r.path, r.first_file, r.last_file) for r in D.lifespans(df).where("path in ('a', 'title')").collect()}
    assert isles == {("a", "1", "1"), ("a", "3", "3"), ("title", "1", "3")}
    rows = D.unified(df, D.drift(df)).collect()
    assert [r.update_type for r in rows] == ["qa"] * 3 and {r.record_id for r in rows} == {"r1"}
