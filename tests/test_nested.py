import json
from datetime import datetime

from lorekeep.operators import nested as N

EXPORTS = "export_id bigint, exported_at timestamp, format_version string, payload string, session_id string, rows string"


def exports(spark, *payloads):
    return spark.createDataFrame([(i, datetime(2026, 1, 1 + i), "1", p if p is None or isinstance(p, str) else json.dumps(p), "clash", "clash") for i, p in enumerate(payloads)], EXPORTS)


def items(df):
    return {(r.session_id, r.record_id, r.child, r.ordinal, r.item) for r in N.all_items(N.nested_records(df)).collect()}


def session(updates, sid="s"):
    return {"session": {"id": sid, "incremental_updates": updates}}


def test_wrappings_and_positions(spark):
    a = {"id": "a", "typed_entities": [None, {"name": "E"}, {"name": ""}, {}], "creates_relationships": {"from_entity": "F"}, "related_code": json.dumps({"file_path": "p.rs"})}
    b = {"id": "b", "typed_entities": json.dumps([{"name": {"value": "W"}}]), "related_code": [{"file_path": None}, {"file_path": "q.rs"}], "creates_relationships": None}
    got = items(exports(spark, session([None, a, {"title": "no id", "typed_entities": [{"name": "X"}]}, b])))
    assert got == {("s", "a", "record", 1, "a"), ("s", "a", "typed_entity", 1, "E"), ("s", "a", "relationship", 0, "F"), ("s", "a", "code", 0, "p.rs"), ("s", "b", "record", 3, "b"), ("s", "b", "typed_entity", 0, "W"), ("s", "b", "code", 1, "q.rs")}


def test_latest_readable_export_and_last_entry(spark):
    old, new = session([{"id": "a"}]), session([{"id": "b", "typed_entities": [{"name": "1"}]}, {"id": "b", "typed_entities": [{"name": "2"}]}])
    got = items(exports(spark, old, json.dumps(json.dumps(new)), json.dumps(old)[:-4], None, "null", "[]", "text"))
    assert got == {("s", "b", "record", 1, "b"), ("s", "b", "typed_entity", 0, "2")}


def test_empty_and_repeated(spark):
    assert items(exports(spark, session([]), session(None, "t"))) == set()
    assert N.nested_records(spark.createDataFrame([], EXPORTS)).count() == 0
    df = exports(spark, session([{"id": "a", "creates_relationships": [{"from_entity": "x", "to_entity": "y"}]}]))
    both = df.unionByName(df)
    assert N.child_rows(N.nested_records(both), "relationship").count() == 1
    long = session([{"id": f"r{i}", "typed_entities": [{"name": "n" * 2000}]} for i in range(300)])
    assert len(items(exports(spark, long))) == 600
