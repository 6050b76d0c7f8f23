import json
from datetime import datetime

from lorekeep.llm import dialogues as D

SCHEMA = "session_id string, seq bigint, turn_id string, role string, author string, source_session string, timestamp timestamp, ingested_at timestamp, text string, tools array<string>, files array<string>, parent string, blocks string, conv string, calls string"
T = datetime(2026, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(s, q, t, role, None, c, T, T, text, [], [], parent, b if b is None or isinstance(b, str) else json.dumps(b), "clash", "clash") for s, q, t, role, c, text, parent, b in rows], SCHEMA)


def found(df):
    return {r.conv: r.defect for r in D.defects(D.assigned(D.turns(df))).collect()}


def ask(c, q=0, text="hello", **k):
    return ("s", q, f"{c}{q}", k.get("role", "user"), c, text, k.get("parent"), k.get("b"))


def reply(c, q=1, text="yes", **k):
    return ask(c, q, text, **{"role": "ai"} | k)


def test_defects(spark):
    use, res = {"type": "tool_use", "id": "x", "name": "n"}, {"toolResult": {"toolUseId": "x"}}
    rows = [
        ask("ok"), reply("ok"),
        ask("blank", text=" ​\n"), reply("blank", text=None, b=[{"text": " "}, {"end": {"stop": "end_turn"}}]),
        ask("think", text=""), reply("think", text=None, b=[{"type": "thinking", "text": "hm"}]),
        ask("cut"), reply("cut", b='[{"type":'),
        ask("orphan", parent="nowhere"), reply("orphan"),
        ask("open"), reply("open", b=[use]),
        ask("early"), reply("early", b=[res]), reply("early", 2, b=[use]),
        ask("fine"), reply("fine", b=[use]), reply("fine", 2, b=[res, {"type": "text", "text": "done"}]),
        reply("nouser"),
        ask("silent"),
        ask("failed"), reply("failed", b=[{"type": "end", "stop": "failed"}]),
        ask("wait"), reply("wait"), ask("wait", 2, role=" USER"),
        ask("textblock", text=None, b=[{"type": "text", "text": "hi"}]), reply("textblock", text="", b=[{"text": "yo"}, {"end": {"stop": "max_tokens"}}]),
    ]
    want = {"ok": None, "blank": "empty", "think": "broken", "cut": "broken", "orphan": "broken", "open": "broken", "early": "broken", "fine": None, "nouser": "broken", "silent": "no_reply", "failed": "no_reply", "wait": "no_reply", "textblock": None}
    df = frame(spark, rows)
    assert found(df) == want and found(df.unionByName(df)) == want


def test_inherited_conversations(spark):
    rows = [("s", 0, "a", "user", "c", "hi", None, None), ("s", 1, "b", "agent", None, "yes", "a", None), ("s", 2, "d", "user", " ", "more", "b", None), ("s", 3, "e", "user", None, "none", None, None), ("s", 4, "f", "user", None, "loop", "g", None), ("s", 5, "g", "user", None, "loop", "f", None), ("t", 6, "h", "user", None, "elsewhere", "a", None), (None, 7, "i", "user", "c", "x", None, None)]
    t = D.assigned(D.turns(frame(spark, rows)))
    assert {(r.turn_id, r.conv) for r in t.collect()} == {("a", "c"), ("b", "c"), ("d", "c")}
    assert found(frame(spark, rows)) == {"c": "no_reply"}


def test_lowest_seq_holds(spark):
    rows = [("s", 5, "a", "user", "late", "hi", None, None), ("s", 1, "a", "user", "c", "hi", None, None), ("s", 6, "b", "assistant", "c", "yo", None, None)]
    assert found(frame(spark, rows)) == {"c": None}


def test_paths_of_forks(spark):
    rows = [ask("c"), reply("c", 1), ask("c", 2), reply("c", 3, parent="c2"), reply("c", 4, parent="c2")]
    got = {}
    for r in sorted(D.conversations(frame(spark, rows)).collect(), key=lambda r: (r.leaf, r.ordinal)):
        got.setdefault(r.leaf, []).append(r.turn_id)
    assert got == {"c3": ["c0", "c1", "c2", "c3"], "c4": ["c0", "c1", "c2", "c4"]}


def test_empty_and_long(spark):
    assert found(frame(spark, [])) == {} and D.conversations(frame(spark, [])).count() == 0
    assert found(frame(spark, [ask("c", text="x" * 1_000_000), reply("c", text="y" * 1_000_000)])) == {"c": None}
