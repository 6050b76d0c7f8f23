import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import redact, text
from lorekeep.operators import boards, graph, retrieval, temporal
from lorekeep.sources import archive
from lorekeep.sources.scratch import materialise
from lorekeep.streaming import streams

T0 = datetime(2026, 1, 1)
RECORD = "id string, session_id string, timestamp timestamp_ntz, ingested_at timestamp_ntz, update_type string, content struct<title string, description string, details array<string>>, creates_entities array<string>, references_entities array<string>, typed_entities array<struct<name string, entity_type string>>, creates_relationships array<struct<from_entity string, to_entity string, relation_type string, context string>>, meta struct<valid_from timestamp_ntz, supersedes array<string>, confidence float, retired_at timestamp_ntz>"


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def record(n, minute, kind="decision_made", title="", entities=(), relations=(), supersedes=(), valid_from=None, retired=None):
    return (uid(n), "s", T0 + timedelta(minutes=minute), T0, kind, (title, "", []), list(entities), [], [], list(relations), (valid_from, list(supersedes), 1.0, retired))


def validity(spark, *rows, aliases=()):
    entities = spark.createDataFrame([*aliases, ("nobody", None)], "name string, aliases array<string>")
    return {r.id: r for r in temporal.validity(temporal.clean_records(spark.createDataFrame(list(rows), RECORD)), entities).collect()}


def test_validity_cases(spark):
    v = validity(spark, record(1, 0), record(2, 10, supersedes=[uid(1)], valid_from=T0 + timedelta(minutes=5)))
    assert (v[uid(1)].valid_to, v[uid(1)].reason, v[uid(1)].ended_by) == (T0 + timedelta(minutes=5), "superseded", uid(2))
    v = validity(spark, record(1, 0, title="Usual board view is narrow", entities=["board view"]), record(2, 5, title="Usual board view is wide", entities=["Board-View"]), record(3, 6, title="Usual board view is wide", entities=["relay"]))
    assert (v[uid(1)].reason, v[uid(2)].reason, v[uid(3)].reason) == ("restated", None, None)
    v = validity(spark, record(1, 0, "problem_solved", "same title here", ["x"]), record(2, 1, "problem_solved", "same title here", ["x"]), record(3, 2, title="mill is one", entities=["mill"]), record(4, 3, title="mill is one", entities=["mill"]))
    assert (v[uid(1)].reason, v[uid(3)].reason) == (None, "duplicate")
    a = [("A", "B", "depends_on", ""), ("A", "C", "depends_on", "")]
    v = validity(spark, record(1, 0, "qa", relations=a[:1]), record(2, 1, "qa", relations=[("B", "A", "conflicts_with", "")]), record(3, 0, "qa", relations=a[1:]))
    assert (v[uid(1)].reason, v[uid(3)].reason) == ("contradicted", None)
    v = validity(spark, record(1, 0, retired=T0 + timedelta(minutes=3)), record(2, 9, supersedes=[uid(1)]))
    assert (v[uid(1)].valid_to, v[uid(1)].reason, v[uid(1)].ended_by) == (T0 + timedelta(minutes=3), "forgotten", None)
    v = validity(spark, record(1, 0, title="desk is chosen", entities=["Lease"]), record(2, 1, title="desk is chosen", entities=["LeaseDesk"]), aliases=[("LeaseDesk", ["Lease"])])
    assert v[uid(1)].reason == "duplicate"


def graph_frames(spark, edges, mentions):
    e = spark.createDataFrame([(a, b, t, graph.WEIGHTS[t]) for a, b, t in edges], "src string, dst string, type string, weight double")
    r = spark.createDataFrame(mentions, "entity string, mentions bigint, last_at timestamp_ntz")
    return e, r


def test_importance(spark):
    e, r = graph_frames(spark, [("hub", "a", "depends_on"), ("hub", "b", "depends_on"), ("hub", "c", "depends_on"), ("c", "d", "related_to")], [(x, 1, T0) for x in ("hub", "a", "b", "c", "d")])
    got = {x.entity: x.importance for x in graph.importance(e, r, 60).collect()}
    assert got["hub"] == pytest.approx(1.0) and all(0 < v <= 1 for v in got.values()) and got["a"] < got["hub"] and got["d"] < got["c"]
    e, r = graph_frames(spark, [("x", "y", "depends_on")], [("x", 1, T0), ("y", 1, T0 - timedelta(days=90))])
    got = {x.entity: x.importance for x in graph.importance(e, r, 60).collect()}
    assert got["y"] / got["x"] == pytest.approx(0.75, abs=1e-3)


def test_communities(spark):
    cliques = [(f"{k}{i}", f"{k}{j}", "depends_on") for k in "ab" for i, j in ((1, 2), (2, 3), (1, 3))] + [("a3", "b1", "related_to")]
    e, _ = graph_frames(spark, cliques, [("a1", 1, T0)])
    got = {r.entity: r.community for r in graph.communities(e).collect()}
    assert [got[f"a{i}"] for i in (1, 2, 3)] == [0] * 3 and [got[f"b{i}"] for i in (1, 2, 3)] == [1] * 3


def test_walks(spark):
    steps = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "start string")
    assert {(r.goal, r.hops, tuple(r.path)) for r in graph.shortest_paths(start, steps, 5).collect()} == {("b", 1, ("a", "b")), ("c", 1, ("a", "c")), ("d", 2, ("a", "b", "d"))}
    assert {r.node for r in graph.cycles(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "e")], "src string, dst string")).collect()} == {"a", "b"}
    steps = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("x", "a"), (None, "a")]
    got = {r.node: (r.length, r.chain) for r in graph.cycles(spark.createDataFrame(steps, "src string, dst string")).collect()}
    assert got == {"a": (2, ["a", "b", "a"]), "b": (2, ["b", "a", "b"]), "c": (3, ["c", "a", "b", "c"]), "d": (2, ["d", "e", "d"]), "e": (2, ["e", "d", "e"]), "s": (1, ["s", "s"])}
    assert graph.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(16)]) for i in range(200)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0] * 3)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    got = retrieval.nearest(df, df.where("id in (0, 50)").withColumnRenamed("id", "qid"), 5).collect()
    m = spark.createDataFrame(rows[:200], "id bigint, vector array<float>").toPandas()
    for q in (0, 50):
        base = pd.Series({i: sum(a * b for a, b in zip(m.vector[q], v)) / (sum(a * a for a in m.vector[q]) ** 0.5 * sum(a * a for a in v) ** 0.5) for i, v in zip(m.id, m.vector)})
        mine = sorted((r.rank, r.id, r.similarity) for r in got if r.qid == q)
        assert [i for _, i, _ in mine] == list(base.sort_values(ascending=False).index[:5]) and mine[0][2] == pytest.approx(1, abs=1e-4)


def test_neighbours_and_packing(spark):
    rows = spark.createDataFrame([("g", i) for i in range(6)], "grp string, pos bigint")
    hits = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.9), ("g", 5, 0.1)], "grp string, pos bigint, score double")
    assert {(r.pos, r.score, r.neighbour_of) for r in retrieval.neighbours(rows, hits).collect()} == {(0, 0.5, 1), (1, 0.5, None), (2, 0.9, None), (3, 0.9, 2), (4, 0.1, 5), (5, 0.1, None)}
    c = spark.createDataFrame([(1, 0, 6), (1, 1, 5), (1, 2, 4)], "qid bigint, pos bigint, cost bigint")
    assert {r.pos for r in retrieval.packed(c, 10).where("kept").collect()} == {0, 2}


def test_shared_ranks(spark):
    df = spark.createDataFrame([(1, "a", "t", 0), (1, "b", "t", 1), (1, "c", "u", 2), (1, "d", "t", 3)], "qid int, id string, text string, rank bigint")
    assert {(r.id, r.rank) for r in retrieval.shared_ranks(df).collect()} == {("a", 0), ("b", 0), ("c", 2), ("d", 3)}


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "word " * 500), (2, ""), (3, None), (4, "x" * 2500)], "i bigint, t string")
    got = text.chunks(df, "i", "t").collect()
    assert {r.id for r in got} == {1, 2, 4} and all(len(r.chunk) <= 1000 for r in got) and [r.chunk_id for r in got if r.id == 1][:2] == ["1", "1#1"]
    assert text.best_passage("short", "x", 10) is None
    shown = text.best_passage("aaa " * 100 + "needle in hay " + "bbb " * 100, "needle hay", 60)
    assert "needle in hay" in shown and shown.startswith("…") and shown.endswith("…")
    assert text.paths_of("src/{a,b}.rs, lib/x.py:12-14 y.py; none") == ["src/a.rs", "src/b.rs", "lib/x.py", "lib/y.py"]
    keys = spark.createDataFrame([("Board-View",), ("_-",)], "n string").select(text.entity_key(F.col("n"))).collect()
    assert [r[0] for r in keys] == ["boardview", "_-"]


def test_redaction(spark):
    texts = ["mail me@host.org", "Authorization: Bearer abcdefghijklmnop1234", "https://u:pw@host/x", "password=hunter22", "at 8.8.8.8 and 10.0.0.1", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redact.redacted(F.col("t"))).collect()]
    assert got == ["mail [REDACTED:email]", "Authorization: Bearer [REDACTED:bearer]", "https://u:[REDACTED:url_password]@host/x", "password=[REDACTED:secret]", "at [REDACTED:ip] and 10.0.0.1", None]


def test_ranks_between():
    rnd = random.Random(1)
    ranks = [boards.rank_between("", None)]
    for _ in range(200):
        i = rnd.randrange(len(ranks) + 1)
        low, high = ranks[i - 1] if i else "", ranks[i] if i < len(ranks) else None
        new = boards.rank_between(low, high)
        assert low < new and (high is None or new < high)
        ranks.insert(i, new)


def test_freshness_and_cascade(spark):
    e = spark.createDataFrame([("a", "f", "x"), ("b", "g", None), ("c", "h", None), ("d", "i", None)], "id string, file_hash string, ast_hash string")
    s = spark.createDataFrame([("a", "fresh", "other", "x"), ("b", "stale", "g", None), ("c", "fresh", "old", None)], "id string, status string, file_hash string, ast_hash string")
    assert {r.id: r.state for r in boards.freshness(e, s).collect()} == {"a": "fresh", "b": "stale", "c": "stale", "d": "unknown"}
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x")], "src string, dst string")
    assert {(r.node, r.hops) for r in boards.invalidated(spark.createDataFrame([("a",)], "start string"), deps).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_archive_and_appends(spark, tmp_path):
    s = spark.createDataFrame([("a", None), ("b", "n")], "session_id string, name string")
    archive.export_archive({"sessions": s}, str(tmp_path / "a"))
    assert sorted(archive.import_archive(spark, str(tmp_path / "a"))["sessions"].collect()) == sorted(s.collect())
    assert archive.preview_archive(spark, str(tmp_path / "a")).first().readable
    stored = spark.createDataFrame([("s", "t1", 0)], "session_id string, turn_id string, seq bigint")
    more = spark.createDataFrame([("s", "t2", 1), ("s", "t1", 2), ("s", "t2", 3), ("s", "t3", 4)], "session_id string, turn_id string, pos bigint")
    assert {(r.turn_id, r.seq) for r in archive.append_messages(stored, more).collect()} == {("t2", 1), ("t3", 2)}


def test_histories(spark):
    cols = "id string, version int, content string, written_at int"
    a = spark.createDataFrame([("new", 1, "x", 1), ("on", 1, "x", 1), ("on", 2, "y", 2), ("div", 1, "p", 9)], cols)
    t = spark.createDataFrame([("on", 1, "x", 1), ("div", 1, "q", 1), ("only", 1, "z", 1)], cols)
    got = {(r.id, r.version, r.content, r.action, r.conflict) for r in archive.merge_history(a, t, newer=True).collect()}
    assert got == {("new", 1, "x", "add", None), ("on", 1, "x", "add", None), ("on", 2, "y", "add", None), ("div", 1, "q", "add", "update"), ("div", 2, "p", "add", "update"), ("only", 1, "z", "keep", None)}
    kept = {(r.id, r.content, r.conflict) for r in archive.merge_history(a, t, overwrite=True).where("id = 'div'").collect()}
    assert kept == {("div", "p", "overwrite")}


def test_streaming_state(spark, tmp_path):
    spark.createDataFrame([("k", "1"), ("k", "2"), ("m", "9")], "key string, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    changes = streams.follow(spark, str(tmp_path / "in"), "key string, value string")
    got = streams.run_available(streams.key_values(changes, lambda old, new: (old or "") + new), "kv_state", str(tmp_path / "cp"), "update")
    assert {(r.key, r.version) for r in got.collect()} == {("k", 2), ("m", 1)}


def test_graph_candidates_follow_relations_and_entities(spark):
    import numpy as np

    docs = [("a", ["x", "y"], ["k"]), ("b", ["z"], ["m"]), ("c", ["y", "w"], []), ("d", [], ["n"]), ("e", ["v"], ["k"])]
    relations = [("k", "m", 0.4), ("m", "n", 1.0), ("k", "gone", 1.0), ("m", "m", 1.0)]
    queries = [(1, ["x"], []), (2, ["none"], ["n"])]
    got = retrieval.graph_candidates(spark.createDataFrame(docs, "id string, terms array<string>, entities array<string>"), spark.createDataFrame(queries, "qid int, terms array<string>, entities array<string>"), relations=spark.createDataFrame(relations, "src string, dst string, weight double")).collect()
    keys = [*"abcde", *sorted({"t" + t for _, ts, _ in docs for t in ts} | {"e" + t for _, _, es in docs for t in es})]
    m = np.zeros((len(keys), len(keys)))
    for i, ts, es in docs:
        for k in ["t" + t for t in ts] + ["e" + t for t in es]:
            m[keys.index(i), keys.index(k)] = m[keys.index(k), keys.index(i)] = 1
    for a, b, w in relations[:2]:
        m[keys.index("e" + a), keys.index("e" + b)] = m[keys.index("e" + b), keys.index("e" + a)] = w
    for qid, seed in ((1, "tx"), (2, "en")):
        s = np.eye(len(keys))[keys.index(seed)]
        rank = s
        for _ in range(30):
            rank = 0.5 * s + 0.5 * rank @ (m / m.sum(axis=1, keepdims=True))
        assert {r.id: round(r.score, 8) for r in got if r.qid == qid} == {k: round(float(v), 8) for k, v in zip("abcde", rank) if v > 0}


def test_graph_steps_shuffle_nothing(spark):
    docs = materialise(spark.createDataFrame([(str(i), [f"w{i % 40}", f"v{i % 25}"], [f"e{i % 30}"]) for i in range(200)], "id string, terms array<string>, entities array<string>"))
    queries = spark.createDataFrame([(1, ["w1"], []), (2, [], ["e2"])], "qid int, terms array<string>, entities array<string>")
    relations = materialise(spark.createDataFrame([("e1", "e2", 0.4), ("e2", "e5", 1.0)], "src string, dst string, weight double"))
    tracker, stages = spark.sparkContext.statusTracker(), {}
    for steps in (5, 15):
        spark.sparkContext.setJobGroup(f"graph-{steps}", "")
        assert retrieval.graph_candidates(docs, queries, steps=steps, relations=relations).count()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"graph-{steps}")]
        stages[steps] = sum(len(j.stageIds) for j in jobs)
    spark.sparkContext.setJobGroup("", "")
    assert stages[15] - stages[5] == 10  # a scan a step


def test_graph_candidates_in_blocks_against_brute_force(spark, monkeypatch):
    import numpy as np

    rnd = random.Random(5)
    docs = [(i, sorted({f"w{rnd.randrange(90)}" for _ in range(rnd.randrange(4))}) or None, [f"e{rnd.randrange(12)}"] if i % 3 else None) for i in range(120)]
    docs += [(900 + i, ["w1", "w2"], None) for i in range(2)]  # tied
    queries = [(f"q{n}", [f"w{rnd.randrange(90)}" for _ in range(3)] + ["none"], [f"e{n}", None]) for n in range(5)] + [("no", ["none"], None)]
    relations = [(f"e{rnd.randrange(12)}", f"e{rnd.randrange(14)}", rnd.choice([0.4, 0.8, 1.0])) for _ in range(20)]
    monkeypatch.setattr(retrieval, "GRAPH_BLOCK", 2)
    got = retrieval.graph_candidates(
        spark.createDataFrame(docs, "id bigint, terms array<string>, entities array<string>").repartition(3),
        spark.createDataFrame(queries, "qid string, terms array<string>, entities array<string>"),
        k=20,
        relations=spark.createDataFrame(relations, "src string, dst string, weight double").repartition(2),
    ).collect()
    on = {i: {"t" + t for t in ts or ()} | {"e" + e for e in es or ()} for i, ts, es in docs}
    df = {k: sum(k in ks for ks in on.values()) for ks in on.values() for k in ks}
    df = {k: n for k, n in df.items() if n <= max(int(0.05 * len(docs)), 2)}
    keys = [*on, *df]
    at = {k: n for n, k in enumerate(keys)}
    m = np.zeros((len(keys), len(keys)))
    for i, ks in on.items():
        for k in ks & set(df):
            m[at[i], at[k]] = m[at[k], at[i]] = 1
    for a, b, w in relations:
        if a != b and {"e" + a, "e" + b} <= set(df):
            m[at["e" + a], at["e" + b]] += w
            m[at["e" + b], at["e" + a]] += w
    part = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
    for qid, ts, es in queries:
        seed = np.zeros(len(keys))
        for k in {"t" + t for t in ts} | {"e" + e for e in es or () if e}:
            if k in df:
                seed[at[k]] = 1 / df[k]
        rank = seed = seed / max(seed.sum(), 1e-300)
        for _ in range(30):
            rank = 0.5 * seed + 0.5 * rank @ part
        best = sorted(((-round(float(rank[at[i]]), 12), str(i)) for i in on if rank[at[i]] > 0))[:20]
        assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == qid] == [(i, round(-s, 9)) for s, i in best]


def test_graph_ranked_takes_all_steps(spark, data, monkeypatch):
    from lorekeep.plans import report_queries

    seen = []
    monkeypatch.setattr(retrieval, "graph_candidates", lambda docs, queries, k=300, steps=30, relations=None: seen.append((docs.columns, k, steps, relations is not None)))
    report_queries.graph_ranked(spark, data)
    assert seen == [(["id", "terms", "entities"], 300, 30, True)]


def test_graph_timeline_has_relation_events(spark):
    rec = spark.sql("""select * from values
        ('a', timestamp_ntz'2025-01-01 00:00:00', 's', 'qa', named_struct('title', 'A'), array(named_struct('from_entity', 'x', 'to_entity', 'y', 'relation_type', 'solves'))),
        ('b', timestamp_ntz'2025-01-03 00:00:00', 's', 'qa', named_struct('title', 'B'), array(named_struct('from_entity', 'x', 'to_entity', 'Y y', 'relation_type', 'solves')))
        as t(id, timestamp, session_id, update_type, content, creates_relationships)""")
    valid = spark.sql("""select * from values ('a', timestamp_ntz'2025-01-01 00:00:00', timestamp_ntz'2025-01-02 00:00:00', 'superseded'), ('b', timestamp_ntz'2025-01-03 00:00:00', timestamp_ntz'2025-01-04 00:00:00', 'forgotten') as t(id, valid_from, valid_to, reason)""")
    entities = spark.createDataFrame([("x", []), ("y", ["yy"])], "name string, aliases array<string>")
    low, high = F.expr("timestamp_ntz'2025-01-01 00:00:00'"), F.expr("timestamp_ntz'2025-01-31 00:00:00'")
    rows = temporal.graph_timeline(rec, valid, entities, low, high, 4).collect()
    assert {(r["at"].day, r.event, r.id, r.dst, r.reason, r.total) for r in rows} == {(2, "ended", "a", None, "superseded", 6), (3, "recorded", "b", None, None, 6), (4, "ended", "b", None, "forgotten", 6), (4, "relation_ended", "b", "y", "forgotten", 6)}
    rows = temporal.graph_timeline(rec, valid, entities, low, high, 9).collect()
    assert (1, "relation_added", "a", "x", "y") in {(r["at"].day, r.event, r.id, r.src, r.dst) for r in rows} and len(rows) == 6


def test_as_of_graph(spark):
    t = "timestamp_ntz'2025-01-0{} 00:00:00'".format
    rollup = spark.sql(f"select * from values ('x', {t(1)}), ('y', {t(2)}), ('z', {t(1)}), ('late', {t(9)}) as t(entity, first_at)")
    scores = spark.createDataFrame([("x", 0.5), ("y", 0.4), ("z", 0.1), ("late", 1.0)], "entity string, importance double")
    rel = spark.sql(f"select * from values ('x', 'y', 'solves', {t(1)}, {t(2)}, 1L), ('y', 'x', 'solves', {t(8)}, null, 1L), ('x', 'z', 'solves', {t(1)}, null, 1L) as t(src, dst, type, start, end, records)")
    got = {r.entity: ([e.dst for e in r.edges], r.nodes, r.relations) for r in graph.as_of(rollup, scores, rel, F.expr(t(5)), 2).collect()}
    assert got == {"x": (["y"], 3, 2), "y": ([], 3, 2)}


def test_copies_stay_tied_after_fusion(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "z", 2)], "qid int, id string, rank bigint")
    b = spark.createDataFrame([(1, "z", 0), (1, "y", 1), (1, "x", 2)], "qid int, id string, rank bigint")
    docs = spark.createDataFrame([("x", "copy"), ("y", "copy"), ("z", "other"), ("u", "copy")], "id string, text string")
    got = {r.id: r.score for r in retrieval.fuse_texts([a, b], docs).collect()}
    assert got["x"] == got["y"] == round((1 / 61 + 1 / 62) / (2 / 61), 6) and got["z"] == round((1 / 61 + 1 / 63) / (2 / 61), 6)


def test_best_passage_against_brute_force():
    import random
    import re

    rnd = random.Random(11)
    for _ in range(300):
        text_, query = (" ".join(rnd.choice(["aa", "bb", "ccc", "d-e", "x", "yy."]) for _ in range(n)) for n in (rnd.randrange(1, 60), 3))
        most = rnd.randrange(4, 50)
        shown = text.best_passage(text_, query, most)
        if len(text_) <= most:
            assert shown is None
            continue
        spans, asked = [m.span() for m in re.finditer(r"[^\W_]+", text_)], set(re.findall(r"[^\W_]+", query))
        score = [len({text_[a:b] for a, b in spans[k:] if b - spans[k][0] <= most} & asked) if text_[slice(*spans[k])] in asked else 0 for k in range(len(spans))]
        k = score.index(max(score))
        if max(score):
            k = next(j for j in range(len(spans)) if spans[k][0] - spans[j][0] <= most // 8)
        ends = [b for _, b in spans[k:] if b - spans[k][0] <= most] or [spans[k][1]]
        assert shown == ("…" if spans[k][0] else "") + text_[spans[k][0] : ends[-1]] + ("…" if ends[-1] < spans[-1][1] else "")


def test_windows_cover_the_text():
    import random

    rnd = random.Random(2)
    for _ in range(100):
        t = "".join(rnd.choice("abc  \n") for _ in range(rnd.randrange(0, 200)))
        size = rnd.randrange(5, 40)
        got = text._windows(t, size, 0)
        assert all(len(w) <= size for w in got) or got == [t]
        assert "".join("".join(got).split()) == "".join(t.split())
        again = text._windows(t, size, 3)
        assert len(again) >= len(got) and all(w in t for w in again)
    assert text._windows("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 5]


def test_labels_slugs_and_times(spark):
    df = spark.createDataFrame([("  Ünïted Boards!  of--2026 ", 0.86, "2026-10-22"), ("***", 0.3, " 2026-10-22T02:00:00+02:00 "), ("a" * 47 + "--b", None, "yesterday"), (None, 0.1, "2026-10-22 00:00:00")], "n string, s double, t string")
    got = df.select(text.slug(F.col("n")).alias("n"), text.quality(F.col("s")).alias("q"), text.parsed_time(F.col("t")).alias("t")).collect()
    assert [r.n for r in got] == ["n-ted-boards-of-2026", "workspace", "a" * 47, None]
    assert [r.q for r in got] == ["Excellent", "Fair", "Weak", "Weak"]
    midnight = datetime(2026, 10, 22)
    assert [r.t for r in got] == [midnight, midnight, None, midnight]


def test_json_values_are_redacted_and_keys_kept(spark):
    whole = '{"me@x.org": ["to you@x.org", {"n": 8.8, "t": "a \\"q\\" me@x.org"}], "plain": "b"}'
    df = spark.createDataFrame([(whole,), ("{broken you@x.org",), (None,), ('"you@x.org"',)], "j string")
    got = [r[0] for r in df.select(redact.redacted_json(F.col("j"))).collect()]
    import json

    assert json.loads(got[0]) == {"me@x.org": ["to [REDACTED:email]", {"n": 8.8, "t": 'a "q" [REDACTED:email]'}], "plain": "b"}
    assert got[1:] == [None, None, '"[REDACTED:email]"']


def test_schedules(spark):
    h = lambda n: T0 + timedelta(seconds=n)
    rows = [("new", h(-3000), 3600, None, None), ("late", h(-7300), 3600, False, h(-4000)), ("ok", h(-7300), 3600, False, h(-50)), ("just", h(-3700), 3600, None, None), ("off", h(-7300), 3600, True, None), ("fast", h(-120), 1, None, None), ("later", h(50), 3600, None, None)]
    got = {r.id: r for r in boards.due(spark.createDataFrame(rows, "id string, start timestamp_ntz, every_s int, paused boolean, last_run timestamp_ntz"), F.lit(T0).cast("timestamp_ntz")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("due", "next_due", "owed")}).collect()}
    assert {k: r.health for k, r in got.items()} == {"new": "ok", "late": "late", "ok": "ok", "just": "ok", "off": "paused", "fast": "ok", "later": "ok"}
    assert got["new"].due is None and got["late"].due == h(-100) and got["late"].owed == h(-3700) and got["off"].next_due is None and got["later"].next_due == h(50 + 3600)


def test_cron_in_a_zone(spark):
    days = spark.sql("select explode(array(date '2026-03-29', date '2026-03-30')) as day")
    got = sorted(r.at for r in boards.cron_ticks([30], [2, 5], days, "Europe/Berlin").collect())
    assert got == [datetime(2026, 3, 29, 3, 30), datetime(2026, 3, 30, 0, 30), datetime(2026, 3, 30, 3, 30)]  # 02:30 does not exist on the 29th


def test_positions_over_parts(spark):
    from lorekeep.operators import ordering

    df = spark.createDataFrame([("g" if i % 3 else "h", i % 7, i) for i in range(500)], "g string, k int, i int")
    got = sorted(ordering.with_previous(df, ["g"], ["k", "i"], {"i": "before"}).collect(), key=lambda r: r["at"])
    want = sorted(df.collect(), key=lambda r: (r.g, r.k, r.i))
    assert [(r.g, r.k, r.i) for r in got] == [(r.g, r.k, r.i) for r in want]
    assert [r.before for r in got] == [None if n == 0 or want[n - 1].g != r.g else want[n - 1].i for n, r in enumerate(want)]


def test_reranker_and_its_failure(spark):
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10, "q", "x" * i) for i in range(4)], "qid bigint, id bigint, relevance double, query string, text string")
    best = lambda score: [r.id for r in sorted(retrieval.reranked(rows, score).collect(), key=lambda r: (-r.relevance, r.id))]
    assert best(None) == [0, 1, 2, 3]
    assert best(lambda q, t: t.str.len()) == [3, 2, 1, 0]
    assert best(lambda q, t: 1 / 0) == [0, 1, 2, 3] and best(lambda q, t: [1.0]) == [0, 1, 2, 3]


def test_nearest_of_several_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [2.0, 0.0])], "id bigint, vector array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, None), (13, [1.0])], "qid bigint, vector array<double>")
    got = sorted((r.qid, r.id, r.similarity, r["rank"]) for r in retrieval.nearest(rows, queries, 2).collect())
    assert got == [(10, 1, 1.0, 0), (10, 6, 1.0, 1), (11, 3, 1.0, 0)]
    wanted = spark.createDataFrame([(10, 2), (10, 3), (10, 4), (10, 6), (10, 5)], "qid bigint, id bigint")
    assert {(r.id, r.similarity) for r in retrieval.similarity_of(rows, queries, wanted).collect()} == {(2, 0.0), (3, None), (6, 1.0), (5, None)}


def test_graph_candidates_of_nothing(spark):
    cols = "terms array<string>, entities array<string>"
    some, none = spark.createDataFrame([(1, ["x"], None)], f"id int, {cols}"), spark.createDataFrame([(2, [], None)], f"id int, {cols}")
    asked = spark.createDataFrame([(7, ["x"], None)], f"qid int, {cols}")
    assert [tuple(r) for r in retrieval.graph_candidates(some, asked).collect()] == [(7, "1", pytest.approx(1 / 3), 0)]
    assert retrieval.graph_candidates(none, asked).count() == retrieval.graph_candidates(some, asked.where("qid = 0")).count() == 0
