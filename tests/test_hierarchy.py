import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import hierarchy as H
from lorekeep.sources.tables import canonical_uuid

NODES = "id string, parent string, grp string"


def brute(parents):
    out = {}
    for i in parents:
        path, x = [i], i
        while parents.get(x) in parents and parents[x] not in path:
            x = parents[x]
            path.append(x)
        nxt = parents.get(x)
        if nxt in parents:
            ring = path[path.index(nxt) :]
            out[i] = (min(ring), -1 if i in ring else -2)
        else:
            out[i] = (x, len(path) - 1)
    return out


@pytest.mark.parametrize("forest_nodes", [200_000, 5])
def test_random_forests_and_rings(spark, forest_nodes):
    rnd = random.Random(7)
    ids = [f"n{i:03d}" for i in range(150)]
    parents = {i: rnd.choice([None, "gone", *ids[:k], *([rnd.choice(ids)] if k % 9 == 0 else [])]) for k, i in enumerate(ids)}
    parents |= {f"c{k:03d}": (f"c{k - 1:03d}" if k else None) for k in range(90)}  # a deep chain
    parents |= {"r1": "r2", "r2": "r3", "r3": "r1", "s": "s", "below": "r2"}
    rows = [(i, p, f"g{rnd.randrange(4)}") for i, p in parents.items()]
    df = spark.createDataFrame(rows, NODES)
    got = {r.id: r for r in H.hierarchy(df, trails=True, forest_nodes=forest_nodes).collect()}
    expected = brute(parents)
    assert {i: (r.root_id, r.depth) for i, r in got.items()} == expected
    for i, r in got.items():
        if r.depth < 0:
            assert r.path is None
        else:
            assert r.path[0] == r.root_id and r.path[-1] == i and len(r.path) == r.depth + 1
            assert all(parents[b] == a for a, b in zip(r.path, r.path[1:]))


def test_empty_nulls_and_extra_columns(spark):
    assert H.hierarchy(spark.createDataFrame([], NODES), trails=True).count() == 0
    df = spark.createDataFrame([(None, "a", None), ("a", None, None), ("b", "a", None)], NODES)
    df = df.withColumns({"depth": F.lit(9), "root_id": F.lit("x"), "up": F.lit("y"), "path": F.lit("z"), "anchor": F.lit("w")})
    assert {(r.id, r.root_id, r.depth) for r in H.hierarchy(df).collect()} == {("a", "a", 0), ("b", "a", 1)}


def test_descendants(spark):
    df = spark.createDataFrame([("a", None, "g"), ("b", "a", "g"), ("c", "b", "h"), ("d", "a", "g")], NODES)
    got = {tuple(r) for r in H.descendants(H.hierarchy(df, trails=True)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("a", "a"), (None, "q"), ("a", "b"), ("z", "y"), ("k", "m"), ("m", "l"), ("l", "j")]
    got = {r.id: r.component for r in H.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x", "k": "j", "m": "j", "l": "j", "j": "j"}
    assert H.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_uuid_spellings(spark):
    same = "0a1b2c3d-0000-4000-8000-00000000000f"
    forms = [same, same.upper(), "{" + same + "}", "urn:uuid:" + same, same.replace("-", ""), f" {same}\n", "{" + same.upper() + "} "]
    bad = ["", " ", "none", None, same[:-1], same + "0"]
    df = spark.createDataFrame([(x,) for x in forms + bad], "c string").select(canonical_uuid(F.col("c")).alias("u"))
    assert [r.u for r in df.collect()] == [same] * len(forms) + [None] * len(bad)


def test_records_latest_row_holds(spark, data, tmp_path):
    from lorekeep.plans import record_queries as R

    t = spark.read.parquet(f"{data}/records.parquet")
    t.unionByName(t).write.parquet(str(tmp_path / "records.parquet"))  # repeated rows change nothing
    assert sorted(R.p1_found(spark, data).collect()) == sorted(R.p1_found(spark, str(tmp_path)).collect())
    (tmp_path / "none").mkdir()
    t.limit(0).write.parquet(str(tmp_path / "none" / "records.parquet"))
    assert R.p1_found(spark, str(tmp_path / "none")).count() == 0


def test_links_close_in_joins_alone(spark):
    rows = [(f"n{i:02d}", f"n{i - 1:02d}", 1) for i in range(1, 40)] + [("x", "y", 2), ("y", "z", 3), ("z", "x", 1), ("w", "x", 5)]
    got = {r.id: (r.root, r.mark) for r in H.close_links(spark.createDataFrame(rows, "id string, up string, far bigint")).collect()}
    assert got == {f"n{i:02d}": ("n00", 0) for i in range(1, 40)} | {k: ("x", -1) for k in "xyz"} | {"w": ("x", -2)}
    far = {r.id: r.far for r in H.close_links(spark.createDataFrame(rows[:39], "id string, up string, far bigint")).collect()}
    assert far == {f"n{i:02d}": i for i in range(1, 40)}
