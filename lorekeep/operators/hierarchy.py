"""Parent-child links of unknown depth: root, depth, rings, paths and descendants of every node.

Links are contracted in partition-local weighted disjoint-set forests (a node's weight is its offset to the local
root). What is left are links between local roots of different partitions; these forests are merged level by level, in
joins: at each level every local root that is not done jumps to where its parent has come (offsets add up), so the
levels number the logarithm of the longest chain of forests. Only nodes in or below a ring are looked at again, by the
same jumps. It is one way for all sizes; nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.scratch import materialise, release

#: Nodes of one local forest; larger groups are split.
FOREST_NODES = 200_000
RING, BELOW = -1, -2


def forest(ids: np.ndarray, ups: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted forest with full path compression: for each node the index of its root, the offset to it, and a mark.

    The mark is 0 for a tree, RING or BELOW for a ring and what hangs below one; then the root is the smallest id of
    the ring. Vectorised: all paths are halved at once, so the passes number the logarithm of the depth.
    """
    n = len(ids)
    up = pd.Index(ids).get_indexer(ups) if n else np.zeros(0, dtype=np.int64)
    jump = np.where(up >= 0, up, np.arange(n))
    far = np.where(up >= 0, weights, 0).astype(np.int64)
    for _ in range(max(1, int(n).bit_length()) + 1):
        after = jump[jump]
        if np.array_equal(after, jump):
            break
        far = far + far[jump]
        jump = after
    caught = up[jump] >= 0 if n else np.zeros(0, dtype=bool)
    mark = np.zeros(n, dtype=np.int64)
    if caught.any():
        on_ring = np.zeros(n, dtype=bool)
        on_ring[jump[caught]] = True
        least = np.full(n, -1)
        for start in np.nonzero(on_ring)[0]:
            if least[start] < 0:
                ring = [start]
                while up[ring[-1]] != start:
                    ring.append(up[ring[-1]])
                least[ring] = min(ring, key=lambda i: ids[i])
        mark[caught] = np.where(on_ring[caught], RING, BELOW)
        jump = np.where(caught, least[jump], jump)
    return jump, far, mark


def _local(pdf: pd.DataFrame, trails: bool) -> pd.DataFrame:
    ids, ups = pdf["id"].to_numpy(object), pdf["up"].to_numpy(object)
    root, far, mark = forest(ids, ups, np.ones(len(ids)))
    out = pd.DataFrame({"id": ids, "up": ups, "anchor": ids[root], "far": far, "caught": mark != 0, "anchor_up": ups[root]})
    if trails:
        out["trail"] = _trails(ids, ups, far, mark)
    return out


def _trails(ids: np.ndarray, ups: np.ndarray, far: np.ndarray, mark: np.ndarray) -> list[list[str]]:
    """Of each tree node the ids below its local root down to itself, through an index of parents, top down."""
    at: dict[str, list[str]] = {}
    out: list[list[str]] = [[] for _ in ids]
    for i in np.argsort(far, kind="stable"):
        if mark[i] == 0:
            out[i] = at[ups[i]] + [ids[i]] if far[i] else []
            at[ids[i]] = out[i]
    return out


def close_links(links: DataFrame, trails: bool = False) -> DataFrame:
    """Follows links (id, up, far[, trail]) to their ends: id, root, far, mark[, trail].

    A root is an `up` that is no id. Rings get mark RING, what leads into one BELOW, root then being the smallest id on
    it. Each level doubles the reach of all links that are not done, by one join; links that are done leave the loop and
    only answer those that jump onto them. Ids must be unique and neither null.
    """
    own = ["trail"] if trails else []
    blank = F.array().cast("array<string>").alias("trail")
    state = materialise(links.select("id", "up", "far", F.col("id").alias("low"), *own))
    count, span, done = state.count(), 1, None
    while count:
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("low").alias("low2"), *[F.col(c).alias(c + "2") for c in own])
        if done is not None:
            ahead = ahead.unionByName(done.select(F.col("id").alias("up"), F.col("root").alias("up2"), F.col("far").alias("far2"), F.lit(None).cast("string").alias("low2"), *[F.col(c).alias(c + "2") for c in own]))
        met = F.col("up2").isNotNull()
        grown = materialise(
            state.join(ahead, "up", "left").select(
                "id", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.least("low", "low2").alias("low"), *[F.when(met, F.concat(c + "2", c)).otherwise(F.col(c)).alias(c) for c in own], F.col("low2").isNotNull().alias("on")
            )
        )
        ended = grown.where("not on").select("id", F.col("up").alias("root"), "far", *own)
        done = ended if done is None else done.unionByName(ended)
        state, before = grown.where("on").drop("on"), count
        count = state.count()
        if span >= before:  # what has gone further than there are links is caught
            break
        span *= 2
    if done is None:
        return state.select("id", F.col("up").alias("root"), "far", F.lit(0).cast("bigint").alias("mark"), *own)
    closed = done.select("id", "root", "far", F.lit(0).cast("bigint").alias("mark"), *own)
    if count:
        ring = state.select(F.col("up").alias("on_ring")).distinct()
        lows = state.join(ring, state["id"] == ring["on_ring"], "left_semi").select(F.col("id").alias("up"), F.col("low").alias("root"))
        rest = state.drop("low").join(lows, "up", "left").join(ring, F.col("id") == F.col("on_ring"), "left")
        mark = F.when(F.col("on_ring").isNotNull(), F.lit(RING)).otherwise(F.lit(BELOW)).cast("bigint")
        closed = closed.unionByName(rest.select("id", "root", "far", mark.alias("mark"), *([blank] if trails else [])))
    return closed


def hierarchy(nodes: DataFrame, trails: bool = False, forest_nodes: int = FOREST_NODES) -> DataFrame:
    """Root and depth of every node of `nodes` (id, parent, grp): id, parent, root_id, depth[, path].

    `grp` only says which nodes probably belong together (a session); links may cross it. Groups beyond `forest_nodes`
    are split. A parent that is null or no id makes a root (depth 0). On a ring (a self link too) depth is -1, below
    one -2, and root_id is the smallest id on it. `path` lists the ids from the root to the node (null for rings).
    Rows with a null id are no nodes; ids must be unique. Any other columns are ignored. Empty in, empty out.
    """
    nodes = materialise(nodes.where(F.col("id").isNotNull()).select("id", "parent", "grp"))
    ups = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    named = nodes.where("parent is not null").join(ups, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("up"), "grp")
    linked = named.unionByName(nodes.where("parent is null").select("id", F.lit(None).cast("string").alias("up"), "grp"))
    sizes = nodes.groupBy("grp").count().where(F.col("count") > forest_nodes).select("grp", F.ceil(F.col("count") / forest_nodes).alias("split"))
    linked = linked.join(sizes, linked["grp"].eqNullSafe(sizes["grp"]), "left").select("id", "up", linked["grp"], F.pmod(F.xxhash64("id"), F.coalesce("split", F.lit(1))).alias("salt"))
    total = nodes.count()
    forests = max(1, -(-total // (forest_nodes // 4)), min(64, total // 2000))
    schema = "id string, up string, anchor string, far bigint, caught boolean, anchor_up string" + (", trail array<string>" if trails else "")
    local = linked.groupBy(F.pmod(F.xxhash64("grp", "salt"), F.lit(forests)).alias("bucket")).applyInPandas(lambda pdf: _local(pdf, trails), schema)
    local = materialise(local)
    release(nodes)

    tops = local.where("id = anchor and up is not null and not caught").select(F.col("id").alias("low_root"), "up")
    over = local.select(F.col("id").alias("up"), F.col("anchor").alias("next"), F.col("far").alias("step"), F.col("caught").alias("lost"), *([F.col("trail").alias("steps")] if trails else []))
    merged = tops.join(over, "up").select(
        F.col("low_root").alias("id"), F.when(F.col("lost"), F.col("up")).otherwise(F.col("next")).alias("up"), (F.when(F.col("lost"), 0).otherwise(F.col("step")) + 1).alias("far"), *([F.concat("steps", F.array("low_root")).alias("trail")] if trails else [])
    )
    closed = close_links(merged, trails).withColumnsRenamed({"id": "anchor", "root": "top", "far": "more", **({"trail": "above"} if trails else {})})
    # what ends in a node that a local forest caught is caught too; settled for forests, so that no tree's root is a join's key for all its nodes
    lost = local.where("caught").select(F.col("id").alias("top"), F.lit(True).alias("in_lost"))
    closed = materialise(closed.join(lost, "top", "left").withColumn("mark", F.when(F.col("in_lost"), F.lit(BELOW)).otherwise(F.col("mark")).cast("bigint")).drop("in_lost"))
    full = local.join(closed, "anchor", "left").withColumn("ringed", F.col("caught") | (F.coalesce("mark", F.lit(0)) != 0)).withColumn("top", F.coalesce("top", "anchor"))
    full = materialise(full.select("id", "up", "top", (F.col("far") + F.coalesce("more", F.lit(0))).alias("depth"), "ringed", *([F.concat(F.array("top"), F.coalesce("above", F.array().cast("array<string>")), "trail").alias("path")] if trails else [])))
    release(local, closed)

    rings = close_links(full.where("ringed").select("id", "up", F.lit(1).cast("bigint").alias("far")))
    trees = full.where("not ringed").select("id", F.col("up").alias("parent"), F.col("top").alias("root_id"), "depth", *(["path"] if trails else []))
    caught = full.where("ringed").select("id", F.col("up").alias("parent")).join(rings.select("id", F.col("root").alias("root_id"), F.col("mark").alias("depth")), "id")
    if trails:
        caught = caught.withColumn("path", F.lit(None).cast("array<string>"))
    return trees.unionByName(caught)


def descendants(paths: DataFrame) -> DataFrame:
    """All descendants of each node, from `hierarchy(..., trails=True)`: ancestor_id, id, distance (1 for a child).

    The pairs number the sum of the depths. Nodes of rings have no path, so no rows.
    """
    at = paths.where(F.size("path") > 1).select("id", F.posexplode(F.slice(F.col("path"), F.lit(1), F.size("path") - 1)).alias("level", "ancestor_id"), "depth")
    return at.select("ancestor_id", "id", (F.col("depth") - F.col("level")).cast("bigint").alias("distance"))


def latest_by(df: DataFrame, key: Column, order: Column, *kept: str) -> DataFrame:
    """One row a key, the one latest in `order`; aggregated before the shuffle. Null keys are left out."""
    best = df.where(key.isNotNull()).groupBy(key.alias("id")).agg(F.max_by(F.struct(*kept), order).alias("x"))
    return best.select("id", *[F.col(f"x.{k}").alias(k) for k in kept])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): id, component (the smallest id of it).

    Every node links to its smallest neighbour if that is smaller than itself; such links form a forest, which
    `close_links` contracts to roots; edges between roots remain and go round again. The rounds number the logarithm
    of the nodes at most. Nulls and self edges are left out; nodes without edges have no row.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    left = both
    while not left.isEmpty():
        links = left.groupBy("a").agg(F.min("b").alias("up")).where("up < a").select(F.col("a").alias("id"), "up", F.lit(1).cast("bigint").alias("far"))
        roots = materialise(close_links(links).select(F.col("id").alias("was"), "root"))
        nodes = nodes.join(roots, F.col("component") == F.col("was"), "left").select("id", F.coalesce("root", "component").alias("component"))
        nodes = materialise(nodes)
        ra, rb = roots.select(F.col("was").alias("a"), F.col("root").alias("ra")), roots.select(F.col("was").alias("b"), F.col("root").alias("rb"))
        left = materialise(left.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct())
    return nodes
