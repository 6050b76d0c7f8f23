"""Retrieval over whole tables: BM25, exact nearest vectors, rank fusion, scores, neighbours, context packing.

Batches of queries are answered at once. Queries are a small side that is sent in blocks; rows stay where they are and
give each query's best ones before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import SCRIPTS, script, tokens
from lorekeep.sources.scratch import materialise, release

# Fixed values of the scoring.
K1, B, RRF_K = 1.2, 0.75, 60
MAX_DF_SHARE, MIN_PRUNED_DF = 0.2, 10
RELEVANCE, IMPORTANCE, AUTHOR_BOOST = 0.7, 0.3, 0.05
IMPORTANCE_OF = {"decision": 1.0, "problem": 0.9, "user_message": 0.8, "document": 0.8, "update": 0.7, "code": 0.6, "entity": 0.5, "message": 0.4, "session_metadata": 0.3}
#: Query vectors in a block that is sent to the executors.
QUERY_BLOCK = 4096
#: Queries whose mass moves at once in the graph, and the most tasks that send theirs to the driver at a step.
GRAPH_BLOCK, GRAPH_TASKS = 16, 32


def postings(docs: DataFrame, ident: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """id, term, tf, length (words of the text), of the terms in `wanted` only if given; counted before the shuffle."""
    words = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), tokens(F.col(text)).alias("w"))
    rows = words.select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    rows = rows.join(wanted, "term", "left_semi") if wanted is not None else rows
    return rows.groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each query: qid, id, score, rank (from 0).

    `docs`: id, text; `queries`: qid, text. Statistics are over all documents. A query's words on more than a fifth of
    the documents written in their script are dropped, unless they are on at most ten. Ties go by id.
    Documents with null texts do not count.
    """
    read = docs.where("text is not null").select(F.array_distinct(tokens(F.col("text"))).alias("w"), F.size(tokens(F.col("text"))).alias("length"))
    read = read.select("length", F.array_distinct(F.transform("w", script)).alias("scripts"))
    stats = read.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"), *[F.count_if(F.array_contains("scripts", s)).alias(s) for s in SCRIPTS])  # one row
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    hits = postings(docs, "id", "text", terms.select("term").distinct())
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    written = F.create_map(*[x for s in SCRIPTS for x in (F.lit(s), F.col(s))])
    limits = df.withColumn("script", script(F.col("term"))).crossJoin(F.broadcast(stats))
    most = F.greatest(F.floor(F.lit(MAX_DF_SHARE) * F.coalesce(F.element_at(written, F.col("script")), F.col("n"))), F.lit(MIN_PRUNED_DF))
    useful = limits.where(F.col("df") <= most).select("term", "avg_length", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = hits.join(useful, "term").select("id", "term", (F.col("idf") * norm).alias("part")).join(terms, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_k(scored, "qid", [F.desc("score"), F.asc("id")], k)


def top_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in a total order, with `rank` from 0; the window's limit prunes before the shuffle."""
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint")).where(F.col("rank") < k)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows with the highest cosine to each query: qid, id, similarity, rank. Exact.

    `rows`: id bigint, vector; `queries`: qid bigint, vector. Vectors that are null, zero, hold NaN or have another
    dimension than the query's match nothing; queries of several dimensions are answered side by side. Ties go by id.
    Each partition keeps k rows a query; of a batch only what reaches a query's k-th best is sorted.
    """
    spark = rows.sparkSession
    found = None
    blocks = max(1, -(-queries.count() // block))
    for part in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == part) if blocks > 1 else queries
        pdf = own.where("vector is not null").toPandas()  # a block of queries
        asked = {}
        for dims, group in pdf.groupby(pdf["vector"].map(len)) if len(pdf) else ():
            q = np.stack(group["vector"].to_numpy()).astype(np.float64)
            with np.errstate(all="ignore"):
                asked[int(dims)] = (group["qid"].to_numpy(np.int64), q / np.linalg.norm(q, axis=1, keepdims=True))
        sent = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            best = pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
            for pdf in batches:
                size = pdf["vector"].map(lambda v: -1 if v is None else len(v))
                for dims, (qids, q) in sent.value.items():
                    mine = pdf[size == dims]
                    if not len(mine):
                        continue
                    m = np.stack(mine["vector"].to_numpy()).astype(np.float64)
                    with np.errstate(all="ignore"):
                        sims = q @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
                    sims = np.where(np.isnan(sims), -np.inf, np.round(sims, 6))
                    least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(q), -np.inf)
                    i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                    best = pd.concat([best, pd.DataFrame({"qid": qids[i], "id": mine["id"].to_numpy(np.int64)[j], "similarity": sims[i, j]})])
                best = best.sort_values(["qid", "similarity", "id"], ascending=[True, False, True]).groupby("qid").head(k)
            yield best

        out = rows.select("id", "vector").mapInPandas(run, "qid bigint, id bigint, similarity double")
        found = out if found is None else found.unionByName(out)
    return top_k(found, "qid", [F.desc("similarity"), F.asc("id")], k)


def similarity_of(rows: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cosine of given rows to their queries: `wanted` (qid, id, ...) with `similarity`; rows without a vector have none and are left out.

    `rows`: id, vector; `queries`: qid, vector. Vectors of other dimensions or without length give null. All in the JVM.
    """
    a, b = rows.select("id", F.col("vector").alias("_a")), queries.select("qid", F.col("vector").alias("_b"))
    both = wanted.join(a.where("_a is not null"), "id").join(b.where("_b is not null"), "qid")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def dot(x: str, y: str) -> Column:
        return total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))

    length = F.sqrt(dot("_a", "_a")) * F.sqrt(dot("_b", "_b"))
    return both.withColumn("similarity", F.when((F.size("_a") == F.size("_b")) & (length > 0), F.round(dot("_a", "_b") / length, 6))).drop("_a", "_b")


def reranked(ranked: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series] | None, pool: int = 300) -> DataFrame:
    """The best `pool` rows of each query (qid, id, relevance, query, text) by another model's score, in `relevance`.

    `score` takes two series of texts, queries and rows, and gives one of numbers; it is called with batches on the
    executors. Without one, or where it fails or gives another number of scores for any row of a query, the query's rows
    keep their relevance.
    """
    best = top_k(ranked, "qid", [F.desc("relevance"), F.asc("id")], pool).drop("rank")
    if score is None:
        return best

    @F.pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        try:
            got = pd.Series(score(query, text), dtype="float64")
        except Exception:  # the order stays as it was
            got = pd.Series([], dtype="float64")
        return got.set_axis(query.index) if len(got) == len(query) else pd.Series([None] * len(query), dtype="float64", index=query.index)

    scored = materialise(best.withColumn("_score", run(F.coalesce("query", F.lit("")), F.coalesce("text", F.lit("")))))
    whole = scored.groupBy("qid").agg(F.bool_and(F.col("_score").isNotNull() & ~F.isnan("_score")).alias("_whole"))
    return scored.join(whole, "qid").withColumn("relevance", F.when(F.col("_whole"), F.col("_score")).otherwise(F.col("relevance"))).drop("_score", "_whole")


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 20, others: dict[str, DataFrame] | None = None, rerank: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """The whole search: BM25 and nearest vectors (and further rankings), fused with shared ranks, rescored, weighed by kind and age.

    `docs`: id bigint, text, vector, kind, at, now (the moment of the search), bias is that of a year; null at counts as
    now. `queries`: qid bigint, text, vector. `others`: further rankings by name (qid, id, rank), such as
    `graph_candidates`. Each list is 50 deep, 300 with a reranker. A query that only vectors answer keeps the cosine as
    its relevance. Out: qid, id, score, rank and the signals: a rank for each list, similarity (also of rows that only
    other lists found; null without a vector), fused, relevance.
    """
    depth = 300 if rerank else 50
    rows = docs.where("vector is not null").select("id", "vector")
    asked = queries.where("vector is not null").select("qid", "vector")
    lists = {"vector_rank": nearest(rows, asked, depth), "lexical_rank": bm25(docs.select("id", "text"), queries.select("qid", "text"), depth), **(others or {})}
    lists = {n: materialise(x.select("qid", "id", F.col("rank").cast("bigint").alias("rank"))) for n, x in lists.items()}
    every = None
    for name, x in lists.items():
        part = x.select("qid", "id", "rank", F.lit(name).alias("list"))
        every = part if every is None else every.unionByName(part)
    signals = materialise(every.groupBy("qid", "id").agg(*[F.min(F.when(F.col("list") == n, F.col("rank"))).alias(n) for n in lists]))
    texts = materialise(docs.join(signals.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    used = every.groupBy("qid").agg(F.countDistinct("list").alias("lists"), F.bool_or(F.col("list") != "vector_rank").alias("fusing"))
    shared = None
    for name, x in lists.items():
        part = shared_ranks(x.join(texts, "id", "left")).select("qid", "id", (1.0 / (RRF_K + 1.0 + F.col("rank"))).alias("s"), F.lit(name == "vector_rank").alias("v"))
        shared = part if shared is None else shared.unionByName(part)
    # the vector list always counts among the lists, found or not; others only where they found something
    lists_of = used.join(every.where("list = 'vector_rank'").select("qid").distinct().withColumn("has", F.lit(1)), "qid", "left").select("qid", "fusing", (F.col("lists") + F.when(F.col("has").isNull(), 1).otherwise(0)).alias("lists"))
    fused = shared.groupBy("qid", "id").agg(F.sum("s").alias("s")).join(lists_of, "qid").select("qid", "id", "fusing", F.round(F.col("s") / (F.col("lists") / (RRF_K + 1.0)), 6).alias("fused"))
    near = similarity_of(rows, asked, signals.select("qid", "id"))
    found = fused.join(near, ["qid", "id"], "left").join(signals, ["qid", "id"]).withColumn("relevance", F.when(F.col("fusing"), F.col("fused")).otherwise(F.coalesce("similarity", F.lit(0.0))))
    found = found.join(texts, "id").join(queries.select("qid", F.col("text").alias("query")), "qid")
    best = reranked(found, rerank)
    meta = docs.select("id", "kind", "at", "now").join(signals.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    scored = best.join(meta, "id").withColumn("score", F.round(combined_score(F.col("relevance"), F.col("kind"), F.coalesce("at", "now"), F.col("now"), 1.0), 5))
    out = top_k(scored, "qid", [F.desc("score"), F.desc_nulls_last("at"), F.asc("id")], k)
    return out.select("qid", "id", "score", "rank", *lists, "similarity", "fused", "relevance")


def shared_ranks(ranked: DataFrame) -> DataFrame:
    """Adjacent rows of one text share a rank: `ranked` (qid, id, text, rank) with rank replaced by the run's first position."""
    w = Window.partitionBy("qid").orderBy("rank")
    start = F.when(~F.col("text").eqNullSafe(F.lag("text").over(w)) | (F.col("rank") == 0), F.col("rank"))
    return ranked.withColumn("_start", start).withColumn("rank", F.max("_start").over(w)).drop("_start")


def fuse_texts(lists: list[DataFrame], docs: DataFrame) -> DataFrame:
    """`fuse` where neighbours of one text share a rank, so that copies stay tied. `docs`: id, text; of several rows of an id the smallest text."""
    lists = [materialise(x.select("qid", "id", "rank")) for x in lists]
    ids = lists[0].select("id")
    for x in lists[1:]:
        ids = ids.union(x.select("id"))
    texts = materialise(docs.join(ids.distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    return fuse([shared_ranks(x.join(texts, "id", "left")) for x in lists])


def fuse(lists: list[DataFrame]) -> DataFrame:
    """Reciprocal rank fusion of rankings (qid, id, rank): qid, id, score; first everywhere is 1. Each list has an id once."""
    rows = None
    for x in lists:
        part = x.select("qid", "id", (1.0 / (RRF_K + 1.0 + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("qid", "id").agg(F.round(F.sum("s") / (len(lists) / (RRF_K + 1.0)), 6).alias("score"))


def decayed(score: Column, at: Column, now: Column, bias: float) -> Column:
    """score * exp(-bias * days / 365) with whole days; the bias is held in 0 to 10."""
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000))
    return score * F.exp(-min(max(bias, 0.0), 10.0) * days / 365.0)


def combined_score(relevance: Column, kind: Column, at: Column, now: Column, bias: float = 0.0, author: Column | None = None, prefer: str | None = None) -> Column:
    """0.7 relevance + 0.3 importance of the kind, decayed by age, plus a boost for the preferred author."""
    importance = F.element_at(F.create_map(*[F.lit(x) for p in IMPORTANCE_OF.items() for x in p]), kind)
    out = decayed(RELEVANCE * relevance + IMPORTANCE * F.coalesce(importance, F.lit(0.5)), at, now, bias)
    return out + F.when(author == prefer, AUTHOR_BOOST).otherwise(0.0) if prefer is not None and author is not None else out


def validity_weight(score: Column, confidence: Column, reason: Column) -> Column:
    """Score by confidence (half to whole) and halved for what was superseded, contradicted or forgotten."""
    out = score * (0.5 + 0.5 * F.coalesce(confidence, F.lit(1.0)))
    return out * F.when(reason.isin("superseded", "contradicted", "forgotten"), 0.5).otherwise(1.0)


def best_of_source(results: DataFrame) -> DataFrame:
    """One row a (source, content id without '#n'): the best score, then the newest. `results`: source, content_id, score, at, ..."""
    whole = results.withColumn("content_id", F.regexp_replace("content_id", r"#\d+$", ""))
    rest = [c for c in whole.columns if c not in ("source", "content_id")]
    best = whole.groupBy("source", "content_id").agg(F.max_by(F.struct(*rest), F.struct("score", "at")).alias("x"))
    return best.select("source", "content_id", *[F.col(f"x.{c}").alias(c) for c in rest])


def neighbours(rows: DataFrame, hits: DataFrame, radius: int = 1) -> DataFrame:
    """Hits with the rows beside them: grp, pos, score, neighbour_of (null for a hit).

    `rows`: grp, pos (unique in grp); `hits`: grp, pos, score. No row twice: a hit stays a hit, another row goes with
    the best hit near it (ties: the earlier). Offsets are exploded, so the join is on equality.
    """
    around = hits.select("grp", F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("near"), "score", F.col("pos").alias("hit")).withColumnRenamed("near", "pos")
    met = around.join(rows.select("grp", "pos"), ["grp", "pos"])
    own = F.col("hit") == F.col("pos")
    best = met.groupBy("grp", "pos").agg(F.max_by(F.struct("score", "hit"), F.struct(own, "score", -F.col("hit"))).alias("x"))
    return best.select("grp", "pos", "x.score", F.when(F.col("x.hit") != F.col("pos"), F.col("x.hit")).alias("neighbour_of"))


def packed(candidates: DataFrame, budget: int = 4000) -> DataFrame:
    """Greedy packing of each query's candidates (qid, pos, cost) in order: what does not fit is skipped. Adds `kept`.

    The scan is sequential by its nature, so a query's candidates (a ranking, bounded by its depth) are one group.
    """
    schema = ", ".join(f"{n} {t}" for n, t in candidates.dtypes) + ", kept boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        left, kept = budget, []
        for cost in pdf["cost"]:
            fits = cost <= left
            left -= cost if fits else 0
            kept.append(bool(fits))
        return pdf.assign(kept=kept)

    return candidates.groupBy("qid").applyInPandas(run, schema)


def graph_candidates(docs: DataFrame, queries: DataFrame, k: int = 300, steps: int = 30, damping: float = 0.5, max_share: float = 0.05, relations: DataFrame | None = None) -> DataFrame:
    """Rows ranked by personalised PageRank from each query's terms and entities: qid, id, score, rank.

    `docs`: id (unique), terms (array) and, if they have any, entities (array of entity keys); `queries`: qid, and the
    same; `relations`: src, dst (entity keys), weight. The graph joins rows with terms and entities by edges of weight 1,
    and entities with each other, both ways, by those of the relations; terms and entities on more than 5 % of the rows
    (and more than two), or on none, are left out; seeds weigh one over the rows that have them. Rows without a term or
    an entity are never reached.

    Rows have edges to nodes (terms and entities) only, and no seeds, so what a row holds at a step follows from its
    nodes one step before: the mass of a block of queries is kept by node, and each step is one scan of the rows'
    node numbers, without a shuffle. The nodes and their mass are the only things that pass through the driver; they
    grow with the vocabulary, not with the rows.
    """
    spark = docs.sparkSession
    most = max(int(max_share * docs.count()), 2)
    counted = _graph_nodes(docs, "id").where("node is not null").groupBy("node").agg(F.count("*").alias("df")).where(F.col("df") <= most).toArrow()
    counted = counted.combine_chunks().sort_by([("df", "descending"), ("node", "ascending")])  # frequent ones side by side
    vocabulary, df = pc.cast(counted["node"].combine_chunks(), pa.string()), counted["df"].to_numpy().astype(np.float64)
    known = spark.sparkContext.broadcast(vocabulary)
    edges, strength = _graph_edges(docs, relations, known), df.copy()
    if relations is not None:
        for dst, weight in edges.where("weights is not null").select(F.explode(F.arrays_zip("targets", "weights")).alias("x")).groupBy("x.targets").agg(F.sum("x.weights")).collect():  # a number an entity
            strength[dst] += weight
    asked = _graph_nodes(queries, "qid").toArrow().combine_chunks()
    at = pc.index_in(pc.cast(asked["node"], pa.string()), value_set=vocabulary)
    hit = at.is_valid().to_numpy()
    at, qids = at.drop_null().to_numpy(), np.array(asked["qid"].to_pylist(), dtype=object)[hit]
    names = sorted(set(qids))
    place = {q: n for n, q in enumerate(names)}
    of = np.array([place[q] for q in qids], dtype=np.int64)
    found = spark.createDataFrame([], "q int, id string, score double")
    for first in range(0, len(names) if steps > 0 else 0, GRAPH_BLOCK):
        own = (of >= first) & (of < first + GRAPH_BLOCK)
        seed = np.zeros((min(GRAPH_BLOCK, len(names) - first), len(df)))
        np.add.at(seed, (of[own] - first, at[own]), 1.0 / df[at[own]])
        seed /= seed.sum(axis=1, keepdims=True)
        mass, held = seed, np.zeros_like(seed)
        for _ in range(steps - 1):
            through, direct = _graph_step(edges, mass / strength)
            mass, held = (1 - damping) * seed + damping * (damping * held + direct), through
        found = found.unionByName(_graph_best(edges, damping * mass / strength, first, k))
    found = materialise(found)
    release(edges)
    known.unpersist()
    named = spark.createDataFrame([(n, q) for n, q in enumerate(names)], f"q int, qid {dict(queries.dtypes)['qid']}")
    best = top_k(found.join(F.broadcast(named), "q").select("qid", "id", "score"), "qid", [F.desc(F.round("score", 12)), F.asc("id")], k)
    return best.withColumn("score", F.round("score", 9))


def _graph_edges(docs: DataFrame, relations: DataFrame | None, known: Broadcast) -> DataFrame:
    """A row a batch, with numbers of nodes: of rows `ids`, `sizes` and `nodes`; of relations, both ways, `nodes`, `targets` and `weights`."""
    schema = "ids array<string>, sizes array<int>, nodes array<int>, targets array<int>, weights array<double>"
    listed = {"ids": pa.string(), "sizes": pa.int32(), "nodes": pa.int32(), "targets": pa.int32(), "weights": pa.float64()}

    def packed_row(**columns: pa.Array) -> pa.RecordBatch:
        one = {n: pa.ListArray.from_arrays(pa.array([0, len(columns[n])], pa.int32()), columns[n]) if n in columns else pa.nulls(1, pa.list_(t)) for n, t in listed.items()}
        return pa.RecordBatch.from_arrays(list(one.values()), names=list(one))

    def number(keys: pa.Array) -> pa.Array:
        return pc.index_in(pc.cast(keys, pa.string()), value_set=known.value)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, row = number(pc.list_flatten(b["keys"])), pc.list_parent_indices(b["keys"]).to_numpy()
            size = np.bincount(row[at.is_valid().to_numpy(zero_copy_only=False)], minlength=len(b)).astype(np.int32)
            if size.any():
                yield packed_row(ids=pc.cast(b["id"], pa.string()).filter(pa.array(size > 0)), sizes=pa.array(size[size > 0]), nodes=at.drop_null())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = number(b["src"]), number(b["dst"])
            both = pc.and_(a.is_valid(), z.is_valid())
            a, z, w = a.filter(both), z.filter(both), b["weight"].filter(both)
            if len(w):
                yield packed_row(nodes=pa.concat_arrays([a, z]), targets=pa.concat_arrays([z, a]), weights=pa.concat_arrays([w, w]))

    out = docs.select(F.col("id").cast("string").alias("id"), _graph_keys(docs).alias("keys")).mapInArrow(rows, schema)
    if relations is not None:
        ends = relations.where("src <> dst and weight > 0").groupBy(F.concat(F.lit("e"), "src").alias("src"), F.concat(F.lit("e"), "dst").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        out = out.unionByName(ends.mapInArrow(pairs, schema))
    return materialise(out)


def _graph_step(edges: DataFrame, flow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What nodes get of `flow` (by query and node, for an edge of weight 1) over rows, and over relations."""
    sent = edges.sparkSession.sparkContext.broadcast(flow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = sent.value
        got: dict[int, np.ndarray] = {}
        for sizes, nodes, targets, weights in _graph_pieces(batches):
            kind = 0 if weights is None else 1
            if kind not in got:
                got[kind] = np.zeros_like(flow)
            for q, f in enumerate(flow):
                if kind:
                    got[kind][q] += np.bincount(targets, weights * f[nodes], minlength=len(f))
                else:
                    got[kind][q] += np.bincount(nodes, np.repeat(np.add.reduceat(f[nodes], np.cumsum(sizes) - sizes) / sizes, sizes), minlength=len(f))
        for kind, mass in got.items():
            at = np.flatnonzero(mass.any(axis=0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at.tobytes()]), pa.array([mass[:, at].tobytes()])], names=["kind", "at", "mass"])

    total = np.zeros_like(flow), np.zeros_like(flow)
    for kind, at, mass in edges.select("sizes", "nodes", "targets", "weights").coalesce(GRAPH_TASKS).mapInArrow(run, "kind int, at binary, mass binary").collect():
        total[kind][:, np.frombuffer(at, np.int32)] += np.frombuffer(mass).reshape(len(flow), -1)
    sent.destroy()
    return total


def _graph_best(edges: DataFrame, flow: np.ndarray, first: int, k: int) -> DataFrame:
    """q, id, score of rows that may be among a query's k best: of each piece those no further behind its k-th than rounding reaches."""
    sent = edges.sparkSession.sparkContext.broadcast(flow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, nodes in zip(b["ids"], b["sizes"], b["nodes"]):
                sizes, nodes = sizes.values.to_numpy(), nodes.values.to_numpy()
                for q, f in enumerate(sent.value):
                    score = np.add.reduceat(f[nodes], np.cumsum(sizes) - sizes)
                    least = np.partition(score, -k)[-k] - 2e-12 if len(score) > k else 0.0
                    at = np.flatnonzero((score > 0) & (score >= least))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + q, np.int32)), ids.values.take(pa.array(at)), pa.array(score[at])], names=["q", "id", "score"])

    return edges.where("ids is not null").select("ids", "sizes", "nodes").mapInArrow(run, "q int, id string, score double")


def _graph_pieces(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[np.ndarray | None, ...]]:
    """Arrays of several rows of `_graph_edges` of one kind at once, some `most` edges together."""
    waiting: dict[bool, list] = {False: [], True: []}
    for b in batches:
        for row in zip(*b.columns):
            piece = [None if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in row]
            held = waiting[piece[3] is not None]
            held.append(piece)
            if sum(len(p[1]) for p in held) >= most:
                yield tuple(None if x[0] is None else np.concatenate(x) for x in zip(*held))
                held.clear()
    for held in waiting.values():
        if held:
            yield tuple(None if x[0] is None else np.concatenate(x) for x in zip(*held))


def _graph_keys(df: DataFrame) -> Column:
    """The nodes of a row, each once: terms (t...) and entities (e...)."""
    def marked(c: str, mark: str) -> Column:
        return F.coalesce(F.transform(F.array_distinct(c), lambda x: F.concat(F.lit(mark), x)), F.array().cast("array<string>"))

    return F.concat(*[marked(c, mark) for c, mark in (("terms", "t"), ("entities", "e")) if c in df.columns])


def _graph_nodes(df: DataFrame, ident: str) -> DataFrame:
    """ident, node: each node of each row once."""
    return df.select(ident, F.explode(_graph_keys(df)).alias("node"))
