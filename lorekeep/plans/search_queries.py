"""Composed searches and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import overlap, words
from lorekeep.operators import retrieval as V
from lorekeep.plans.memory_queries import NOW, VALID_SQL, _valid, rrf_hybrid
from lorekeep.plans.memory_queries import SQL as MEMORY_SQL
from lorekeep.sources.tables import canonical_uuid, table

SQL: dict[str, str] = {}


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Two lexical lists (texts and titles; no vector and no graph list) fused, scored with importance and age, the 20 best of each item (score, newest, id)."""
    fused = rrf_hybrid(spark, folder)
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "updated_at", "author")
    score = V.combined_score(F.col("score"), F.lit("document"), F.coalesce("updated_at", F.expr(f"TIMESTAMP_NTZ '{NOW}'")), F.expr(f"TIMESTAMP_NTZ '{NOW}'"), 1.0)
    rows = fused.join(d, "id").select("qid", "id", F.round(score, 5).alias("score"), "updated_at")
    return V.top_k(rows, "qid", [F.desc("score"), F.desc_nulls_last("updated_at"), F.asc("id")], 20).select("qid", "id", "score", "rank")


SQL["hybrid_search"] = f"WITH x AS ({MEMORY_SQL['rrf_hybrid']}), s AS (SELECT qid, id, round((0.7 * score + 0.3 * 0.8) * exp(-1.0 * greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(updated_at, TIMESTAMP '{NOW}'))) / 86400000000)) / 365.0), 5) AS score, updated_at FROM x JOIN documents ON doc_id = id) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, updated_at DESC NULLS LAST, id) - 1 AS rank FROM s QUALIFY rank < 20"


def hybrid_signals(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 and vectors over documents fused, weighed and cut at 20, with each result's signals.

    A document's vector is the embedding of its number, an item's likewise; items are those whose id is divisible by 50.
    """
    e = table(spark, folder, "embeddings").groupBy(F.col("vec_id").cast("bigint").alias("id")).agg(F.first("embedding").alias("vector"))
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("document").alias("kind"), F.col("updated_at").alias("at"), F.expr(f"TIMESTAMP_NTZ '{NOW}'").alias("now"))
    q = table(spark, folder, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), "text")
    return V.hybrid(d.join(e, "id", "left"), q.join(e.withColumnRenamed("id", "qid"), "qid", "left")).drop("relevance")


def _hybrid_sql() -> str:
    lexical = MEMORY_SQL["bm25_topk"].replace("rank < 20", "rank < 50")
    cosine = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"
    return f"""WITH lx AS (SELECT qid, id, rank FROM ({lexical}) l), nr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) - 1 rank FROM (SELECT q.vec_id qid, e.vec_id id, {cosine} s FROM embeddings q JOIN eval_items ON item_id = q.vec_id AND item_id % 50 = 0, embeddings e JOIN documents ON doc_id = e.vec_id) QUALIFY rank < 50),
ev AS (SELECT 1 k, * FROM nr UNION ALL SELECT 2, * FROM lx), tx AS (SELECT doc_id id, min(text) t FROM documents GROUP BY 1),
ch AS (SELECT k, qid, id, rank, CASE WHEN rank = 0 OR t IS DISTINCT FROM lag(t) OVER (PARTITION BY k, qid ORDER BY rank) THEN rank END st FROM ev LEFT JOIN tx USING (id)), sh AS (SELECT k, qid, id, rank, max(st) OVER (PARTITION BY k, qid ORDER BY rank) rk FROM ch),
fu AS (SELECT qid, id, min(rank) FILTER (WHERE k = 1) vector_rank, min(rank) FILTER (WHERE k = 2) lexical_rank, sum(1.0 / (61.0 + rk)) s FROM sh GROUP BY ALL), us AS (SELECT qid, 1 + max(CASE WHEN k = 2 THEN 1 ELSE 0 END) n FROM ev GROUP BY qid),
si AS (SELECT fu.*, n, {cosine} similarity, round(s / (n / 61.0), 6) fused FROM fu JOIN us USING (qid) LEFT JOIN embeddings q ON q.vec_id = qid LEFT JOIN embeddings e ON e.vec_id = id),
sc AS (SELECT si.*, updated_at, round((0.7 * CASE WHEN n > 1 THEN fused ELSE coalesce(similarity, 0) END + 0.3 * 0.8) * exp(-1.0 * greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(updated_at, TIMESTAMP '{NOW}'))) / 86400000000)) / 365.0), 5) score FROM si JOIN documents ON doc_id = id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, updated_at DESC NULLS LAST, id) - 1 AS rank, vector_rank, lexical_rank, similarity, fused FROM sc QUALIFY rank < 20"""


SQL["hybrid_signals"] = _hybrid_sql()


def related_content(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of other labels among the 20 nearest, for every vector whose id is divisible by 50."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("vector"), "label")
    near = V.nearest(e.select("id", "vector"), e.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), 20)
    other = near.join(e.select("id", "label"), "id").join(e.select(F.col("id").alias("qid"), F.col("label").alias("own")), "qid").where("label <> own")
    return V.top_k(other.select("qid", "id", "similarity"), "qid", [F.desc("similarity"), F.asc("id")], 10)


SQL["related_content"] = "WITH n AS (SELECT q.vec_id qid, e.vec_id id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) similarity, q.label own, e.label FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id) <= 20) SELECT qid, id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) - 1 AS rank FROM n WHERE own <> label QUALIFY rank < 10"


def index_filter(spark: SparkSession, folder: str) -> DataFrame:
    """D12, SC6: messages of a half year with an author, as index entries, by author."""
    m = table(spark, folder, "messages").select("session_id", "turn_id", "timestamp", F.create_map(F.lit("author"), F.col("author")).alias("metadata"))
    inside = F.col("timestamp").between(F.expr("TIMESTAMP_NTZ '2025-07-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2025-12-31 23:59:59'"))
    return m.where(inside & F.col("metadata")["author"].isNotNull()).groupBy(F.col("metadata")["author"].alias("author")).agg(F.count("*").alias("entries"), F.countDistinct("session_id").alias("sessions"))


SQL["index_filter"] = "SELECT author, count(*) AS entries, count(DISTINCT session_id) AS sessions FROM messages WHERE author IS NOT NULL AND timestamp BETWEEN TIMESTAMP '2025-07-01' AND TIMESTAMP '2025-12-31 23:59:59' GROUP BY 1"


def multi_get(spark: SparkSession, folder: str) -> DataFrame:
    """SC1, SC2: documents that messages' sessions share a workspace with, looked up by key."""
    keys = table(spark, folder, "sessions").where("workspace_id is not null").select("workspace_id").distinct()
    return table(spark, folder, "documents").join(keys, "workspace_id", "left_semi").select("doc_id", "workspace_id")


SQL["multi_get"] = "SELECT doc_id, workspace_id FROM documents WHERE workspace_id IN (SELECT workspace_id FROM sessions WHERE workspace_id IS NOT NULL)"


def document_history(spark: SparkSession, folder: str) -> DataFrame:
    """SC9: deliveries of each record as its versions, in the order of arrival."""
    r = table(spark, folder, "records").select(canonical_uuid(F.col("id")).alias("id"), "ingested_at", F.col("content.title").alias("title")).where("id is not null").distinct()
    return r.withColumn("version", F.row_number().over(Window.partitionBy("id").orderBy("ingested_at", F.asc_nulls_first("title"))).cast("bigint"))


SQL["document_history"] = r"WITH r AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(id),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') h, ingested_at, content.title AS title FROM records) SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS id, ingested_at, title, row_number() OVER (PARTITION BY h ORDER BY ingested_at, title NULLS FIRST) AS version FROM r WHERE regexp_full_match(h,'[0-9a-f]{32}')"


def word_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of each document's title with its text."""
    d = table(spark, folder, "documents").where("title is not null and text is not null")
    return d.select("doc_id", F.round(overlap(words(F.col("title")), words(F.col("text"))), 6).alias("overlap"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3))"
SQL["word_overlaps"] = f"WITH d AS (SELECT doc_id, {_WORDS.format('title')} a, {_WORDS.format('text')} b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL) SELECT doc_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS overlap FROM d"


def structured_context(spark: SparkSession, folder: str) -> DataFrame:
    """Current records of each session by the list they belong to."""
    r, v = _valid(spark, folder)
    kinds = {"decision_made": "decisions", "qa": "questions", "concept_defined": "concepts", "requirement_added": "specs"}
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("update_type")), F.lit("flow"))
    return r.join(v.where("valid_to is null").select("id"), "id", "left_semi").groupBy("session_id", name.alias("list")).agg(F.count("*").alias("items"))


SQL["structured_context"] = VALID_SQL + " SELECT session_id, CASE update_type WHEN 'decision_made' THEN 'decisions' WHEN 'qa' THEN 'questions' WHEN 'concept_defined' THEN 'concepts' WHEN 'requirement_added' THEN 'specs' ELSE 'flow' END AS list, count(*) AS items FROM rec JOIN val USING (id) WHERE valid_to IS NULL GROUP BY ALL"

QUERIES = {f.__name__: f for f in (hybrid_search, hybrid_signals, related_content, index_filter, multi_get, document_history, word_overlaps, structured_context)}
