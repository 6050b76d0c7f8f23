"""Queries that find entities in texts, list and page, check boards and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import redact, text
from lorekeep.operators import boards, graph, listing, lists, matching
from lorekeep.operators.ordering import numbered
from lorekeep.plans.graph_queries import EDGES_SQL
from lorekeep.plans.memory_queries import SQL as MEMORY_SQL
from lorekeep.plans.memory_queries import records_of, vector_topk
from lorekeep.sources.scratch import materialise
from lorekeep.sources.tables import canonical_uuid, table

SQL: dict[str, str] = {}
_ASKED = "item_id % 50 = 0 and text is not null"


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").where(_ASKED).select("item_id", "text")


def entities_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    """entities that the items whose id is divisible by 50 name: by the name itself, else by enough parts of it."""
    return matching.entities_in(_asked(spark, folder), "item_id", "text", table(spark, folder, "entities").select("name"))


_CUT = r"regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[\s_\-/.]+')"
_IN_SQL = rf"""q AS (SELECT item_id, lower(text) t, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: strlen(w) >= 3) ws FROM eval_items WHERE {_ASKED}),
n AS (SELECT name, lower(name) l, list_filter({_CUT}, lambda w: w <> '') k FROM (SELECT DISTINCT name FROM entities WHERE strlen(name) >= 2)),
m AS (SELECT item_id, name, contains(t, l) whole, strlen(l) b, len(k) parts, len(list_filter(k, lambda p: strlen(p) >= 3 AND len(list_filter(ws, lambda w: starts_with(w, p) OR starts_with(p, w))) > 0)) hit FROM q, n),
found AS (SELECT item_id, name, whole AS in_text, CAST(CASE WHEN whole THEN 10 * b ELSE 5 * hit + b END AS BIGINT) AS score FROM m WHERE whole OR (hit > 0 AND hit >= CASE WHEN parts <= 2 THEN parts ELSE greatest(1, (2 * parts + 4) // 5) END))"""
SQL["entities_in_texts"] = f"WITH {_IN_SQL} SELECT item_id, name, in_text, score FROM found"


def query_context(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that the items whose id is divisible by 50 name, their neighbours, and what a change of the named ones reaches in three hops."""
    r, e = materialise(records_of(spark, folder)), table(spark, folder, "entities")
    edges = materialise(graph.edges_of(r, e))
    return matching.query_context(entities_in_texts(spark, folder), edges, 3)


_STEPS_SQL = "SELECT dst s, src d FROM edge WHERE type IN ('depends_on','implements') UNION SELECT src, dst FROM edge WHERE type = 'required_by'"
SQL["query_context"] = (
    EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1)
    + f""", {_IN_SQL}, st AS ({_STEPS_SQL}), w AS (SELECT item_id, name start, name node, 0 h FROM found UNION SELECT w.item_id, w.start, st.d, h + 1 FROM w JOIN st ON st.s = w.node WHERE h < 3),
nb AS (SELECT item_id, name via, dst other FROM found JOIN edge ON src = name UNION SELECT item_id, name, src FROM found JOIN edge ON dst = name)
SELECT item_id, name AS entity, 'direct' AS relevance, CAST(NULL AS VARCHAR) AS via, 0 AS hops FROM found UNION ALL SELECT item_id, other, 'neighbour', min(via), 1 FROM nb WHERE (item_id, other) NOT IN (SELECT item_id, name FROM found) GROUP BY ALL
UNION ALL SELECT item_id, node, 'impact', arg_min(start, {{'h': h, 's': start}}), CAST(min(h) AS INTEGER) FROM w WHERE h > 0 AND (item_id, node) NOT IN (SELECT item_id, name FROM found) GROUP BY item_id, node"""
)


def similarity_labels(spark: SparkSession, folder: str) -> DataFrame:
    """the labels of the similarities that a vector search gives."""
    return vector_topk(spark, folder).select("qid", "id", text.quality(F.col("similarity")).alias("label"))


SQL["similarity_labels"] = f"SELECT qid, id, CASE WHEN similarity >= 0.85 THEN 'Excellent' WHEN similarity >= 0.7 THEN 'Very Good' WHEN similarity >= 0.55 THEN 'Good' WHEN similarity >= 0.4 THEN 'Moderate' WHEN similarity >= 0.3 THEN 'Fair' ELSE 'Weak' END AS label FROM ({MEMORY_SQL['vector_topk']}) v"


def workspace_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """a slug for each workspace by its name; of equal ones all but the oldest carry six digits of the id."""
    w = table(spark, folder, "workspaces").select("workspace_id", "created_at", F.coalesce(text.slug(F.col("name")), F.lit("workspace")).alias("base"))
    first = w.groupBy("base").agg(F.min(F.struct("created_at", "workspace_id"))["workspace_id"].alias("owner"))
    hexes = F.substring(F.replace(F.lower("workspace_id"), F.lit("-"), F.lit("")), 1, 6)
    return w.join(first, "base").select("workspace_id", F.when(F.col("workspace_id") == F.col("owner"), F.col("base")).otherwise(F.concat("base", F.lit("-"), hexes)).alias("slug"))


SQL["workspace_slugs"] = r"WITH b AS (SELECT workspace_id, created_at, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 1, 48), '-+$', ''), ''), 'workspace') base FROM workspaces) SELECT workspace_id, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY created_at, workspace_id) = 1 THEN base ELSE base || '-' || substr(replace(lower(workspace_id), '-', ''), 1, 6) END AS slug FROM b"


def parsed_times(spark: SparkSession, folder: str) -> DataFrame:
    """times of events written in each accepted form and read back; one form in four is none."""
    e = table(spark, folder, "events").select("event_id", F.date_trunc("second", F.col("ts")).alias("ts"))
    kind = F.pmod("event_id", F.lit(4))
    shown = F.when(kind == 0, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))).when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("yesterday")
    return e.select("event_id", text.parsed_time(shown).alias("at"))


SQL["parsed_times"] = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS at FROM events"


def redacted_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """blocks of messages with their string values redacted: session_id, turn_id, seq, length, places by kind."""
    m = table(spark, folder, "messages").where("blocks is not null").select("session_id", "turn_id", "seq", redact.redacted_json(F.col("blocks")).alias("b"))
    return m.select("session_id", "turn_id", "seq", F.char_length("b").alias("length"), F.to_json(redact.redaction_counts(F.col("b"))).alias("places"))


def task_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Of records with followers how many are done (solved or decided), of those not retired."""
    r = records_of(spark, folder)
    stage = F.when(F.col("meta.retired_at").isNotNull(), "canceled").when(F.col("update_type").isin("problem_solved", "decision_made"), "done").otherwise("open")
    return boards.progress(r.select("id", canonical_uuid(F.col("parent_update")).alias("parent"), stage.alias("stage")))


SQL["task_progress"] = EDGES_SQL + r", c AS (SELECT regexp_replace(regexp_replace(lower(parent_update),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') p, meta.retired_at IS NOT NULL x, update_type IN ('problem_solved','decision_made') d FROM rec) SELECT substr(p,1,8)||'-'||substr(p,9,4)||'-'||substr(p,13,4)||'-'||substr(p,17,4)||'-'||substr(p,21,12) AS id, count(*) FILTER (WHERE d AND NOT x) AS done, count(*) FILTER (WHERE NOT x) AS total FROM c WHERE regexp_full_match(p,'[0-9a-f]{32}') GROUP BY p"


def board_order(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as cards of a board: their place in the column of their kind, by rank (the author here), those without one last."""
    return boards.column_order(table(spark, folder, "documents").select("doc_id", "kind", "author"), "kind", "author", "doc_id").select("doc_id", "kind", "place")


SQL["board_order"] = "SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY coalesce(author, '') = '', author NULLS FIRST, doc_id) AS place FROM documents"


def radar_open(spark: SparkSession, folder: str) -> DataFrame:
    """Problems that nothing solves, without those dismissed (here: of little importance in the store)."""
    r, e = materialise(records_of(spark, folder)), table(spark, folder, "entities")
    found = graph.unsolved(e, graph.edges_of(r, e)).select(F.lit("unsolved").alias("kind"), F.col("name").alias("subject"))
    dismissed = e.where("importance < 0.3").select(F.lit("unsolved").alias("kind"), F.col("name").alias("subject"))
    return graph.open_findings(found, dismissed)


SQL["radar_open"] = EDGES_SQL + " SELECT DISTINCT 'unsolved' AS kind, name AS subject FROM entities WHERE entity_type = 'problem' AND name IS NOT NULL AND name NOT IN (SELECT dst FROM edge WHERE type = 'solves') AND name NOT IN (SELECT name FROM entities WHERE importance < 0.3 AND name IS NOT NULL)"


def document_page(spark: SparkSession, folder: str) -> DataFrame:
    """SC8, T5: a page of 40 documents, newest first, after a cursor: with the total and the cursor of the next page."""
    d = table(spark, folder, "documents").where("kind in ('runbook', 'incident', 'guide') and updated_at is not null").select("doc_id", "kind", "updated_at")
    after = d.where("updated_at >= timestamp_ntz '2025-10-01 00:00:00'").agg(F.min(F.struct("updated_at", "doc_id")).alias("c"))
    at = after.select("c.updated_at", "c.doc_id").first()
    return listing.page(d, [("updated_at", False), ("doc_id", True)], 40, {"updated_at": at[0], "doc_id": at[1]} if at and at[0] else None)


SQL["document_page"] = """WITH d AS (SELECT doc_id, kind, updated_at FROM documents WHERE kind IN ('runbook','incident','guide') AND updated_at IS NOT NULL), c AS (SELECT updated_at u, doc_id i FROM d WHERE updated_at >= TIMESTAMP '2025-10-01' ORDER BY updated_at, doc_id LIMIT 1),
r AS (SELECT d.*, (SELECT count(*) FROM d) total, row_number() OVER (ORDER BY updated_at DESC, doc_id) n, count(*) OVER () k FROM d WHERE NOT EXISTS (SELECT 1 FROM c) OR EXISTS (SELECT 1 FROM c WHERE updated_at < u OR (updated_at = u AND doc_id > i)))
SELECT doc_id, kind, updated_at, total, n = 40 AND k > 40 AS more FROM r WHERE n <= 40"""


def entity_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 most important entities of the store above 0.2, with their number and whether the list is cut."""
    e = table(spark, folder, "entities").where("name is not null").select("name", F.round(F.col("importance").cast("double"), 6).alias("importance"))
    return listing.most_important(e, 0.2, 100)


SQL["entity_listing"] = "WITH e AS (SELECT name, round(CAST(importance AS DOUBLE), 6) importance FROM entities WHERE name IS NOT NULL), k AS (SELECT *, count(*) OVER () total, row_number() OVER (ORDER BY importance DESC, name) place FROM e WHERE importance >= 0.2) SELECT name, importance, place, total, total > 100 AS truncated FROM k WHERE place <= 100"


def entity_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Of each mentioned entity: relations, records, decisions, files and authors."""
    r, e = materialise(records_of(spark, folder)), table(spark, folder, "entities")
    return matching.entity_details(graph.mentions_of(r, e), r, graph.edges_of(r, e))


SQL["entity_detail"] = EDGES_SQL + """, rl AS (SELECT n, count(*) k FROM (SELECT src n, dst, type FROM edge UNION ALL SELECT dst, src, type FROM edge) GROUP BY n)
SELECT entity, coalesce(any_value(k), 0) AS relations, count(DISTINCT men.id) AS records, count(DISTINCT men.id) FILTER (WHERE kind = 'decision_made') AS decisions, count(DISTINCT nullif(related_code.file_path, '')) AS files, count(DISTINCT author) AS authors FROM men JOIN rec ON rec.id = men.id LEFT JOIN rl ON n = entity GROUP BY entity"""


def risk_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each entity that others depend on directly, the decisions and requirements about those, ranked by hop, newest and id."""
    r, e = materialise(records_of(spark, folder)), table(spark, folder, "entities")
    steps = materialise(graph.impact_steps(graph.edges_of(r, e)))
    found = graph.reach(steps.select(F.col("src").alias("start")).distinct(), steps, 1).where("hops > 0")
    return matching.ranked_risks(found, graph.mentions_of(r, e).where(F.col("kind").isin("decision_made", "requirement_added")), 5)


SQL["risk_ranks"] = EDGES_SQL + f", st AS ({_STEPS_SQL}), f AS (SELECT DISTINCT s, d FROM st WHERE s <> d), x AS (SELECT s, men.id, min(d) about, any_value(ts) ts FROM f JOIN men ON entity = d WHERE kind IN ('decision_made','requirement_added') GROUP BY s, men.id) SELECT s AS start, id, about, 1 AS hops, row_number() OVER (PARTITION BY s ORDER BY ts DESC, id) AS place FROM x QUALIFY row_number() OVER (PARTITION BY s ORDER BY ts DESC, id) <= 5"


def checked_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records that keep rules of bytes, items and required fields, and those that break them, counted by rule."""
    r = records_of(spark, folder).select("id", F.col("content.title").alias("title"), F.col("content.details").alias("details"))
    rules = [*lists.constraint("title", required=True, min_bytes=8, max_bytes=60), *lists.constraint("details", max_items=2)]
    valid, invalid = lists.partition_items(r, "id", rules)
    broken = invalid.select("id", F.explode("violations").alias("v")).groupBy(F.concat_ws(".", "v.path", "v.rule").alias("rule")).agg(F.count("*").alias("records"))
    return broken.unionByName(valid.agg(F.lit("valid").alias("rule"), F.count("*").alias("records")))


SQL["checked_records"] = EDGES_SQL + ", c AS (SELECT content.title t, coalesce(len(content.details), -1) n FROM rec), v AS (SELECT t IS NULL a, coalesce(strlen(t) < 8, false) b, coalesce(strlen(t) > 60, false) c, n > 2 d FROM c) SELECT * FROM (SELECT unnest(['title.required','title.min_bytes','title.max_bytes','details.max_items','valid']) AS rule, unnest([count(*) FILTER (WHERE a), count(*) FILTER (WHERE b), count(*) FILTER (WHERE c), count(*) FILTER (WHERE d), count(*) FILTER (WHERE NOT (a OR b OR c OR d))]) AS records FROM v) WHERE records > 0 OR rule = 'valid'"


def set_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with fields set by expressions over the row as it was."""
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    return lists.set_fields(o, {"o_totalprice": "o_totalprice * 2.0", "large": "o_totalprice > 100000.0"})


SQL["set_items"] = "SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DOUBLE) * 2.0 AS o_totalprice, CAST(o_totalprice AS DOUBLE) > 100000.0 AS large FROM orders"

def entity_network(spark: SparkSession, folder: str) -> DataFrame:
    """The network of two hops around the first entity by name that has relations: at most 15 entities and 20 relations."""
    edges = materialise(graph.edges_of(materialise(records_of(spark, folder)), table(spark, folder, "entities")))
    center = edges.agg(F.min("src")).first()[0] or ""  # one name
    return graph.network(center, edges, 2, 15, 20)


SQL["entity_network"] = (
    EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1)
    + """, bo AS (SELECT src s, dst d FROM edge UNION SELECT dst, src FROM edge), w AS (SELECT (SELECT min(src) FROM edge) n, 0 h UNION SELECT d, h + 1 FROM w JOIN bo ON s = n WHERE h < 2), nd AS (SELECT n, min(h) h FROM w WHERE n IS NOT NULL GROUP BY n ORDER BY 2, 1 LIMIT 15),
r AS (SELECT src, dst, type, row_number() OVER (ORDER BY least(a.h, b.h), src, dst, type) AS place FROM edge JOIN nd a ON a.n = src JOIN nd b ON b.n = dst) SELECT * FROM r WHERE place <= 20"""
)


def removed_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Relations when all entities of little importance in the store are removed."""
    e = table(spark, folder, "entities")
    edges = graph.edges_of(materialise(records_of(spark, folder)), e)
    return graph.without(edges, e.where("importance < 0.3")).select("src", "dst", "type")


SQL["removed_entities"] = EDGES_SQL + ", g AS (SELECT name FROM entities WHERE importance < 0.3 AND name IS NOT NULL) SELECT src, dst, type FROM edge WHERE src NOT IN (FROM g) AND dst NOT IN (FROM g)"

QUERIES = {f.__name__: f for f in (entities_in_texts, query_context, similarity_labels, workspace_slugs, parsed_times, redacted_blocks, task_progress, board_order, radar_open, document_page, entity_listing, entity_detail, risk_ranks, checked_records, set_items, entity_network, removed_entities)}
