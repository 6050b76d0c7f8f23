"""Queries of retrieval and of records over time, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import redact, text
from lorekeep.operators import retrieval as V
from lorekeep.operators import temporal as P
from lorekeep.sources.scratch import materialise
from lorekeep.sources.tables import table

SQL: dict[str, str] = {}
NOW = "2026-06-30 00:00:00"
_NOW = f"TIMESTAMP_NTZ '{NOW}'"

# SQL that several oracles begin with: records once each, their mentions with canonical entities, validity.
RECORDS_SQL = r"""WITH raw AS (SELECT *, regexp_replace(regexp_replace(lower(id),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') h FROM records),
rec AS (SELECT * REPLACE (substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS id, CASE update_type WHEN 'QuestionAnswered' THEN 'qa' WHEN 'ProblemSolved' THEN 'problem_solved' WHEN 'CodeChanged' THEN 'code_change' WHEN 'DecisionMade' THEN 'decision_made' WHEN 'ConceptDefined' THEN 'concept_defined' WHEN 'RequirementAdded' THEN 'requirement_added' ELSE update_type END AS update_type)
FROM raw WHERE regexp_full_match(h,'[0-9a-f]{32}') QUALIFY row_number() OVER (PARTITION BY h ORDER BY ingested_at DESC) = 1)"""
KEY_SQL = r"CASE WHEN regexp_replace(lower({0}),'[\s\-_]','','g') = '' THEN lower({0}) ELSE regexp_replace(lower({0}),'[\s\-_]','','g') END"
GRAPH_SQL = RECORDS_SQL + f""",
al AS (SELECT k, min(name) AS of FROM (SELECT name, {KEY_SQL.format('a')} k FROM (SELECT name, unnest(aliases) a FROM entities WHERE name IS NOT NULL)) GROUP BY k),
ment AS (SELECT DISTINCT id, n FROM (SELECT id, unnest(list_concat(list_transform(coalesce(typed_entities,[]), lambda e: e.name), coalesce(creates_entities,[]), coalesce(references_entities,[]), list_transform(coalesce(creates_relationships,[]), lambda e: e.from_entity), list_transform(coalesce(creates_relationships,[]), lambda e: e.to_entity))) n FROM rec) WHERE n <> ''),
names AS (SELECT n, CASE WHEN n IN (SELECT name FROM entities WHERE name IS NOT NULL) THEN n ELSE coalesce(al.of, n) END c FROM (SELECT DISTINCT n FROM ment) m LEFT JOIN al ON al.k = {KEY_SQL.format('n')}),
rel AS (SELECT id, ts, x.from_entity f, x.to_entity t, x.relation_type rt, x.context ctx FROM (SELECT id, timestamp ts, unnest(creates_relationships) x FROM rec) WHERE x.from_entity IS NOT NULL AND x.to_entity IS NOT NULL)"""
_WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3))"
_OVER_SQL = "coalesce(len(list_intersect({0},{1})) / nullif(len(list_distinct(list_concat({0},{1}))), 0), 0)"
VALID_SQL = GRAPH_SQL + rf""",
st AS (SELECT id, timestamp ts, coalesce(meta.valid_from, timestamp) vf, meta.retired_at ra FROM rec),
sup0 AS (SELECT id AS by_id, timestamp ts, regexp_replace(regexp_replace(lower(unnest(meta.supersedes)),'^[\s{{]*(urn:uuid:)?[\s{{]*',''),'[\s}}\-]+','','g') s FROM rec),
sup AS (SELECT rec.id, sup0.ts, by_id, 1 br, 'superseded' reason FROM sup0 JOIN rec ON rec.h = sup0.s WHERE rec.id <> by_id),
pr AS (SELECT rel.id, ts, rt, least({KEY_SQL.format('a.c')}, {KEY_SQL.format('b.c')}) x, greatest({KEY_SQL.format('a.c')}, {KEY_SQL.format('b.c')}) y FROM rel JOIN names a ON a.n = f JOIN names b ON b.n = t),
con AS (SELECT o.id, w.ts, w.id by_id, 2 br, 'contradicted' reason FROM pr o JOIN pr w ON o.x = w.x AND o.y = w.y AND o.rt <> 'conflicts_with' AND w.rt = 'conflicts_with' AND (w.ts, w.id) > (o.ts, o.id)),
sub AS (SELECT id, list_sort(list(DISTINCT {KEY_SQL.format('c')})) s FROM ment JOIN names USING (n) GROUP BY id),
so AS (SELECT rec.id, timestamp ts, update_type k, s, {_WORDS_SQL.format("coalesce(content.title,'')")} tw, {_WORDS_SQL.format("coalesce(content.title,'')||' '||coalesce(content.description,'')")} aw FROM rec JOIN sub USING (id) WHERE update_type IN ('decision_made','requirement_added','concept_defined')),
res AS (SELECT o.id, w.ts, w.id by_id, 3 br, CASE WHEN {_OVER_SQL.format('o.aw','w.aw')} >= 0.8 THEN 'duplicate' ELSE 'restated' END reason FROM so o JOIN so w ON o.k = w.k AND o.s = w.s AND (w.ts, w.id) > (o.ts, o.id) AND {_OVER_SQL.format('o.tw','w.tw')} >= 0.5),
en AS (SELECT * FROM (SELECT * FROM sup UNION ALL SELECT * FROM con UNION ALL SELECT * FROM res) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, by_id, br) = 1),
v0 AS (SELECT st.id, st.vf, st.ra, en.by_id, en.reason, CASE WHEN en.by_id IS NOT NULL THEN greatest(b.vf, st.vf) END e FROM st LEFT JOIN en ON st.id = en.id LEFT JOIN st b ON b.id = en.by_id),
val AS (SELECT id, vf AS valid_from, CASE WHEN ra IS NOT NULL AND (e IS NULL OR ra < e) THEN greatest(ra, vf) ELSE e END AS valid_to, CASE WHEN ra IS NOT NULL AND (e IS NULL OR ra < e) THEN NULL ELSE by_id END AS ended_by, CASE WHEN ra IS NOT NULL AND (e IS NULL OR ra < e) THEN 'forgotten' ELSE reason END AS reason FROM v0)"""


def records_of(spark: SparkSession, folder: str) -> DataFrame:
    return P.clean_records(table(spark, folder, "records"))


def _valid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    r = materialise(records_of(spark, folder))
    return r, P.validity(r, table(spark, folder, "entities"))


def validity_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """When each record held, what ended it and why."""
    return _valid(spark, folder)[1]


SQL["validity_intervals"] = VALID_SQL + " SELECT * FROM val"


def as_of_state(spark: SparkSession, folder: str) -> DataFrame:
    """Records that held at the start of 2026, by session and kind."""
    r, v = _valid(spark, folder)
    held = v.where(P.holds_at(F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"))).select("id")
    return r.join(held, "id", "left_semi").groupBy("session_id", "update_type").agg(F.count("*").alias("records"))


SQL["as_of_state"] = VALID_SQL + " SELECT session_id, update_type, count(*) AS records FROM rec JOIN val USING (id) WHERE valid_from <= TIMESTAMP '2026-01-01' AND (valid_to IS NULL OR TIMESTAMP '2026-01-01' < valid_to) GROUP BY ALL"


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """The latest 500 events of records of 2025, a top-k report; `graph_timeline` has those of relations as well."""
    _, v = _valid(spark, folder)
    return P.timeline(v, F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2025-12-31 23:59:59'"), 500)


SQL["timeline"] = VALID_SQL + " SELECT x AS \"at\", event, id FROM (SELECT valid_from AS x, 'recorded' AS event, id FROM val UNION ALL SELECT valid_to, 'ended', id FROM val WHERE valid_to IS NOT NULL) WHERE x BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-12-31 23:59:59' ORDER BY x DESC, event DESC, id DESC LIMIT 500"


def graph_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """The latest 500 events of records and relations of 2025."""
    r, v = _valid(spark, folder)
    return P.graph_timeline(r, materialise(v), table(spark, folder, "entities"), F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2025-12-31 23:59:59'"), 500)


SQL["graph_timeline"] = VALID_SQL + """, er AS (SELECT a.c src, b.c dst, rt AS type, arg_min(rel.id, {'t': rel.ts, 'i': rel.id}) f1, arg_max(rel.id, {'t': rel.ts, 'i': rel.id}) l1, min(valid_from) s, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END e FROM rel JOIN val ON val.id = rel.id JOIN names a ON a.n = f JOIN names b ON b.n = t GROUP BY ALL),
ev AS (SELECT timestamp x, 2 n, id, NULL src, NULL dst, NULL AS type FROM rec UNION ALL SELECT valid_to, 0, id, NULL, NULL, NULL FROM val UNION ALL SELECT s, 3, f1, src, dst, type FROM er UNION ALL SELECT e, 1, l1, src, dst, type FROM er),
w AS (SELECT *, count(*) OVER () total FROM ev WHERE x BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-12-31 23:59:59' ORDER BY x DESC, n DESC, id DESC, src DESC NULLS LAST, dst DESC NULLS LAST, type DESC NULLS LAST LIMIT 500)
SELECT x AS "at", ['ended','relation_ended','recorded','relation_added'][n + 1] AS event, w.id, src, dst, type, session_id, update_type, content.title AS title, CASE WHEN n < 2 THEN reason END AS reason, total FROM w JOIN rec ON rec.id = w.id LEFT JOIN val ON val.id = w.id"""


def edge_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Since when and until when each relation holds."""
    r, v = _valid(spark, folder)
    return P.edge_validity(r, v)


SQL["edge_validity"] = VALID_SQL + """ SELECT f AS src, t AS dst, rt AS type, min(valid_from) AS start, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS "end", count(DISTINCT id) AS records FROM rel JOIN val USING (id) GROUP BY ALL"""


def browse_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of current decisions that mention a lease, after a cursor."""
    r, v = _valid(spark, folder)
    found = P.browse(r, v, kinds=["decision_made", "requirement_added"], text="lease", state="current")
    return P.page(found.select("id", "timestamp", F.col("content.title").alias("title")), "timestamp", "id", (datetime(2026, 4, 1), "f"), 50)


SQL["browse_page"] = VALID_SQL + " SELECT id, timestamp, content.title AS title FROM rec JOIN val USING (id) WHERE update_type IN ('decision_made','requirement_added') AND valid_to IS NULL AND (contains(lower(content.title),'lease') OR contains(lower(content.description),'lease') OR len(list_filter(content.details, lambda d: contains(lower(d),'lease'))) > 0) AND (timestamp < TIMESTAMP '2026-04-01' OR (timestamp = TIMESTAMP '2026-04-01' AND id < 'f')) ORDER BY timestamp DESC, id DESC LIMIT 51"


def overview(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over all records."""
    r, v = _valid(spark, folder)
    return P.overview(r, v, F.expr(_NOW))


SQL["overview"] = VALID_SQL + f" SELECT count(*) AS records, count(*) FILTER (WHERE timestamp > TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS day, count(*) FILTER (WHERE timestamp > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE valid_to IS NULL) AS current, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id) FILTER (WHERE timestamp > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS active FROM rec JOIN val USING (id)"


def message_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A5: streams of messages by session."""
    return P.message_stats(table(spark, folder, "messages"))


SQL["message_stats"] = "SELECT session_id, count(*) AS messages, min(seq) AS first_seq, max(seq) AS last_seq, min(timestamp) AS first_at, max(timestamp) AS last_at, coalesce(array_to_string(list_sort(list(DISTINCT author) FILTER (WHERE author IS NOT NULL)), ','), '') AS authors FROM messages GROUP BY session_id"


def file_touches(spark: SparkSession, folder: str) -> DataFrame:
    """How often, when and by what kind of record each file was last touched."""
    return P.file_touches(records_of(spark, folder))


SQL["file_touches"] = RECORDS_SQL + " SELECT related_code.file_path AS path, count(*) AS touches, max(timestamp) AS last_at, arg_max(update_type, {'t': timestamp, 'i': id}) AS last_kind FROM rec WHERE related_code.file_path <> '' GROUP BY 1"


def session_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Records, first and last time and whole minutes between, of each session with its name."""
    s = table(spark, folder, "sessions").groupBy("session_id").agg(F.max_by("name", F.struct("last_updated", "name")).alias("name"))
    r = records_of(spark, folder).groupBy("session_id").agg(F.count("*").alias("records"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    return r.join(s, "session_id", "left").withColumn("minutes", F.floor((F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 60_000_000))


SQL["session_statistics"] = RECORDS_SQL + ", s AS (SELECT session_id, arg_max(name, {'t': last_updated, 'n': name}) AS name FROM sessions WHERE name IS NOT NULL OR true GROUP BY 1) SELECT session_id, records, first_at, last_at, name, CAST(floor((epoch_us(last_at) - epoch_us(first_at)) / 60000000) AS BIGINT) AS minutes FROM (SELECT session_id, count(*) AS records, min(timestamp) AS first_at, max(timestamp) AS last_at FROM rec GROUP BY 1) LEFT JOIN s USING (session_id)"


def latest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """SC8, W7: the latest document of each workspace and kind, by time, then id."""
    d = table(spark, folder, "documents").where("workspace_id is not null and kind is not null")
    return d.groupBy("workspace_id", "kind").agg(F.max_by("doc_id", F.struct("updated_at", "doc_id")).alias("doc_id"), F.max("updated_at").alias("updated_at"))


SQL["latest_documents"] = "SELECT workspace_id, kind, doc_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, kind ORDER BY updated_at DESC NULLS LAST, doc_id DESC) rn FROM documents WHERE workspace_id IS NOT NULL AND kind IS NOT NULL) WHERE rn = 1"


def _item_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").where("item_id % 50 = 0 and text is not null").select(F.col("item_id").alias("qid"), "text")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of each item whose id is divisible by 50."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.bm25(docs, _item_queries(spark, folder), 20)


_TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '^\\P{{{{L}}}}*[{p.replace('{', '{{').replace('}', '}}')}]') THEN '{n}'" for n, p in text.SCRIPTS.items()) + " ELSE 'other' END"


def _bm25_sql(docs: str, queries: str, k: int, name: str) -> str:
    return f"""d AS (SELECT id, {_TOK.format('text')} w FROM ({docs}) WHERE text IS NOT NULL), q AS (SELECT DISTINCT qid, unnest({_TOK.format('text')}) term FROM ({queries})),
s AS (SELECT count(*) n, avg(len(w)) al FROM d), p AS (SELECT id, term, count(*) tf, any_value(l) l FROM (SELECT id, len(w) l, unnest(w) term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
wr AS (SELECT sc, count(*) docs FROM (SELECT DISTINCT id, {_SCRIPT.format('t')} sc FROM (SELECT DISTINCT id, unnest(w) t FROM d)) GROUP BY sc),
u AS (SELECT term, df, n, al FROM (SELECT term, count(*) df, {_SCRIPT.format('term')} sc FROM p GROUP BY term) f, s WHERE df <= greatest(floor(0.2 * coalesce(CASE WHEN f.sc <> 'other' THEN (SELECT docs FROM wr WHERE wr.sc = f.sc) END, n)), 10)),
r AS (SELECT qid, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) score FROM p JOIN u USING (term) JOIN q USING (term) GROUP BY qid, id),
{name} AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM r QUALIFY rank < {k})"""


SQL["bm25_topk"] = "WITH " + _bm25_sql("SELECT doc_id id, text FROM documents", "SELECT item_id qid, text FROM eval_items WHERE item_id % 50 = 0", 20, "o") + " SELECT * FROM o"


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("vector"))
    return V.nearest(e, e.where("id % 50 = 0").withColumnRenamed("id", "qid"), 10)


SQL["vector_topk"] = "SELECT qid, id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) - 1 AS rank FROM (SELECT q.vec_id qid, e.vec_id id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) similarity FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) QUALIFY rank < 10"


def _lexical_lists(spark: SparkSession, folder: str) -> list[DataFrame]:
    docs = table(spark, folder, "documents")
    return [V.bm25(docs.select(F.col("doc_id").alias("id"), F.col(c).alias("text")), _item_queries(spark, folder), 50) for c in ("text", "title")]


def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and titles ranked by BM25 and fused by position; `rrf_shared` lets copies share a rank."""
    return V.fuse(_lexical_lists(spark, folder))


SQL["rrf_hybrid"] = "WITH " + _bm25_sql("SELECT doc_id id, text FROM documents", "SELECT item_id qid, text FROM eval_items WHERE item_id % 50 = 0", 50, "o1") + ", " + _bm25_sql("SELECT doc_id id, title AS text FROM documents", "SELECT item_id qid, text FROM eval_items WHERE item_id % 50 = 0", 50, "o2").replace("d AS (", "d2 AS (").replace("FROM d)", "FROM d2)").replace(" q AS (", " q2 AS (").replace("FROM q)", "FROM q2)").replace("JOIN q USING", "JOIN q2 USING").replace("\ns AS (", "\ns2 AS (").replace("FROM d),", "FROM d2),").replace(" p AS (", " p2 AS (").replace("FROM p ", "FROM p2 ").replace("\nwr AS", "\nwr2 AS").replace("FROM wr WHERE wr.sc", "FROM wr2 WHERE wr2.sc").replace("\nu AS", "\nu2 AS").replace("JOIN u USING", "JOIN u2 USING").replace(") f, s WHERE", ") f, s2 WHERE").replace("\nr AS", "\nr2 AS").replace("FROM r QUALIFY", "FROM r2 QUALIFY") + " SELECT qid, id, round(sum(1.0 / (61.0 + rank)) / (2 / 61.0), 6) AS score FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) GROUP BY qid, id"


def rrf_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and titles ranked by BM25 and fused; equal neighbours share a rank."""
    return V.fuse_texts(_lexical_lists(spark, folder), table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


SQL["rrf_shared"] = SQL["rrf_hybrid"][: SQL["rrf_hybrid"].rindex(" SELECT qid, id, round(sum(")] + """, tx AS (SELECT doc_id id, min(text) t FROM documents GROUP BY 1), ls AS (SELECT 1 k, qid, id, rank FROM o1 UNION ALL SELECT 2, qid, id, rank FROM o2),
ch AS (SELECT k, qid, id, rank, CASE WHEN rank = 0 OR t IS DISTINCT FROM lag(t) OVER (PARTITION BY k, qid ORDER BY rank) THEN rank END st FROM ls LEFT JOIN tx USING (id)), sh AS (SELECT qid, id, max(st) OVER (PARTITION BY k, qid ORDER BY rank) rk FROM ch)
SELECT qid, id, round(sum(1.0 / (61.0 + rk)) / (2 / 61.0), 6) AS score FROM sh GROUP BY qid, id"""


def combined_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance and importance of documents, faded by age, with a boost for an author."""
    d = table(spark, folder, "documents").where("updated_at is not null")
    score = V.combined_score(F.lit(0.5), F.lit("document"), F.col("updated_at"), F.expr(_NOW), 2.0, F.col("author"), "agent-osier")
    return d.select("doc_id", F.round(score, 6).alias("score"))


SQL["combined_scores"] = f"SELECT doc_id, round((0.7 * 0.5 + 0.3 * 0.8) * exp(-2.0 * greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000)) / 365.0) + CASE WHEN author = 'agent-osier' THEN 0.05 ELSE 0 END, 6) AS score FROM documents WHERE updated_at IS NOT NULL"


def neighbour_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that mention a lease, with those beside them in their session."""
    m = table(spark, folder, "messages").groupBy("session_id", "turn_id").agg(F.min("seq").alias("seq"), F.min_by("text", "seq").alias("text"))
    rows = m.select(F.col("session_id").alias("grp"), F.col("seq").alias("pos"), "text")
    hits = rows.where(F.lower("text").contains("lease")).select("grp", "pos", F.char_length("text").cast("double").alias("score"))
    return V.neighbours(rows, hits, 1)


SQL["neighbour_messages"] = "WITH m AS (SELECT session_id grp, min(seq) pos, arg_min(text, seq) t FROM messages GROUP BY session_id, turn_id), h AS (SELECT grp, pos, CAST(length(t) AS DOUBLE) score FROM m WHERE contains(lower(t), 'lease')) SELECT m.grp, m.pos, h.score, CASE WHEN h.pos <> m.pos THEN h.pos END AS neighbour_of FROM m JOIN h ON m.grp = h.grp AND abs(m.pos - h.pos) <= 1 QUALIFY row_number() OVER (PARTITION BY m.grp, m.pos ORDER BY (h.pos = m.pos) DESC, h.score DESC, h.pos) = 1"


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """windows of all documents."""
    return text.chunks(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def best_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document's windows the one with the most distinct words, as the document's result."""
    c = text.chunks(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", 200, 40)
    rows = c.select(F.lit("documents").alias("source"), F.col("chunk_id").alias("content_id"), F.size(text.words(F.col("chunk"))).alias("score"), (-F.col("n")).alias("at"))
    return V.best_of_source(rows).select("content_id", "score", (-F.col("at")).alias("chunk"))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """what a search for its title shows of each document."""
    d = table(spark, folder, "documents").select("doc_id", "text", "title")
    return text.passages(d, "text", "title", 240).select("doc_id", "passage")


def packed_context(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 results packed by a budget of estimated tokens, skipping what does not fit."""
    docs = table(spark, folder, "documents")
    best = V.bm25(docs.select(F.col("doc_id").alias("id"), "text"), _item_queries(spark, folder), 50)
    costs = docs.select(F.col("doc_id").alias("id"), text.estimated_tokens(F.col("text")).alias("cost"))
    return V.packed(best.join(costs, "id").select("qid", F.col("rank").cast("bigint").alias("pos"), "id", "cost"), 2000)


def redacted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of documents and messages of what redaction leaves, by kind found."""
    d = table(spark, folder, "documents").select("doc_id", redact.redacted(F.col("text")).alias("t"))
    return d.select("doc_id", F.char_length("t").cast("bigint").alias("chars"), F.to_json(redact.redaction_counts(F.col("t"))).alias("found"))


def text_keys(spark: SparkSession, folder: str) -> DataFrame:
    """entity keys, slugs and estimates of names."""
    e = table(spark, folder, "entities").where("name is not null")
    return e.select("name", text.entity_key(F.col("name")).alias("key"), text.slug(F.col("name")).alias("slug"), text.estimated_tokens(F.col("name")).alias("tokens"))


SQL["text_keys"] = f"SELECT name, {KEY_SQL.format('name')} AS key, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CAST(ceil(octet_length(encode(name)) / 4.0) AS BIGINT) AS tokens FROM entities WHERE name IS NOT NULL"


def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Of each word, in how many documents and how often."""
    return V.postings(table(spark, folder, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


SQL["token_stats"] = f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest({_TOK.format('text')}) term FROM documents) GROUP BY term"


def named_paths(spark: SparkSession, folder: str) -> DataFrame:
    """files that documents name, with the number of documents."""
    d = text.with_paths(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.explode(F.array_distinct("paths")).alias("path")).groupBy("path").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (validity_intervals, as_of_state, timeline, graph_timeline, edge_validity, browse_page, overview, message_stats, file_touches, session_statistics, latest_documents, bm25_topk, vector_topk, rrf_hybrid, rrf_shared, combined_scores, neighbour_messages, document_chunks, best_chunks, passages, packed_context, redacted_documents, text_keys, token_stats, named_paths)}
