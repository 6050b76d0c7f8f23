"""Reports and checks over records, sessions and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import boards, graph, retrieval, temporal
from lorekeep.plans import expressions as X
from lorekeep.plans.graph_queries import EDGES_SQL
from lorekeep.plans.memory_queries import KEY_SQL, NOW, RECORDS_SQL, VALID_SQL, records_of
from lorekeep.sources.scratch import materialise
from lorekeep.sources.tables import canonical_uuid, table

SQL: dict[str, str] = {}


def list_records(spark: SparkSession, folder: str) -> DataFrame:
    """SC7: of each session the first 50 decisions and requirements after a time, with the total before the limit."""
    r = records_of(spark, folder).where((F.col("timestamp") > F.expr("TIMESTAMP_NTZ '2025-06-01 00:00:00'")) & F.col("update_type").isin("decision_made", "requirement_added"))
    w = Window.partitionBy("session_id")
    rows = r.select("session_id", "id", "timestamp").withColumn("n", F.row_number().over(w.orderBy("timestamp", "id")))
    total = r.groupBy("session_id").agg(F.count("*").alias("total"))
    return rows.where("n <= 50").join(total, "session_id").select("session_id", "id", "total")


SQL["list_records"] = RECORDS_SQL + " SELECT session_id, id, count(*) OVER (PARTITION BY session_id) AS total FROM rec WHERE timestamp > TIMESTAMP '2025-06-01' AND update_type IN ('decision_made','requirement_added') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) <= 50"


def reference_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Records that supersede records which do not exist."""
    r = records_of(spark, folder)
    named = r.select("id", F.explode("meta.supersedes").alias("ref")).withColumn("uid", canonical_uuid(F.col("ref")))
    return named.join(r.select(F.col("id").alias("uid")), "uid", "left_anti").select("id", "ref")


SQL["reference_checks"] = RECORDS_SQL + r", s AS (SELECT id, unnest(meta.supersedes) ref FROM rec) SELECT id, ref FROM s WHERE regexp_replace(regexp_replace(lower(ref),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') NOT IN (SELECT h FROM rec)"


def message_references(spark: SparkSession, folder: str) -> DataFrame:
    """Positions that records are derived from and their sessions do not have."""
    r = records_of(spark, folder).select("id", "session_id", F.explode("derived_from").alias("ref")).where("ref like 'message:%'")
    asked = r.withColumn("seq", F.regexp_extract("ref", r"^message:(\d+)$", 1).try_cast("bigint"))
    return asked.join(table(spark, folder, "messages").select("session_id", "seq"), ["session_id", "seq"], "left_anti").select("id", "ref")


SQL["message_references"] = RECORDS_SQL + r", s AS (SELECT id, session_id, unnest(derived_from) ref FROM rec) SELECT id, ref FROM s WHERE ref LIKE 'message:%' AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.session_id = s.session_id AND m.seq = TRY_CAST(regexp_extract(ref, '^message:(\d+)$', 1) AS BIGINT))"


def record_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Records against the newest commit of their file: fresh, stale or unknown."""
    r = records_of(spark, folder)
    code = r.where("related_code.file_path <> ''").select("id", F.col("related_code.file_path").alias("path"), F.col("related_code.commit_hash").alias("hash"), "timestamp")
    newest = code.where("hash is not null").groupBy("path").agg(F.max_by("hash", F.struct("timestamp", "id")).alias("now"))
    entries = code.join(newest, "path", "left").select("id", F.col("now").alias("file_hash"), F.lit(None).cast("string").alias("ast_hash"))
    sources = code.where("hash is not null").select("id", F.lit("fresh").alias("status"), F.col("hash").alias("file_hash"), F.lit(None).cast("string").alias("ast_hash"))
    return boards.freshness(entries, sources).groupBy("state").agg(F.count("*").alias("records"))


SQL["record_sources"] = RECORDS_SQL + ", c AS (SELECT id, related_code.file_path p, related_code.commit_hash h2, timestamp t FROM rec WHERE related_code.file_path <> ''), n AS (SELECT p, arg_max(h2, {'t': t, 'i': id}) now FROM c WHERE h2 IS NOT NULL GROUP BY p) SELECT CASE WHEN h2 IS NULL THEN 'unknown' WHEN h2 = now THEN 'fresh' ELSE 'stale' END AS state, count(*) AS records FROM c LEFT JOIN n USING (p) GROUP BY 1"


def recent_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Code changes of the last 30 days by file."""
    r = records_of(spark, folder).where((F.col("update_type") == "code_change") & (F.col("timestamp") >= F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 30 DAY")))
    return r.groupBy(F.col("related_code.file_path").alias("path")).agg(F.count("*").alias("changes"))


SQL["recent_changes"] = RECORDS_SQL + f" SELECT related_code.file_path AS path, count(*) AS changes FROM rec WHERE update_type = 'code_change' AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1"


def summary_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Of each session and kind the five best records (confidence, newest, id) with levels of confidence and age."""
    r = records_of(spark, folder).select("session_id", "update_type", "id", "timestamp", F.col("meta.confidence").cast("double").alias("c"))
    rank = F.row_number().over(Window.partitionBy("session_id", "update_type").orderBy(F.desc_nulls_last("c"), F.desc("timestamp"), "id"))
    days = F.floor((F.unix_micros(F.expr(f"TIMESTAMP_NTZ '{NOW}'").cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 86_400_000_000)
    confidence = F.when(F.col("c") >= 0.8, "high").when(F.col("c") >= 0.6, "medium").when(F.col("c") >= 0.4, "low").otherwise("very_low")
    age = F.when(days <= 0, "today").when(days <= 3, "recent").when(days <= 7, "this_week").when(days <= 30, "this_month").otherwise("old")
    return r.withColumn("n", rank.cast("bigint")).where("n <= 5").select("session_id", "update_type", "id", "n", confidence.alias("confidence"), age.alias("age"))


SQL["summary_topk"] = RECORDS_SQL + f", s AS (SELECT session_id, update_type, id, timestamp, CAST(meta.confidence AS DOUBLE) c FROM rec) SELECT session_id, update_type, id, row_number() OVER (PARTITION BY session_id, update_type ORDER BY c DESC NULLS LAST, timestamp DESC, id) AS n, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c >= 0.4 THEN 'low' ELSE 'very_low' END AS confidence, CASE WHEN d <= 0 THEN 'today' WHEN d <= 3 THEN 'recent' WHEN d <= 7 THEN 'this_week' WHEN d <= 30 THEN 'this_month' ELSE 'old' END AS age FROM (SELECT *, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 86400000000) d FROM s) QUALIFY n <= 5"


def flow_cap(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each session's stream of messages when more than 50 drop the oldest ten at a time."""
    m = table(spark, folder, "messages").select("session_id", "turn_id", "seq")
    return temporal.flow_cap(m, "session_id", ["seq", "turn_id"], 50, 10).groupBy("session_id").agg(F.count("*").alias("kept"), F.min("seq").alias("first_seq"))


SQL["flow_cap"] = "WITH m AS (SELECT session_id, seq, count(*) OVER (PARTITION BY session_id) n, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, turn_id DESC) r FROM messages) SELECT session_id, count(*) AS kept, min(seq) AS first_seq FROM m WHERE r <= n - 10 * ceil(greatest(0, n - 50) / 10.0) GROUP BY 1"


def weighted_records(spark: SparkSession, folder: str) -> DataFrame:
    """An even score of every record, weighted by confidence and validity."""
    r = materialise(records_of(spark, folder))
    v = temporal.validity(r, table(spark, folder, "entities")).select("id", "reason")
    score = retrieval.validity_weight(F.lit(1.0), F.col("meta.confidence").cast("double"), F.col("reason"))
    return r.join(v, "id").select("id", F.round(score, 5).alias("score"))


SQL["weighted_records"] = VALID_SQL + " SELECT id, round((0.5 + 0.5 * coalesce(CAST(meta.confidence AS DOUBLE), 1)) * CASE WHEN reason IN ('superseded','contradicted','forgotten') THEN 0.5 ELSE 1 END, 5) AS score FROM rec JOIN val USING (id)"


def update_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts under which records are embedded."""
    r = records_of(spark, folder)
    return r.select("id", text.update_text(F.col("content.title"), F.col("content.description"), F.col("content.details")).alias("text"))


SQL["update_texts"] = RECORDS_SQL + ", t AS (SELECT id, concat_ws(chr(10), content.title, content.description, array_to_string(content.details, chr(10))) w FROM rec) SELECT id, CASE WHEN length(trim(w, ' ')) >= 10 THEN w END AS text FROM t"


def graph_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Records by personalised PageRank (30 steps) over terms, entities and relations from the items whose id is divisible by 50."""
    read = table(spark, folder, "records").select("id", "ingested_at", "timestamp", "update_type", F.struct("content.title", "content.description", "content.details").alias("content"), "creates_entities", "references_entities", "typed_entities", "creates_relationships")
    r, e = materialise(temporal.clean_records(read)), table(spark, folder, "entities")
    named = r.withColumn("creates_relationships", F.lit(None).cast(r.schema["creates_relationships"].dataType))  # ends of relations alone are not attached
    names = materialise(temporal.resolved(temporal.mentioned(named), "name", e).select("id", F.col("canonical").alias("entity")))
    attached = names.groupBy("id").agg(F.collect_set(text.entity_key(F.col("entity"))).alias("entities"))
    texts = r.select("id", F.concat_ws("\n", "content.title", "content.description", "content.details").alias("text"))
    docs = materialise(texts.join(attached, "id", "left").select("id", text.terms(F.col("text")).alias("terms"), "entities"))
    most = names.select("entity").distinct().agg(F.max(text.name_words(F.col("entity")))).first()[0] or 1
    q = table(spark, folder, "eval_items").where("item_id % 50 = 0 and text is not null").select(F.col("item_id").alias("qid"), text.terms(F.col("text")).alias("terms"), text.name_keys(F.col("text"), most).alias("entities"))
    edges = graph.edges_of(r, e).select(text.entity_key(F.col("src")).alias("src"), text.entity_key(F.col("dst")).alias("dst"), "weight")
    return retrieval.graph_candidates(docs, q, 300, relations=edges)


def named_entities(spark: SparkSession, folder: str) -> DataFrame:
    """entities that items name, by the keys of their runs of words, up to the longest name's."""
    names = table(spark, folder, "entities").where("name is not null")
    most = names.agg(F.max(text.name_words(F.col("name")))).first()[0] or 1  # one number
    q = table(spark, folder, "eval_items").where("text is not null").select("item_id", F.explode(text.name_keys(F.col("text"), most)).alias("key"))
    e = table(spark, folder, "entities").where("name is not null").select(text.entity_key(F.col("name")).alias("key"), "name")
    return q.join(e, "key").select("item_id", "name").distinct()


SQL["named_entities"] = rf"WITH w AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}+#./\-_''’]+'), lambda x: regexp_replace(regexp_replace(x, '^[.''’]+|[.''’]+$', '', 'g'), '[''’]s$', '')), lambda x: x <> '') x FROM eval_items WHERE text IS NOT NULL), r AS (SELECT item_id, array_to_string(x[i:i + n], ' ') x FROM (SELECT item_id, x, n, unnest(range(1, len(x) - n + 1)) i FROM (SELECT *, unnest(range(0, (SELECT max(len(list_filter(regexp_split_to_array(name, '[\s\-_]+'), lambda y: y <> ''))) FROM entities))) n FROM w))), k AS (SELECT DISTINCT item_id, {KEY_SQL.format('x')} k FROM r WHERE x <> '') SELECT DISTINCT item_id, name FROM k JOIN (SELECT name, {KEY_SQL.format('name')} n FROM entities WHERE name IS NOT NULL) ON n = k"


def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Relations when every entity of a name with an underscore is folded into the one before its underscore."""
    r, e = materialise(records_of(spark, folder)), table(spark, folder, "entities")
    edges = materialise(graph.edges_of(r, e))
    names = edges.select(F.col("src").alias("alias")).union(edges.select("dst")).distinct().where("alias like '%\\_%'")
    return graph.merged(edges, names.select("alias", F.split("alias", "_")[0].alias("canonical")))


SQL["merged_edges"] = EDGES_SQL + " SELECT DISTINCT * FROM (SELECT CASE WHEN contains(src, '_') THEN split_part(src, '_', 1) ELSE src END AS src, CASE WHEN contains(dst, '_') THEN split_part(dst, '_', 1) ELSE dst END AS dst, type FROM edge) WHERE src <> dst"


def entity_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each entity among those of its type by mentions, then name."""
    r, e = records_of(spark, folder), table(spark, folder, "entities")
    m = graph.mention_rollup(graph.mentions_of(r, e), e)
    return m.where("type is not null").withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("mentions"), "entity")).cast("bigint")).select("type", "entity", "place")


SQL["entity_ranks"] = EDGES_SQL + ", m AS (SELECT entity, count(*) n, (SELECT min(entity_type) FROM entities WHERE name = entity) AS type FROM men GROUP BY entity) SELECT type, entity, row_number() OVER (PARTITION BY type ORDER BY n DESC, entity) AS place FROM m WHERE type IS NOT NULL"


def formatted_times(spark: SparkSession, folder: str) -> DataFrame:
    """times of events formatted and read again, by expression."""
    e = table(spark, folder, "events").select("event_id", F.date_trunc("second", F.col("ts")).alias("ts"))
    names = X.row_names([("event_id", "bigint"), ("ts", "timestamp_ntz")])
    shown = X.compile_expression("time.format(ts, '%Y/%m/%d %H:%M:%S')", names).column
    rows = e.select("event_id", shown.alias("shown"))
    back = X.compile_expression("int(time.parse(shown, '%Y/%m/%d %H:%M:%S'))", X.row_names(rows.dtypes)).column
    return rows.select("event_id", "shown", back.alias("seconds"))


SQL["formatted_times"] = "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS shown, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events"


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of importance, and descriptions escaped."""
    e = table(spark, folder, "entities").where("name is not null")
    return e.select("name", graph.level(F.col("importance").cast("double")).alias("level"), text.escaped(F.coalesce("description", F.lit(""))).alias("description"))


SQL["quality_labels"] = "SELECT name, CASE WHEN CAST(importance AS DOUBLE) >= 0.8 THEN 'critical' WHEN CAST(importance AS DOUBLE) >= 0.5 THEN 'high' WHEN CAST(importance AS DOUBLE) >= 0.25 THEN 'medium' WHEN CAST(importance AS DOUBLE) >= 0.1 THEN 'low' ELSE 'minimal' END AS level, replace(replace(replace(replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS description FROM entities WHERE name IS NOT NULL"

QUERIES = {f.__name__: f for f in (list_records, reference_checks, message_references, record_sources, recent_changes, summary_topk, flow_cap, weighted_records, update_texts, graph_ranked, named_entities, merged_edges, entity_ranks, formatted_times, quality_labels)}
