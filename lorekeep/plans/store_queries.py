"""Queries of reads and writes, schedules and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import boards as O
from lorekeep.plans.memory_queries import NOW
from lorekeep.sources import archive as A
from lorekeep.sources.scratch import shared_folder
from lorekeep.sources.tables import table
from lorekeep.streaming import streams as S

SQL: dict[str, str] = {}


def range_scan(spark: SparkSession, folder: str) -> DataFrame:
    """SC3: positions 10 to 19 of every session's stream, in order."""
    return table(spark, folder, "messages").where("seq >= 10 and seq < 20").select("session_id", "seq", "turn_id")


SQL["range_scan"] = "SELECT session_id, seq, turn_id FROM messages WHERE seq >= 10 AND seq < 20"


def count_scan(spark: SparkSession, folder: str) -> DataFrame:
    """SC4, SC5: rows of each workspace, counted where they lie."""
    return table(spark, folder, "documents").groupBy("workspace_id").agg(F.count("*").alias("documents"))


SQL["count_scan"] = "SELECT workspace_id, count(*) AS documents FROM documents GROUP BY 1"


def session_find(spark: SparkSession, folder: str) -> DataFrame:
    """SC10, D13: sessions whose name or description holds a word, in any case."""
    s = table(spark, folder, "sessions")
    hit = F.lower("name").contains("review") | F.coalesce(F.lower("description").contains("review"), F.lit(False))
    return s.where(F.coalesce(hit, F.lower("description").contains("review"))).select("session_id", "name").distinct()


SQL["session_find"] = "SELECT DISTINCT session_id, name FROM sessions WHERE coalesce(contains(lower(name), 'review'), false) OR coalesce(contains(lower(description), 'review'), false)"


def workspace_members(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each workspace through its sessions."""
    s = table(spark, folder, "sessions").where("workspace_id is not null").select("session_id", "workspace_id").distinct()
    r = table(spark, folder, "records").select("session_id")
    return r.join(s, "session_id").groupBy("workspace_id").agg(F.count("*").alias("deliveries"), F.countDistinct("session_id").alias("sessions"))


SQL["workspace_members"] = "SELECT workspace_id, count(*) AS deliveries, count(DISTINCT session_id) AS sessions FROM records JOIN (SELECT DISTINCT session_id, workspace_id FROM sessions WHERE workspace_id IS NOT NULL) USING (session_id) GROUP BY 1"


def append_turns(spark: SparkSession, folder: str) -> DataFrame:
    """SC14, ST3: turns once each, at new dense positions in the order of arrival at a new store."""
    m = table(spark, folder, "messages").select("session_id", "turn_id", F.col("seq").alias("pos"))
    stored = m.where("false").select("session_id", "turn_id", F.col("pos").alias("seq"))
    return A.append_messages(stored, m).select("session_id", "turn_id", "seq")


SQL["append_turns"] = "SELECT session_id, turn_id, row_number() OVER (PARTITION BY session_id ORDER BY pos, turn_id) - 1 AS seq FROM (SELECT session_id, turn_id, min(seq) pos FROM messages GROUP BY 1, 2)"


def upsert_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """SC15: vectors by key; those of the wrong dimension are counted."""
    e = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("session_id"), F.pmod("vec_id", F.lit(100)).cast("string").alias("content_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("pos"))
    kept, rejected = A.upsert_vectors(e.where("false"), e, 64)
    return kept.agg(F.count("*").alias("kept"), F.sum("pos").alias("positions")).crossJoin(rejected)


SQL["upsert_vectors"] = "SELECT count(*) AS kept, CAST(sum(pos) AS BIGINT) AS positions, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS rejected FROM (SELECT label, vec_id % 100, max(vec_id) pos FROM embeddings WHERE len(embedding) = 64 GROUP BY 1, 2)"


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """SC16, SC6, J14: entries that remain when those of null languages go with their chunks."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("content_id"), "lang")
    chunks = d.unionByName(d.select(F.concat("content_id", F.lit("#1")).alias("content_id"), "lang"))
    return A.delete_cascade(chunks, d.where("lang is null")).select("content_id")


SQL["cascade_delete"] = "SELECT CAST(doc_id AS VARCHAR) || s AS content_id FROM documents, (SELECT unnest(['', '#1']) s) WHERE lang IS NOT NULL"


def retention(spark: SparkSession, folder: str) -> DataFrame:
    """SC17, ST9: messages of the last 90 days, by session."""
    return A.retained(table(spark, folder, "messages"), "timestamp", F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 90 DAY")).groupBy("session_id").agg(F.count("*").alias("kept"))


SQL["retention"] = f"SELECT session_id, count(*) AS kept FROM messages WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY GROUP BY 1"


def history_merge(spark: SparkSession, folder: str) -> DataFrame:
    """SC13: older deliveries of records as an archive's history against the others as a target's."""
    r = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("content"), F.col("o_orderdate").alias("written_at"))
    version = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    target = r.where("n % 2 = 0").withColumn("version", version).select("id", "version", "content", "written_at")
    archive = r.where("n % 2 = 1").withColumn("version", version).select("id", "version", "content", "written_at")
    return A.merge_history(archive, target, newer=True).groupBy("action", "conflict").agg(F.count("*").alias("versions"), F.countDistinct("id").alias("ids"))


SQL["history_merge"] = """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) v, o_orderstatus c, o_orderdate w FROM orders WHERE o_orderkey % 2 = 0),
a AS (SELECT CAST(o_custkey AS VARCHAR) id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) v, o_orderstatus c, o_orderdate w FROM orders WHERE o_orderkey % 2 = 1),
k AS (SELECT id, (SELECT max(v) FROM a WHERE a.id = i.id) al, (SELECT max(v) FROM t WHERE t.id = i.id) tl, (SELECT arg_max(c, v) FROM a WHERE a.id = i.id) ac, (SELECT arg_max(c, v) FROM t WHERE t.id = i.id) tc, (SELECT arg_max(w, v) FROM a WHERE a.id = i.id) aw, (SELECT arg_max(w, v) FROM t WHERE t.id = i.id) tw,
NOT EXISTS (SELECT 1 FROM t WHERE t.id = i.id AND NOT EXISTS (SELECT 1 FROM a WHERE a.id = t.id AND a.v = t.v AND a.c = t.c)) onn, NOT EXISTS (SELECT 1 FROM a WHERE a.id = i.id AND NOT EXISTS (SELECT 1 FROM t WHERE a.id = t.id AND a.v = t.v AND a.c = t.c)) ahead FROM (SELECT id FROM a UNION SELECT id FROM t) i),
m AS (SELECT *, CASE WHEN al IS NULL THEN 'keep' WHEN tl IS NULL THEN 'add' WHEN ac = tc THEN 'keep' WHEN onn THEN 'add' WHEN ahead THEN 'keep' WHEN aw > tw THEN 'add' ELSE 'keep' END AS action, CASE WHEN al IS NOT NULL AND tl IS NOT NULL AND ac <> tc AND NOT onn AND NOT ahead THEN CASE WHEN aw > tw THEN 'update' ELSE 'keep' END END AS conflict FROM k),
o AS (SELECT id FROM t UNION ALL SELECT a.id FROM a JOIN m USING (id) WHERE action = 'add' AND CASE WHEN conflict = 'update' THEN a.v = al ELSE tl IS NULL OR a.v > tl END) SELECT action, conflict, count(*) AS versions, count(DISTINCT id) AS ids FROM o JOIN m USING (id) GROUP BY ALL"""


def archive_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """SC11, SC12: sessions and messages written as an archive and read back: rows by section."""
    path = f"{shared_folder(spark)}/lorekeep/archive-{uuid.uuid4().hex}"
    A.export_archive({"sessions": table(spark, folder, "sessions"), "messages": table(spark, folder, "messages")}, path)
    out = None
    for name, df in A.import_archive(spark, path).items():
        part = df.agg(F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions")).withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


SQL["archive_round_trip"] = "SELECT 'sessions' AS section, count(*) AS rows, count(DISTINCT session_id) AS sessions FROM sessions UNION ALL SELECT 'messages', count(*), count(DISTINCT session_id) FROM messages"


def schedule_due(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions as schedules of seven hours, those without a name paused, run last at their last update."""
    s = table(spark, folder, "sessions").groupBy(F.col("session_id").alias("id")).agg(F.min("created_at").alias("start"), F.max("last_updated").alias("last_run"), F.bool_and(F.col("name").isNull()).alias("paused"))
    found = O.due(s.withColumn("every_s", F.lit(25_200)), F.expr(f"TIMESTAMP_NTZ '{NOW}'"))
    return found.select("id", *[F.unix_timestamp(c).alias(c) for c in ("due", "next_due", "owed")], "health")


_DUE_SQL = "CASE WHEN NOT p AND ({0} - b) // 25200 > 0 THEN b + ({0} - b) // 25200 * 25200 END"
SQL["schedule_due"] = f"WITH s AS (SELECT session_id id, CAST(floor(epoch(min(created_at))) AS BIGINT) b, CAST(floor(epoch(max(last_updated))) AS BIGINT) r, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) n, bool_and(name IS NULL) p FROM sessions GROUP BY 1), o AS (SELECT *, {_DUE_SQL.format('n')} due, CASE WHEN NOT p THEN b + (greatest(0, (n - b) // 25200) + 1) * 25200 END next_due, {_DUE_SQL.format('(n - 900)')} owed FROM s) SELECT id, due, next_due, owed, CASE WHEN p THEN 'paused' WHEN owed IS NOT NULL AND (r IS NULL OR r < owed) THEN 'late' ELSE 'ok' END AS health FROM o"


def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """ST1, ST2: the events log followed as a stream, each event id once; counted by type."""
    e = table(spark, folder, "events")
    log = f"{shared_folder(spark)}/lorekeep/log-{uuid.uuid4().hex}"
    e.unionByName(e).repartition(4).write.parquet(f"{log}/data")
    rows = S.once(S.follow(spark, f"{log}/data", e.schema).withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts", "7 days")
    rows.writeStream.format("parquet").option("path", f"{log}/out").option("checkpointLocation", f"{log}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{log}/out").groupBy("event_type").agg(F.count("*").alias("events"))


SQL["stream_once"] = "SELECT event_type, count(*) AS events FROM events GROUP BY 1"


def stream_watch(spark: SparkSession, folder: str) -> DataFrame:
    """ST4, ST5: events since a time caught up by a watcher, each once, also when the watcher starts again."""
    e = table(spark, folder, "events")
    log = f"{shared_folder(spark)}/lorekeep/watch-{uuid.uuid4().hex}"
    e.repartition(4).write.parquet(f"{log}/data")
    for run in range(2):
        S.watch(S.follow(spark, f"{log}/data", e.schema), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "ts", "event_id", f"{log}/out", f"{log}/at{run}").awaitTermination()
    return spark.read.parquet(f"{log}/out").groupBy("event_type").agg(F.count("*").alias("events"))


SQL["stream_watch"] = "SELECT event_type, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1"


def conversation_states(spark: SparkSession, folder: str) -> DataFrame:
    """ST10: the state of each conversation from its newest prompt and end."""
    m = table(spark, folder, "messages").where("source_session is not null")
    role = F.lower(F.trim("role"))
    rows = m.select(F.concat_ws("/", "session_id", "source_session").alias("key"), F.col("seq").alias("at"), F.when(role.isin("user", "human"), "prompt").otherwise("end").alias("kind"), F.when(F.coalesce(F.col("blocks"), F.lit("")).rlike('"stop": ?"failed"'), "failed").alias("stop"))
    return S.conversation_states(rows).groupBy("state").agg(F.count("*").alias("conversations"))


SQL["conversation_states"] = """WITH m AS (SELECT session_id || '/' || source_session k, seq, lower(trim(role)) IN ('user', 'human') p, regexp_matches(coalesce(blocks, ''), '"stop": ?"failed"') f FROM messages WHERE source_session IS NOT NULL), a AS (SELECT k, max(seq) FILTER (WHERE p) pr, max(seq) FILTER (WHERE NOT p) en FROM m GROUP BY k), s AS (SELECT a.*, coalesce((SELECT bool_or(f) FROM m WHERE m.k = a.k AND NOT p AND seq = en), false) f FROM a) SELECT CASE WHEN pr IS NOT NULL AND (en IS NULL OR en < pr) THEN 'running' WHEN f THEN 'failed' ELSE 'idle' END AS state, count(*) AS conversations FROM s GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (range_scan, count_scan, session_find, workspace_members, append_turns, upsert_vectors, cascade_delete, retention, history_merge, archive_round_trip, schedule_due, stream_once, stream_watch, conversation_states)}
