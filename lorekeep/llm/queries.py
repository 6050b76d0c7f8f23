"""Queries of the text operators and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import dialogues, leaks, near_duplicates, residue, tokens
from lorekeep.sources.tables import canonical_uuid, table


P7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_items WHERE lower(trim(split)) IN ('test', 'dev') AND text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d WHERE len(w) >= 12)),
iw AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)
"""


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids: the ids of each document by byte_bpe_50k."""
    return tokens.token_ids(table(spark, folder, "documents"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of held-out items, verbatim or re-parameterised: doc_id, item_id, verbatim, consistent, slots."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and held-out items with a common run of at least 12 words: doc_id, item_id."""
    return p7_leaks(spark, folder).where(F.col("verbatim") >= leaks.WINDOW).select("doc_id", "item_id")


P4_SQL = r"""
WITH raw AS (SELECT regexp_replace(regexp_replace(lower(id),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') h, content, ingested_at FROM records),
r AS (SELECT h, content FROM raw WHERE regexp_full_match(h,'[0-9a-f]{32}') QUALIFY row_number() OVER (PARTITION BY h ORDER BY ingested_at DESC) = 1),
w AS (SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS id, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', content.title, content.description, array_to_string(content.details, ' '))), '[\p{L}\p{N}]+'), lambda x: length(x) >= 3)) s FROM r),
k AS (SELECT id, s, len(s) n FROM w WHERE len(s) >= 20), x AS (SELECT id, n, unnest(s) t FROM k),
o AS (SELECT a.id id_a, b.id id_b, any_value(a.n) n, any_value(b.n) m, count(*) c FROM x a JOIN x b ON a.t = b.t AND a.id < b.id AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n GROUP BY 1, 2)
SELECT id_a, id_b FROM o WHERE 17 * c >= 7 * (n + m)
"""
_SEEN = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
P5_SQL = rf"""
WITH RECURSIVE m AS (SELECT session_id, turn_id, seq, lower(trim(role)) IN ('user','human') usr, lower(trim(role)) IN ('assistant','ai','agent','model') ast, nullif(trim(source_session),'') own, nullif(trim(parent),'') parent, text, nullif(trim(blocks),'') bl FROM messages WHERE session_id IS NOT NULL AND turn_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, turn_id ORDER BY seq, ingested_at, parent, own) = 1),
t AS (SELECT *, bl IS NULL OR json_valid(bl) readable, CASE WHEN json_valid(bl) THEN CAST(bl AS JSON) END j FROM m),
b0 AS (SELECT session_id, turn_id, seq, i, json_extract(j, '$[' || i || ']') x FROM (SELECT *, unnest(range(CAST(json_array_length(j) AS BIGINT))) i FROM t WHERE json_type(j) = 'ARRAY')),
b AS (SELECT session_id, turn_id, seq, i, coalesce(x ->> '$.type', CASE WHEN json_exists(x, '$.text') THEN 'text' WHEN json_exists(x, '$.thinking') THEN 'thinking' WHEN json_exists(x, '$.summary') THEN 'summary' WHEN json_exists(x, '$.tool_use') OR json_exists(x, '$.toolUse') THEN 'tool_use' WHEN json_exists(x, '$.tool_result') OR json_exists(x, '$.toolResult') THEN 'tool_result' WHEN json_exists(x, '$.end') THEN 'end' END) kind,
coalesce(x ->> '$.tool_use_id', x ->> '$.tool_result.tool_use_id', x ->> '$.toolResult.toolUseId', x ->> '$.tool_use.id', x ->> '$.toolUse.id', x ->> '$.id') call, coalesce(x ->> '$.stop', x ->> '$.end.stop') stop, x ->> '$.text' txt FROM b0),
f AS (SELECT session_id, turn_id, bool_or(kind = 'text' AND regexp_matches(txt, '{_SEEN}')) shown, bool_or(kind NOT IN ('text','end')) other, bool_or(kind = 'end' AND stop IN ('failed','cancelled','blocked')) failed FROM b GROUP BY 1, 2),
c AS (SELECT session_id, turn_id, own conv FROM t WHERE own IS NOT NULL UNION SELECT t.session_id, t.turn_id, c.conv FROM t JOIN c ON t.session_id = c.session_id AND t.parent = c.turn_id WHERE t.own IS NULL),
a AS (SELECT t.*, conv, coalesce(regexp_matches(text, '{_SEEN}'), false) OR coalesce(shown, false) says, coalesce(other, false) oth, coalesce(failed, false) fail FROM t JOIN c USING (session_id, turn_id) LEFT JOIN f USING (session_id, turn_id)),
cl AS (SELECT a.session_id, conv, call, min((b.seq, i)) FILTER (WHERE kind = 'tool_use') fu, max((b.seq, i)) FILTER (WHERE kind = 'tool_use') lu, min((b.seq, i)) FILTER (WHERE kind = 'tool_result') fr, max((b.seq, i)) FILTER (WHERE kind = 'tool_result') lr FROM a JOIN b USING (session_id, turn_id) WHERE kind IN ('tool_use','tool_result') GROUP BY ALL),
bad AS (SELECT session_id, conv FROM cl WHERE NOT coalesce(call IS NOT NULL AND lr > lu AND fu < fr, false) UNION SELECT x.session_id, x.conv FROM a x WHERE x.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a y WHERE y.session_id = x.session_id AND y.conv = x.conv AND y.turn_id = x.parent)),
g AS (SELECT session_id, conv, bool_and(readable) rd, bool_or(says) sy, bool_or(oth) ot, max(seq) FILTER (WHERE usr AND says) u, max(seq) FILTER (WHERE ast AND says AND NOT fail) r FROM a GROUP BY 1, 2),
d AS (SELECT session_id, conv AS source_session, CASE WHEN rd AND NOT sy AND NOT ot THEN 'empty' WHEN NOT rd OR u IS NULL OR (session_id, conv) IN (SELECT session_id, conv FROM bad) THEN 'broken' WHEN r IS NULL OR r < u THEN 'no_reply' END AS defect FROM g)
SELECT * FROM d WHERE defect IS NOT NULL
"""


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "records").select("id", "ingested_at", "content.title", "content.description", "content.details")
    return t.select(canonical_uuid(F.col("id")).alias("id"), F.col("ingested_at").alias("at"), "title", "description", "details")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose words of title, description and details share 0.7 of their union: id_a, id_b."""
    return near_duplicates.similar_pairs(_contents(spark, folder), ["title", "description", "details"])


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of enough words: id, class_id (equal sets), group_id (connected by similarity), links (similar classes)."""
    return near_duplicates.similar_groups(_contents(spark, folder), ["title", "description", "details"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations to drop: session_id, source_session, defect."""
    t = dialogues.assigned(dialogues.turns(table(spark, folder, "messages")))
    return dialogues.defects(t).where("defect is not null").select("session_id", F.col("conv").alias("source_session"), "defect")


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Kept conversations, each root-to-leaf path in order: session_id, source_session, leaf, ordinal, turn_id, speaker, seq, text."""
    messages = table(spark, folder, "messages")
    steps = dialogues.conversations(messages).withColumnRenamed("conv", "source_session")
    said = messages.groupBy("session_id", "turn_id").agg(F.min_by("text", F.struct("seq", "ingested_at")).alias("text"))
    return steps.join(said, ["session_id", "turn_id"]).select("session_id", "source_session", "leaf", "ordinal", "turn_id", "speaker", "seq", "text")


def p8_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its residue labels: doc_id, placeholder, filler, page, spread."""
    return residue.labelled(table(spark, folder, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to exclude: doc_id."""
    return p8_labels(spark, folder).where("placeholder or filler or page or spread").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_groups, p5_found, p5_conversations, p6_ids, p7_leaks, p7_found, p8_labels, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL}
