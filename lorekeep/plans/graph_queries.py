"""Queries of the entity graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import temporal as P
from lorekeep.plans.memory_queries import GRAPH_SQL, KEY_SQL, NOW, records_of
from lorekeep.sources.scratch import materialise
from lorekeep.sources.tables import table

SQL: dict[str, str] = {}
EDGES_SQL = GRAPH_SQL + """, edge AS (SELECT a.c src, b.c dst, rt AS type, arg_min(ctx, {'t': ts, 'i': id}) context, count(DISTINCT id) records FROM rel JOIN names a ON a.n = f JOIN names b ON b.n = t WHERE a.c <> b.c GROUP BY ALL),
men AS (SELECT DISTINCT c entity, ment.id, timestamp ts, update_type kind FROM ment JOIN names USING (n) JOIN rec ON rec.id = ment.id)"""
_W = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.WEIGHTS.items()) + " ELSE 0 END"


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r, e = materialise(records_of(spark, folder)), table(spark, folder, "entities")
    return r, e, materialise(G.edges_of(r, e))


def entity_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The graph's edges over all sessions."""
    return _parts(spark, folder)[2].select("src", "dst", "type", "weight", "records")


SQL["entity_edges"] = EDGES_SQL + f" SELECT src, dst, type, CAST({_W} AS DOUBLE) AS weight, records FROM edge"


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of each entity."""
    r, e = records_of(spark, folder), table(spark, folder, "entities")
    return G.mention_rollup(G.mentions_of(r, e), e).select("entity", "mentions", "first_at", "last_at", "type")


SQL["entity_mentions"] = EDGES_SQL + " SELECT entity, count(*) AS mentions, min(ts) AS first_at, max(ts) AS last_at, (SELECT min(entity_type) FROM entities WHERE name = entity) AS type FROM men GROUP BY entity"


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, edges, average degree."""
    edges = _parts(spark, folder)[2]
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).agg(F.countDistinct("n").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(nodes).select("nodes", "edges", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("degree"))


SQL["graph_stats"] = EDGES_SQL + " SELECT n AS nodes, m AS edges, round(2 * m / n, 6) AS degree FROM (SELECT count(*) m FROM edge), (SELECT count(DISTINCT x) n FROM (SELECT src x FROM edge UNION ALL SELECT dst FROM edge))"


def entity_related(spark: SparkSession, folder: str) -> DataFrame:
    """One hop either way."""
    return G.related(_parts(spark, folder)[2])


SQL["entity_related"] = EDGES_SQL + " SELECT src AS name, dst AS other, type AS relation FROM edge UNION SELECT dst, src, 'inverse_' || type FROM edge"


def _starts(edges: DataFrame) -> DataFrame:
    """All entities that a relation starts from; their number is fixed."""
    return edges.select(F.col("src").alias("start")).distinct()


_STARTS = "SELECT DISTINCT src FROM edge"


def _reach_sql(steps: str, depth: int, name: str) -> str:
    return f"{name}s AS (SELECT DISTINCT src, dst FROM ({steps}) WHERE src <> dst), {name} AS (SELECT src AS start, src AS node, 0 AS hops FROM ({_STARTS}) UNION SELECT {name}.start, {name}s.dst, hops + 1 FROM {name} JOIN {name}s ON {name}s.src = {name}.node WHERE hops < {depth})"


def bfs_trace(spark: SparkSession, folder: str) -> DataFrame:
    """What is reached from every entity within three hops, either way."""
    edges = _parts(spark, folder)[2]
    steps = G.related(edges).select(F.col("name").alias("src"), F.col("other").alias("dst")).distinct()
    return G.reach(_starts(edges), materialise(steps), 3).select("start", "node", "hops")


SQL["bfs_trace"] = EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + ", " + _reach_sql("SELECT src, dst FROM edge UNION SELECT dst, src FROM edge", 3, "w") + " SELECT start, node, min(hops) AS hops FROM w GROUP BY ALL"


def impact(spark: SparkSession, folder: str) -> DataFrame:
    """What depends on every entity, up to ten hops."""
    edges = _parts(spark, folder)[2]
    return G.reach(_starts(edges), materialise(G.impact_steps(edges)), 10).where("hops > 0").select("start", "node", "hops")


SQL["impact"] = EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + ", " + _reach_sql("SELECT dst AS src, src AS dst FROM edge WHERE type IN ('depends_on', 'implements') UNION SELECT src, dst FROM edge WHERE type = 'required_by'", 10, "w") + " SELECT start, node, min(hops) AS hops FROM w GROUP BY ALL HAVING min(hops) > 0"


def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest directed paths from every entity, up to four hops: their lengths."""
    edges = _parts(spark, folder)[2]
    paths = G.shortest_paths(_starts(edges), materialise(edges.select("src", "dst").distinct()), 4)
    return paths.where(F.size("path") == F.col("hops") + 1).select("start", "goal", "hops")


SQL["shortest_path"] = EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + ", " + _reach_sql("SELECT src, dst FROM edge", 4, "w") + " SELECT start, node AS goal, min(hops) AS hops FROM w WHERE start <> node GROUP BY ALL"


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Causes and effects within three hops."""
    edges = _parts(spark, folder)[2]
    return G.lineage(_starts(edges), edges, 3)


_CAUSE = "SELECT src, dst FROM edge WHERE type = 'leads_to' UNION SELECT dst, src FROM edge WHERE type IN ('caused_by', 'solves')"
SQL["lineage"] = EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + ", " + _reach_sql(f"SELECT dst AS src, src AS dst FROM ({_CAUSE})", 3, "bk") + ", " + _reach_sql(_CAUSE, 3, "fw") + ", b AS (SELECT start, node, min(hops) h FROM bk GROUP BY ALL), f AS (SELECT start, node, min(hops) h FROM fw GROUP BY ALL) SELECT start, node, CAST(-h AS INTEGER) AS hops FROM b UNION ALL SELECT start, node, h FROM f WHERE h > 0 AND (start, node) NOT IN (SELECT start, node FROM b)"


def pagerank_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of every entity, mentioned or only stored."""
    r, e, edges = _parts(spark, folder)
    found = G.importance(edges, G.counted_mentions(G.mention_rollup(G.mentions_of(r, e), e), e))
    return found.select("entity", F.round("importance", 5).alias("importance"))


def as_of_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 most important entities at the start of 2026 and the relations asserted by then between them, a row each (one without relation for an entity that has none)."""
    r, e, edges = _parts(spark, folder)
    rollup = materialise(G.mention_rollup(G.mentions_of(r, e), e))
    relations = materialise(P.asserted(r, P.validity(r, e), e))
    found = G.as_of(rollup, G.importance(edges, rollup), relations, F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"), 50)
    return found.select("entity", F.round("importance", 5).alias("importance"), F.expr("inline_outer(edges)"), "nodes", "relations")


def _pagerank_sql(steps: int) -> str:
    out = EDGES_SQL.replace("WITH raw", "WITH raw", 1) + f""", roll AS (SELECT entity, 1 + ln(1 + greatest(coalesce(k, 0), coalesce(mc, 0))) t, coalesce(la, lm) la FROM (SELECT entity, count(*) k, max(ts) la FROM men GROUP BY entity) FULL JOIN (SELECT name entity, max(mention_count) mc, max(last_mentioned) lm FROM entities WHERE name IS NOT NULL GROUP BY 1) USING (entity)), nd AS MATERIALIZED (SELECT entity id, t / (SELECT sum(t) FROM roll) sh, greatest(0, coalesce((epoch_us((SELECT max(la) FROM roll)) - epoch_us(la)) / 86400000000.0, 0)) dy FROM roll),
un AS MATERIALIZED (SELECT least(src, dst) a, greatest(src, dst) b, sum({_W}) w FROM edge GROUP BY ALL), bo AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) p FROM (SELECT a, b, w FROM un UNION ALL SELECT b, a, w FROM un)), r0 AS (SELECT id, sh AS rk FROM nd)"""
    for k in range(steps):
        out += f", r{k + 1} AS MATERIALIZED (SELECT nd.id, (0.15 + 0.85 * (SELECT coalesce(sum(rk), 0) FROM r{k} WHERE id NOT IN (SELECT a FROM bo))) * sh + 0.85 * coalesce(g, 0) rk FROM nd LEFT JOIN (SELECT b, sum(rk * p) g FROM r{k} JOIN bo ON id = a GROUP BY b) x ON x.b = nd.id)"
    return out + f" SELECT nd.id AS entity, round(rk / (SELECT max(rk) FROM r{steps}) * (0.5 + 0.5 * pow(0.5, dy / 90)), 5) AS importance FROM r{steps} JOIN nd USING (id)"


SQL["pagerank_importance"] = _pagerank_sql(60)


def entity_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of entities; sequential, so without SQL."""
    return G.communities(_parts(spark, folder)[2])


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """Size, records and first and last time of each community."""
    r, e, edges = _parts(spark, folder)
    c = G.communities(edges)
    return G.mentions_of(r, e).join(c, "entity").groupBy("community").agg(F.countDistinct("entity").alias("size"), F.countDistinct("id").alias("records"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def radar_unsolved(spark: SparkSession, folder: str) -> DataFrame:
    """Problems that nothing solves."""
    _, e, edges = _parts(spark, folder)
    return G.unsolved(e, edges)


SQL["radar_unsolved"] = EDGES_SQL + " SELECT DISTINCT name FROM entities WHERE entity_type = 'problem' AND name IS NOT NULL AND name NOT IN (SELECT dst FROM edge WHERE type = 'solves')"


def radar_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Entities not mentioned for 90 days."""
    r, e = records_of(spark, folder), table(spark, folder, "entities")
    return G.stale(G.mention_rollup(G.mentions_of(r, e), e), F.expr(f"TIMESTAMP_NTZ '{NOW}'"))


SQL["radar_stale"] = EDGES_SQL + f" SELECT entity, max(ts) AS last_at FROM men GROUP BY entity HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 90 DAY"


def radar_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Names that begin other names, with the records they share."""
    r, e = records_of(spark, folder), table(spark, folder, "entities")
    m = materialise(G.mentions_of(r, e))
    return G.alias_candidates(m, m.select("entity").distinct())


SQL["radar_aliases"] = EDGES_SQL + f", k AS (SELECT DISTINCT entity, {KEY_SQL.format('entity')} key FROM men) SELECT a.entity AS name, b.entity AS of, (SELECT count(*) FROM men x JOIN men y ON x.id = y.id WHERE x.entity = a.entity AND y.entity = b.entity) AS shared FROM k a JOIN k b ON length(a.key) >= 4 AND a.key <> b.key AND starts_with(b.key, a.key)"


def radar_bare_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions without description and details."""
    r = records_of(spark, folder)
    return r.where((F.col("update_type") == "decision_made") & (F.trim(F.coalesce("content.description", F.lit(""))) == "") & (F.coalesce(F.size("content.details"), F.lit(0)) <= 0)).select("id")


SQL["radar_bare_decisions"] = EDGES_SQL + " SELECT id FROM rec WHERE update_type = 'decision_made' AND trim(coalesce(content.description, '')) = '' AND coalesce(len(content.details), 0) = 0"


def files_together(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that records of a file name, by file."""
    r, e = records_of(spark, folder), table(spark, folder, "entities")
    files = r.where("related_code.file_path <> ''").select("id", F.col("related_code.file_path").alias("path"))
    return files.join(G.mentions_of(r, e).select("id", "entity"), "id").groupBy("path", "entity").agg(F.count("*").alias("records"))


SQL["files_together"] = EDGES_SQL + " SELECT related_code.file_path AS path, entity, count(*) AS records FROM rec JOIN men ON men.id = rec.id WHERE related_code.file_path <> '' GROUP BY ALL"


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Authors and sessions that each entity's records come from."""
    r, e = records_of(spark, folder), table(spark, folder, "entities")
    m = G.mentions_of(r, e).select("entity", "id").join(r.select("id", "author", "session_id"), "id")
    return m.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"), F.countDistinct("session_id").alias("sessions"))


SQL["provenance"] = EDGES_SQL + " SELECT entity, coalesce(array_to_string(list_sort(list(DISTINCT author) FILTER (WHERE author IS NOT NULL)), ','), '') AS authors, count(DISTINCT session_id) AS sessions FROM men JOIN rec ON rec.id = men.id GROUP BY entity"


def dependency_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Entities on a cycle of depends_on, with the length of a shortest one."""
    edges = _parts(spark, folder)[2]
    return G.cycles(edges.where("type = 'depends_on'").select("src", "dst")).select("node", "length")


SQL["dependency_cycles"] = EDGES_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1) + ", dep AS (SELECT DISTINCT src, dst FROM edge WHERE type = 'depends_on'), cl AS (SELECT src, dst FROM dep UNION SELECT cl.src, dep.dst FROM cl JOIN dep ON cl.dst = dep.src), ring AS (SELECT src FROM cl WHERE src = dst), rd AS (SELECT * FROM dep WHERE src IN (FROM ring) AND dst IN (FROM ring)), w AS (SELECT src s, dst n, 1 h FROM rd UNION SELECT s, dst, h + 1 FROM w JOIN rd ON n = src WHERE n <> s AND h < 60) SELECT s AS node, CAST(min(h) AS INTEGER) AS length FROM w WHERE s = n GROUP BY s"


def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose parents are all of a closing kind are ready; counted by session."""
    r = records_of(spark, folder).select("id", "session_id", "update_type", "parent_update")
    from lorekeep.sources.tables import canonical_uuid

    deps = r.select("id", "session_id", canonical_uuid(F.col("parent_update")).alias("dep"))
    done = r.select(F.col("id").alias("dep"), F.col("update_type").isin("problem_solved", "decision_made").alias("done"))
    ready = deps.join(done, "dep", "left").groupBy("session_id", "id").agg(F.bool_and(F.col("dep").isNull() | F.coalesce("done", F.lit(False))).alias("ready"))
    return ready.groupBy("session_id").agg(F.count_if("ready").alias("ready"), F.count("*").alias("total"))


SQL["readiness"] = EDGES_SQL + r", dp AS (SELECT id, session_id, regexp_replace(regexp_replace(lower(parent_update),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') p FROM rec), dq AS (SELECT id, session_id, CASE WHEN regexp_full_match(p,'[0-9a-f]{32}') THEN p END p FROM dp) SELECT dq.session_id, count(*) FILTER (WHERE p IS NULL OR coalesce(b.update_type IN ('problem_solved','decision_made'), false)) AS ready, count(*) AS total FROM dq LEFT JOIN rec b ON b.h = dq.p GROUP BY 1"

QUERIES = {f.__name__: f for f in (entity_edges, entity_mentions, graph_stats, entity_related, bfs_trace, impact, shortest_path, lineage, pagerank_importance, as_of_graph, entity_communities, topics, radar_unsolved, radar_stale, radar_aliases, radar_bare_decisions, files_together, provenance, dependency_cycles, readiness)}
