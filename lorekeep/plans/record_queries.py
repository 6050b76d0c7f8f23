"""Queries on the tables of records, feeds and exports: hierarchies, drift, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import drift as D
from lorekeep.operators import hierarchy as H
from lorekeep.operators import nested as N
from lorekeep.sources.tables import canonical_uuid, table

SQL: dict[str, str] = {}
_HIERARCHY = r"""
WITH RECURSIVE raw AS (SELECT regexp_replace(regexp_replace(lower(id),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') h, regexp_replace(regexp_replace(lower(parent_update),'^[\s{]*(urn:uuid:)?[\s{]*',''),'[\s}\-]+','','g') p, ingested_at FROM records),
c AS (SELECT CASE WHEN regexp_full_match(h,'[0-9a-f]{32}') THEN h END h, CASE WHEN regexp_full_match(p,'[0-9a-f]{32}') THEN p END p, ingested_at FROM raw),
n AS (SELECT h, p FROM (SELECT h,p,row_number() OVER (PARTITION BY h ORDER BY ingested_at DESC, p DESC NULLS LAST) rn FROM c WHERE h IS NOT NULL) WHERE rn=1),
l AS (SELECT a.h, a.p FROM n a JOIN n b ON a.p=b.h),
up AS (SELECT h, p AS anc FROM l UNION SELECT up.h, l.p FROM up JOIN l ON up.anc=l.h),
ring AS (SELECT DISTINCT h FROM up WHERE h=anc),
tree AS (SELECT up.h, count(*) d, max(CASE WHEN l.h IS NULL THEN anc END) root, bool_or(ring.h IS NOT NULL) caught, min(ring.h) least FROM up LEFT JOIN l ON up.anc=l.h LEFT JOIN ring ON up.anc=ring.h GROUP BY up.h),
o AS (SELECT tree.h, CASE WHEN caught THEN least ELSE root END r, CASE WHEN ring.h IS NOT NULL THEN -1 WHEN caught THEN -2 ELSE d END depth FROM tree LEFT JOIN ring ON tree.h=ring.h)
"""
_UUID = "substr({0},1,8)||'-'||substr({0},9,4)||'-'||substr({0},13,4)||'-'||substr({0},17,4)||'-'||substr({0},21,12)"
SQL["p1_found"] = _HIERARCHY + f"SELECT {_UUID.format('h')} AS id, {_UUID.format('r')} AS root_id, CAST(depth AS BIGINT) AS depth FROM o"
SQL["p1_descendants"] = (
    _HIERARCHY + f", far AS (SELECT u.h, u.anc, (SELECT count(*) FROM up v WHERE v.h = u.h) - (SELECT count(*) FROM up v WHERE v.h = u.anc) AS distance FROM up u JOIN o ON u.h = o.h WHERE o.depth > 0) SELECT {_UUID.format('anc')} AS ancestor_id, {_UUID.format('h')} AS id, CAST(distance AS BIGINT) AS distance FROM far"
)

SQL["p1_paths"] = (
    _HIERARCHY + f", far AS (SELECT u.h, u.anc, (SELECT count(*) FROM up v WHERE v.h = u.anc) AS level FROM up u JOIN o ON u.h = o.h WHERE o.depth > 0), pt AS (SELECT h, string_agg({_UUID.format('anc')}, '/' ORDER BY level) || '/' || {_UUID.format('any_value(h)')} AS p FROM far GROUP BY h) "
    f"SELECT {_UUID.format('o.h')} AS id, {_UUID.format('r')} AS root_id, CAST(depth AS BIGINT) AS depth, p AS path FROM o LEFT JOIN pt ON pt.h = o.h UNION ALL SELECT {_UUID.format('h')}, {_UUID.format('h')}, 0, {_UUID.format('h')} FROM n WHERE h NOT IN (SELECT h FROM l)"
)
_UNWRAP = "CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) END ELSE {0} END"
_FLAT = f"""WITH e AS (SELECT export_id, exported_at, CAST(payload AS JSON) j FROM session_exports WHERE json_valid(payload)), u AS (SELECT export_id, exported_at, {_UNWRAP.format('j')} k FROM e),
s AS (SELECT export_id, exported_at, k ->> '$.session.id' sid, {_UNWRAP.format("json_extract(k, '$.session.incremental_updates')")} ups FROM u WHERE json_type(k) = 'OBJECT'), l AS (SELECT * FROM s WHERE sid <> '' QUALIFY row_number() OVER (PARTITION BY sid ORDER BY exported_at DESC, export_id DESC) = 1),
r0 AS (SELECT sid, i, json_extract(ups, '$[' || i || ']') x FROM (SELECT sid, ups, unnest(range(CAST(json_array_length(ups) AS BIGINT))) i FROM l WHERE json_type(ups) = 'ARRAY') UNION ALL SELECT sid, 0, ups FROM l WHERE json_type(ups) = 'OBJECT'),
r1 AS (SELECT sid, i, {_UNWRAP.format('x')} x FROM r0), r AS (SELECT sid, x ->> '$.id' rid, i, x FROM r1 WHERE x ->> '$.id' <> '' QUALIFY row_number() OVER (PARTITION BY sid, x ->> '$.id' ORDER BY i DESC) = 1),
c0 AS (SELECT sid, rid, 'typed_entity' child, 'name' f, {_UNWRAP.format("json_extract(x, '$.typed_entities')")} y FROM r UNION ALL SELECT sid, rid, 'relationship', 'from_entity', {_UNWRAP.format("json_extract(x, '$.creates_relationships')")} FROM r UNION ALL SELECT sid, rid, 'code', 'file_path', {_UNWRAP.format("json_extract(x, '$.related_code')")} FROM r),
c1 AS (SELECT sid, rid, child, f, o, json_extract(y, '$[' || o || ']') z FROM (SELECT *, unnest(range(CAST(json_array_length(y) AS BIGINT))) o FROM c0 WHERE json_type(y) = 'ARRAY') UNION ALL SELECT sid, rid, child, f, 0, y FROM c0 WHERE json_type(y) = 'OBJECT'),
c2 AS (SELECT sid, rid, child, f, o, {_UNWRAP.format('z')} z FROM c1), c AS (SELECT sid, rid, child, o, CASE json_type(json_extract(z, '$.' || f)) WHEN 'OBJECT' THEN z ->> ('$.' || f || '.value') WHEN 'ARRAY' THEN NULL ELSE z ->> ('$.' || f) END item, z FROM c2)"""
SQL["p3_found"] = _FLAT + " SELECT sid AS session_id, rid AS record_id, 'record' AS child, i AS ordinal, rid AS item FROM r UNION ALL SELECT sid, rid, child, o, item FROM c WHERE item <> ''"
_SCALAR = "nullif(CASE json_type(json_extract(x, '{0}')) WHEN 'OBJECT' THEN x ->> '{0}.value' WHEN 'ARRAY' THEN NULL ELSE x ->> '{0}' END, '')"
SQL["p3_records"] = _FLAT + " SELECT sid AS session_id, rid AS record_id, i AS ordinal, " + ", ".join(f"{_SCALAR.format(p)} AS {n}" for n, p in N.RECORD_FIELDS.items() if n != "id") + " FROM r"
SQL["p3_entities"] = _FLAT + " SELECT sid AS session_id, rid AS record_id, o AS ordinal, item AS name, nullif(z ->> '$.entity_type', '') AS entity_type FROM c WHERE item <> '' AND child = 'typed_entity'"
SQL["p3_relationships"] = _FLAT + " SELECT sid AS session_id, rid AS record_id, o AS ordinal, item AS from_entity, nullif(z ->> '$.to_entity', '') AS to_entity, nullif(z ->> '$.relation_type', '') AS relation_type, nullif(z ->> '$.context', '') AS context FROM c WHERE item <> '' AND child = 'relationship'"
SQL["p3_code"] = _FLAT + " SELECT sid AS session_id, rid AS record_id, o AS ordinal, item AS file_path, z ->> '$.start_line' AS start_line, z ->> '$.end_line' AS end_line, nullif(z ->> '$.commit_hash', '') AS commit_hash FROM c WHERE item <> '' AND child = 'code'"

_TREE = f"""WITH w0 AS (SELECT series, file_name, CAST(payload AS JSON) j FROM record_feeds WHERE json_valid(payload)), w AS (SELECT series, file_name, {_UNWRAP.format('j')} j FROM w0),
q AS (SELECT file_name, j, json_type(j, '$.session') = 'OBJECT' IS TRUE s, json_extract(j, '$.session.incremental_updates') u FROM w WHERE json_type(j) = 'OBJECT'),
x AS (SELECT file_name, '' p, j x FROM q WHERE NOT s UNION ALL SELECT file_name, 'session.incremental_updates.', u FROM q WHERE s AND json_type(u) = 'OBJECT' UNION ALL SELECT file_name, 'session.incremental_updates.', json_extract(u, '$[' || i || ']') FROM (SELECT file_name, u, unnest(range(CAST(json_array_length(u) AS BIGINT))) i FROM q WHERE s AND json_type(u) = 'ARRAY')),
r AS MATERIALIZED (SELECT row_number() OVER () k, * FROM x WHERE json_type(x) = 'OBJECT'),
tr AS MATERIALIZED (SELECT k, file_name, p || regexp_replace(substr(t.fullkey, 3), '\\[\\d+\\]', '', 'g') path, NOT ends_with(t.fullkey, ']') own, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN '' ELSE 'number' END kind, CAST(t.value AS VARCHAR) v FROM r, json_tree(r.x) t WHERE t.fullkey <> '$'),
kn AS (SELECT file_name, path, kind, count(*) n FROM tr WHERE own GROUP BY ALL), fd AS MATERIALIZED (SELECT file_name, path, arg_max(kind, (kind <> '', n, kind)) kind FROM kn GROUP BY ALL),
fi AS (SELECT file_name, min(series) series, min(exported_at) e FROM record_feeds WHERE file_name IS NOT NULL GROUP BY 1), fl AS MATERIALIZED (SELECT file_name, series, row_number() OVER (PARTITION BY series ORDER BY e, file_name) n FROM fi)"""
SQL["p2_lifespans"] = _TREE + ", a AS (SELECT series, path, kind, n, file_name, n - row_number() OVER (PARTITION BY series, path, kind ORDER BY n) g FROM fd JOIN fl USING (file_name)) SELECT series, path, kind, arg_min(file_name, n) AS first_file, arg_max(file_name, n) AS last_file, count(*) AS files FROM a GROUP BY series, path, kind, g"
SQL["p2_found"] = _TREE + r""", pv AS (SELECT a.file_name f, b.file_name g FROM fl a JOIN fl b ON a.series = b.series AND b.n = a.n - 1),
now AS (SELECT f, path, kind FROM fd JOIN pv ON f = file_name), was AS (SELECT f, path, kind FROM fd JOIN pv ON g = file_name),
st AS MATERIALIZED (SELECT f, path, CASE WHEN was.kind IS NULL THEN 'added' WHEN now.kind IS NULL THEN 'removed' ELSE 'retyped' END change FROM now FULL JOIN was USING (f, path) WHERE was.kind IS NULL OR now.kind IS NULL OR (was.kind <> now.kind AND was.kind <> '' AND now.kind <> '')),
pr AS MATERIALIZED (SELECT a.f, a.path o, b.path w FROM st a JOIN st b ON a.f = b.f AND a.change = 'removed' AND b.change = 'added' AND regexp_replace(a.path, '[^.]*$', '') = regexp_replace(b.path, '[^.]*$', '')),
id AS (SELECT k, file_name, lower(trim(coalesce(x ->> '$.id.value', CASE WHEN json_type(x, '$.id') NOT IN ('OBJECT','ARRAY') THEN x ->> '$.id' END))) rid FROM r),
lv AS (SELECT k, path, v FROM tr WHERE kind IN ('string','boolean','number') AND v <> '""'),
wt AS (SELECT f, g file_name, o top, 0 side FROM pr JOIN pv USING (f) UNION SELECT f, f, w, 1 FROM pr),
vl AS (SELECT f, side, top, rid, max(h) h FROM (SELECT f, side, top, rid, lv.k, list_sort(list((regexp_replace(substr(path, length(top) + 1), '\.value(\.|$)', '', 'g'), v)))::VARCHAR h FROM wt JOIN id USING (file_name) JOIN lv ON lv.k = id.k AND (path = top OR starts_with(path, top || '.')) WHERE rid <> '' GROUP BY ALL) GROUP BY ALL),
ev AS (SELECT pr.f, o, w, count(*) FILTER (WHERE a.h = b.h) same, count(*) n FROM pr JOIN vl a ON a.f = pr.f AND a.top = o AND a.side = 0 JOIN vl b ON b.f = pr.f AND b.top = w AND b.side = 1 AND a.rid = b.rid GROUP BY ALL),
rn AS MATERIALIZED (SELECT f, o, w FROM ev WHERE 2 * same > n QUALIFY row_number() OVER (PARTITION BY f, o ORDER BY same DESC, same / n DESC, w) = 1 AND row_number() OVER (PARTITION BY f, w ORDER BY same DESC, same / n DESC, o) = 1),
ch AS MATERIALIZED (SELECT f, change, CASE WHEN change = 'added' THEN '' ELSE path END o, CASE WHEN change = 'removed' THEN '' ELSE path END w FROM st WHERE NOT (change = 'removed' AND (f, path) IN (SELECT f, o FROM rn)) AND NOT (change = 'added' AND (f, path) IN (SELECT f, w FROM rn)) UNION ALL SELECT f, 'renamed', o, w FROM rn)
SELECT f AS file_name, change, o AS old_path, w AS new_path FROM ch a WHERE NOT EXISTS (SELECT 1 FROM ch b WHERE b.f = a.f AND a.o <> '' AND b.o <> '' AND starts_with(a.o, b.o || '.')) AND NOT EXISTS (SELECT 1 FROM ch b WHERE b.f = a.f AND a.w <> '' AND b.w <> '' AND starts_with(a.w, b.w || '.'))"""


def record_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record (the delivery ingested last): id, parent, grp. Equal times are settled by the parent."""
    t = table(spark, folder, "records").select("id", "parent_update", "session_id", "ingested_at")
    rows = t.select(canonical_uuid(F.col("id")).alias("uid"), canonical_uuid(F.col("parent_update")).alias("parent"), F.col("session_id").alias("grp"), "ingested_at")
    return H.latest_by(rows, F.col("uid"), F.struct("ingested_at", "parent"), "parent", "grp")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with a parent in the table: id, root_id, depth (-1 on a ring, -2 below one)."""
    return H.hierarchy(record_nodes(spark, folder)).where("depth <> 0").select("id", "root_id", F.col("depth").cast("bigint").alias("depth"))


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each record: id, root_id, depth, path (ids from the root, joined by '/'; null in and below rings)."""
    return H.hierarchy(record_nodes(spark, folder), trails=True).select("id", "root_id", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", "/").alias("path"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Each record above others: every descendant with its distance."""
    return H.descendants(H.hierarchy(record_nodes(spark, folder), trails=True))


def _exports(spark: SparkSession, folder: str, only_items: bool = False) -> DataFrame:
    t = table(spark, folder, "session_exports").select("export_id", "exported_at", "payload")
    if only_items:  # the parse then extracts nothing but keys and items
        return N.nested_records(t, {}, {n: (p, dict(list(c.items())[:1])) for n, (p, c) in N.CHILDREN.items()})
    return N.nested_records(t)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and their children in the latest readable export of each session: session_id, record_id, child, ordinal, item."""
    return N.all_items(_exports(spark, folder, only_items=True))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of records: keys, position, type, time, title, description, parent, author."""
    return _exports(spark, folder).select("session_id", "record_id", "ordinal", *[c for c in N.RECORD_FIELDS if c != "id"])


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    return N.child_rows(_exports(spark, folder), "typed_entity")


def p3_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return N.child_rows(_exports(spark, folder), "relationship")


def p3_code(spark: SparkSession, folder: str) -> DataFrame:
    return N.child_rows(_exports(spark, folder), "code")


def _feeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "record_feeds").select("series", "file_name", "exported_at", "line_no", "payload")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of record fields from file to file: file_name, change, old_path, new_path."""
    return D.drift(_feeds(spark, folder)).select("file_name", "change", "old_path", "new_path")


def p2_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    """The column lifespan catalogue: series, path, kind, first_file, last_file, files."""
    return D.lifespans(_feeds(spark, folder))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all files in one table, renamed fields under their first names; extra fields as JSON text."""
    feeds = _feeds(spark, folder)
    return D.unified(feeds, D.drift(feeds)).withColumn("extra", F.to_json("extra"))
