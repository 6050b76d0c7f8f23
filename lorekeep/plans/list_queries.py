"""Queries of data blocks (lists, expressions, constraints) on events, orders and lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import lists as L
from lorekeep.plans import expressions as X
from lorekeep.sources.tables import table

SQL: dict[str, str] = {}


def filter_distinct_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a value above 50, the first of each user, the first ten of them."""
    return L.filter_items(table(spark, folder, "events").select("event_id", "user_id", "value"), "event_id", "value > 50.0", "user_id", 10)


SQL["filter_distinct_limit"] = """SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events WHERE value > 50) WHERE rn = 1 ORDER BY event_id LIMIT 10"""


def filter_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Kept and dropped of a filter with distinct keys."""
    e = table(spark, folder, "events").select("event_id", "user_id", "value")
    return L.kept_and_dropped(e, L.filter_items(e, "event_id", "value > 50.0 && user_id % 2 == 0", "user_id / 10"))


SQL["filter_dropped"] = """WITH k AS (SELECT count(DISTINCT user_id // 10) kept FROM events WHERE value > 50 AND user_id % 2 = 0) SELECT kept, (SELECT count(*) FROM events) - kept AS dropped FROM k"""


def transform_items(spark: SparkSession, folder: str) -> DataFrame:
    """A record an order with typed fields and zero values."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return L.transform_items(o, {"key": ("bigint", "o_orderkey"), "band": ("string", "o_totalprice > 200000.0 ? 'high' : o_totalprice > 100000.0 ? 'middle' : 'low'"), "half": ("bigint", "o_custkey / 2"), "urgent": ("boolean", "o_orderpriority.startsWith('1')"), "note": ("string", None), "score": ("double", None)})


SQL["transform_items"] = """SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, o_custkey // 2 AS half, starts_with(o_orderpriority, '1') AS urgent, '' AS note, CAST(0 AS DOUBLE) AS score FROM orders"""


def transform_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by nation, descending, ties in their own order. The position is the result, so one global order is made."""
    return L.sort_items(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey", F.col("c_nationkey"), descending=True)


SQL["transform_sort"] = """SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1 AS position FROM customer"""


def transform_group(spark: SparkSession, folder: str) -> DataFrame:
    """A1: orders grouped by customer in order of first appearance."""
    g = L.group_items(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", F.col("o_orderkey"))
    return g.select("key", "first", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


SQL["transform_group"] = """SELECT o_custkey AS key, min(o_orderkey) AS first, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey"""


def _rules(df: DataFrame) -> list[L.Rule]:
    rules = L.constraint("o_totalprice", minimum=1000.0, maximum=300000.0) + L.constraint("o_orderpriority", max_length=8, pattern="[1-5]-.*") + L.constraint("o_orderstatus", one_of=["O", "F"])
    return [*rules, L.custom(df, 0, "o_custkey % 7 != 0", "customer")]


def validate_violations(spark: SparkSession, folder: str) -> DataFrame:
    """All violations of the rules on orders."""
    o = table(spark, folder, "orders")
    return L.validate_items(o, "o_orderkey", _rules(o)).select("index", "path", "rule")


SQL["validate_violations"] = """SELECT o_orderkey AS index, 'o_totalprice' AS path, 'minimum' AS rule FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, 'o_totalprice', 'maximum' FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT o_orderkey, 'o_orderpriority', 'max_length' FROM orders WHERE length(o_orderpriority) > 8 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern' FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-.*')
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'one_of' FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'rules[0]', 'custom' FROM orders WHERE o_custkey % 7 = 0"""


def validate_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 violations and the number of the rest."""
    o = table(spark, folder, "orders")
    return L.failure_summary(L.validate_items(o, "o_orderkey", [L.custom(o, 0, "o_custkey % 7 != 0", "customer")]))


SQL["validate_summary"] = """WITH v AS (SELECT o_orderkey k FROM orders WHERE o_custkey % 7 = 0), f AS (SELECT string_agg('items[' || k || '].rules[0]: customer', '; ' ORDER BY k) s FROM (SELECT k FROM v ORDER BY k LIMIT 20)) SELECT CASE WHEN n > 20 THEN s || '; and ' || (n - 20) || ' more' ELSE s END AS summary, n AS violations FROM f, (SELECT count(*) n FROM v)"""


def json_projection(spark: SparkSession, folder: str) -> DataFrame:
    """A path into JSON text."""
    return table(spark, folder, "events").select("event_id", X.json_path(F.col("props"), "$.k").cast("bigint").alias("k"))


SQL["json_projection"] = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


def json_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of the first, the last and all blocks of messages, by index, from the end and by *."""
    m = table(spark, folder, "messages").where("blocks is not null")
    return m.select("turn_id", "seq", X.json_path(F.col("blocks"), "$[0].type").alias("first"), X.json_path(F.col("blocks"), "$[-1].type").alias("last"), X.json_path(F.col("blocks"), "$[1:].type").alias("rest"))


SQL["json_slices"] = """WITH m AS (SELECT turn_id, seq, TRY_CAST(blocks AS JSON) j FROM messages WHERE blocks IS NOT NULL), x AS (SELECT turn_id, seq, CASE WHEN json_type(j) = 'ARRAY' THEN list_filter(json_extract(j, '$[*].type'), lambda v: v IS NOT NULL) END every,
json_extract(j, '$[0].type') f, json_extract(j, '$[#-1].type') l, CASE WHEN json_array_length(j) > 1 THEN list_filter(list_transform(range(1, CAST(json_array_length(j) AS BIGINT)), lambda i: json_extract(j, '$[' || i || '].type')), lambda v: v IS NOT NULL) END r FROM m)
SELECT turn_id, seq, CAST(f AS VARCHAR) AS first, CAST(l AS VARCHAR) AS last, CASE WHEN r IS NULL OR len(r) = 0 THEN NULL WHEN len(r) = 1 THEN CAST(r[1] AS VARCHAR) ELSE '[' || array_to_string(list_transform(r, lambda v: CAST(v AS VARCHAR)), ',') || ']' END AS rest FROM x"""


def list_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Sums, slices, ranges, distinct values and macros over the orders of a customer, by expression."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))).alias("keys"))
    names = X.row_names(o.dtypes)
    made = {"total": "lists.sum(keys)", "numbers": "size(lists.range(size(keys)))", "head": "lists.sum(lists.slice(keys, 0, 1))", "residues": "size(lists.distinct(keys.map(k, k % 3)))", "even": "size(keys.filter(k, k % 2 == 0))", "some": "keys.exists(k, k % 5 == 0)", "every": "keys.all(k, k > 10)", "flat": "size(lists.flatten([keys, keys]))"}
    return o.select("o_custkey", *[X.compile_expression(text, names).column.alias(n) for n, text in made.items()])


SQL["list_functions"] = """SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS total, count(*) AS numbers, CAST(min(o_orderkey) AS BIGINT) AS head, count(DISTINCT o_orderkey % 3) AS residues, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS even, bool_or(o_orderkey % 5 = 0) AS some, bool_and(o_orderkey > 10) AS every, 2 * count(*) AS flat FROM orders GROUP BY o_custkey"""


def template_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with slots."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return e.select("event_id", X.template("user {{ user_id }}: {{ event_type.upperAscii() }} ({{ size(event_type) }})", X.row_names(e.dtypes)).alias("text"))


SQL["template_fill"] = """SELECT event_id, 'user ' || user_id || ': ' || upper(event_type) || ' (' || length(event_type) || ')' AS text FROM events"""


def metric_samples(spark: SparkSession, folder: str) -> DataFrame:
    """SC18, W8: samples of [seconds, "value"] as text, cast with NaN and infinities, averaged by steps of a sixtieth of the range."""
    e = table(spark, folder, "events").select("event_type", F.to_json(F.array(F.unix_timestamp("ts").cast("string"), F.col("value").cast("string"))).alias("sample"))
    pair = F.from_json("sample", "array<string>")
    read = e.select("event_type", pair[0].try_cast("bigint").alias("at"), pair[1].try_cast("double").alias("value"))
    span = read.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    step = F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low")) / 60))
    return read.crossJoin(F.broadcast(span)).groupBy("event_type", F.floor((F.col("at") - F.col("low")) / step).alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


SQL["metric_samples"] = """WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) sec, value FROM events), s AS (SELECT min(sec) low, greatest(1, (max(sec) - min(sec)) // 60) step FROM e) SELECT event_type, (sec - low) // step AS step, count(*) AS n, round(avg(value), 6) AS mean FROM e, s GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (filter_distinct_limit, filter_dropped, transform_items, transform_sort, transform_group, validate_violations, validate_summary, json_projection, json_slices, list_functions, template_fill, metric_samples)}
