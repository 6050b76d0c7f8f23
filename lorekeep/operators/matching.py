"""Entities in texts by whole names and by parts of names, and what surrounds the named ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import name_tokens
from lorekeep.operators.graph import impact_steps, reach


def _pairs_of(c: Column) -> Column:
    """All distinct runs of two characters."""
    at = F.when(F.char_length(c) >= 2, F.sequence(F.lit(1), F.char_length(c) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: c.substr(i, F.lit(2))))


def entities_in(texts: DataFrame, ident: str, text: str, entities: DataFrame) -> DataFrame:
    """Entities (name) that texts name: ident, name, in_text, score.

    First those whose name stands in the text (score: ten a byte); else those of whose parts enough match a word of the
    text, one being the beginning of the other with three bytes at least: all of up to two parts, two fifths of more
    (score: five a part, one a byte). Names of one byte name nothing; null texts and names give no row. Texts and names
    meet on the name's first two characters, parts and words on their first three, so no text is held against all names.
    """
    t = texts.where(F.col(text).isNotNull()).select(F.col(ident), F.lower(text).alias("low"))
    names = entities.where("name is not null").select("name", F.lower("name").alias("key")).distinct().where(F.octet_length("key") >= 2)
    heads = names.select("name", "key", F.when(F.char_length("key") >= 2, F.substring("key", 1, 2)).alias("head"))
    whole = t.select(ident, "low", F.explode(_pairs_of(F.col("low"))).alias("head")).join(heads.where("head is not null"), "head").where(F.contains("low", "key"))
    lone = heads.where("head is null")  # one character of two bytes or more
    single = t.select(ident, F.explode(F.array_distinct(F.split("low", ""))).alias("key")).join(lone.select("name", "key"), "key")
    whole = whole.select(ident, "name", "key").unionByName(single.select(ident, "name", "key")).select(ident, "name", F.lit(True).alias("in_text"), (10 * F.octet_length("key")).cast("bigint").alias("score"))
    words = t.select(ident, F.explode(F.array_distinct(F.split("low", r"[^\p{L}\p{N}_]+"))).alias("word")).where(F.octet_length("word") >= 3)
    parts = names.withColumn("parts", name_tokens(F.col("name"))).select("name", "key", F.size("parts").alias("count"), F.posexplode("parts").alias("at", "part")).where(F.octet_length("part") >= 3)
    met = words.withColumn("head", F.substring("word", 1, 1)).join(parts.withColumn("head", F.substring("part", 1, 1)), "head").where(F.startswith("word", "part") | F.startswith("part", "word"))
    hit = met.groupBy(ident, "name", "key", "count").agg(F.countDistinct("at").alias("hit"))
    need = F.when(F.col("count") <= 2, F.col("count")).otherwise(F.greatest(F.lit(1), F.ceil(2 * F.col("count") / 5)))
    by_parts = hit.where(F.col("hit") >= need).select(ident, "name", F.lit(False).alias("in_text"), (5 * F.col("hit") + F.octet_length("key")).cast("bigint").alias("score"))
    return whole.unionByName(by_parts.join(whole.select(ident, "name"), [ident, "name"], "left_anti"))


def query_context(named: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Around named entities (item_id, name): item_id, entity, relevance (direct, neighbour, impact), via, hops.

    Neighbours are one relation away, either way; impact is what depends on the named ones within `depth` hops. `via` is
    the named entity by which one came in (the nearest, then the first by name); what is named is listed as direct only.
    """
    named = named.select("item_id", "name").distinct()
    direct = named.select("item_id", F.col("name").alias("entity"), F.lit("direct").alias("relevance"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("hops"))
    ends = edges.select(F.col("src").alias("name"), F.col("dst").alias("entity")).unionByName(edges.select(F.col("dst").alias("name"), F.col("src").alias("entity"))).distinct()
    near = named.join(ends, "name").groupBy("item_id", "entity").agg(F.min("name").alias("via")).select("item_id", "entity", F.lit("neighbour").alias("relevance"), "via", F.lit(1).alias("hops"))
    found = reach(named.select(F.col("name").alias("start")), impact_steps(edges), depth).where("hops > 0")
    far = named.join(found, named["name"] == found["start"]).groupBy("item_id", F.col("node").alias("entity")).agg(F.min(F.struct("hops", "name")).alias("x")).select("item_id", "entity", F.lit("impact").alias("relevance"), F.col("x.name").alias("via"), F.col("x.hops").alias("hops"))
    return direct.unionByName(near.unionByName(far).join(direct.select("item_id", "entity"), ["item_id", "entity"], "left_anti"))


def entity_details(mentions: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each mentioned entity: relations (either way), records, decisions, files, authors; all counts of distinct ones."""
    about = mentions.select("entity", "id", "kind").join(records.select("id", F.col("related_code.file_path").alias("path"), "author"), "id")
    counts = about.groupBy("entity").agg(F.countDistinct("id").alias("records"), F.countDistinct(F.when(F.col("kind") == "decision_made", F.col("id"))).alias("decisions"), F.countDistinct(F.when(F.col("path") != "", F.col("path"))).alias("files"), F.countDistinct("author").alias("authors"))
    ends = edges.select(F.col("src").alias("entity")).unionByName(edges.select(F.col("dst").alias("entity"))).groupBy("entity").agg(F.count("*").alias("relations"))
    return counts.join(ends, "entity", "left").select("entity", F.coalesce("relations", F.lit(0)).cast("bigint").alias("relations"), "records", "decisions", "files", "authors")


def ranked_risks(found: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """The first records about what depends on each start (found: start, node, hops): start, id, about, hops, place.

    By hop, then the newest, then id; a record about several counts for the nearest, then the first by name.
    """
    about = found.join(mentions.select(F.col("entity").alias("node"), "id", "ts"), "node").groupBy("start", "id").agg(F.min(F.struct("hops", "node")).alias("x"), F.max("ts").alias("ts"))
    order = Window.partitionBy("start").orderBy("hops", F.desc("ts"), "id")
    rows = about.select("start", "id", F.col("x.node").alias("about"), F.col("x.hops").alias("hops"), "ts").withColumn("place", F.row_number().over(order).cast("bigint"))
    return rows.where(F.col("place") <= most).select("start", "id", "about", "hops", "place")
