"""Validity of records over time, states at a time, timelines, pages and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import entity_key, overlap, words
from lorekeep.sources.scratch import materialise
from lorekeep.sources.tables import canonical_uuid

#: Archive spellings of record kinds, kinds that a newer record can restate, thresholds.
KINDS = {"QuestionAnswered": "qa", "ProblemSolved": "problem_solved", "CodeChanged": "code_change", "DecisionMade": "decision_made", "ConceptDefined": "concept_defined", "RequirementAdded": "requirement_added"}
RESTATABLE = ["decision_made", "requirement_added", "concept_defined"]
RESTATED, DUPLICATE = 0.5, 0.8


def clean_records(records: DataFrame) -> DataFrame:
    """One row a record: the delivery ingested last, its id in one spelling, its kind in the wire's."""
    uid = canonical_uuid(F.col("id"))
    kept = [c for c in records.columns if c != "id"]
    last = records.where(uid.isNotNull()).groupBy(uid.alias("id")).agg(F.max_by(F.struct(*kept), F.col("ingested_at")).alias("x"))
    out = last.select("id", *[F.col(f"x.{c}").alias(c) for c in kept])
    spelled = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    return out.withColumn("update_type", F.coalesce(F.element_at(spelled, F.col("update_type")), F.col("update_type")))


def mentioned(records: DataFrame) -> DataFrame:
    """id, name of all entities that a record mentions, each once: typed, created, referenced, and the ends of its relations."""
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(*[F.coalesce(x, none) for x in (F.transform("typed_entities", lambda e: e["name"]), F.col("creates_entities"), F.col("references_entities"), F.transform("creates_relationships", lambda r: r["from_entity"]), F.transform("creates_relationships", lambda r: r["to_entity"]))]))
    return records.select("id", F.explode(names).alias("name")).where("name <> ''")


def resolved(df: DataFrame, name: str, entities: DataFrame) -> DataFrame:
    """df with `canonical`: the entity of that very name, else the one with an alias of that key, else the name. Of several the smallest."""
    exact = entities.where("name is not null").select(F.col("name").alias(name)).distinct().withColumn("_exact", F.lit(True))
    alias = entities.where("name is not null").select(F.col("name").alias("_of"), F.explode("aliases").alias("_alias")).groupBy(entity_key(F.col("_alias")).alias("_key")).agg(F.min("_of").alias("_of"))
    out = df.join(exact, name, "left").withColumn("_key", entity_key(F.col(name))).join(alias, "_key", "left")
    return out.withColumn("canonical", F.when(F.col("_exact"), F.col(name)).otherwise(F.coalesce("_of", name))).drop("_exact", "_of", "_key")


def validity(records: DataFrame, entities: DataFrame) -> DataFrame:
    """When each record held: id, valid_from, valid_to, ended_by, reason.

    `records` as of `clean_records`. Candidates for an ending are the records that name it in supersedes, the first
    later record with a conflicts_with on an entity pair it related otherwise, and later records of its kind and
    subject (set of entity keys) with half of the title's words in common. The first candidate by (time, id), in this
    order at one record, ends it; forgetting wins if it is earlier. Records of no time are never ended by another.
    Titles meet on the first words of their order that a common half must touch, so a subject of many records isn't
    compared in all pairs.
    """
    r = records.select("id", F.col("timestamp").alias("ts"), "update_type", F.col("content.title").alias("title"), F.col("content.description").alias("description"), "creates_relationships", "meta", "typed_entities", "creates_entities", "references_entities")
    start = r.select("id", "ts", F.coalesce("meta.valid_from", "ts").alias("valid_from"), F.col("meta.retired_at").alias("retired_at"))
    supers = r.select(F.col("id").alias("by"), "ts", F.explode("meta.supersedes").alias("s")).select("by", "ts", canonical_uuid(F.col("s")).alias("id")).where("id is not null and id <> by").select("id", "ts", "by", F.lit(1).alias("branch"), F.lit("superseded").alias("reason"))

    rel = r.select("id", "ts", F.inline("creates_relationships")).where("from_entity is not null and to_entity is not null")
    ends = resolved(resolved(rel, "from_entity", entities).withColumnRenamed("canonical", "cf"), "to_entity", entities).withColumnRenamed("canonical", "ct")
    a, b = entity_key(F.col("cf")), entity_key(F.col("ct"))
    pairs = ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "ts", "id", (F.col("relation_type") == "conflicts_with").alias("conflict"))
    per = pairs.groupBy("a", "b", "ts", "id").agg(F.bool_or("conflict").alias("conflict"), F.bool_or(~F.col("conflict")).alias("other"))
    later = Window.partitionBy("a", "b").orderBy("ts", "id").rowsBetween(1, Window.unboundedFollowing)
    contra = per.withColumn("next", F.min(F.when(F.col("conflict"), F.struct("ts", "id"))).over(later)).where("other and next is not null").select("id", F.col("next.ts").alias("ts"), F.col("next.id").alias("by"), F.lit(2).alias("branch"), F.lit("contradicted").alias("reason"))

    said = resolved(mentioned(r), "name", entities).groupBy("id").agg(F.array_sort(F.collect_set(entity_key(F.col("canonical")))).alias("subject"))
    some = r.where(F.col("update_type").isin(RESTATABLE)).join(said, "id").select("id", "ts", F.xxhash64("update_type", "subject").alias("topic"), F.array_sort(words(F.coalesce("title", F.lit("")))).alias("tw"), words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))).alias("all"))
    first = F.slice("tw", 1, F.greatest(F.lit(0), F.size("tw") - F.ceil(F.size("tw") * F.lit(RESTATED)).cast("int") + 1))
    keyed = some.select("*", F.explode(first).alias("word"))
    old, new = keyed.select(*[F.col(c).alias(f"o_{c}") for c in keyed.columns]), keyed
    same = old.join(new, (F.col("o_topic") == F.col("topic")) & (F.col("o_word") == F.col("word"))).where((F.struct("o_ts", "o_id") < F.struct("ts", "id")) & (overlap(F.col("o_tw"), F.col("tw")) >= RESTATED))
    restated = same.select(F.col("o_id").alias("id"), "ts", F.col("id").alias("by"), F.lit(3).alias("branch"), F.when(overlap(F.col("o_all"), F.col("all")) >= DUPLICATE, "duplicate").otherwise("restated").alias("reason"))

    ended = supers.unionByName(contra).unionByName(restated).groupBy("id").agg(F.min_by(F.struct("by", "reason"), F.struct("ts", "by", "branch")).alias("x")).select("id", "x.by", "x.reason")
    froms = start.select(F.col("id").alias("by"), F.col("valid_from").alias("by_from"))
    out = start.join(ended, "id", "left").join(froms, "by", "left").withColumn("end", F.when(F.col("by").isNotNull(), F.greatest("by_from", "valid_from")))
    retired = F.col("retired_at").isNotNull() & (F.col("end").isNull() | (F.col("retired_at") < F.col("end")))
    return out.select("id", "valid_from", F.when(retired, F.greatest("retired_at", "valid_from")).otherwise(F.col("end")).alias("valid_to"), F.when(~retired, F.col("by")).alias("ended_by"), F.when(retired, "forgotten").otherwise(F.col("reason")).alias("reason"))


def holds_at(t: Column) -> Column:
    """Half-open: valid_from <= t < valid_to."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def timeline(valid: DataFrame, low: Column, high: Column, limit: int) -> DataFrame:
    """Events recorded and ended in [low, high]: at, event, id; the latest `limit`."""
    began = valid.select(F.col("valid_from").alias("at"), F.lit("recorded").alias("event"), "id")
    ended = valid.where("valid_to is not null").select(F.col("valid_to").alias("at"), F.lit("ended").alias("event"), "id")
    return began.unionByName(ended).where(F.col("at").between(low, high)).orderBy(F.desc("at"), F.desc("event"), F.desc("id")).limit(limit)


def edge_validity(records: DataFrame, valid: DataFrame) -> DataFrame:
    """Of each relation: src, dst, type, start, end (null while a record that says so holds), records."""
    rel = records.select("id", F.inline("creates_relationships")).where("from_entity is not null and to_entity is not null")
    met = rel.join(valid, "id").groupBy(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), F.col("relation_type").alias("type"))
    return met.agg(F.min("valid_from").alias("start"), F.when(F.bool_or(F.col("valid_to").isNull()), F.lit(None)).otherwise(F.max("valid_to")).alias("end"), F.countDistinct("id").alias("records"))


def asserted(records: DataFrame, valid: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each relation between canonical entities: src, dst, type, first and last (records by time, id), start, end, records."""
    rel = records.select("id", F.col("timestamp").alias("ts"), F.inline("creates_relationships")).where("from_entity is not null and to_entity is not null")
    ends = resolved(resolved(rel, "from_entity", entities).withColumnRenamed("canonical", "src"), "to_entity", entities).withColumnRenamed("canonical", "dst")
    met = ends.join(valid.select("id", "valid_from", "valid_to"), "id").groupBy("src", "dst", F.col("relation_type").alias("type"))
    by = F.struct("ts", "id")
    return met.agg(F.min_by("id", by).alias("first"), F.max_by("id", by).alias("last"), F.min("valid_from").alias("start"), F.when(F.bool_or(F.col("valid_to").isNull()), F.lit(None)).otherwise(F.max("valid_to")).alias("end"), F.countDistinct("id").alias("records"))


def graph_timeline(records: DataFrame, valid: DataFrame, entities: DataFrame, low: Column, high: Column, limit: int) -> DataFrame:
    """The latest `limit` events in [low, high]: at, event, id, src, dst, type, session_id, update_type, title, reason, total.

    Records written and ended, relations added (by the first record that says so) and ended (with the last one that
    held). At one instant endings come before beginnings, then records in order; `total` counts before the limit.
    """
    none = [F.lit(None).cast("string").alias(c) for c in ("src", "dst", "type")]
    rel = materialise(asserted(records, valid, entities))
    found = records.select(F.col("timestamp").alias("at"), F.lit(2).alias("n"), "id", *none)
    found = found.unionByName(valid.select(F.col("valid_to").alias("at"), F.lit(0).alias("n"), "id", *none))
    found = found.unionByName(rel.select(F.col("start").alias("at"), F.lit(3).alias("n"), F.col("first").alias("id"), "src", "dst", "type"))
    found = found.unionByName(rel.select(F.col("end").alias("at"), F.lit(1).alias("n"), F.col("last").alias("id"), "src", "dst", "type")).where(F.col("at").between(low, high))
    total = found.agg(F.count("*").alias("total"))
    latest = found.orderBy(*[F.desc(c) for c in ("at", "n", "id", "src", "dst", "type")]).limit(limit)
    event = F.element_at(F.array(*[F.lit(x) for x in ("ended", "relation_ended", "recorded", "relation_added")]), F.col("n") + 1)
    about = records.select("id", "session_id", "update_type", F.col("content.title").alias("title"))
    latest = materialise(latest)  # a bounded number of rows, so records and validity are not shuffled for them
    why = valid.select("id", F.col("reason").alias("why")).join(F.broadcast(latest.select("id").distinct()), "id")
    out = about.join(F.broadcast(latest), "id").join(F.broadcast(why), "id", "left").crossJoin(F.broadcast(total))
    return out.select("at", event.alias("event"), "id", "src", "dst", "type", "session_id", "update_type", "title", F.when(F.col("n") < 2, F.col("why")).alias("reason"), "total")


def page(df: DataFrame, at: str, ident: str, after: tuple[object, object] | None, size: int) -> DataFrame:
    """A page newest first after a cursor (time, id): at most size + 1 rows; the last one tells that more follow."""
    if after is not None:
        t, i = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(at) < t) | ((F.col(at) == t) & (F.col(ident) < i)))
    return df.orderBy(F.desc(at), F.desc(ident)).limit(size + 1)


def browse(records: DataFrame, valid: DataFrame, kinds: list[str] | None = None, text: str | None = None, entity: str | None = None, state: str = "any") -> DataFrame:
    """Records that pass all filters given: kinds, text in title, description or a detail, a mentioned entity, current or ended."""
    out = records
    if kinds:
        out = out.where(F.col("update_type").isin(kinds))
    if text:
        t = text.lower()
        hit = F.lower("content.title").contains(t) | F.lower("content.description").contains(t) | F.exists("content.details", lambda d: F.lower(d).contains(t))
        out = out.where(F.coalesce(hit, F.lit(False)) | F.coalesce(F.lower("content.description").contains(t), F.lit(False)) | F.coalesce(F.exists("content.details", lambda d: F.coalesce(F.lower(d).contains(t), F.lit(False))), F.lit(False)))
    if entity:
        out = out.join(mentioned(records).where(F.col("name") == entity), "id", "left_semi")
    if state != "any":
        out = out.join(valid.where("valid_to is null" if state == "current" else "valid_to is not null"), "id", "left_semi")
    return out


def message_stats(messages: DataFrame) -> DataFrame:
    """Of each session: count, first and last seq and time, authors in order."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"))


def overview(records: DataFrame, valid: DataFrame, now: Column) -> DataFrame:
    """One row: records, of the last day and week, current ones, sessions, sessions active within a week."""
    r = records.join(valid.select("id", F.col("valid_to").isNull().alias("holds")), "id")
    week, day = F.col("timestamp") > now - F.expr("INTERVAL 7 DAY"), F.col("timestamp") > now - F.expr("INTERVAL 1 DAY")
    return r.agg(F.count("*").alias("records"), F.count_if(day).alias("day"), F.count_if(week).alias("week"), F.count_if("holds").alias("current"), F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.when(week, F.col("session_id"))).alias("active"))


def file_touches(records: DataFrame) -> DataFrame:
    """Of each file: count, latest time, kind of the latest record."""
    files = records.where("related_code.file_path is not null and related_code.file_path <> ''")
    return files.groupBy(F.col("related_code.file_path").alias("path")).agg(F.count("*").alias("touches"), F.max("timestamp").alias("last_at"), F.max_by("update_type", F.struct("timestamp", "id")).alias("last_kind"))


def flow_cap(df: DataFrame, key: str, order: list[str], most: int = 500, dropped: int = 50) -> DataFrame:
    """The newest of each key: beyond `most` the oldest go in steps of `dropped`."""
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    keep = F.col("_n") - dropped * F.ceil(F.greatest(F.lit(0), F.col("_n") - most) / dropped)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.join(sizes, key).withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r", "_n")
