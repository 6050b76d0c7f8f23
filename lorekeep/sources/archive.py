"""Writes and reads: archives, merging of histories, idempotent appends, upserts, deletes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: archive versions that can be read.
VERSIONS = [f"1.{n}.0" for n in range(11)] + ["1.4.1"]
SECTIONS = ("sessions", "messages", "embeddings", "cards", "documents", "checkpoints")


def export_archive(tables: dict[str, DataFrame], folder: str, version: str = "1.10.0") -> None:
    """A folder a section with JSON lines in many files, and a manifest of version and counts. Nothing passes the driver."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{folder}/{name}")
        counts.append((name, df.schema.json(), spark.read.text(f"{folder}/{name}").count()))
    spark.createDataFrame(counts, "section string, fields string, rows bigint").withColumn("format_version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def preview_archive(spark: SparkSession, folder: str) -> DataFrame:
    """section, rows, format_version, readable."""
    return spark.read.schema("section string, rows bigint, format_version string").json(f"{folder}/manifest").withColumn("readable", F.col("format_version").isin(VERSIONS))


def import_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The sections of an archive with the schemas it was written with; an unknown version is an error."""
    from pyspark.sql.types import StructType

    rows = spark.read.schema("section string, fields string, format_version string").json(f"{folder}/manifest").collect()  # a row a section
    if any(r.format_version not in VERSIONS for r in rows):
        raise ValueError(f"archive version {rows[0].format_version}")
    import json

    return {r.section: spark.read.schema(StructType.fromJson(json.loads(r.fields))).json(f"{folder}/{r.section}") for r in rows}


def merge_history(archive: DataFrame, target: DataFrame, overwrite: bool = False, newer: bool = False) -> DataFrame:
    """Versioned histories (id, version, content, written_at) of an archive merged into a target's.

    Out: the merged rows with `action` of the id: keep, add or replace, and `conflict` (overwrite, update, keep or null).
    Same latest content, or a target that continues the archive: kept. An archive that continues the target adds its
    later versions. Diverged: replaced with `overwrite`; with `newer` and a later time the archive's latest becomes the
    target's next version; else kept. (id, version) must be unique on each side.
    """
    cols = ["version", "content", "written_at"]
    both = archive.select("id", *[F.col(c).alias(f"a_{c}") for c in cols], F.col("version").alias("version")).join(target.select("id", *[F.col(c).alias(f"t_{c}") for c in cols], F.col("version").alias("version")), ["id", "version"], "full")
    same = F.col("a_content").eqNullSafe(F.col("t_content")) & F.col("a_version").isNotNull() & F.col("t_version").isNotNull()
    per = both.groupBy("id").agg(
        F.max("a_version").alias("a_last"), F.max("t_version").alias("t_last"), F.max_by("a_content", F.when(F.col("a_version").isNotNull(), F.col("version"))).alias("a_end"), F.max_by("t_content", F.when(F.col("t_version").isNotNull(), F.col("version"))).alias("t_end"),
        F.max_by("a_written_at", F.when(F.col("a_version").isNotNull(), F.col("version"))).alias("a_at"), F.max_by("t_written_at", F.when(F.col("t_version").isNotNull(), F.col("version"))).alias("t_at"),
        F.bool_and(F.col("t_version").isNull() | same).alias("on"), F.bool_and(F.col("a_version").isNull() | same).alias("ahead"),
    )
    diverged = F.col("a_last").isNotNull() & F.col("t_last").isNotNull() & ~F.col("a_end").eqNullSafe(F.col("t_end")) & ~F.col("on") & ~F.col("ahead")
    later = F.coalesce(F.col("a_at") > F.col("t_at"), F.lit(False))
    conflict = F.when(diverged & F.lit(overwrite), "overwrite").when(diverged & F.lit(newer) & later, "update").when(diverged, "keep")
    grows = F.col("t_last").isNull() | (F.col("a_last").isNotNull() & ~F.col("a_end").eqNullSafe(F.col("t_end")) & F.col("on"))
    action = F.when(conflict == "overwrite", "replace").when((conflict == "update") | (conflict.isNull() & grows), "add").otherwise("keep")
    per = per.select("id", "a_last", "t_last", action.alias("action"), conflict.alias("conflict"))
    rows = both.join(per, "id")
    ours = rows.where("t_version is not null and action <> 'replace'").select("id", F.col("t_version").alias("version"), F.col("t_content").alias("content"), F.col("t_written_at").alias("written_at"), "action", "conflict")
    theirs = rows.where("a_version is not null and (action = 'replace' or (action = 'add' and ((conflict is null and (t_last is null or a_version > t_last)) or (conflict = 'update' and a_version = a_last))))")
    number = F.when(F.col("conflict") == "update", F.col("t_last") + 1).otherwise(F.col("a_version"))
    return ours.unionByName(theirs.select("id", number.alias("version"), F.col("a_content").alias("content"), F.col("a_written_at").alias("written_at"), "action", "conflict"))


def append_messages(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """New turns with dense positions after those stored: arriving (session_id, turn_id, ...) with `seq`.

    A turn stored or sent before is left out. Positions follow the arriving `pos`; they are never used again.
    """
    first = arriving.groupBy("session_id", "turn_id").agg(F.min_by(F.struct(*[c for c in arriving.columns if c not in ("session_id", "turn_id")]), "pos").alias("x")).select("session_id", "turn_id", "x.*")
    fresh = first.join(stored.select("session_id", "turn_id"), ["session_id", "turn_id"], "left_anti")
    last = stored.groupBy("session_id").agg(F.max("seq").alias("last"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos", "turn_id"))
    return fresh.join(last, "session_id", "left").withColumn("seq", (F.coalesce("last", F.lit(-1)) + rank).cast("bigint")).drop("last")


def upsert_vectors(stored: DataFrame, arriving: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Stored vectors (session_id, content_id, vector, pos) with arriving ones in place of those of the same key; and one row: rejected.

    Vectors of another dimension (or null) are rejected and counted; of one key the last by pos holds.
    """
    fits = F.coalesce(F.size("vector") == dimension, F.lit(False))
    both = stored.unionByName(arriving.where(fits))
    rest = [c for c in both.columns if c not in ("session_id", "content_id")]
    kept = both.groupBy("session_id", "content_id").agg(F.max_by(F.struct(*rest), F.col("pos")).alias("x")).select("session_id", "content_id", "x.*")
    return kept, arriving.agg(F.count_if(~fits).alias("rejected"))


def delete_cascade(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries whose id, and whose chunk's parent ('<id>#n'), is not in `ids` (content_id)."""
    return entries.withColumn("_base", F.regexp_replace("content_id", r"#\d+$", "")).join(ids.select(F.col("content_id").alias("_base")).distinct(), "_base", "left_anti").drop("_base")


def retained(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return df.where(F.col(at) >= cutoff)


def select_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the given content ids, with the chunks of each."""
    return entries.withColumn("_base", F.regexp_replace("content_id", r"#\d+$", "")).join(ids.select(F.col("content_id").alias("_base")).distinct(), "_base", "left_semi").drop("_base")
