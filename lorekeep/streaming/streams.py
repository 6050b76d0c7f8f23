"""Streams of messages and events: idempotent appends, retention, watching with catch-up, per-key state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str | object, files_a_batch: int = 100) -> DataFrame:
    """The append-only log of a folder; each follower keeps its cursor in its checkpoint, so acknowledging is committing a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once(events: DataFrame, ident: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """Events of an id once within the delay; the state of older ids is evicted. Null ids count as one id."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(ident)


def triggered(events: DataFrame, name: str, kind: str, where: Column | None = None) -> DataFrame:
    """Events of a name whose payload passes a condition."""
    out = events.where(F.col(kind) == name)
    return out.where(where) if where is not None else out


def holds_rows(spark: SparkSession, folder: str) -> bool:
    """Whether a folder exists and holds a Parquet file; an error of the file system is raised, not taken for an empty folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(path)) and any(f.getPath().getName().endswith(".parquet") for f in system.listStatus(path))


def watch(events: DataFrame, since: Column, at: str, ident: str, sink: str, checkpoint: str, once_only: bool = True) -> StreamingQuery:
    """Catches up from `since`, then follows: writes each unseen id once to the Parquet folder `sink`.

    What was written is anti-joined, so a batch that is run again after a failure adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(at) >= since).dropDuplicates([ident])
        out = fresh.join(spark.read.parquet(sink).select(ident), ident, "left_anti") if holds_rows(spark, sink) else fresh
        out.withColumn("_batch", F.lit(number)).write.mode("append").parquet(sink)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer).start()


def running_stats(events: DataFrame, key: str, at: str) -> DataFrame:
    """Count, first and last time by key, updated with each batch."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def conversation_states(events: DataFrame) -> DataFrame:
    """The state of each conversation (key, at, kind prompt/end, stop): running, idle or failed, from the newest prompt and end."""
    agg = events.groupBy("key").agg(F.max(F.when(F.col("kind") == "prompt", F.col("at"))).alias("prompt"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("end"), F.max_by("stop", F.when(F.col("kind") == "end", F.col("at"))).alias("stop"))
    running = F.col("prompt").isNotNull() & (F.col("end").isNull() | (F.col("end") < F.col("prompt")))
    return agg.select("key", F.when(running, "running").when(F.col("stop") == "failed", "failed").otherwise("idle").alias("state"))


def key_values(changes: DataFrame, merge: Callable[[str | None, str], str]) -> DataFrame:
    """State a key over a stream of changes (key, value): key, value, version after each batch; `merge` folds a change into the old value."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        value, version = state.get if state.exists else (None, 0)
        for pdf in batches:
            for change in pdf["value"]:
                value, version = merge(value, change), version + 1
        state.update((value, version))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "version": [version]})

    return changes.groupBy("key").applyInPandasWithState(run, "key string, value string, version bigint", "value string, version bigint", "update", "NoTimeout")


def awaited(events: DataFrame, timeout_ms: int) -> DataFrame:
    """Of each key (key, kind ask/answer, at): 'answered' when both came, 'timeout' when the watermark passes the ask by the timeout."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "outcome": ["timeout"]})
            return
        asked, answered, at = state.get if state.exists else (False, False, 0)
        for pdf in batches:
            asked = asked or bool((pdf["kind"] == "ask").any())
            answered = answered or bool((pdf["kind"] == "answer").any())
            at = max(at, int(pdf["at"].max().timestamp() * 1000))
        if asked and answered:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"key": [key[0]], "outcome": ["answered"]})
            return
        state.update((asked, answered, at))
        state.setTimeoutTimestamp(at + timeout_ms)

    return events.groupBy("key").applyInPandasWithState(run, "key string, outcome string", "asked boolean, answered boolean, at bigint", "append", "EventTimeTimeout")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns the rows of its memory table (for tests and small results)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
