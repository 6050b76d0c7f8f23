"""Ranks between ranks, schedules, freshness of sources and what their changes invalidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.graph import reach
from lorekeep.operators.ordering import numbered
from lorekeep.sources.scratch import materialise

#: Fixed value: digits of ranks in their order.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def rank_between(low: str, high: str | None) -> str:
    """A text that sorts after `low` and before `high` (None: no end); both of DIGITS. A high that is not above low counts as none."""
    if any(c not in DIGITS for c in low):
        return low + DIGITS[len(DIGITS) // 2]
    if high is not None and (high <= low or any(c not in DIGITS for c in high)):
        high = None
    out = ""
    at = 0
    while True:
        a = DIGITS.index(low[at]) if at < len(low) else 0
        b = DIGITS.index(high[at]) if high is not None and at < len(high) else len(DIGITS)
        if b - a > 1:
            return out + DIGITS[(a + b) // 2]
        if high is not None and at < len(high) and a == b:
            out += DIGITS[a]
        elif high is not None and at < len(high) and len(high) > at + 1:
            return out + DIGITS[b]
        else:
            out += DIGITS[a]
            high = None
        at += 1


#: Seconds after which a missing run is late; the least interval.
LATE, LEAST = 900, 60


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Interval schedules (id, start, every_s, paused, last_run): due, next_due, owed, health.

    `due` is the latest tick after the start that has passed (missed ticks collapse to it), `next_due` the one to come,
    `owed` the latest that passed more than 900 s ago; a paused schedule has none of them. `last_run` is the latest run
    that succeeded or still runs. Health: paused; late if one is owed and no such run came since; else ok. Intervals are
    a minute at least.
    """
    at = F.unix_timestamp(now.cast("timestamp"))
    begin, every = F.unix_timestamp(F.col("start").cast("timestamp")), F.greatest(F.lit(LEAST), F.col("every_s"))
    runs = ~F.coalesce("paused", F.lit(False))

    def latest(moment: Column) -> Column:
        passed = F.floor((moment - begin) / every)
        return F.when(runs & (passed > 0), begin + passed * every)

    owed = latest(at - LATE)
    coming = F.when(runs, begin + (F.greatest(F.lit(0), F.floor((at - begin) / every)) + 1) * every)
    ran = F.unix_timestamp(F.col("last_run").cast("timestamp"))
    health = F.when(~runs, "paused").when(owed.isNotNull() & (ran.isNull() | (ran < owed)), "late").otherwise("ok")
    return schedules.select("id", F.timestamp_seconds(latest(at)).alias("due"), F.timestamp_seconds(coming).alias("next_due"), F.timestamp_seconds(owed).alias("owed"), health.alias("health"))


def progress(tasks: DataFrame) -> DataFrame:
    """Of tasks (id, parent, stage) with children: id, done, total; canceled children do not count."""
    counted = F.coalesce("stage", F.lit("")) != "canceled"
    return tasks.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count_if(counted & (F.col("stage") == "done")).alias("done"), F.count_if(counted).alias("total"))


def column_order(tasks: DataFrame, column: str, rank: str, ident: str) -> DataFrame:
    """`place` from 1 in each column: by rank, those without one after, then by id."""
    rows = materialise(numbered(tasks.withColumn("_last", F.coalesce(F.col(rank), F.lit("")) == ""), column, "_last", rank, ident))
    first = rows.groupBy(F.col(column).alias("_column")).agg(F.min("at").alias("_first"))
    return rows.join(first, rows[column].eqNullSafe(first["_column"])).withColumn("place", F.col("at") - F.col("_first") + 1).drop("at", "_last", "_column", "_first")


def cron_ticks(field_minutes: list[int], field_hours: list[int], days: DataFrame, zone: str = "UTC") -> DataFrame:
    """Ticks (UTC) of a cron line's minutes and hours, in the zone's wall clock, on days (column day, a date): at, each once.

    A wall time that the zone skips has no tick; of one that it has twice the earlier counts.
    """
    hours, minutes = F.array(*[F.lit(h) for h in sorted(set(field_hours))]), F.array(*[F.lit(m) for m in sorted(set(field_minutes))])
    rows = days.select("day", F.explode(hours).alias("h")).select("day", "h", F.explode(minutes).alias("m"))
    wall = F.make_timestamp_ntz(F.year("day"), F.month("day"), F.day("day"), "h", "m", F.lit(0))
    there = rows.select(wall.alias("wall")).withColumn("at", F.convert_timezone(F.lit(zone), F.lit("UTC"), "wall"))
    return there.where(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("at")) == F.col("wall")).select("at").distinct()


def freshness(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """entries (id, file_hash, ast_hash) against sources (id, status, file_hash, ast_hash): id, state.

    Stale stays stale; else the syntax hashes decide if both have one, else the files'; an unknown entry is unknown.
    """
    s = sources.select("id", "status", F.col("file_hash").alias("old_file"), F.col("ast_hash").alias("old_ast"), F.lit(True).alias("known"))
    same = F.when(F.col("ast_hash").isNotNull() & F.col("old_ast").isNotNull(), F.col("ast_hash") == F.col("old_ast")).otherwise(F.col("file_hash").eqNullSafe(F.col("old_file")))
    return entries.join(s, "id", "left").select("id", F.when(F.col("known").isNull(), "unknown").when(F.col("status") == "stale", "stale").when(same, "fresh").otherwise("stale").alias("state"))


def invalidated(changed: DataFrame, depends: DataFrame, depth: int = 10) -> DataFrame:
    """What changes in `changed` (start) invalidate through `depends` (src, dst: src depends on dst): node, hops.

    A start written as 'path#name' names one entry, one without '#' all entries of that name or that path.
    """
    entries = depends.select(F.col("src").alias("node")).union(depends.select("dst")).distinct()
    parts = entries.select("node", F.array_distinct(F.array("node", F.element_at(F.split("node", "#"), -1), F.element_at(F.split("node", "#"), 1))).alias("keys"))
    starts = parts.select("node", F.explode("keys").alias("start")).join(changed.select("start").distinct(), "start").select(F.col("node").alias("start"))
    found = reach(starts.unionByName(changed.select("start")).distinct(), depends.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), depth)
    return found.groupBy("node").agg(F.min("hops").alias("hops"))


def invalidation_counts(found: DataFrame) -> DataFrame:
    """One row: direct (the changed entries), cascade (all others)."""
    return found.agg(F.count_if(F.col("hops") == 0).alias("direct"), F.count_if(F.col("hops") > 0).alias("cascade"))
