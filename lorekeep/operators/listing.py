"""Pages and cut lists, with totals and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _after(order: list[tuple[str, bool]], cursor: dict) -> Column:
    """Rows that follow the cursor's in the order."""
    (name, ascending), rest = order[0], order[1:]
    at = F.lit(cursor[name])
    beyond = F.col(name) > at if ascending else F.col(name) < at
    return beyond | ((F.col(name) == at) & _after(rest, cursor)) if rest else beyond


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, cursor: dict | None = None) -> DataFrame:
    """A page of rows in a total order of columns (name, ascending) after a cursor's row: df's columns, total, more.

    `total` counts all rows, whatever the cursor; `more` marks the page's last row if others follow, so its columns of
    the order are the cursor of the next page. Only limit + 1 rows meet in one place. Nulls in the order are left out of
    what follows a cursor.
    """
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    rest = df.where(_after(order, cursor)) if cursor else df
    taken = rest.orderBy(*keys).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*keys))  # of a page
    rows = taken.withColumn("_n", place).withColumn("_k", F.count("*").over(Window.partitionBy(F.lit(0))))
    total = df.agg(F.count("*").alias("total"))
    return rows.where(F.col("_n") <= limit).crossJoin(F.broadcast(total)).select(*df.columns, "total", ((F.col("_n") == limit) & (F.col("_k") > limit)).alias("more"))


def most_important(df: DataFrame, least: float, limit: int) -> DataFrame:
    """Rows (name, importance) of at least `least`: the first `limit` by importance, then name, with place, total, truncated."""
    fit = df.where(F.col("importance") >= least)
    keys = [F.desc("importance"), F.asc("name")]
    rows = fit.orderBy(*keys).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
    total = fit.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("name", "importance", "place", "total", (F.col("total") > limit).alias("truncated"))
