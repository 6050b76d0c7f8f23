"""Places in one order over a whole table, without any group or table having to fit in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.sources.scratch import materialise, release


def numbered(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df with `at`, 1, 2, ... in the order of `keys` (nulls first, or as the key says), from a range-partitioned sort and the sizes of its parts.

    Rows of one key value are spread over parts if the keys are unique, so a key prefix that holds a third of all rows
    costs no more than any other. Rows with equal keys stand next to each other in no given order.
    """
    parts = materialise(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()  # a row a part
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    out = parts.join(F.broadcast(before), "_part").withColumn("at", (F.col("_before") + rank).cast("bigint")).drop("_part", "_before")
    out._lorekeep_path = parts._lorekeep_path  # released by who writes the result
    return out


def with_previous(df: DataFrame, group: list[str], order: list[str], previous: dict[str, str]) -> DataFrame:
    """df with `at` and, of the row before in the same group, the columns named in `previous` (column: new name); null for a group's first.

    It is `lag` over a window of the group: rows are numbered as in `numbered`, each part is one window of its own, and
    only the first row of a part looks at the last of the part before.
    """
    counted = numbered(df, *group, *order)
    rows = materialise(counted)
    release(counted)
    ahead = rows.select((F.col("at") + 1).alias("at"), *[F.col(g).alias(f"_{g}") for g in group], *[F.col(c).alias(n) for c, n in previous.items()])
    joined = rows.join(ahead, "at", "left")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = joined.select(*rows.columns, *[F.when(same, F.col(n)).alias(n) for n in previous.values()])
    out._lorekeep_path = rows._lorekeep_path
    return out
