"""List operators with exact order: filter, transform, sort, group, validate.

Every operator takes an explicit order column; survivors and ties follow it, never the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.ordering import numbered
from lorekeep.plans.expressions import Typed, compile_expression, row_names


def filter_items(df: DataFrame, order: str, where: str | None = None, distinct_by: str | None = None, limit: int = 0, names: dict[str, Typed] | None = None) -> DataFrame:
    """Rows that pass `where`; of each key of `distinct_by` the first in order; then at most `limit` (0: all).

    Expressions see the columns (and `names`). Keys may be string, int or bool; a null key is a key. The rows of a key
    meet after each partition has kept its own first. `order` must be unique.
    """
    names = row_names(df.dtypes) | (names or {})
    out = df.where(compile_expression(where, names, "bool").column) if where else df
    if distinct_by:
        key = compile_expression(distinct_by, names)
        if key.type not in ("string", "int", "bool"):
            raise ValueError(f"distinct_by of {key.type}")
        first = out.groupBy(key.column.alias("_key")).agg(F.min_by(F.struct(*out.columns), F.col(order)).alias("_row"))
        out = first.select("_row.*")
    return out.orderBy(order).limit(limit) if limit else out


def kept_and_dropped(df: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: kept and dropped, the latter of all rows of `df` that are not kept, evaluated or not."""
    return df.agg(F.count("*").alias("_all")).crossJoin(kept.agg(F.count("*").alias("kept"))).select("kept", (F.col("_all") - F.col("kept")).alias("dropped"))


#: What a field without a value becomes.
ZERO = {"string": "''", "bigint": "0L", "int": "0", "double": "0.0D", "boolean": "false"}


def transform_items(df: DataFrame, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One record a row: fields maps a name to (type, expression); no expression or null gives the type's zero value."""
    names = row_names(df.dtypes)
    out = []
    for name, (kind, text) in fields.items():
        zero = F.expr(ZERO[kind])
        out.append((F.coalesce(compile_expression(text, names).column.cast(kind), zero) if text else zero).alias(name))
    return df.select(*out)


def transform_value(spark: SparkSession, value: dict, schema: str, fields: dict[str, tuple[str, str | None]]) -> dict:
    """`transform_items` of one value, which has the columns of `schema`: one record."""
    return transform_items(spark.createDataFrame([value], schema), fields).first().asDict()


def sort_items(df: DataFrame, order: str, by: Column, descending: bool = False) -> DataFrame:
    """Rows with `position` from 0 in the stable order by `by`; ties stay in the order of `order`, descending too.

    Positions come from a range-partitioned sort and the sizes of its parts, so no task holds the table.
    """
    keyed = df.withColumn("_by", by)
    placed = numbered(keyed, F.col("_by").desc() if descending else F.col("_by").asc(), F.col(order).asc())
    return placed.withColumn("position", F.col("at") - 1).drop("at", "_by")


def group_items(df: DataFrame, order: str, by: str, item: Column) -> DataFrame:
    """Groups in the order of their first row, items in row order: key, first (its order), items."""
    rows = df.groupBy(F.col(by).alias("key")).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))).alias("rows"))
    return rows.select("key", "first", F.transform("rows", lambda r: r["v"]).alias("items"))


#: How a value's schema begins, by the type a rule names.
TYPES = {"string": "STRING", "int": "BIGINT", "double": "D", "bool": "BOOLEAN", "list": "ARRAY", "map": "OBJECT"}


@dataclass(frozen=True)
class Rule:
    """A constraint on a field (path): a name, the condition that holds, a message."""

    path: str
    name: str
    holds: Column
    message: str


def constraint(path: str, **limits: object) -> list[Rule]:
    """Rules of a field: minimum, maximum, min_length, max_length (characters), min_bytes,
    max_bytes, min_items, max_items (of lists and maps), type (of TYPES), pattern (of the whole text; at most 1024 characters), one_of, required.
    """
    if len(str(limits.get("pattern", ""))) > 1024:
        raise ValueError("a pattern of more than 1024 characters")
    c = F.col(path)
    made = {
        "minimum": lambda v: c >= F.lit(v),
        "maximum": lambda v: c <= F.lit(v),
        "min_length": lambda v: F.char_length(c) >= v,
        "max_length": lambda v: F.char_length(c) <= v,
        "min_bytes": lambda v: F.octet_length(c) >= v,
        "max_bytes": lambda v: F.octet_length(c) <= v,
        "min_items": lambda v: F.size(c) >= v,
        "max_items": lambda v: F.size(c) <= v,
        "type": lambda v: F.schema_of_variant(c.cast("variant")).startswith(TYPES[v]),
        "pattern": lambda v: c.rlike(rf"\A(?:{v})\z"),
        "one_of": lambda v: c.isin(*v),
        "required": lambda v: c.isNotNull(),
    }
    return [Rule(path, name, made[name](v), f"{name} {v}") for name, v in limits.items()]


def custom(df: DataFrame, number: int, expression: str, message: str) -> Rule:
    return Rule(f"rules[{number}]", "custom", compile_expression(expression, row_names(df.dtypes), "bool").column, message)


def validate_items(df: DataFrame, index: str, rules: list[Rule]) -> DataFrame:
    """All violations of all rows: index, path, rule, message. No rule hides another; a null passes all but `required`."""
    broken = [F.when(~(F.coalesce(r.holds, F.lit(True)) if r.name != "required" else r.holds), F.struct(F.lit(r.path).alias("path"), F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"))) for r in rules]
    return df.select(F.col(index).alias("index"), F.inline(F.array_compact(F.array(*broken))))


def failure_summary(violations: DataFrame, shown: int = 20) -> DataFrame:
    """One row: the first violations in order and how many more there are."""
    first = violations.orderBy("index", "path", "rule").limit(shown).agg(F.array_sort(F.collect_list(F.struct("index", "path", "rule", "message"))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: F.concat(F.lit("items["), x["index"].cast("string"), F.lit("]."), x["path"], F.lit(": "), x["message"])), "; ")
    more = violations.agg(F.count("*").alias("n"))
    return first.crossJoin(more).select(F.when(F.col("n") > shown, F.concat(text, F.lit("; and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise(text).alias("summary"), F.col("n").alias("violations"))


def validate_value(spark: SparkSession, value: dict, schema: str, rules: list[Rule]) -> list[dict]:
    """`validate_items` of one value, which has the columns of `schema`: its violations."""
    return [r.asDict() for r in validate_items(spark.createDataFrame([value], schema).withColumn("_index", F.lit(0)), "_index", rules).drop("index").collect()]  # of one row


def partition_items(df: DataFrame, index: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """The rows that break no rule, and the others with their `violations` (path, rule, message)."""
    broken = [F.when(~(F.coalesce(r.holds, F.lit(True)) if r.name != "required" else r.holds), F.struct(F.lit(r.path).alias("path"), F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"))) for r in rules]
    marked = df.withColumn("violations", F.array_compact(F.array(*broken)))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def set_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows with the named columns set to expressions over the row as it was; new ones are added, all others stay."""
    names = row_names(df.dtypes)
    return df.select(*[c for c in df.columns if c not in fields], *[compile_expression(e, names).column.alias(c) for c, e in fields.items()])
