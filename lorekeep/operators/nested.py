"""Deeply nested JSON records into related flat tables that keep their parents' keys and positions.

All in higher-order SQL on VARIANT values: transforms attach positions, one `inline` a target table emits its rows. A
value counts whatever its wrapping: JSON kept as text, a lone object where a list is meant, a scalar as {"value": x}.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bound(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(v), f)[0]


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    """Whether a variant is an object; looks at its top only."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def unwrapped(v: Column) -> Column:
    """A variant whose text holds JSON becomes that JSON; other text becomes null."""
    return _bound(v, lambda x: F.when(_list(x).isNotNull() | _object(x), x).otherwise(F.try_parse_json(F.try_variant_get(x, "$", "string"))))


def as_list(v: Column) -> Column:
    """array<variant> of a list, of a lone object, or of either as text, elements unwrapped; null for anything else. Null elements stay."""
    return _bound(unwrapped(v), lambda u: F.transform(F.coalesce(_list(u), F.when(_object(u), F.array(u))), unwrapped))


def scalar(v: Column, path: str) -> Column:
    """The value at path as text: also of {"value": x}; null for absent, null, empty, lists and other objects."""

    def text(x: Column) -> Column:
        return F.when(_object(x), F.try_variant_get(x, "$.value", "string")).when(_list(x).isNull(), F.try_variant_get(x, "$", "string"))

    return _bound(_bound(F.try_variant_get(v, path, "variant"), text), lambda t: F.when(t != "", t))


def children(v: Column, path: str, fields: dict[str, str]) -> Column:
    """array<struct<ordinal, *fields>> of the list at path; fields: name of a column to its path in an element."""
    return F.transform(as_list(F.try_variant_get(v, path, "variant")), lambda e, i: F.struct(i.cast("bigint").alias("ordinal"), *[scalar(e, p).alias(n) for n, p in fields.items()]))


#: Target tables below a record: name, path in the record, columns by their path in an element (the first is the item).
CHILDREN: dict[str, tuple[str, dict[str, str]]] = {
    "typed_entity": ("$.typed_entities", {"name": "$.name", "entity_type": "$.entity_type"}),
    "relationship": ("$.creates_relationships", {"from_entity": "$.from_entity", "to_entity": "$.to_entity", "relation_type": "$.relation_type", "context": "$.context"}),
    "code": ("$.related_code", {"file_path": "$.file_path", "start_line": "$.start_line", "end_line": "$.end_line", "commit_hash": "$.commit_hash"}),
}
RECORD_FIELDS = {"id": "$.id", "update_type": "$.update_type", "timestamp": "$.timestamp", "title": "$.content.title", "description": "$.content.description", "parent_update": "$.parent_update", "author": "$.author"}


def nested_records(exports: DataFrame, fields: dict[str, str] | None = None, tables: dict[str, tuple[str, dict[str, str]]] | None = None) -> DataFrame:
    """Records of each session's latest readable archive, with an array of structs a child table.

    `exports`: export_id, exported_at, payload. Unreadable payloads and such without a session id are passed over; of
    equal times the higher export_id holds. Records without id are left out with all below them; of entries with one id
    the last holds. Ordinals count from 0 over the list as it stands. Out: session_id, record_id, ordinal, the fields,
    a column a child table. Empty in, empty out; other columns of `exports` are ignored.
    """
    fields = RECORD_FIELDS if fields is None else fields
    tables = CHILDREN if tables is None else tables
    doc = unwrapped(F.try_parse_json("payload"))
    read = exports.select("export_id", "exported_at", doc.alias("doc")).select("export_id", "exported_at", F.coalesce(unwrapped(F.try_variant_get("doc", "$.session", "variant")), F.lit(None).cast("variant")).alias("s"))
    rows = F.transform(
        as_list(F.try_variant_get("s", "$.incremental_updates", "variant")),
        lambda e, i: F.struct(
            i.cast("bigint").alias("ordinal"),
            scalar(e, "$.id").alias("record_id"),
            *[scalar(e, p).alias(n) for n, p in fields.items() if n != "id"],
            *[children(e, p, cols).alias(n) for n, (p, cols) in tables.items()],
        ),
    )
    known = read.select("export_id", "exported_at", scalar(F.col("s"), "$.id").alias("session_id"), rows.alias("rows")).where("session_id is not null")
    last = known.groupBy("session_id").agg(F.max_by("rows", F.struct("exported_at", "export_id")).alias("rows"))
    flat = last.select("session_id", F.inline("rows")).where("record_id is not null")
    kept = [c for c in flat.columns if c not in ("session_id", "record_id")]
    return flat.groupBy("session_id", "record_id").agg(F.max_by(F.struct(*kept), F.col("ordinal")).alias("x")).select("session_id", "record_id", *[F.col(f"x.{c}").alias(c) for c in kept])


def child_rows(records: DataFrame, name: str) -> DataFrame:
    """The flat table of one child kind: session_id, record_id, ordinal and its columns; rows without the item are left out."""
    item = next(iter(CHILDREN[name][1]))
    return records.select("session_id", "record_id", F.inline(name)).where(F.col(item).isNotNull())


def all_items(records: DataFrame) -> DataFrame:
    """Records and children in one table: session_id, record_id, child, ordinal, item."""
    parts = [F.array(F.struct(F.lit("record").alias("child"), F.col("ordinal"), F.col("record_id").alias("item")))]
    for name, (_, cols) in CHILDREN.items():
        rows = F.expr(f"transform({name}, e -> struct('{name}' AS child, e.ordinal AS ordinal, e.{next(iter(cols))} AS item))")
        parts.append(F.coalesce(rows, F.array().cast("array<struct<child:string,ordinal:bigint,item:string>>")))
    return records.select("session_id", "record_id", F.inline(F.flatten(F.array(*parts)))).where("item is not null")
