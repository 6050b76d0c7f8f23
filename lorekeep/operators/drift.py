"""Fields of JSON records that are added, removed, renamed or retyped from file to file.

A catalogue of footers holds, for each file, every field and the type of most of its values: lines are parsed once as
variants, all objects in them are opened in one expression in the JVM, and counts are combined before they are shuffled. Files
of a series are numbered in order; `lag` over the files of a field gives its islands, whose beginnings and endings are
the log of fields added and removed; where the type before differs the field is retyped. The lag runs over
range-partitioned rows, so a series that holds a third of all files is spread like any other. Fields that end and begin
in one object of the same file are compared on the records that both files hold; what agrees becomes a row of the alias
table, from which casts into one table are made.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.ordering import numbered, with_previous
from lorekeep.sources.scratch import materialise

#: More than this share of the records with a value in either file must hold the same value under both names.
RENAME_SHARE = 0.5
#: Files whose changes are settled together in one task.
FILES_A_TASK = 2000
SESSION_PREFIX = "session.incremental_updates."


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _kind(v: Column) -> Column:
    """string, boolean, number, object or array; '' for null."""

    def plain(s: Column) -> Column:
        return F.when(s.isNull() | (s == "VOID"), "").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number")

    # objects and lists are told by their tops alone; the schema of a deep value costs its whole size
    return F.when(_get(v, "$", "map<string,variant>").isNotNull(), "object").when(_get(v, "$", "array<variant>").isNotNull(), "array").otherwise(_bound(F.schema_of_variant(v), plain))


def _box(path: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), _kind(v).alias("kind"), v.alias("v"))


def _read(payload: Column) -> Column:
    """The records of a line: prefix (of their fields' paths) and a list of box (path, kind, v); null for no readable object."""

    def of_session(line: Column, session: Column) -> Column:
        inner = _get(session, "$.incremental_updates")
        held = F.coalesce(_get(inner, "$", "array<variant>"), F.array(inner))
        return F.when(_kind(session) == "object", F.transform(held, lambda v: _box(F.lit(SESSION_PREFIX), v))).otherwise(F.array(F.struct(F.lit("").alias("path"), F.lit("object").alias("kind"), line.alias("v"))))

    def of_line(line: Column) -> Column:
        return F.when(_kind(line) == "object", _bound(_get(line, "$.session"), lambda session: of_session(line, session)))

    def of_text(read: Column) -> Column:
        return F.when(_kind(read) == "string", F.try_parse_json(_get(read, "$", "string"))).otherwise(read)

    return _bound(_bound(F.try_parse_json(payload), of_text), of_line)


def _line_records(feeds: DataFrame, *kept: str) -> DataFrame:
    """The records of readable lines: kept columns, n (place in the line), box."""
    return feeds.select(*kept, F.posexplode(_read(F.col("payload"))).alias("n", "box")).where("box.kind = 'object'")


def _opened(b: Column) -> Column:
    """What lies in a box: path, kind, v, own (a field, not a list's element)."""

    def inner(path: Column, v: Column, own: bool) -> Column:
        return F.struct(path.alias("path"), _kind(v).alias("kind"), v.alias("v"), F.lit(own).alias("own"))

    head = F.when((b["path"] == "") | b["path"].endswith("."), b["path"]).otherwise(F.concat(b["path"], F.lit(".")))
    fields = F.transform(F.map_entries(_get(b["v"], "$", "map<string,variant>")), lambda e: inner(F.concat(head, e["key"]), e["value"], True))
    listed = F.transform(_get(b["v"], "$", "array<variant>"), lambda v: inner(b["path"], v, False))
    return F.when(b["kind"] == "object", fields).otherwise(listed)


#: Levels that one pass opens; deeper objects take another pass over what is left.
STRIDE = 5


def _all_below(boxes: Column, levels: int, keep: Callable[[Column], Column], shape: Callable[[Column], Column], toward: Callable[[Column], Column]) -> Column:
    """struct(out, rest): what `keep` keeps of all that lies below boxes, in `shape`, and the boxes still closed after the last level. Only boxes `toward` what is sought are opened."""

    def deeper(own: Column) -> Column:
        out = F.transform(F.filter(own, keep), shape)
        closed = F.transform(F.filter(own, lambda o: o["kind"].isin("object", "array") & toward(o)), lambda o: F.struct(o["path"].alias("path"), o["kind"].alias("kind"), o["v"].alias("v")))
        if levels == 1:
            return F.struct(out.alias("out"), closed.alias("rest"))
        return _bound(_all_below(closed, levels - 1, keep, shape, toward), lambda below: F.struct(F.concat(out, below["out"]).alias("out"), below["rest"].alias("rest")))

    return _bound(F.flatten(F.transform(boxes, _opened)), deeper)


def _below(records: DataFrame, kept: list[str], keep: Callable[[Column], Column], shape: Callable[[Column], Column], toward: Callable[[Column], Column] = lambda o: F.lit(True)) -> DataFrame:
    """kept columns and one row for all that `keep` keeps below the records' boxes, at any depth. A path is dotted keys; lists add nothing."""
    boxes, found = records.select(*kept, F.array("box").alias("boxes")), None
    while True:
        got = materialise(boxes.select(*kept, _all_below(F.col("boxes"), STRIDE, keep, shape, toward).alias("x")))
        rows = got.select(*kept, F.inline("x.out"))
        found = rows if found is None else found.unionByName(rows)
        boxes = got.where(F.size("x.rest") > 0).select(*kept, F.col("x.rest").alias("boxes"))
        if boxes.isEmpty():
            return found


def catalogue(feeds: DataFrame) -> DataFrame:
    """Of each file every field: file_name, path, kind ('' if all values are null), n."""
    fields = _below(_line_records(feeds, "file_name"), ["file_name"], lambda o: o["own"], lambda o: F.struct(o["path"].alias("path"), o["kind"].alias("kind")))
    kinds = fields.groupBy("file_name", "path", "kind").agg(F.count("*").alias("n"))
    most = F.max_by(F.col("kind"), F.struct(F.col("kind") != "", F.col("n"), F.col("kind")))
    return kinds.groupBy("file_name", "path").agg(most.alias("kind"), F.sum("n").alias("n"))


def numbered_files(feeds: DataFrame) -> DataFrame:
    """Files in their order: series, file_name, at (consecutive over all files), prev_file (null for the first of a series).

    Equal times are settled by the file's name.
    """
    files = feeds.where("file_name is not null").groupBy("file_name").agg(F.min("series").alias("series"), F.min("exported_at").alias("exported_at"))
    return materialise(with_previous(files, ["series"], ["exported_at", "file_name"], {"file_name": "prev_file"}).select("series", "file_name", "at", "prev_file"))


def islands(fields: DataFrame, files: DataFrame, *group: str) -> DataFrame:
    """The runs of files of a series in which a field (or a field of one type) stands: series, group, file (number), kind,
    begins, ends, kind_before (of the file before, if it has the field).

    A row a file and field. `lag` and `lead` run over the files of a field; a gap in the numbers ends an island.
    """
    rows = fields.select("file_name", "path", "kind").join(files.select("file_name", "series", F.col("at").alias("file")), "file_name").drop("file_name")
    lagged = with_previous(rows, ["series", *group], ["file"], {"file": "file_before", "kind": "kind_before"})
    ahead = lagged.select((F.col("at") - 1).alias("at"), F.col("file_before").alias("this"), F.col("file").alias("file_after"))
    out = materialise(lagged.join(ahead, "at", "left"))
    follows = F.coalesce(F.col("file_before") == F.col("file") - 1, F.lit(False))
    followed = F.coalesce((F.col("this") == F.col("file")) & (F.col("file_after") == F.col("file") + 1), F.lit(False))
    return out.select("series", *group, "file", *[c for c in ("kind",) if c not in group], (~follows).alias("begins"), (~followed).alias("ends"), F.when(follows, F.col("kind_before")).alias("kind_before"))


def _steps(fields: DataFrame, files: DataFrame) -> DataFrame:
    """The log of islands: at (number of the file), path, change. What begins in a series' first file or ends in its last is no change."""
    isles = materialise(islands(fields, files, "path"))
    later = files.where("prev_file is not null").select("at")
    began = isles.where("begins").select(F.col("file").alias("at"), "path", F.lit("added").alias("change"))
    ended = isles.where("ends").select((F.col("file") + 1).alias("at"), "path", F.lit("removed").alias("change"))
    typed = isles.where("kind_before <> kind and kind_before <> '' and kind <> ''").select(F.col("file").alias("at"), "path", F.lit("retyped").alias("change"))
    return began.unionByName(ended).join(later, "at", "left_semi").unionByName(typed)


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def _evidence(feeds: DataFrame, files: DataFrame, steps: DataFrame) -> DataFrame:
    """Pairs of an ended and a started field of one object, with the records that agree: at, old, new, same, filled.

    Only lines of file pairs in which some object both loses and gains a field are read again. The value of a field is
    the set of its scalars with their places below it; nulls and empty texts, the order of keys and {"value": x}
    wrappings don't count. Of a record's several values in a file the largest hash stands for it.
    """
    obj = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    gone = steps.where("change = 'removed'").select("at", obj.alias("obj"), F.col("path").alias("old"))
    come = steps.where("change = 'added'").select("at", obj.alias("obj"), F.col("path").alias("new"))
    pairs = materialise(gone.join(come, ["at", "obj"]).select("at", "old", "new"))
    wanted = pairs.select("at", F.lit(0).alias("side"), F.col("old").alias("top")).unionByName(pairs.select("at", F.lit(1).alias("side"), F.col("new").alias("top"))).distinct()
    named = files.where("prev_file is not null").join(wanted.select("at").distinct(), "at")
    asked = named.select(F.col("prev_file").alias("file_name"), "at", F.lit(0).alias("side")).unionByName(named.select("file_name", "at", F.lit(1).alias("side")))
    asked = asked.join(wanted.groupBy("at", "side").agg(F.collect_set("top").alias("tops")), ["at", "side"])  # the changed fields of a file
    lines = feeds.select("file_name", "payload").join(asked, "file_name").withColumn("line_hash", F.xxhash64("payload"))
    v = F.col("box.v")
    ident = F.coalesce(_get(v, "$.id.value", "string"), _bound(_get(v, "$.id"), lambda i: F.when(_kind(i).isin("string", "number"), _get(i, "$", "string"))))
    records = _line_records(lines, "at", "side", "tops", "line_hash").select("at", "side", "tops", "line_hash", "n", "box", F.lower(F.trim(ident)).alias("rid")).where("rid <> ''")
    kept = ["at", "side", "rid", "line_hash", "n"]

    def within(o: Column) -> Column:
        return F.exists("tops", lambda t: (o["path"] == t) | o["path"].startswith(F.concat(t, F.lit("."))))

    def toward(o: Column) -> Column:
        return within(o) | F.exists("tops", lambda t: t.startswith(F.concat(o["path"], F.lit("."))))

    scalars = _below(records, [*kept, "tops"], lambda o: o["kind"].isin("string", "boolean", "number") & within(o), lambda o: F.struct(o["path"].alias("path"), F.to_json(o["v"]).alias("text")), toward)
    texts = scalars.where("text <> '\"\"'")
    steps_of = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(steps_of)), lambda i: F.array_join(F.slice(steps_of, F.lit(1), i), "."))
    below = texts.select(*kept, "path", "text", F.explode(above).alias("top")).join(wanted, ["at", "side", "top"])
    place = F.regexp_replace(F.expr("substring(path, length(top) + 1)"), r"\.value(?=\.|$)", "")
    values = below.groupBy(*kept, "top").agg(F.xxhash64(F.to_json(F.array_sort(F.collect_list(F.struct(place.alias("p"), "text"))))).alias("hash"))
    values = materialise(values.groupBy("at", "side", "rid", F.col("top").alias("path")).agg(F.max("hash").alias("hash")))
    olds = values.where("side = 0").select("at", "rid", F.col("path").alias("old"), F.col("hash").alias("old_hash"))
    news = values.where("side = 1").select("at", "rid", F.col("path").alias("new"), F.col("hash").alias("new_hash"))
    met = olds.join(news, ["at", "rid"]).join(pairs, ["at", "old", "new"], "left_semi")
    return met.groupBy("at", "old", "new").agg(F.count_if(F.col("old_hash") == F.col("new_hash")).alias("same"), F.count("*").alias("filled"))


def _inside(path: str, tops: set[str]) -> bool:
    while path := _parent(path):
        if path in tops:
            return True
    return False


def _settle(changes: list[tuple[str, str, str, int, int]]) -> list[tuple[str, str, str]]:
    """The changes of one file: pairs names, best agreement first, and leaves out what lies inside a changed object."""
    gone, come, retyped = ({o or n for c, o, n, _, _ in changes if c == kind} for kind in ("removed", "added", "retyped"))
    pairs = sorted(((-same, -same / filled, o, n) for c, o, n, same, filled in changes if c == "pair" and filled and same / filled > RENAME_SHARE))
    renames = []
    for _, _, old, new in pairs:
        if old in gone and new in come:
            gone.discard(old)
            come.discard(new)
            renames.append((old, new))
    top_old, top_new = gone | retyped | {o for o, _ in renames}, come | retyped | {n for _, n in renames}
    rows = [("added", "", p) for p in come if not _inside(p, top_new)] + [("removed", p, "") for p in gone if not _inside(p, top_old)]
    return rows + [("renamed", o, n) for o, n in renames if not _inside(o, top_old) and not _inside(n, top_new)] + [("retyped", p, p) for p in retyped if not _inside(p, top_new)]


def _settle_files(pdf: pd.DataFrame) -> pd.DataFrame:
    per: dict[int, list] = defaultdict(list)
    for at, *change in zip(*(pdf[c] for c in ("at", "change", "old", "new", "same", "filled"))):
        per[at].append(change)
    return pd.DataFrame([(at, *row) for at, changes in per.items() for row in _settle(changes)], columns=["at", "change", "old_path", "new_path"])


def drift(feeds: DataFrame) -> DataFrame:
    """Every change of a record field in a file against the previous file of its series.

    `feeds`: series, file_name, exported_at, payload (other columns are ignored). Out: series, file_name, change,
    old_path, new_path. Unreadable lines count nowhere; a file without a readable line has no fields. A field whose
    values are all null has no type, so it is never retyped. The first file of a series has no changes.
    """
    files = numbered_files(feeds)
    fields = materialise(catalogue(feeds))
    steps = materialise(_steps(fields, files))
    pairs = _evidence(feeds, files, steps)
    none = F.lit(None).cast("string")
    rows = steps.select("at", "change", F.when(F.col("change") != "added", F.col("path")).alias("old"), F.when(F.col("change") != "removed", F.col("path")).alias("new"), F.lit(0).cast("bigint").alias("same"), F.lit(0).cast("bigint").alias("filled"))
    rows = rows.unionByName(pairs.select("at", F.lit("pair").alias("change"), "old", "new", "same", "filled"))
    groups = max(16, files.count() // FILES_A_TASK)
    settled = rows.groupBy(F.pmod("at", F.lit(groups)).alias("group")).applyInPandas(_settle_files, "at bigint, change string, old_path string, new_path string")
    return settled.join(files.select("at", "series", "file_name"), "at").select("series", "file_name", "change", "old_path", "new_path")


def lifespans(feeds: DataFrame) -> DataFrame:
    """Islands of each field and type in a series: series, path, kind, first_file, last_file, files.

    A field that goes and comes back has two islands. Beginnings and endings, each numbered in the order of series, path,
    type and file, belong together by their numbers.
    """
    files = numbered_files(feeds)
    isles = materialise(islands(catalogue(feeds), files, "path", "kind"))
    keys = ["series", "path", "kind", "file"]
    first = numbered(isles.where("begins").select(*keys), *keys)
    last = numbered(isles.where("ends").select(*keys), *keys).select("at", F.col("file").alias("end"))
    spans = first.join(last, "at").select("series", "path", "kind", F.col("file").alias("begin"), "end")
    names = files.select("at", "file_name")
    spans = spans.join(names.select(F.col("at").alias("begin"), F.col("file_name").alias("first_file")), "begin").join(names.select(F.col("at").alias("end"), F.col("file_name").alias("last_file")), "end")
    return spans.select("series", "path", "kind", "first_file", "last_file", (F.col("end") - F.col("begin") + 1).alias("files"))


#: The fields of a record, by their names in the record's own schema.
RECORD_SCHEMA = ["id", "timestamp", "update_type", "content.title", "content.description", "content.details", "content.examples", "content.implications", "related_code.file_path", "related_code.start_line", "parent_update", "user_marked_important", "creates_entities", "references_entities", "author", "derived_from"]


def alias_table(feeds: DataFrame, changes: DataFrame) -> DataFrame:
    """Of each file the names that stand for other fields: file_name, aliases (map of a path in the file to its first name).

    Renames are followed back in a series; a field that has a name of the record schema in any of its files gets that.
    A series' renames are folded in the order of its files; only files with renames take
    part, all others get the aliases in force.
    """
    files = numbered_files(feeds)
    schema_names = {*RECORD_SCHEMA, "content", "related_code"}
    renames = changes.where("change = 'renamed'").select("file_name", "old_path", "new_path")
    per_file = files.join(renames, "file_name").groupBy("series", "at").agg(F.collect_list(F.struct("old_path", "new_path")).alias("moves"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, str] = {}
        proper: dict[str, str] = {}
        steps = []
        for name, moves in zip(*(pdf.sort_values("at")[c] for c in ("at", "moves"))):
            gone = {m["old_path"]: m["new_path"] for m in moves}
            after = {k: v for k, v in known.items() if k not in gone}
            for k, v in known.items():  # what lies in a renamed object moves with it
                for old, new in gone.items():
                    if k.startswith(old + "."):
                        after.pop(k, None)
                        after[new + k[len(old) :]] = v
            known = after | {new: known.get(old, old) for old, new in gone.items()}
            for k, v in known.items():
                for form in (k, v):
                    if form.removeprefix(SESSION_PREFIX) in schema_names:
                        proper.setdefault(v, form)
            steps.append((name, dict(known)))
        out = [(None, {v: p for v, p in proper.items() if v != p})]  # before the first rename
        for name, aliases in steps:
            firsts = {k: proper.get(v, v) for k, v in aliases.items()} | {v: p for v, p in proper.items() if v != p and v not in aliases}
            out.append((name, firsts))
        return pd.DataFrame({"series": [pdf["series"].iloc[0]] * len(out), "begin": pd.array([n for n, _ in out], dtype="Int64"), "aliases": [a for _, a in out]})

    folded = materialise(per_file.groupBy("series").applyInPandas(run, "series string, begin bigint, aliases map<string,string>"))
    reach = files.groupBy("series").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    begun = folded.join(reach, folded["series"].eqNullSafe(reach["series"])).select(reach["series"], F.coalesce("begin", "low").alias("begin"), F.col("begin").isNotNull().alias("renames"), "aliases", "high")
    until = F.lead("begin").over(Window.partitionBy("series").orderBy("begin", "renames"))  # the renames of a series
    spans = begun.select("begin", (F.coalesce(until, F.col("high") + 1) - 1).alias("end"), "aliases").where("end >= begin")
    return spans.select(F.explode(F.sequence("begin", "end")).alias("at"), "aliases").join(files.select("at", "file_name"), "at").select("file_name", "aliases")


def _records(payload: str | None) -> tuple[str, list[dict]] | None:
    """The path prefix and the records of a line; None if it is no readable object."""
    try:
        line = json.loads(payload)
        line = json.loads(line) if isinstance(line, str) else line
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(line, dict):
        return None
    session = line.get("session")
    if isinstance(session, dict):
        inner = session.get("incremental_updates")
        return SESSION_PREFIX, [r for r in ([inner] if isinstance(inner, dict) else inner if isinstance(inner, list) else []) if isinstance(r, dict)]
    return "", [line]


def unified(feeds: DataFrame, changes: DataFrame) -> DataFrame:
    """All readable records in one table: series, file_name, line_no, record_id, then a text column a schema field, and `extra`.

    Renamed fields and objects go to the column of their first name; lists are JSON text, {"value": x} is its value,
    numbers of a time are kept as text. `extra` maps what the schema does not name.
    """
    columns = [p.replace(".", "_") for p in RECORD_SCHEMA[1:]]
    schema = "series string, file_name string, line_no bigint, record_id string, " + ", ".join(f"{c} string" for c in columns) + ", extra map<string,string>"
    wanted = dict(zip(RECORD_SCHEMA[1:], columns))

    def text(v: object) -> str | None:
        v = v["value"] if isinstance(v, dict) and set(v) == {"value"} else v
        return None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)

    def name(path: str, aliases: dict[str, str], prefix: str) -> str:
        full, tail = prefix + path, ""
        while full:
            if full in aliases:
                return (aliases[full] + tail).removeprefix(prefix)
            head = _parent(full)
            full, tail = head, full[len(head) :] + tail
        return path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for series, file, line, payload, aliases in zip(pdf["series"], pdf["file_name"], pdf["line_no"], pdf["payload"], pdf["aliases"]):
                if (read := _records(payload)) is None:
                    continue
                aliases = dict(aliases) if aliases is not None else {}
                for r in read[1]:
                    flat = {name(k, aliases, read[0]): v for k, v in r.items()}
                    for k in [k for k, v in flat.items() if isinstance(v, dict) and set(v) != {"value"}]:
                        inner = flat.pop(k)
                        flat |= {name(f"{k}.{i}" if k in r else next((f"{o}.{i}" for o in r if name(o, aliases, read[0]) == k), f"{k}.{i}"), aliases, read[0]): v for i, v in inner.items()}
                    row = {c: text(flat.pop(p, None)) for p, c in wanted.items()}
                    out.append({"series": series, "file_name": file, "line_no": line, "record_id": text(flat.pop("id", None)), **row, "extra": {k: t for k, v in flat.items() if (t := text(v)) is not None}})
            yield pd.DataFrame(out, columns=["series", "file_name", "line_no", "record_id", *columns, "extra"])

    lines = feeds.select("series", "file_name", "line_no", "payload").join(alias_table(feeds, changes), "file_name", "left")
    return lines.mapInPandas(run, schema)
