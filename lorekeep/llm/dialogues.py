"""Conversations from message rows: ordered, with speakers, without those that are broken, empty or unanswered.

Blocks are read once into a few flags a turn. A turn without a conversation of its own gets that of the nearest
ancestor that has one, by pointer jumping over parents (in distributed joins, offsets doubling; rings and loose ends
fall out). Defects are aggregates over conversations, combined before the shuffle, so no conversation is ever gathered
in one place, however large. Kept conversations come out as root-to-leaf paths, forks as a path each; runs of turns are
contracted before paths are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.hierarchy import close_links, hierarchy
from lorekeep.operators.ordering import with_previous
from lorekeep.sources.scratch import materialise, release

#: Spellings of roles; stops that are no answer.
ROLES = {"user": ["user", "human"], "assistant": ["assistant", "ai", "agent", "model"]}
FAILED = ["failed", "cancelled", "canceled", "blocked"]
#: What shows nothing: separators, controls, format characters, fillers, variation selectors, blank braille.
UNSEEN = "[\\s\\p{Z}\\p{Cc}\\p{Cf}\\x{34F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{2800}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FFA0}\\x{E0100}-\\x{E01EF}]"
VISIBLE = UNSEEN.replace("[", "[^", 1)


def visible(c: Column) -> Column:
    """Whether the text has a visible character; false for null."""
    return F.coalesce(c.rlike(VISIBLE), F.lit(False))


def role(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, UNSEEN, ""))
    out = F.when(bare.isin(ROLES["user"]), "user").when(bare.isin(ROLES["assistant"]), "assistant")
    return out.otherwise(bare)


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def _block(v: Column) -> Column:
    """kind, id, stop and visibility of a block (a variant), in the tagged or the one-of form."""

    def get(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    tagged = F.lower(get("$.type"))
    names = {"text": "text", "thinking": "thinking", "summary": "summary", "tool_use": "tool_use", "toolUse": "tool_use", "tool_result": "tool_result", "toolResult": "tool_result", "end": "end"}
    kind = tagged
    for key, name in names.items():
        kind = F.coalesce(kind, F.when(F.try_variant_get(v, f"$.{key}", "variant").isNotNull(), F.lit(name)))
    kind = F.when(kind == "tooluse", "tool_use").when(kind == "toolresult", "tool_result").otherwise(F.coalesce(kind, F.lit("unknown")))
    ident = F.coalesce(*[get(p) for p in ("$.tool_use_id", "$.toolUseId", "$.tool_result.tool_use_id", "$.tool_result.toolUseId", "$.toolResult.toolUseId", "$.toolResult.tool_use_id", "$.tool_use.id", "$.toolUse.id", "$.id")])
    stop = F.lower(F.coalesce(get("$.stop"), get("$.end.stop")))
    text = F.coalesce(get("$.text.text"), get("$.text"))
    return F.struct(
        kind.alias("kind"),
        F.when(kind.isin("tool_use", "tool_result"), ident).alias("call"),
        F.coalesce((kind == "end") & F.regexp_replace(stop, r"^.*[^a-z](?=[a-z]+$)", "").isin(FAILED), F.lit(False)).alias("failed"),
        ((kind == "text") & visible(text)).alias("shown"),
    )


def turns(messages: DataFrame) -> DataFrame:
    """One row a turn of a session (of rows with one turn_id the lowest seq, then the earliest arrival).

    Out: session_id, turn_id, seq, own (its conversation or null), parent, speaker, says, other (has a block besides
    text and end), readable, failed, calls (array of kind, call, at). Null, blank and empty-list blocks are no blocks.
    Rows without session_id or turn_id belong to no conversation and are left out.
    """
    given = _filled(F.col("blocks"))
    read = F.try_parse_json(given)
    lone = F.when(F.schema_of_variant(read).startswith("OBJECT"), F.array(read))
    blocks = F.transform(F.coalesce(F.try_variant_get(read, "$", "array<variant>"), lone, F.array().cast("array<variant>")), _block)
    m = messages.where(F.col("session_id").isNotNull() & F.col("turn_id").isNotNull()).select(
        "session_id", "turn_id", "seq", "ingested_at", _filled(F.col("source_session")).alias("own"), _filled(F.col("parent")).alias("parent"), role(F.col("role")).alias("speaker"), visible(F.col("text")).alias("spoken"), (given.isNull() | read.isNotNull()).alias("readable"), blocks.alias("b")
    )
    calls = F.filter(F.transform("b", lambda b, i: F.struct(b["kind"].alias("kind"), b["call"].alias("call"), i.alias("at"))), lambda c: c["kind"].isin("tool_use", "tool_result"))
    m = m.select(
        "session_id", "turn_id", "seq", "ingested_at", "own", "parent", "speaker",
        (F.col("spoken") | F.exists("b", lambda b: b["shown"])).alias("says"),
        F.exists("b", lambda b: ~b["kind"].isin("text", "end")).alias("other"),
        "readable",
        F.exists("b", lambda b: b["failed"]).alias("failed"),
        calls.alias("calls"),
    )
    kept = ["seq", "own", "parent", "speaker", "says", "other", "readable", "failed", "calls"]
    # parent and own settle rows that are alike up to them
    first = m.groupBy("session_id", "turn_id").agg(F.min_by(F.struct(*kept), F.struct("seq", "ingested_at", "parent", "own")).alias("x"))
    return first.select("session_id", "turn_id", *[F.col(f"x.{k}").alias(k) for k in kept])


def _key(session: str = "session_id", turn: Column | str = "turn_id") -> Column:
    return F.concat_ws("\u0001", session, turn)


def assigned(t: DataFrame) -> DataFrame:
    """`turns` with `conv`: the own conversation or that of the nearest ancestor with one; turns of none are left out."""
    t = t if hasattr(t, "_lorekeep_path") else materialise(t)
    loose = t.where("own is null and parent is not null").select(_key().alias("id"), _key("session_id", "parent").alias("up"), F.lit(1).cast("bigint").alias("far"))
    ends = close_links(loose).where("mark = 0").select("id", "root")
    owners = t.where("own is not null").select(_key().alias("root"), F.col("own").alias("conv"))
    found = ends.join(owners, "root").select("id", "conv")
    inherited = t.where("own is null").withColumn("id", _key()).join(found, "id").drop("id")
    return t.where("own is not null").withColumn("conv", F.col("own")).unionByName(inherited.select(*t.columns, "conv"))


def defects(t: DataFrame) -> DataFrame:
    """Of each conversation of `assigned`: session_id, conv, defect (empty, broken, no_reply or null), the first that applies."""
    keys = ["session_id", "conv"]
    named = t.where("parent is not null").select(*keys, F.col("parent").alias("turn_id"))
    orphans = named.join(t.select(*keys, "turn_id"), [*keys, "turn_id"], "left_anti").select(*keys, F.lit(True).alias("orphan"))
    calls = t.where(F.size("calls") > 0).select(*keys, "seq", F.inline("calls"))
    place = F.struct("seq", "at")
    by_call = calls.groupBy(*keys, "call").agg(*[f(F.when(F.col("kind") == k, place)).alias(f"{n}_{k}") for k in ("tool_use", "tool_result") for n, f in (("first", F.min), ("last", F.max))])
    matched = F.col("call").isNotNull() & (F.col("last_tool_result") > F.col("last_tool_use")) & (F.col("first_tool_use") < F.col("first_tool_result"))
    loose = by_call.where(~F.coalesce(matched, F.lit(False))).select(*keys, F.lit(True).alias("orphan"))
    bad = orphans.unionByName(loose).select(*keys, "orphan", *[F.lit(None).cast(k).alias(c) for c, k in (("speaker", "string"), ("seq", "bigint"), ("says", "boolean"), ("other", "boolean"), ("readable", "boolean"), ("failed", "boolean"))])
    rows = t.select(*keys, F.lit(False).alias("orphan"), "speaker", "seq", "says", "other", "readable", "failed").unionByName(bad)
    asked = (F.col("speaker") == "user") & F.col("says")
    answered = (F.col("speaker") == "assistant") & F.col("says") & ~F.col("failed")
    agg = rows.groupBy(*keys).agg(
        F.bool_and("readable").alias("readable"), F.bool_or("says").alias("says"), F.bool_or("other").alias("other"), F.bool_or("orphan").alias("orphan"), F.max(F.when(asked, F.col("seq"))).alias("asked"), F.max(F.when(answered, F.col("seq"))).alias("answered")
    )
    defect = (
        F.when(F.col("readable") & ~F.col("says") & ~F.col("other"), "empty")
        .when(~F.col("readable") | F.col("orphan") | F.col("asked").isNull(), "broken")
        .when(F.col("answered").isNull() | (F.col("answered") < F.col("asked")), "no_reply")
    )
    return agg.select(*keys, defect.alias("defect"))


def conversations(messages: DataFrame) -> DataFrame:
    """Kept conversations as paths: session_id, conv, leaf (turn_id), ordinal, turn_id, speaker, seq.

    A turn follows its parent; one that names none follows the turn before it. Every leaf has a path from its root;
    where the links of a conversation lead in a ring those turns are left out. Ordinals count from 0.

    Runs of turns with one follower each are contracted to segments first, so the tree whose paths are listed has a node
    a fork, and no turn gets a path of its own: the work is that of the rows that come out.
    """
    raw = materialise(turns(messages))
    t = materialise(assigned(raw))
    release(raw)
    kept = materialise(defects(t).where("defect is null").select("session_id", "conv"))
    own = t.join(kept, ["session_id", "conv"]).select("session_id", "conv", "turn_id", "parent", "speaker", "seq")
    linked = with_previous(own, ["session_id", "conv"], ["seq", "turn_id"], {"turn_id": "before"})
    group = F.xxhash64("session_id", "conv").cast("string")  # says what probably belongs together, no more
    lagged, linked = linked, materialise(linked.select(_key().alias("id"), F.when(F.coalesce("parent", "before").isNotNull(), _key("session_id", F.coalesce("parent", "before"))).alias("parent"), group.alias("grp"), "session_id", "conv", "turn_id", "speaker", "seq"))
    release(t, kept, lagged)
    followers = linked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("followers"))
    forks = followers.where("followers > 1").select(F.col("id").alias("parent"), F.lit(True).alias("fork"))
    within = linked.where("parent is not null").join(forks, "parent", "left").select("id", F.when(F.col("fork").isNull(), F.col("parent")).alias("parent"), "grp")
    runs = hierarchy(within.unionByName(linked.where("parent is null").select("id", "parent", "grp"))).where("depth >= 0").select("id", F.col("root_id").alias("segment"), F.col("depth").alias("offset"))
    placed = materialise(linked.join(runs, "id").join(followers, "id", "left").select(*linked.columns, "segment", "offset", F.coalesce("followers", F.lit(0)).alias("followers")))
    release(linked)
    heads = placed.where("offset = 0").select("id", "parent", "grp")
    above = placed.where("followers > 1").select(F.col("id").alias("parent"), F.col("segment").alias("up"))
    tree = heads.where("parent is not null").join(above, "parent", "left").select("id", F.coalesce("up", "parent").alias("parent"), "grp").unionByName(heads.where("parent is null"))
    # a head whose parent lies on a ring ends there: such segments and all below them are left out
    gone = heads.where("parent is not null").join(placed.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.col("id").alias("first"))
    paths = hierarchy(tree, trails=True).where("path is not null").select("id", "root_id", "path")
    lengths = placed.groupBy("segment").agg(F.max("offset").alias("last"), F.max_by(F.struct("turn_id", "followers"), "offset").alias("end"))
    leaves = paths.join(gone, paths["root_id"] == gone["first"], "left_anti").join(lengths, paths["id"] == lengths["segment"]).where("end.followers = 0")
    steps = leaves.select(F.col("end.turn_id").alias("leaf"), F.posexplode("path").alias("level", "segment"), paths["id"].alias("tip")).join(lengths.select("segment", "last"), "segment")
    begun = F.sum(F.col("last") + 1).over(Window.partitionBy("tip").orderBy("level").rowsBetween(Window.unboundedPreceding, -1))  # the forks of one path
    steps = steps.select("leaf", "segment", F.coalesce(begun, F.lit(0)).alias("begun"))
    return steps.join(placed, "segment").select("session_id", "conv", "leaf", (F.col("begun") + F.col("offset")).cast("bigint").alias("ordinal"), "turn_id", "speaker", "seq")
