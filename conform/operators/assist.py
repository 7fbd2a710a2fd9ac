"""Checking proposed mappings, ranking candidates by similarity, replaying rule edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform.operators.joins import attach_group

# Keys under which a model may wrap its list, tried in this order.
WRAPPERS = ("proposals", "mappings", "routes", "items", "results")
# Reasons a proposal or a suggested entry is dropped.
DROPS = ("schema", "unknown_field", "unknown_value")
TOP_K = 5
#: Up to this many blocks of target vectors are broadcast; more are joined with salts.
BROADCAST_BLOCKS, SPREAD = 16, 64

ENTRY = "struct<source_value:string,target_value:string,note:string>"
ITEM = f"struct<target_field:string,from_path:string,rationale:string,value_map_name:string,suggested_entries:array<{ENTRY}>>"
# Members of an item and of an entry with the pattern and the length (least, most) of their text.
ITEM_TEXTS = {"target_field": ("^[a-z][a-z0-9_]*$", 1, 120), "from_path": (r"^(header|finding)\.[a-z][a-z0-9_]*$", 0, None),
              "rationale": (None, 3, 300), "value_map_name": ("^[a-z][a-z0-9_]*$", 0, 120)}
ENTRY_TEXTS = {"source_value": (None, 0, 500), "target_value": (None, 0, 500), "note": (None, 0, 300)}
NEEDED = {"item": ("target_field", "from_path", "rationale"), "entry": ("source_value", "target_value")}
MAX_ENTRIES = 100


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _members(v: Column) -> Column:
    """The members of an object by name; null for anything else."""
    return F.when(F.startswith(_kind(v), F.lit("OBJECT")), v.try_cast("map<string,variant>"))


def with_items(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``items``: the items (variants) of a model answer, or null when it holds none in any known shape.

    Accepted: a list; a list under a known key; any list-valued member; a lone proposal object. An empty list is an answer
    without items, not an unusable one; a text that merely looks like a list is none. The text is parsed once: each step is a
    column of its own that the next ones share.
    """
    as_list = lambda x: F.when(F.startswith(_kind(x), F.lit("ARRAY")), x.try_cast("array<variant>"))
    df = answers.withColumn("_v", F.try_parse_json(F.trim(F.col(raw)))).withColumn("_list", as_list(F.col("_v"))).withColumn("_m", _members(F.col("_v")))
    # lists among the members, by name; most answers are lists themselves and have none
    df = df.withColumn("_lists", F.map_filter(F.transform_values("_m", lambda _, x: as_list(x)), lambda _, x: x.isNotNull()))
    wrapped = [F.try_element_at("_lists", F.lit(k)) for k in WRAPPERS]
    names = F.when(F.size("_lists") > 0, F.map_keys(F.from_json(F.trim(F.col(raw)), "map<string,string>")))  # in the order of the text
    first = F.try_element_at("_lists", F.get(F.filter(names, lambda k: F.map_contains_key("_lists", k)), F.lit(0)))
    lone = F.when(F.map_contains_key("_m", "target_field") & F.map_contains_key("_m", "from_path"), F.array("_v"))
    return df.withColumn("items", F.coalesce("_list", *wrapped, first, lone)).drop("_v", "_list", "_m", "_lists")


def _sound_texts(members: Column, texts: dict, needed: tuple) -> Column:
    """Whether needed members exist and all text members are texts of the right form."""
    ok = F.lit(True)
    for name, (pattern, least, most) in texts.items():
        v = F.try_element_at(members, F.lit(name))
        t = F.when(_kind(v) == "STRING", v.try_cast("string"))
        form = t.isNotNull() & (F.length(t) >= least)
        form = form & (F.length(t) <= most) if most else form
        form = form & t.rlike(pattern) if pattern else form
        ok = ok & (F.coalesce(form, F.lit(False)) if name in needed else v.isNull() | F.coalesce(form, F.lit(False)))
    return ok


def sound_item(m: Column) -> Column:
    """Whether an item (its members by name) has the members a proposal may have, with their types, forms and lengths, and no others.

    A map name and its entries come together or not at all.
    """
    known = F.array(*map(F.lit, (*ITEM_TEXTS, "suggested_entries")))
    listed = F.try_element_at(m, F.lit("suggested_entries"))
    entries = F.when(F.startswith(_kind(listed), F.lit("ARRAY")), F.transform(listed.try_cast("array<variant>"), _members))

    def sound_entry(own: Column) -> Column:
        return F.coalesce((F.size(F.array_except(F.map_keys(own), F.array(*map(F.lit, ENTRY_TEXTS)))) == 0) & _sound_texts(own, ENTRY_TEXTS, NEEDED["entry"]), F.lit(False))

    paired = F.map_contains_key(m, "suggested_entries") == F.map_contains_key(m, "value_map_name")
    fine = listed.isNull() | F.coalesce((F.size(entries) <= MAX_ENTRIES) & F.forall(entries, sound_entry), F.lit(False))
    return F.coalesce((F.size(F.array_except(F.map_keys(m), known)) == 0) & _sound_texts(m, ITEM_TEXTS, NEEDED["item"]) & paired & fine, F.lit(False))


def parse_answers(answers: DataFrame) -> DataFrame:
    """One row per item (``item`` null and ``drop = schema`` for an unusable answer); an answer without items has no row."""
    items = with_items(answers).filter(F.coalesce(F.size("items") > 0, F.lit(True)))
    rows = items.select("session_id", "answer_id", F.posexplode_outer("items").alias("pos", "v"))
    rows = rows.withColumn("_m", _members(F.col("v"))).withColumn("_ok", sound_item(F.col("_m")))
    return rows.select("session_id", "answer_id", "pos", F.when(F.col("_ok"), F.from_json(F.to_json("v"), ITEM)).alias("item"), F.when(~F.col("_ok"), F.lit("schema")).alias("drop"))


def gate(items: DataFrame, targets: DataFrame, paths: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposals that refer to real things, and everything dropped with its reason.

    ``targets(target_field)``, ``paths(from_path)`` and ``observed(from_path, source_value)`` say
    what exists. A proposal with an unknown field is dropped; an entry for a value nobody has seen
    is dropped from its proposal.
    """
    key = ["session_id", "answer_id", "pos"]
    flagged = items.select(*key, "drop", "item.*").join(
        targets.withColumn("is_target", F.lit(True)), "target_field", "left").join(
        paths.withColumn("is_path", F.lit(True)), "from_path", "left")
    unknown = F.col("is_target").isNull() | F.col("is_path").isNull()
    judged = flagged.withColumn("drop", F.when(F.col("drop").isNotNull(), F.col("drop")).when(unknown, "unknown_field"))
    known = judged.filter(F.col("drop").isNull())
    seen = observed.select("from_path", "source_value").distinct().withColumn("seen", F.lit(True))
    entries = known.select(*key, "target_field", "from_path", "value_map_name", F.posexplode("suggested_entries").alias("n", "e")).select(
        *key, "target_field", "from_path", "value_map_name", "n", "e.source_value", "e.target_value").join(
        seen, ["from_path", "source_value"], "left")
    lost = judged.filter(F.col("drop").isNotNull()).select(*key, "drop").unionByName(
        entries.filter(F.col("seen").isNull()).select(*key, F.lit("unknown_value").alias("drop")))
    return known.drop("suggested_entries", "drop", "is_target", "is_path"), entries.filter("seen").drop("seen"), lost


def starter_maps(entries: DataFrame) -> DataFrame:
    """Suggested entries per (session, map name): those of the latest proposal that names the map."""
    last = entries.groupBy("session_id", "value_map_name").agg(F.max(F.struct("answer_id", "pos")).alias("last"))
    return entries.join(last, ["session_id", "value_map_name"]).filter(F.struct("answer_id", "pos") == F.col("last")).drop("last")


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def rank_similar(sources: DataFrame, targets: DataFrame, k: int | None, block: int = 256) -> DataFrame:
    """For every source vector the ``k`` most similar targets (all of them when k is None).

    ``sources(source, v)``, ``targets(target, v)``. Targets are packed into blocks of bounded size;
    sources meet the blocks by an equi join on the block number, score a block in one expression
    and keep its k best, so neither all targets nor all pairs sit in one place. Ties go to the
    smaller name. Few blocks are broadcast (their number and size are checked here); many are
    repeated over ``SPREAD`` salts, so no block gathers all sources in one task.
    """
    n_blocks = max(1, -(-targets.count() // block))
    packed = targets.withColumn("block", F.pmod(F.xxhash64("target"), F.lit(n_blocks)).cast("int")).groupBy("block").agg(
        F.collect_list(F.struct("target", unit(F.col("v").cast("array<double>")).alias("u"))).alias("targets"))
    s = sources.select("source", unit(F.col("v").cast("array<double>")).alias("u")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if n_blocks <= BROADCAST_BLOCKS:
        paired = s.join(F.broadcast(packed), "block")
    else:
        salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        paired = s.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SPREAD)).cast("int")).join(salted, ["block", "salt"])
    scored = F.transform("targets", lambda t: F.struct(
        (-F.aggregate(F.zip_with(t["u"], F.col("u"), lambda a, c: a * c), F.lit(0.0), lambda a, x: a + x)).alias("neg"),
        t["target"].alias("target")))
    best = F.array_sort(scored)
    best = F.slice(best, 1, k) if k else best
    hits = paired.select("source", F.explode(best).alias("h")).select("source", "h.target", "h.neg")
    rank = F.row_number().over(W.partitionBy("source").orderBy("neg", "target"))
    ranked = hits.withColumn("rank", rank)
    if k:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.select("source", F.col("rank").cast("long").alias("rank"), "target", (F.bround(-F.col("neg"), 4) + 0.0).alias("score"))


# -- rule edits -------------------------------------------------------------------------------------------

FIXED = ("constant", "formula", "prompt")
ON_ROUTE = ("accept", "reject", "reroute", "pin")


def apply_edits(drafts: DataFrame, edits: DataFrame, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Current rule of every field after its edits, and the edits that could not apply.

    ``drafts(session_id, target_field, from_path, tier)``, ``edits(session_id, target_field, step,
    action, arg)``. No list of edits is gathered: an edit depends on the past only through a few
    facts per field, all of them partial aggregates. A field is routed after a create, unrouted after
    a reject or a fixed value (which stays set under later routes); a stub (T3) or a proposal (T2) stays one until the first edit that
    can change it. ``bucket`` grows with ``step`` and splits the edits of a busy field.
    """
    key = ["session_id", "target_field"]
    act = F.col("action")
    first = lambda *a: F.min(F.when(act.isin(*a), F.col("step")))
    facts = edits.groupBy(*key).agg(
        first("create", "reroute", "reject", *FIXED).alias("stub_until"), first("accept", "reroute", "reject", *FIXED).alias("proposal_until"),
        F.count("*").alias("n"))
    start = drafts.select(*key, F.col("from_path").alias("d_path"), F.col("tier").alias("d_tier"))
    fields = start.join(facts, key, "full")

    # which of create / reject / fixed value came last before each edit
    b = edits.withColumn("_b", bucket)
    turn = F.when(act.isin("create", "reject", *FIXED), act)
    ends = b.groupBy(*key, "_b").agg(F.max_by(turn, F.when(turn.isNotNull(), F.col("step"))).alias("end"))
    carried = F.last("end", True).over(W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*key, "_b", carried.alias("carried"))
    inside = F.last(turn, True).over(W.partitionBy(*key, "_b").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    placed = b.join(ends, [*key, "_b"]).withColumn("before", F.coalesce(inside, "carried")).drop("carried", "_b")
    known = attach_group(placed, fields.filter("n is not null"), key, "n", F.col("step"), how="inner")
    routed = F.coalesce(F.col("before") == "create", F.col("d_tier").isNotNull())
    stub = F.coalesce((F.col("d_tier") == "T3") & (F.col("step") <= F.coalesce("stub_until", "step")), F.lit(False))
    proposal = F.coalesce((F.col("d_tier") == "T2") & (F.col("step") <= F.coalesce("proposal_until", "step")), F.lit(False))
    why = (F.when((act == "create") & routed & ~stub, "already has a route")
           .when(act.isin(*ON_ROUTE) & ~routed, "no route").when((act == "accept") & ~proposal, "not a pending proposal")
           .when(~act.isin("create", *ON_ROUTE, *FIXED), "unknown edit"))
    judged = known.withColumn("why", why)

    # the rule in force: what opened the current route, then the last reroute and the last pin since
    final = fields.join(edits_since(judged, key), key, "left")
    reset, opened_at = F.col("reset.step"), F.col("opened")
    by_create = opened_at.isNotNull() & (reset.isNull() | (opened_at > reset))
    by_draft = F.col("d_tier").isNotNull() & reset.isNull() & opened_at.isNull()
    on_route = by_create | by_draft
    # a route goes first; below it a constant, a formula and a prompt stay set once they were, in this order
    kind = F.coalesce(*[F.when(F.col(f"last_{a}").isNotNull(), F.lit(a)) for a in FIXED])
    value = F.coalesce(*[F.col(f"last_{a}.arg") for a in FIXED])
    auto = F.when(F.col("vm").isNotNull(), "T1").otherwise("T0")
    tier = F.when(by_create | F.coalesce("settled", F.lit(False)), auto).otherwise(F.col("d_tier"))
    state = final.select(
        *key, F.when(on_route, "route").otherwise(kind).alias("mechanism"),
        F.when(on_route, F.coalesce("path", "d_path")).otherwise(value).alias("from_path"),
        F.when(on_route, tier).when(kind.isNotNull(), "T0").alias("tier"), F.when(on_route, F.col("vm")).alias("vm"))
    return state, judged.filter(F.col("why").isNotNull()).select(*key, "step", "why")


def edits_since(judged: DataFrame, key: list[str]) -> DataFrame:
    """Per field, over its applied edits: when its route was last opened, its path, its pinned map.

    Maxima of (step, value) are kept per kind of edit; what lies before the opening is recognised
    by comparing steps, so one aggregate over all edits is enough.
    """
    ok = F.col("why").isNull()
    latest = lambda *a: F.max(F.when(ok & F.col("action").isin(*a), F.struct("step", "arg")))
    g = judged.groupBy(*key).agg(latest("create").alias("o"), latest("create", "reroute").alias("p"), latest("pin").alias("v"),
                                 latest("accept", "reroute").alias("s"), *[latest(a).alias(f"last_{a}") for a in FIXED],
                                 F.max(F.when(ok & F.col("action").isin("reject", *FIXED), F.struct("step", "action", "arg"))).alias("reset"))
    since = lambda c: F.col("o").isNull() | (F.col(f"{c}.step") > F.col("o.step"))
    return g.select(*key, "reset", *[f"last_{a}" for a in FIXED], F.col("o.step").alias("opened"), F.col("p.arg").alias("path"), F.when(since("v"), F.col("v.arg")).alias("vm"),
                    F.when(since("s"), F.col("s.step").isNotNull()).alias("settled"))
