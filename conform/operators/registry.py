"""Rules, registries and review decisions over many mappings at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Who may have written a value-map entry.
PROVENANCE = ("human", "ai-accepted")
FIELD = ("transform_id", "target_field")


def missing_required(required: DataFrame, rules: DataFrame) -> DataFrame:
    """Required target fields no mechanism fills."""
    return required.join(rules.select(*FIELD), list(FIELD), "left_anti")


def unreviewed(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("tier").isin("T2", "T3"))


def unresolved_pins(rules: DataFrame, registry: DataFrame) -> DataFrame:
    """Rules whose pinned value map (name, version) is not registered."""
    pinned = rules.filter(F.col("vm_name").isNotNull())
    known = registry.select(F.col("name").alias("vm_name"), F.col("version").alias("vm_version")).distinct()
    return pinned.join(known, ["vm_name", "vm_version"], "left_anti")


def approval_state(required: DataFrame, rules: DataFrame, registry: DataFrame) -> DataFrame:
    """Readiness of every transform: what is routed, what still blocks approval, what comes next.

    One pass over (required full outer rules); per transform there are as many rows as its
    template has fields, so the short lists stay short.
    """
    bad_pins = unresolved_pins(rules, registry).select(*FIELD, F.lit(True).alias("bad_pin"))
    r = rules.join(bad_pins, list(FIELD), "left").select(*FIELD, "tier", F.coalesce("bad_pin", F.lit(False)).alias("bad_pin"),
                                                         F.lit(True).alias("routed"))
    q = required.select(*FIELD, F.lit(True).alias("is_required"))
    both = q.join(r, list(FIELD), "full")
    req, routed = F.coalesce("is_required", F.lit(False)), F.coalesce("routed", F.lit(False))
    missing = req & ~routed
    t2, t3 = F.coalesce(F.col("tier") == "T2", F.lit(False)), F.coalesce(F.col("tier") == "T3", F.lit(False))

    def names(cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(cond, F.col("target_field"))))

    g = both.groupBy("transform_id").agg(
        F.count_if(req).alias("total_required"), F.count_if(routed).alias("routed"),
        F.count_if(req & routed & ~t2 & ~t3).alias("ready"), names(t2).alias("pending"),
        names(missing | t3).alias("unmapped"), names(F.coalesce("bad_pin", F.lit(False))).alias("bad_pins"))
    return g.select(
        "transform_id", "total_required", "routed", "ready", F.array_join("pending", ",").alias("t2_pending"),
        F.array_join("unmapped", ",").alias("t3_unmapped"), F.array_join("bad_pins", ",").alias("unresolved_pins"),
        ((F.size("pending") == 0) & (F.size("unmapped") == 0) & (F.size("bad_pins") == 0)).alias("approvable"),
        F.coalesce(F.get(F.concat("pending", "unmapped"), F.lit(0)), F.lit("")).alias("next_blocking"))


def decisions(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """What became of each proposal, and what people added, per session and target field."""
    key = ["session_id", "target_field"]
    p = proposals.select(*key, F.col("from_path").alias("proposed"))
    final = rules.withColumnRenamed("transform_id", "session_id")
    fixed = final.filter(F.col("mechanism") != "prompt")
    both = p.join(fixed.select(*key, "mechanism", "from_path", "tier"), key, "full")
    route = F.col("mechanism") == "route"
    action = (
        F.when(F.col("proposed").isNull(), "manual").when(F.col("mechanism").isNull(), "rejected")
        .when(~route, "edited").when(F.col("from_path") == F.col("proposed"), "accepted").otherwise("edited"))
    detail = (
        F.when(F.col("proposed").isNull() & route, F.concat(F.lit("human-authored route from "), "from_path"))
        .when(F.col("proposed").isNull(), F.concat(F.lit("human-authored "), "mechanism"))
        .when(F.col("mechanism").isNull(), F.lit("proposal removed from draft"))
        .when(~route, F.lit("replaced by constant/formula"))
        .when(F.col("from_path") == F.col("proposed"), F.concat(F.lit("tier "), "tier"))
        .otherwise(F.concat(F.lit("route changed to "), "from_path")))
    asked = final.filter(F.col("mechanism") == "prompt").select(
        *key, F.lit("manual").alias("action"), F.concat(F.lit("per-batch prompt '"), "spec", F.lit("'")).alias("detail"))
    return both.select(*key, action.alias("action"), detail.alias("detail")).unionByName(asked)


def append_new(incoming: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose natural key is not registered yet, one per key: loading twice adds nothing."""
    return incoming.dropDuplicates(list(keys)).join(registry.select(*keys), list(keys), "left_anti")


def append_violations(before: DataFrame, after: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Registered entries that a later snapshot changed or lost."""
    b = before.select(*keys, F.col(payload).alias("was"))
    a = after.select(*keys, F.col(payload).alias("now"), F.lit(True).alias("kept"))
    return b.join(a, list(keys), "left").select(
        *keys, F.when(F.col("kept").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed").alias("violation")
    ).filter(F.col("violation").isNotNull())


def compare_entries(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outputs that a rebuild lost, added or changed; ``side`` of an entry is ``old`` (recorded) or ``new`` (rebuilt)."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("content_hash"))).alias(side)
    return entries.groupBy(*keys).agg(of("old"), of("new")).select(
        *keys, F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra")
        .when(F.col("old") != F.col("new"), "changed").alias("difference")).filter(F.col("difference").isNotNull())


def compare_manifests(recorded: DataFrame, rebuilt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for two manifests."""
    side = lambda m, name: m.select(*keys, F.col("content_hash"), F.lit(name).alias("side"))
    return compare_entries(side(recorded, "old").unionByName(side(rebuilt, "new")), keys)


def links(rules: DataFrame) -> DataFrame:
    """Rules as review links; the state follows from the tier."""
    tier = F.coalesce("tier", F.lit("T3"))
    source = (F.when(F.col("mechanism") == "route", F.col("from_path"))
              .when(F.col("mechanism") == "constant", F.concat(F.lit("'"), "spec", F.lit("'")))
              .when(F.col("mechanism") == "formula", F.col("spec"))
              .otherwise(F.concat(F.lit("--answer "), "spec", F.lit("=…"))))
    state = F.when(tier.isin("T0", "T1"), "confirmed").when(tier == "T2", "pending").otherwise("missing")
    return rules.select("*", source.alias("source"), state.alias("state"))
