"""Join queries: value maps, vocabularies, pins, decisions, collisions, manifests, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.operators import detect, mapping, onboard, registry
from conform.plans import bindings as b
from conform.plans.bindings import Tables
from conform.plans.catalog import query
from conform.plans.projections import records
from conform.sinks import content_hash
from conform.sources.config import Template


@query("jn_valuemap", """
WITH m AS (SELECT name, version, source_value, arg_min(target_value, pos) AS target_value FROM v_map_entries GROUP BY 1, 2, 3),
r AS (SELECT DISTINCT name, version FROM v_map_entries)
SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber, p_brand, coalesce(m.target_value, '') AS target_value,
 CASE WHEN r.name IS NULL THEN 'not loaded' WHEN m.target_value IS NULL THEN 'oov_value' ELSE 'mapped' END AS outcome
FROM lineitem JOIN part ON p_partkey = l_partkey
LEFT JOIN m ON m.name = 'map_' || (l_suppkey % 4) AND m.version = l_linenumber % 5 + 1 AND m.source_value = p_brand
LEFT JOIN r ON r.name = 'map_' || (l_suppkey % 4) AND r.version = l_linenumber % 5 + 1""")
def jn_valuemap(t: Tables) -> DataFrame:
    """Table-driven lookup: pinned (name, version), first entry wins, a miss is reported."""
    first = mapping.first_entries_frame(t.map_entries())
    known = t.map_entries().select("name", "version").distinct().withColumn("known", F.lit(True))
    l = t.t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = t.t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("source_value"))
    look = l.join(p, "l_partkey").withColumn("name", F.concat(F.lit("map_"), (F.col("l_suppkey") % 4).cast("string"))) \
        .withColumn("version", F.col("l_linenumber") % 5 + 1)
    out = look.join(first, ["name", "version", "source_value"], "left").join(known, ["name", "version"], "left")
    return out.select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", "l_linenumber",
                      F.col("source_value").alias("p_brand"), F.coalesce("target_value", F.lit("")).alias("target_value"),
                      F.when(F.col("known").isNull(), "not loaded").when(F.col("target_value").isNull(), "oov_value")
                      .otherwise("mapped").alias("outcome"))


@query("jn_header", "SELECT document, id, inspection_name, company, report_date FROM v_findings JOIN v_headers USING (doc_id)")
def jn_header(t: Tables) -> DataFrame:
    return records(t).select("document", "id", "inspection_name", "company", "report_date")


@query("jn_vocab", """
WITH v AS (SELECT DISTINCT n_name AS template, CASE n_nationkey % 3 WHEN 0 THEN 'EXPRESS' WHEN 1 THEN 'REGULAR' ELSE 'ECONOMY' END AS value FROM nation UNION SELECT n_name, 'ASK' FROM nation)
SELECT h.document, f.id, coalesce(s.tv, 'none') AS value, coalesce(s.tv, 'none') IN (SELECT value FROM v WHERE v.template = h.company) AS legal
FROM v_findings f JOIN v_headers h USING (doc_id) LEFT JOIN v_sev s ON s.sv = f.severity""")
def jn_vocab(t: Tables) -> DataFrame:
    """Vocabularies as a table: every row, with whether the template allows its value."""
    n = t.t("nation")
    vocab = n.select(F.col("n_name").alias("company"), F.get(F.array(*map(F.lit, ("EXPRESS", "REGULAR", "ECONOMY"))), F.col("n_nationkey") % 3).alias("value")) \
        .unionByName(n.select(F.col("n_name").alias("company"), F.lit("ASK").alias("value"))).distinct()
    handling = mapping.compile_lookup(F.col("severity"), mapping.first_entries(b.SEVERITY_MAP))
    rows = records(t).select("document", "id", "company", F.coalesce(handling, F.lit("none")).alias("value"))
    keep = ("document", "id", "value")
    flagged = rows.join(vocab.withColumn("known", F.lit(True)), ["company", "value"], "left")
    return flagged.select(*keep, F.coalesce("known", F.lit(False)).alias("legal"))


@query("jn_required", """
SELECT transform_id, target_field FROM v_required EXCEPT SELECT transform_id, target_field FROM v_rules""")
def jn_required(t: Tables) -> DataFrame:
    return registry.missing_required(t.required(), t.rules())


@query("set_routed", """
SELECT transform_id, target_field, 'routed' AS side FROM (SELECT transform_id, target_field FROM v_rules WHERE mechanism = 'route'
  UNION SELECT transform_id, target_field FROM v_rules WHERE mechanism <> 'route')
UNION ALL SELECT transform_id, target_field, 'missing' FROM (SELECT transform_id, target_field FROM v_required EXCEPT SELECT transform_id, target_field FROM v_rules)""")
def set_routed(t: Tables) -> DataFrame:
    """Fields any mechanism fills, and required minus those, as set operations."""
    rules, key = t.rules(), ["transform_id", "target_field"]
    routed = rules.filter(F.col("mechanism") == "route").select(*key).union(
        rules.filter(F.col("mechanism") != "route").select(*key)).distinct()
    missing = t.required().select(*key).subtract(routed)
    return routed.withColumn("side", F.lit("routed")).union(missing.withColumn("side", F.lit("missing")))


@query("jn_pins", """
SELECT transform_id, target_field, vm_name || '@' || vm_version AS pin FROM v_rules r WHERE vm_name IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM v_map_entries m WHERE m.name = r.vm_name AND m.version = r.vm_version)""")
def jn_pins(t: Tables) -> DataFrame:
    return registry.unresolved_pins(t.rules(), t.map_entries()).select(
        "transform_id", "target_field", F.concat("vm_name", F.lit("@"), F.col("vm_version").cast("string")).alias("pin"))


@query("jn_unmapped", """
WITH pins AS (SELECT transform_id, target_field, split_part(from_path, '.', 2) AS key, vm_name, vm_version FROM v_rules
  WHERE vm_name IS NOT NULL AND from_path IN ('finding.issues', 'finding.severity', 'finding.comments')),
seen AS (SELECT doc_id, 'issues' AS key, 'joined' AS form, array_to_string(issues, ' | ') AS value FROM v_findings
  UNION ALL SELECT doc_id, 'issues', 'single', unnest(issues) FROM v_findings
  UNION ALL SELECT doc_id, 'severity', 'joined', severity FROM v_findings UNION ALL SELECT doc_id, 'severity', 'single', severity FROM v_findings
  UNION ALL SELECT doc_id, 'comments', 'joined', comments FROM v_findings UNION ALL SELECT doc_id, 'comments', 'single', comments FROM v_findings)
SELECT p.transform_id, p.target_field, s.form, s.value, count(*) AS n FROM pins p JOIN seen s ON s.doc_id = p.transform_id AND s.key = p.key
WHERE NOT EXISTS (SELECT 1 FROM v_map_entries m WHERE m.name = p.vm_name AND m.version = p.vm_version AND m.source_value = s.value)
GROUP BY ALL""")
def jn_unmapped(t: Tables) -> DataFrame:
    """Values an exemplar shows that its pinned map lacks, as single values and as joined lists."""
    pins = t.rules().filter(F.col("vm_name").isNotNull()).select(
        "transform_id", "target_field", F.col("vm_name").alias("name"), F.col("vm_version").alias("version"),
        F.col("from_path").alias("path"))
    seen = onboard.observed(t.findings(), {"issues": True, "severity": False, "comments": False}).groupBy(
        F.col("doc_id").alias("transform_id"), "path", "form", "value").agg(F.count("*").alias("n"))
    entries = t.map_entries().select("name", "version", F.col("source_value").alias("value")).distinct()
    return pins.join(seen, ["transform_id", "path"]).join(entries, ["name", "version", "value"], "left_anti").groupBy(
        "transform_id", "target_field", "form", "value").agg(F.sum("n").alias("n"))


@query("jn_decide", """
WITH r AS (SELECT transform_id AS session_id, target_field, mechanism, from_path, tier, spec FROM v_rules),
b AS (SELECT coalesce(p.session_id, r.session_id) AS session_id, coalesce(p.target_field, r.target_field) AS target_field, p.from_path AS proposed,
  mechanism, r.from_path, tier FROM v_proposals p FULL OUTER JOIN (SELECT * FROM r WHERE mechanism <> 'prompt') r
  ON r.session_id = p.session_id AND r.target_field = p.target_field)
SELECT session_id, target_field, CASE WHEN proposed IS NULL THEN 'manual' WHEN mechanism IS NULL THEN 'rejected' WHEN mechanism <> 'route' THEN 'edited'
  WHEN from_path = proposed THEN 'accepted' ELSE 'edited' END AS action,
 CASE WHEN proposed IS NULL AND mechanism = 'route' THEN 'human-authored route from ' || from_path WHEN proposed IS NULL THEN 'human-authored ' || mechanism
  WHEN mechanism IS NULL THEN 'proposal removed from draft' WHEN mechanism <> 'route' THEN 'replaced by constant/formula'
  WHEN from_path = proposed THEN 'tier ' || tier ELSE 'route changed to ' || from_path END AS detail FROM b
UNION ALL SELECT session_id, target_field, 'manual', 'per-batch prompt ''' || spec || '''' FROM r WHERE mechanism = 'prompt'""")
def jn_decide(t: Tables) -> DataFrame:
    return registry.decisions(t.proposals(), t.rules())


@query("jn_collide", r"""
WITH c AS (SELECT document, CASE WHEN contains(lead_text, 'Inspection report') AND contains(lead_text, 'Company:')
   AND regexp_matches(lead_text, '(?m)^Id\s+Severity.*Page$') THEN 'line.report@v2020' END AS a,
  CASE WHEN contains(lead_text, 'Inspection report') AND regexp_matches(lead_text, '(?m)^Ref\s+Class\b.*Sheet$') THEN 'survey.register@v1' END AS b,
  CASE WHEN contains(lead_text, 'Inspection report') AND contains(lead_text, 'Observation') THEN 'any.report@v1' END AS c FROM v_batch)
SELECT document, concat_ws(',', nullif(b, 'survey.register@v1'), a, c) AS colliding FROM c WHERE a IS NOT NULL OR c IS NOT NULL""")
def jn_collide(t: Tables) -> DataFrame:
    """Exemplars of a new shape that another active profile claims as well (itself excluded)."""
    own = F.filter(detect.all_matches(b.PROFILES, F.col("lead_text")), lambda p: p != "survey.register@v1")
    return t.batch().select("document", own.alias("c")).filter(F.size("c") > 0).select(
        "document", F.array_join("c", ",").alias("colliding"))


def rebuilt_rows(t: Tables) -> tuple[DataFrame, Template]:
    """The rows of a run, and (``side`` new) of a rebuild in which some outputs were renamed or altered: two of every row, which is made once."""
    from conform.plans.scoring import sheet_bundle, make_run

    bundle = sheet_bundle()
    run = make_run(t)
    rows = run.rows(run.outcome(bundle), bundle)
    renamed, altered = F.endswith("customer_name", F.lit("3")), F.endswith("customer_name", F.lit("4"))
    both = F.array(
        F.struct(F.lit("old").alias("side"), F.col("document"), F.col("comments")),
        F.struct(F.lit("new").alias("side"), F.when(renamed, F.concat(F.lit("new_"), "document")).otherwise(F.col("document")).alias("document"),
                 F.when(altered, F.concat("comments", F.lit("!"))).otherwise(F.col("comments")).alias("comments")))
    other = [c for c in rows.columns if c not in ("document", "comments")]
    return rows.select(*other, F.explode(both).alias("b")).select(*other, "b.*"), bundle.template


@query("jn_regen", """
SELECT DISTINCT document, CASE WHEN customer_name LIKE '%3' THEN 'missing' ELSE 'changed' END AS difference
FROM v_legal WHERE customer_name LIKE '%3' OR customer_name LIKE '%4'
UNION ALL SELECT DISTINCT 'new_' || document, 'extra' FROM v_legal WHERE customer_name LIKE '%3'""")
def jn_regen(t: Tables) -> DataFrame:
    rows, template = rebuilt_rows(t)
    return registry.compare_entries(content_hash(rows, ["side", "document"], "record_seq", template.columns), ["document"])


@query("set_symdiff", """
SELECT DISTINCT document FROM v_legal WHERE customer_name LIKE '%3' UNION ALL SELECT DISTINCT 'new_' || document FROM v_legal WHERE customer_name LIKE '%3'""")
def set_symdiff(t: Tables) -> DataFrame:
    sides = rebuilt_rows(t)[0].groupBy("document").agg(F.min("side").alias("first"), F.max("side").alias("last"))
    return sides.filter("first = last").select("document")


@query("jn_seed", """
WITH seed AS (SELECT DISTINCT e.kind, e.payload FROM v_elements e JOIN documents d ON d.doc_id = e.proposal_id WHERE d.source = 'src0')
SELECT proposal_id, element_id, e.kind, CASE WHEN e.kind = 'image_region' THEN 'not compared' WHEN s.payload IS NULL THEN 'seed_divergent' ELSE 'seed_match' END AS mark
FROM v_elements e LEFT JOIN seed s ON s.kind = e.kind AND s.payload = e.payload""")
def jn_seed(t: Tables) -> DataFrame:
    """Review as a delta: which elements the seeding recipes already know."""
    seed = t.elements().join(t.t("documents").filter(F.col("source") == "src0").select(F.col("doc_id").alias("proposal_id")),
                             "proposal_id", "left_semi").select("kind", "payload")
    return onboard.seed_delta(t.elements(), seed).select("proposal_id", "element_id", "kind", "mark")


@query("set_labels", """
SELECT payload AS label FROM v_elements WHERE kind = 'header_field' INTERSECT
SELECT e.payload FROM v_elements e JOIN documents d ON d.doc_id = e.proposal_id WHERE d.source = 'src0' AND e.kind = 'header_field'""")
def set_labels(t: Tables) -> DataFrame:
    e = t.elements().filter(F.col("kind") == "header_field")
    seeded = e.join(t.t("documents").filter(F.col("source") == "src0").select(F.col("doc_id").alias("proposal_id")), "proposal_id", "left_semi")
    return e.select(F.col("payload").alias("label")).intersect(seeded.select("payload"))


@query("prj_links", """
SELECT transform_id, row_number() OVER (PARTITION BY transform_id ORDER BY target_field) AS tag, target_field, mechanism,
 CASE mechanism WHEN 'route' THEN from_path WHEN 'constant' THEN '''' || spec || '''' WHEN 'formula' THEN spec ELSE '--answer ' || spec || '=…' END AS source, tier,
 CASE WHEN tier IN ('T0', 'T1') THEN 'confirmed' WHEN tier = 'T2' THEN 'pending' ELSE 'missing' END AS state,
 EXISTS (SELECT 1 FROM v_required q WHERE q.transform_id = r.transform_id AND q.target_field = r.target_field) AS required,
 coalesce(CASE WHEN mechanism = 'prompt' THEN '<<answered at batch launch>>' WHEN mechanism = 'constant' THEN spec ELSE s.sample END, '') AS sample
FROM v_rules r LEFT JOIN (SELECT doc_id, 'finding.' || key AS path, sample FROM (
   SELECT doc_id, 'id' AS key, arg_min(id, record_seq) AS sample FROM v_findings GROUP BY 1
   UNION ALL SELECT doc_id, 'comments', arg_min(comments, record_seq) FROM v_findings GROUP BY 1)) s
 ON s.doc_id = r.transform_id AND s.path = r.from_path""")
def prj_links(t: Tables) -> DataFrame:
    """Rules as numbered review links, with the first record's value and whether the target needs it."""
    from pyspark.sql import Window as W

    rules = registry.links(t.rules())
    req = t.required().withColumn("required", F.lit(True))
    sample = onboard.inventory(t.findings(), {"id": False, "comments": False}).select(
        F.col("doc_id").alias("transform_id"), F.col("path").alias("from_path"), "sample")
    tag = F.row_number().over(W.partitionBy("transform_id").orderBy("target_field"))
    out = rules.join(req, ["transform_id", "target_field"], "left").join(sample, ["transform_id", "from_path"], "left")
    shown = F.when(F.col("mechanism") == "prompt", F.lit("<<answered at batch launch>>")).when(
        F.col("mechanism") == "constant", F.col("spec")).otherwise(F.col("sample"))
    return out.select("transform_id", tag.cast("long").alias("tag"), "target_field", "mechanism", "source", "tier", "state",
                      F.coalesce("required", F.lit(False)).alias("required"), F.coalesce(shown, F.lit("")).alias("sample"))
