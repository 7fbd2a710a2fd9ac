"""Aggregates over sources and registries, samples, positions, generations, rule edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform.operators import assist, onboard, ranking, registry
from conform.operators.joins import attach_group
from conform.plans.bindings import Tables
from conform.plans.catalog import query
from conform.plans.oracle import VIEWS
from conform.plans.scoring import sheet_bundle, make_run
from conform.sinks import content_hash

KEYS = {"id": False, "severity": False, "user_tags": True, "issues": True, "comments": False, "page": False}


@query("agg_inventory", """
SELECT doc_id, 'finding.' || k AS path, v AS sample FROM (SELECT doc_id, unnest(['id','severity','user_tags','issues','comments','page']) AS k,
  unnest([r.id, r.severity, array_to_string(r.user_tags, ' | '), array_to_string(r.issues, ' | '), r.comments, coalesce(r.page::VARCHAR, '')]) AS v
  FROM (SELECT doc_id, arg_min(f, (record_seq, severity, user_tags, issues)) AS r FROM v_findings f GROUP BY 1))
UNION ALL SELECT doc_id, unnest(['header.inspection_name','header.report_date','header.inspection_type','header.company']),
  unnest([inspection_name, report_date, inspection_type, company]) FROM v_headers""")
def agg_inventory(t: Tables) -> DataFrame:
    """What a source offers: every header value, and per finding key the value of the first record."""
    first = t.findings().groupBy("doc_id").agg(F.min_by(
        F.struct(*KEYS), F.struct("record_seq", "severity", "user_tags", "issues")).alias("r")).select(
        "doc_id", F.lit(0).alias("record_seq"), "r.*")
    found = onboard.inventory(first, KEYS).select("doc_id", "path", "sample")
    heads = t.headers().unpivot("doc_id", ["inspection_name", "report_date", "inspection_type", "company"], "path", "sample")
    return found.unionByName(heads.withColumn("path", F.concat(F.lit("header."), "path")))


@query("agg_observed", """
SELECT DISTINCT doc_id, path, value FROM (SELECT doc_id, 'finding.severity' AS path, severity AS value FROM v_findings
 UNION ALL SELECT doc_id, 'finding.user_tags', unnest(user_tags) FROM v_findings UNION ALL SELECT doc_id, 'finding.issues', unnest(issues) FROM v_findings
 UNION ALL SELECT doc_id, 'finding.comments', comments FROM v_findings UNION ALL SELECT doc_id, 'header.company', company FROM v_headers)""")
def agg_observed(t: Tables) -> DataFrame:
    keys = {"severity": False, "user_tags": True, "issues": True, "comments": False}
    seen = onboard.observed(t.findings(), keys).filter(F.col("form") == "single").select("doc_id", "path", "value")
    heads = t.headers().select("doc_id", F.lit("header.company").alias("path"), F.col("company").alias("value"))
    return seen.unionByName(heads).distinct()


@query("agg_obs12", """
WITH s AS (SELECT company, 'comments' AS key, comments AS value, min((doc_id, record_seq)) AS at_first FROM v_findings JOIN v_headers USING (doc_id) WHERE comments <> '' GROUP BY ALL
  UNION ALL SELECT company, 'severity', severity, min((doc_id, record_seq)) FROM v_findings JOIN v_headers USING (doc_id) WHERE severity <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY company, key ORDER BY at_first, value) AS rn FROM s)
SELECT company, key, rn AS position, value FROM r WHERE rn <= 12""")
def agg_obs12(t: Tables) -> DataFrame:
    """The first twelve distinct values of a finding key, in the order they appear, per company."""
    f = t.findings().join(t.headers().select("doc_id", "company"), "doc_id")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("comments", "severity")])
    long = f.select("company", "doc_id", "record_seq", F.explode(pairs).alias("p")).select("company", "doc_id", "record_seq", "p.*")
    first = long.filter(F.col("value") != "").groupBy("company", "key", "value").agg(F.min(F.struct("doc_id", "record_seq")).alias("first"))
    rn = F.row_number().over(W.partitionBy("company", "key").orderBy("first", "value"))
    return first.withColumn("position", rn).filter(F.col("position") <= 12).select(
        "company", "key", F.col("position").cast("long").alias("position"), "value")


SUMS = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::HUGEINT::VARCHAR" for i in range(4))


@query("agg_digest", f"""
SELECT count(*) AS n_rows, sha256(concat_ws(',', count(*)::VARCHAR, {SUMS})) AS content_hash
FROM (SELECT sha256(concat_ws(chr(31), document, sha)) AS h FROM v_batch)""")
def agg_digest(t: Tables) -> DataFrame:
    """Digest of a batch: changes with any name or content, needs no global order to compute."""
    return content_hash(t.batch(), [], "document", ["sha"])


@query("agg_latest", """
SELECT name, max(version)::INTEGER AS latest, (max(version) + 1)::INTEGER AS next_version, count(DISTINCT version) AS versions,
 count(*) FILTER (version = m) AS latest_entries FROM (SELECT *, max(version) OVER (PARTITION BY name) AS m FROM v_map_entries) GROUP BY name""")
def agg_latest(t: Tables) -> DataFrame:
    per = t.map_entries().groupBy("name", "version").agg(F.count("*").alias("n"))
    return per.groupBy("name").agg(F.max("version").alias("latest"), (F.max("version") + 1).alias("next_version"),
                                   F.count("*").alias("versions"), F.max_by("n", "version").alias("latest_entries"))


@query("agg_overview", """
SELECT 'value_maps' AS registry, name || '@' || version AS ref, count(*) AS n FROM v_map_entries GROUP BY ALL
UNION ALL SELECT 'transforms', profile || ':' || template, count(*) FROM v_transforms GROUP BY ALL
UNION ALL SELECT 'templates', n_name, count(*) FROM nation GROUP BY ALL
UNION ALL SELECT 'sessions', CASE WHEN m > 4 THEN 'approved' ELSE 'draft' END, count(*) FROM (SELECT max(turn) AS m FROM conversations GROUP BY conv_id) GROUP BY ALL
UNION ALL SELECT 'proposals', source, count(*) FROM documents GROUP BY ALL""")
def agg_overview(t: Tables) -> DataFrame:
    def tally(df: DataFrame, name: str, ref) -> DataFrame:
        return df.groupBy(ref.alias("ref")).agg(F.count("*").alias("n")).select(F.lit(name).alias("registry"), "ref", "n")

    x = t.transforms()
    sessions = t.t("conversations").groupBy("conv_id").agg(F.max("turn").alias("m"))
    return (tally(t.map_entries(), "value_maps", F.concat("name", F.lit("@"), F.col("version").cast("string")))
            .unionByName(tally(x, "transforms", F.concat("profile", F.lit(":"), "template")))
            .unionByName(tally(t.t("nation"), "templates", F.col("n_name")))
            .unionByName(tally(sessions, "sessions", F.when(F.col("m") > 4, "approved").otherwise("draft")))
            .unionByName(tally(t.t("documents"), "proposals", F.col("source"))))


@query("agg_gate", """
WITH pins AS (SELECT transform_id, target_field FROM v_rules r WHERE vm_name IS NOT NULL AND NOT EXISTS (
   SELECT 1 FROM v_map_entries m WHERE m.name = r.vm_name AND m.version = r.vm_version)),
b AS (SELECT coalesce(q.transform_id, r.transform_id) AS transform_id, coalesce(q.target_field, r.target_field) AS f, q.target_field IS NOT NULL AS req,
  r.target_field IS NOT NULL AS routed, coalesce(tier, '') AS tier, p.target_field IS NOT NULL AS bad FROM v_required q FULL OUTER JOIN v_rules r
  ON r.transform_id = q.transform_id AND r.target_field = q.target_field LEFT JOIN pins p ON p.transform_id = r.transform_id AND p.target_field = r.target_field),
g AS (SELECT transform_id, count(*) FILTER (req) AS total_required, count(*) FILTER (routed) AS routed, count(*) FILTER (req AND routed AND tier NOT IN ('T2','T3')) AS ready,
  coalesce(string_agg(f, ',' ORDER BY f) FILTER (tier = 'T2'), '') AS t2_pending, coalesce(string_agg(f, ',' ORDER BY f) FILTER (tier = 'T3' OR (req AND NOT routed)), '') AS t3_unmapped,
  coalesce(string_agg(f, ',' ORDER BY f) FILTER (bad), '') AS unresolved_pins FROM b GROUP BY 1)
SELECT *, t2_pending = '' AND t3_unmapped = '' AND unresolved_pins = '' AS approvable,
 CASE WHEN t2_pending <> '' THEN split_part(t2_pending, ',', 1) ELSE split_part(t3_unmapped, ',', 1) END AS next_blocking FROM g""")
def agg_gate(t: Tables) -> DataFrame:
    return registry.approval_state(t.required(), t.rules(), t.map_entries())


@query("win_sample", """
WITH p AS (SELECT doc_id, page, sum(length(text)) + count(*) - 1 AS len FROM v_lines GROUP BY 1, 2),
n AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page IN (1, last) ORDER BY len DESC, page) AS rn FROM n)
SELECT doc_id, page::BIGINT AS page FROM r WHERE last <= 6 OR page IN (1, last) OR rn <= 4""")
def win_sample(t: Tables) -> DataFrame:
    """Representative pages: first, last, and the four densest between them."""
    pages = t.text_lines().groupBy("doc_id", "page").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("len"))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    p = pages.join(last, "doc_id")
    edge = (F.col("last") <= 6) | (F.col("page") == 1) | (F.col("page") == F.col("last"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("len"), "page"))
    dense = p.filter(~edge).withColumn("rn", rank).filter(F.col("rn") <= 4)
    return p.filter(edge).select("doc_id", "page").unionByName(dense.select("doc_id", "page")).select("doc_id", F.col("page").cast("long").alias("page"))


@query("win_recref", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY record_seq, severity, user_tags, issues) AS i FROM v_findings)
SELECT doc_id, record_seq, CASE WHEN record_seq % 10 = 3 THEN 'record-' || i ELSE id END AS record_ref FROM r""")
def win_recref(t: Tables) -> DataFrame:
    """A record without an id is called after its position in the document."""
    f = t.findings().withColumn("id", F.when(F.col("record_seq") % 10 != 3, F.col("id")))
    # a bucket holds one line number and a thousand parts
    placed = ranking.position_within(f, ["doc_id"], ["record_seq", "severity", "user_tags", "issues"], F.expr("record_seq div 100000000000"))
    return placed.select("doc_id", "record_seq", F.coalesce("id", F.concat(F.lit("record-"), F.col("position").cast("string"))).alias("record_ref"))


@query("win_gener", """
SELECT conv_id AS session_id, turn AS generation, role, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'active' ELSE 'superseded' END AS status FROM conversations""")
def win_gener(t: Tables) -> DataFrame:
    """Proposal generations of a session: the newest is active, the older ones stay for the audit."""
    c = t.t("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("generation"), "role")
    newest = c.groupBy("session_id").agg(F.max("generation").alias("newest"), F.count("*").alias("n"))
    return attach_group(c, newest, ["session_id"], "n", F.col("generation")).select("session_id", "generation", "role",
                                               F.when(F.col("generation") == F.col("newest"), "active").otherwise("superseded").alias("status"))


@query("lim_card", """
SELECT document, arg_min(line_ref, record_seq) AS line_ref, count(*) AS per_record FROM v_legal GROUP BY 1""")
def lim_card(t: Tables) -> DataFrame:
    """Per-batch targets take the first record of each document, per-record targets all of them."""
    bundle = sheet_bundle()
    run = make_run(t)
    rows = run.rows(run.outcome(bundle), bundle)
    return rows.groupBy("document").agg(F.min_by("line_ref", "record_seq").alias("line_ref"), F.count("*").alias("per_record"))


@query("srt_element", "SELECT document, sha FROM v_batch ORDER BY document")
def srt_element(t: Tables) -> DataFrame:
    return t.batch().select("document", "sha").orderBy("document")


ACTIONS = ("create", "accept", "reject", "reroute", "pin", "constant", "formula", "prompt", "redraw")

VIEWS["v_drafts"] = """
SELECT session_id, target_field, from_path, 'T2' AS tier FROM v_proposals
UNION ALL SELECT transform_id, target_field, '?', 'T3' FROM v_required q WHERE NOT EXISTS (
  SELECT 1 FROM v_proposals p WHERE p.session_id = q.transform_id AND p.target_field = q.target_field)
"""
VIEWS["v_edits"] = """
SELECT session_id, field AS target_field, event_id AS step, ['create','accept','reject','reroute','pin','constant','formula','prompt','redraw'][(event_id // 7) % 9 + 1] AS action,
 'a' || event_id AS arg, row_number() OVER (PARTITION BY session_id, field ORDER BY event_id) AS rn FROM v_evt
"""


@query("win_edits", """
WITH RECURSIVE k AS (SELECT DISTINCT session_id, target_field FROM v_drafts UNION SELECT DISTINCT session_id, target_field FROM v_edits),
st AS (
 SELECT k.session_id, k.target_field, 0::BIGINT AS rn, CASE WHEN d.tier IS NULL THEN NULL ELSE 'route' END AS mechanism, d.from_path, d.tier, NULL::VARCHAR AS vm, ''::VARCHAR AS refused,
  NULL::VARCHAR AS c, NULL::VARCHAR AS f, NULL::VARCHAR AS p
 FROM k LEFT JOIN v_drafts d USING (session_id, target_field)
 UNION ALL
 SELECT session_id, target_field, rn,
  CASE WHEN why <> '' THEN mechanism WHEN action IN ('create','accept','reroute','pin') THEN 'route' ELSE NULL END,
  CASE WHEN why <> '' THEN from_path WHEN action IN ('accept','pin') THEN from_path WHEN action IN ('create','reroute') THEN arg ELSE NULL END,
  CASE WHEN why <> '' THEN tier WHEN action IN ('accept','reroute') THEN CASE WHEN vm IS NULL THEN 'T0' ELSE 'T1' END
       WHEN action = 'pin' THEN CASE WHEN tier IN ('T0','T1') THEN 'T1' ELSE tier END WHEN action = 'create' THEN 'T0' ELSE NULL END,
  CASE WHEN why <> '' THEN vm WHEN action IN ('accept','reroute') THEN vm WHEN action = 'pin' THEN arg ELSE NULL END,
  refused || CASE WHEN why <> '' THEN step || ':' || why || ';' ELSE '' END,
  CASE WHEN action = 'constant' THEN arg ELSE c END, CASE WHEN action = 'formula' THEN arg ELSE f END, CASE WHEN action = 'prompt' THEN arg ELSE p END
 FROM (SELECT s.session_id, s.target_field, e.rn, s.mechanism, s.from_path, s.tier, s.vm, s.refused, s.c, s.f, s.p, e.action, e.arg, e.step,
   CASE WHEN e.action = 'create' AND coalesce(s.mechanism = 'route', false) AND coalesce(s.tier, '') <> 'T3' THEN 'already has a route'
    WHEN e.action IN ('accept','reject','reroute','pin') AND NOT coalesce(s.mechanism = 'route', false) THEN 'no route'
    WHEN e.action = 'accept' AND s.tier <> 'T2' THEN 'not a pending proposal' WHEN e.action = 'redraw' THEN 'unknown edit' ELSE '' END AS why
  FROM st s JOIN v_edits e ON e.session_id = s.session_id AND e.target_field = s.target_field AND e.rn = s.rn + 1))
SELECT session_id, target_field, -1::BIGINT AS step, coalesce(mechanism, CASE WHEN c IS NOT NULL THEN 'constant' WHEN f IS NOT NULL THEN 'formula' WHEN p IS NOT NULL THEN 'prompt' END, '') AS mechanism,
 CASE WHEN mechanism IS NULL THEN coalesce(c, f, p, '') ELSE coalesce(from_path, '') END AS from_path,
 CASE WHEN mechanism IS NULL AND coalesce(c, f, p) IS NOT NULL THEN 'T0' ELSE coalesce(tier, '') END AS tier, coalesce(vm, '') AS vm, '' AS refused
FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY session_id, target_field ORDER BY rn DESC) = 1)
UNION ALL SELECT session_id, target_field, split_part(r, ':', 1)::BIGINT, '', '', '', '', split_part(r, ':', 2) FROM (
 SELECT session_id, target_field, unnest(string_split(refused, ';')) AS r FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY session_id, target_field ORDER BY rn DESC) = 1))
WHERE r <> ''""")
def win_edits(t: Tables) -> DataFrame:
    e = t.t("events").select(F.col("user_id").alias("session_id"), _field(F.col("event_type")).alias("target_field"), F.col("event_id").alias("step"),
                             F.element_at(F.array(*map(F.lit, ACTIONS)), (F.floor(F.col("event_id") / 7) % 9 + 1).cast("int")).alias("action"),
                             F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("arg"))
    key = ["session_id", "target_field"]
    p = t.proposals()
    q = t.required().withColumnRenamed("transform_id", "session_id").join(p.select(*key), key, "left_anti")
    drafts = p.select(*key, "from_path", F.lit("T2").alias("tier")).unionByName(
        q.select(*key, F.lit("?").alias("from_path"), F.lit("T3").alias("tier")))
    state, refused = assist.apply_edits(drafts, e, F.floor(F.col("step") / 1000))
    parts = ("mechanism", "from_path", "tier", "vm")
    rows = state.select(*key, F.lit(-1).cast("long").alias("step"), *[F.coalesce(c, F.lit("")).alias(c) for c in parts], F.lit("").alias("refused"))
    return rows.unionByName(refused.select(*key, "step", *[F.lit("").alias(c) for c in parts], F.col("why").alias("refused")))


def _field(e):
    return F.when(e == "signup", "line_ref").when(e == "view", "handling").when(e == "click", "part_family") \
        .when(e == "purchase", "urgency_mark").otherwise("comments")
