"""Queries on proposed mappings: parsing, the referent gate, drops, starter maps, similarity ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.operators import assist, onboard
from conform.operators.joins import config_frame
from conform.plans import bindings as b
from conform.plans.bindings import Tables
from conform.plans.catalog import query
from conform.plans.oracle import VIEWS
from conform.session import packed as stage

PATHS = tuple(f"finding.{k}" for k in ("id", "severity", "user_tags", "issues", "comments", "page")) + tuple(
    f"header.{k}" for k in ("inspection_name", "report_date", "inspection_type", "company"))

# every answer's sound items, by construction of the answers: position 0; lone proposals name a map but bring no entries
VIEWS["v_items"] = """
SELECT event_id AS answer_id, session_id, v, CASE WHEN event_id % 7 = 4 THEN 'no_such_field' ELSE field END AS target_field,
 CASE WHEN event_id % 21 = 8 THEN 'finding.colour' ELSE path0 END AS from_path, 'map_' || (event_id % 4) AS map_name FROM v_evt WHERE event_id % 7 NOT IN (2, 3, 6) OR event_id % 49 = 6
"""
VIEWS["v_known"] = "SELECT * FROM v_items WHERE target_field <> 'no_such_field' AND from_path <> 'finding.colour'"
VIEWS["v_seen"] = """
SELECT DISTINCT 'finding.severity' AS from_path, severity AS value FROM v_findings UNION SELECT DISTINCT 'finding.issues', unnest(issues) FROM v_findings
UNION SELECT DISTINCT 'header.company', company FROM v_headers
"""
VIEWS["v_sugg"] = """
SELECT k.*, e.value, e.tv, EXISTS (SELECT 1 FROM v_seen s WHERE s.from_path = k.from_path AND s.value = e.value) AS seen
FROM v_known k CROSS JOIN LATERAL (SELECT k.v AS value, 'EXPRESS' AS tv UNION ALL SELECT '3', 'REGULAR') e WHERE answer_id % 7 = 5
"""


def gated(t: Tables):
    items = stage(assist.parse_answers(t.proposals_raw()), "answers")  # known ones, their entries and drops all come from it
    targets = config_frame(t.spark, [(c,) for c in b.COLUMNS], "target_field string")
    paths = config_frame(t.spark, [(p,) for p in PATHS], "from_path string")
    seen = onboard.observed(t.findings(), {"severity": False, "issues": True}).filter(F.col("form") == "single").select(
        F.col("path").alias("from_path"), F.col("value").alias("source_value")).unionByName(
        t.headers().select(F.lit("header.company").alias("from_path"), F.col("company").alias("source_value"))).distinct()
    return assist.gate(items, targets, paths, seen)


@query("fn_json", """
SELECT event_id AS answer_id, CASE WHEN event_id % 14 = 7 THEN 2 WHEN event_id % 49 IN (3, 10) THEN 0 WHEN event_id % 49 IN (6, 13, 20, 27) THEN 1
  WHEN event_id % 7 IN (3, 6) THEN -1 ELSE 1 END AS items FROM events""")
def fn_json(t: Tables) -> DataFrame:
    return assist.with_items(t.proposals_raw()).select("answer_id", F.coalesce(F.size("items"), F.lit(-1)).alias("items"))


@query("jn_referent", """
SELECT answer_id, session_id, target_field, from_path, map_name FROM v_known""")
def jn_referent(t: Tables) -> DataFrame:
    known, _, _ = gated(t)
    return known.select("answer_id", "session_id", "target_field", "from_path", F.col("value_map_name").alias("map_name"))


@query("agg_drops", """
SELECT 'schema' AS reason, count(*) FILTER ((event_id % 7 IN (2, 3, 6) AND event_id % 49 NOT IN (3, 6, 10)) OR event_id % 14 = 7) AS n FROM events
UNION ALL SELECT 'unknown_field', (SELECT count(*) FROM v_items) - (SELECT count(*) FROM v_known)
UNION ALL SELECT 'unknown_value', (SELECT count(*) FROM v_sugg WHERE NOT seen)""")
def agg_drops(t: Tables) -> DataFrame:
    """How many proposals and entries were dropped, by reason; every reason is listed."""
    _, _, lost = gated(t)
    counts = lost.groupBy(F.col("drop").alias("reason")).agg(F.count("*").alias("n"))
    reasons = config_frame(t.spark, [(r,) for r in assist.DROPS], "reason string")
    return reasons.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("prj_starter", """
WITH l AS (SELECT session_id, map_name, max(answer_id) AS answer_id FROM v_sugg WHERE seen GROUP BY 1, 2)
SELECT s.session_id, s.map_name, s.value AS source_value, s.tv AS target_value FROM v_sugg s JOIN l USING (session_id, map_name, answer_id) WHERE seen""")
def prj_starter(t: Tables) -> DataFrame:
    _, entries, _ = gated(t)
    return assist.starter_maps(entries).select("session_id", F.col("value_map_name").alias("map_name"), "source_value", "target_value")


VIEWS["v_targets"] = """
SELECT 'field_' || label AS target, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label
"""
VIEWS["v_cos"] = """
SELECT vec_id::VARCHAR AS source, target, list_inner_product(e.embedding::DOUBLE[], t.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(t.v, t.v))) AS s
FROM embeddings e CROSS JOIN v_targets t
"""


def vectors(t: Tables):
    e = t.t("embeddings")
    sources = e.select(F.col("vec_id").cast("string").alias("source"), F.col("embedding").alias("v"))
    targets = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).select(
        F.concat(F.lit("field_"), F.col("label").cast("string")).alias("target"), "v")
    return sources, targets


@query("top_cosine", """
WITH r AS (SELECT source, target, round_even(s, 4) + 0.0 AS score, row_number() OVER (PARTITION BY source ORDER BY s DESC, target) AS rank FROM v_cos)
SELECT source, rank, target, score FROM r WHERE rank <= 5""")
def top_cosine(t: Tables) -> DataFrame:
    return assist.rank_similar(*vectors(t), assist.TOP_K)


@query("top_profile", """
WITH u AS (SELECT doc_id::VARCHAR AS source FROM v_detect WHERE profile IS NULL),
r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY s DESC, target) AS rank, target, round_even(s, 4) + 0.0 AS score FROM v_cos JOIN u USING (source))
SELECT * FROM r WHERE rank <= 5""")
def top_profile(t: Tables) -> DataFrame:
    """The closest profiles by resemblance, for the documents that no profile claims."""
    from conform.operators.detect import first_match

    sources, targets = vectors(t)
    unclaimed = t.batch().filter(first_match(b.PROFILES, F.col("lead_text")).isNull()).select(F.col("doc_id").cast("string").alias("source"))
    return assist.rank_similar(sources.join(unclaimed, "source", "left_semi"), targets, assist.TOP_K)


@query("top_sig", """
SELECT 'document' AS kind, doc_id::VARCHAR AS key, substr(string_agg(text, chr(10) ORDER BY line_no), 1, 2000) AS signature FROM v_lines WHERE page <= 4 GROUP BY doc_id
UNION ALL SELECT 'profile', 'line.report@v2019', 'Inspection report line survey pdf' UNION ALL
SELECT 'profile', 'line.report@v2020', 'Inspection report Company: ^Id\\s+Severity.*Page$ line survey pdf' UNION ALL
SELECT 'profile', 'survey.register@v1', 'Inspection report ^Ref\\s+Class\\b.*Sheet$ line survey pdf' UNION ALL
SELECT 'profile', 'any.report@v1', 'Inspection report Observation line survey pdf'""".replace("\\\\", "\\"))
def top_sig(t: Tables) -> DataFrame:
    """Structural signature text of documents and profiles, the input of a resemblance ranking."""
    from conform.operators.detect import leading_text

    docs = leading_text(t.text_lines()).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"),
                                               F.substring("lead_text", 1, 2000).alias("signature"))
    profiles = config_frame(t.spark, [("profile", p.ref, " ".join(x for x in (*p.required_text, p.header_regex, "line", "survey", "pdf") if x))
                                      for p in b.PROFILES], "kind string, key string, signature string")
    return docs.unionByName(profiles)
