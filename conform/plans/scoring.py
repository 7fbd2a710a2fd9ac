"""Run-level queries: gates, verdicts, cards, summaries, exception relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.functions.messages import EXCEPTION_COLUMNS
from conform.operators import detect, score
from conform.plans import audit
from conform.plans import bindings as b
from conform.plans.bindings import Tables
from conform.plans.catalog import query
from conform.plans.run import Bundle, Run
from conform.session import shared_dir
from conform.sources.config import load_mapping


def sheet_bundle() -> Bundle:
    return Bundle(load_mapping(b.MAPPING), b.TEMPLATE)


def order_bundle() -> Bundle:
    return Bundle(load_mapping(b.WORK_ORDER), b.ORDER_TEMPLATE)


def make_run(t: Tables, *bundles: Bundle) -> Run:
    return Run(t.batch(), t.findings(), t.finding_counts(), bundles or (sheet_bundle(),), b.VALUE_MAPS, b.ANSWERS,
               b.PROFILES, "line.report@v2020", b.ANCHORS, b.SEVERITIES)


VERDICT_COLUMNS = ("document", "sha", "verdict", "blocked_kind", "reason", "findings_total", "rows_converted",
                   "exception_count", "value_coverage", "tier_coverage")


@query("agg_verdict", f"SELECT {', '.join(VERDICT_COLUMNS)} FROM v_verdict")
def agg_verdict(t: Tables) -> DataFrame:
    return make_run(t).verdicts().select(*VERDICT_COLUMNS)


@query("agg_card", """
SELECT count(*) AS total, count(*) FILTER (verdict = 'pass') AS n_pass, count(*) FILTER (verdict = 'warn') AS n_warn,
 count(*) FILTER (verdict = 'block') AS n_block, sum(exception_count)::BIGINT AS exceptions_total FROM v_verdict""")
def agg_card(t: Tables) -> DataFrame:
    return score.batch_card(make_run(t).verdicts())


@query("agg_summary", """
SELECT count(*) AS documents, count(*) FILTER (verdict <> 'block') AS converted,
 count(*) FILTER (verdict = 'block') AS blocked, sum(exception_count)::BIGINT AS exceptions FROM v_verdict""")
def agg_summary(t: Tables) -> DataFrame:
    return score.run_summary(make_run(t).verdicts())


@query("set_exc", f"SELECT {', '.join(EXCEPTION_COLUMNS)} FROM v_exc")
def set_exc(t: Tables) -> DataFrame:
    return make_run(t).exceptions().select(*EXCEPTION_COLUMNS)


@query("jn_detect", "SELECT document, coalesce(profile, 'unknown') AS profile FROM v_detect")
def jn_detect(t: Tables) -> DataFrame:
    return t.batch().select("document", F.coalesce(detect.first_match(b.PROFILES, F.col("lead_text")),
                                                   F.lit("unknown")).alias("profile"))


@query("win_dedup", "SELECT document, sha, is_first FROM v_first")
def win_dedup(t: Tables) -> DataFrame:
    return detect.mark_copies(t.batch()).select("document", "sha", "is_first")


@query("flt_integrity", """
SELECT document, reason FROM v_gate WHERE blocked_kind = 'drift_block'""")
def flt_integrity(t: Tables) -> DataFrame:
    return make_run(t).gated.filter(F.col("blocked_kind") == "drift_block").select("document", "reason")


@query("agg_tier", """
WITH req AS (SELECT q.transform_id, q.target_field, CASE WHEN r.tier IN ('T0','T1') THEN 1 ELSE 0 END AS ok
  FROM v_required q LEFT JOIN v_rules r USING (transform_id, target_field)),
per AS (SELECT transform_id, sum(ok)::DOUBLE / count(*) AS c FROM req GROUP BY 1)
SELECT profile, count(*) AS transforms, round_even(min(c), 4) AS tier_coverage FROM per JOIN v_transforms USING (transform_id) GROUP BY 1""")
def agg_tier(t: Tables) -> DataFrame:
    """Share of required fields on reviewed mechanisms; a run takes the lowest of its transforms."""
    ok = F.when(F.col("tier").isin("T0", "T1"), 1).otherwise(0)
    per = t.required().join(t.rules().select("transform_id", "target_field", "tier"), ["transform_id", "target_field"], "left") \
        .groupBy("transform_id").agg((F.sum(ok) / F.count("*")).alias("c"))
    return per.join(t.transforms(), "transform_id").groupBy("profile").agg(
        F.count("*").alias("transforms"), F.bround(F.min("c"), 4).alias("tier_coverage"))


@query("agg_declared", """
SELECT h.document, h.declared, coalesce(c.extracted, 0) AS extracted, h.declared = coalesce(c.extracted, 0) AS agrees
FROM v_headers h LEFT JOIN v_counts c USING (doc_id)""")
def agg_declared(t: Tables) -> DataFrame:
    n = F.coalesce("extracted", F.lit(0)).cast("long")
    return t.headers().join(t.finding_counts(), "doc_id", "left").select(
        "document", "declared", n.alias("extracted"), (F.col("declared") == n).alias("agrees"))


@query("agg_run", """
SELECT v.document, v.verdict, coalesce(e.kind, '') AS kind, count(e.kind) AS exceptions
FROM v_verdict v LEFT JOIN v_exc e USING (doc_id) GROUP BY v.document, v.verdict, coalesce(e.kind, '')""")
def agg_run(t: Tables) -> DataFrame:
    """Run detail, read from the tables of a committed run."""
    path = f"{shared_dir(t.spark)}/audit/{uuid.uuid4().hex}"
    audit.commit_run(make_run(t), "run-1", path)
    return audit.run_detail(t.spark, path, "run-1")


@query("jn_excdoc", """
SELECT e.document, g.sha, e.record_ref, e.kind, e.field FROM v_exc e JOIN v_gate g USING (doc_id)""")
def jn_excdoc(t: Tables) -> DataFrame:
    """Exceptions as audit rows: each carries the content hash of its document."""
    run = make_run(t)
    return run.exceptions().join(run.documents.select("doc_id", "sha"), "doc_id").select(
        "document", "sha", "record_ref", "kind", "field")


@query("prj_multi", """
SELECT 'line_sheet@1' AS template, document, line_ref AS ref, handling AS a, ordered_on AS b FROM v_legal
UNION ALL SELECT 'work_order@1', document, line_ref, handling,
  CASE WHEN page % 2 = 0 THEN (page // 2)::VARCHAR ELSE (page / 2.0)::DOUBLE::VARCHAR END
 FROM v_open WHERE parse_error IS NULL AND handling IS NOT NULL""")
def prj_multi(t: Tables) -> DataFrame:
    """Two targets over one extraction, in long form."""
    one, two = sheet_bundle(), order_bundle()
    run = make_run(t, one, two).freeze()
    x = run.rows(run.outcome(one), one).select(F.lit(one.template.ref).alias("template"), "document",
                                               F.col("line_ref").alias("ref"), F.col("handling").alias("a"),
                                               F.col("ordered_on").alias("b"))
    y = run.rows(run.outcome(two), two).select(F.lit(two.template.ref).alias("template"), "document",
                                               F.col("order_ref").alias("ref"), F.col("urgency").alias("a"),
                                               F.col("page_2").alias("b"))
    return x.unionByName(y)

