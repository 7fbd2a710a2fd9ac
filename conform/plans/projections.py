"""Projection queries: source paths, mechanisms, strict and preview resolution, list cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.functions import text as tx
from conform.operators import mapping
from conform.operators.joins import attach_group
from conform.plans import bindings as b
from conform.plans.bindings import Tables
from conform.plans.catalog import query
from conform.plans.run import FINDING_PATHS, HEADER_PATHS, LISTS
from conform.sources.config import load_mapping

SCOPE = mapping.Scope(HEADER_PATHS, FINDING_PATHS, b.ANSWERS, LISTS)
KEEP = ("document", "record_seq", "id")


def records(t: Tables) -> DataFrame:
    """Every finding with its document header, no gate applied."""
    heads = t.headers().select("doc_id", "document", F.col("declared").alias("extracted"), *HEADER_PATHS)
    return attach_group(t.findings(), heads, ["doc_id"], "extracted", F.col("record_seq"), how="inner", sizes=t.finding_counts())


def resolve_one(t: Tables, doc: dict, targets: tuple[str, ...], df: DataFrame | None = None, keep=KEEP) -> DataFrame:
    return mapping.resolve(df if df is not None else records(t), targets, doc, SCOPE, b.VALUE_MAPS, keep)


@query("prj_path", """
SELECT document, id, company AS header_company, severity AS finding_severity, 'FA-77' AS prompt_contract,
 '''asset'' in ''asset.name'' is no part of a report' AS bad_scope,
 'the record has no field ''finding.colour''' AS bad_key FROM v_findings JOIN v_headers USING (doc_id)""")
def prj_path(t: Tables) -> DataFrame:
    found = [SCOPE.path(p)[0].alias(a) for p, a in (
        ("header.company", "header_company"), ("finding.severity", "finding_severity"),
        ("prompt.frame_agreement", "prompt_contract"))]
    errors = [F.lit(SCOPE.path(p)[1]).alias(a) for p, a in (("asset.name", "bad_scope"), ("finding.colour", "bad_key"))]
    return records(t).select("document", "id", *found, *errors)


@query("prj_text", """
SELECT doc_id, id, array_to_string(issues, ' | ') AS issues_text, array_to_string(user_tags, ' | ') AS tags_text,
 coalesce(page::VARCHAR, '') AS page_text FROM v_findings""")
def prj_text(t: Tables) -> DataFrame:
    return t.findings().select("doc_id", "id", tx.as_text(F.col("issues"), True).alias("issues_text"),
                               tx.as_text(F.col("user_tags"), True).alias("tags_text"),
                               tx.as_text(F.col("page")).alias("page_text"))


@query("prj_route", "SELECT document, line_ref, urgency_mark, sheet_no FROM v_res")
def prj_route(t: Tables) -> DataFrame:
    cols = ("line_ref", "urgency_mark", "sheet_no")
    out = resolve_one(t, load_mapping(b.MAPPING), cols)
    return mapping.good_rows(out, cols, ("document",))


@query("prj_const", "SELECT document, id, 'dock desk' AS intake_channel FROM v_findings JOIN v_headers USING (doc_id)")
def prj_const(t: Tables) -> DataFrame:
    out = resolve_one(t, load_mapping(b.MAPPING), ("intake_channel",))
    return mapping.good_rows(out, ("intake_channel",), ("document", "id"))


@query("prj_prompt", """
SELECT document, id, 'FA-77' AS frame_agreement, 'missing per-batch prompt answer ''crew''' AS crew_reason
FROM v_findings JOIN v_headers USING (doc_id)""")
def prj_prompt(t: Tables) -> DataFrame:
    doc = {"prompts": [{"key": "frame_agreement"}, {"key": "crew", "required": False}]}
    out = resolve_one(t, doc, ("frame_agreement", "crew"))
    return out.select("document", "id", F.col("t_frame_agreement.value").alias("frame_agreement"),
                      F.col("t_crew.reason").alias("crew_reason"))


PRECEDENCE = {
    "routes": {"a": {"from": "finding.severity", "tier": "T0"}},
    "constants": {"a": "const", "b": "const"},
    "formulas": {k: {"fn": "concat", "args": [{"lit": "f:"}, {"field": "finding.comments"}]} for k in "abc"},
    "prompts": [{"key": "frame_agreement", "target_field": k} for k in "abcd"],
}


@query("prj_dispatch", """
SELECT document, id, severity AS a, 'const' AS b, 'f:' || comments AS c, 'FA-77' AS d,
 'no rule fills ''e''' AS e FROM v_findings JOIN v_headers USING (doc_id)""")
def prj_dispatch(t: Tables) -> DataFrame:
    out = resolve_one(t, PRECEDENCE, tuple("abcde"))
    return out.select("document", "id", *[F.col(f"t_{k}.value").alias(k) for k in "abcd"], F.col("t_e.reason").alias("e"))


@query("prj_strict", """
SELECT document, line_ref AS ref, 'row' AS outcome, part_family AS field, handling AS detail FROM v_res
 WHERE part_family IS NOT NULL AND handling IS NOT NULL
UNION ALL SELECT document, line_ref, 'oov_value', 'part_family', issues_text FROM v_res WHERE part_family IS NULL
UNION ALL SELECT document, line_ref, 'oov_value', 'handling', urgency_mark FROM v_res WHERE handling IS NULL""")
def prj_strict(t: Tables) -> DataFrame:
    """Rows and exceptions are two branches of one projection: a record gives one row or its problems."""
    out = resolve_one(t, load_mapping(b.MAPPING), b.COLUMNS)
    row = F.array(F.struct(F.lit("row").alias("outcome"), F.col("t_part_family.value").alias("field"),
                           F.col("t_handling.value").alias("detail")))
    bad = F.transform("problems", lambda p: F.struct(p["kind"].alias("outcome"), p["field"].alias("field"),
                                                     p["value"].alias("detail")))
    return out.select("document", F.col("id").alias("ref"),
                      F.explode(F.when(F.size("problems") == 0, row).otherwise(bad)).alias("o")).select("document", "ref", "o.*")


@query("prj_preview", """
SELECT document, line_ref, ordered_on, coalesce(handling, '<<unresolved: value ''' || urgency_mark
  || ''' has no entry in the pinned value map>>') AS handling,
 coalesce(part_family, '<<unresolved: value ''' || issues_text || ''' has no entry in the pinned value map>>') AS part_family,
 '<<frame_agreement>>' AS frame_agreement FROM v_res""")
def prj_preview(t: Tables) -> DataFrame:
    doc = load_mapping(b.MAPPING)
    scope = mapping.Scope(HEADER_PATHS, FINDING_PATHS, mapping.prompt_markers(doc), LISTS)
    cols = ("line_ref", "ordered_on", "handling", "part_family", "frame_agreement")
    out = mapping.resolve(records(t), cols, doc, scope, b.VALUE_MAPS, KEEP)
    return mapping.preview(out, cols, ("document",))


@query("prj_optional", """
SELECT document, company AS site, '' AS inspector, '' AS comments,
 strftime(strptime(report_date, '%b %d, %Y'), '%d/%m/%Y') AS day FROM v_headers""")
def prj_optional(t: Tables) -> DataFrame:
    """Optional header fields: what cannot be resolved stays empty and blocks nothing."""
    doc = {"routes": {"site": {"from": "header.company", "tier": "T0"}, "inspector": {"from": "header.inspector", "tier": "T0"},
                      "comments": {"from": "finding.comments", "tier": "T0"}},
           "formulas": {"day": {"fn": "date_format", "args": [{"field": "header.report_date"}, {"lit": "%d/%m/%Y"}]}}}
    scope = mapping.Scope(HEADER_PATHS, {}, b.ANSWERS, LISTS)
    cols = ("site", "inspector", "comments", "day")
    out = mapping.resolve(t.headers(), cols, doc, scope, b.VALUE_MAPS, ("document",))
    return out.select("document", *[F.coalesce(F.col(f"t_{c}.value"), F.lit("")).alias(c) for c in cols])


@query("prj_split", """
WITH s AS (SELECT doc_id, line_no, CASE WHEN text = '' THEN []::VARCHAR[] ELSE list_transform(string_split(text, '.'), lambda x: trim(x)) END AS kept FROM v_lines)
SELECT doc_id, line_no::BIGINT AS line_no, array_to_string(list_filter(kept, lambda x: x <> ''), '/') AS dropped_blanks,
 array_to_string(kept, '/') AS kept_blanks FROM s""")
def prj_split(t: Tables) -> DataFrame:
    return t.text_lines().select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.array_join(tx.split_list(F.col("text"), "."), "/").alias("dropped_blanks"),
        F.array_join(tx.split_list(F.col("text"), ".", keep_blank=True), "/").alias("kept_blanks"))


@query("prj_skeleton", """
SELECT coalesce(p.session_id, q.transform_id) AS session_id, coalesce(p.target_field, q.target_field) AS target_field,
 coalesce(p.from_path, '?') AS from_path, CASE WHEN p.target_field IS NULL THEN 'T3' ELSE 'T2' END AS tier
FROM v_proposals p FULL OUTER JOIN v_required q ON q.transform_id = p.session_id AND q.target_field = p.target_field""")
def prj_skeleton(t: Tables) -> DataFrame:
    """Draft rules of every new pair: proposals wait at T2, required fields without one are T3 stubs."""
    p = t.proposals().withColumn("proposed", F.lit(True))
    q = t.required().withColumnRenamed("transform_id", "session_id")
    return p.join(q, ["session_id", "target_field"], "full").select(
        "session_id", "target_field", F.coalesce("from_path", F.lit("?")).alias("from_path"),
        F.when(F.col("proposed"), "T2").otherwise("T3").alias("tier"))
