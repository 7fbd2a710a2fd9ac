"""Filter queries: running lines, header lines, vocabularies, parse errors, prompts, drafts, review state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.operators import layout, validate
from conform.operators.matrix import MIN_HEIGHT, MIN_WIDTH, fillable
from conform.plans import bindings as b
from conform.plans.bindings import Tables
from conform.plans.catalog import query
from conform.plans.scoring import sheet_bundle, make_run

PREFIXES = ("Licensed under", "Released under", "The and", "Of.")


@query("flt_furn", """
SELECT doc_id, line_no::BIGINT AS line_no, text FROM v_lines WHERE NOT (starts_with(text, 'Licensed under')
 OR starts_with(text, 'Released under') OR starts_with(text, 'The and') OR starts_with(text, 'Of.'))""")
def flt_furn(t: Tables) -> DataFrame:
    return layout.without_furniture(t.text_lines(), PREFIXES).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


@query("flt_hdrline", r"""
SELECT doc_id, page, line_top, text FROM v_plines WHERE NOT regexp_matches(text, '^Id\s+Severity')""")
def flt_hdrline(t: Tables) -> DataFrame:
    return layout.without_header_lines(layout.visual_lines(t.printed_pages()), r"Id\s+Severity").select("doc_id", "page", "line_top", "text")


@query("flt_rowpat", r"""
SELECT doc_id, page, line_top, text FROM v_plines WHERE regexp_matches(text, '^F[0-9]{12}-[0-9]{12}-[0-9]+ ')""")
def flt_rowpat(t: Tables) -> DataFrame:
    lines = layout.visual_lines(t.printed_pages())
    first = layout.column_cells(F.col("words"), b.X_RANGES[:1])[0]
    return layout.matching_rows(lines, first, b.ROW_PATTERN).select("doc_id", "page", "line_top", "text")


@query("flt_vocab", """
SELECT document, line_ref, part_family, part_family IN ('A1','A2','C2','C3','D3','E4') AS legal FROM v_rows""")
def flt_vocab(t: Tables) -> DataFrame:
    """Converted rows, legal or not: an illegal value removes the row and is reported."""
    bundle = sheet_bundle()
    out = make_run(t).outcome(bundle).filter(~F.col("unresolved"))
    checked = validate.split_by_vocabulary(out.drop("errors"), bundle.template.vocabularies)
    return checked.select("document", "line_ref", "part_family", (F.size("violations") == 0).alias("legal"))


@query("flt_parse", """
SELECT document, line_ref AS id, parse_error, CASE WHEN parse_error LIKE 'severity %' THEN 'severity None outside vocabulary' ELSE parse_error END AS without_severity
FROM v_res WHERE parse_error IS NOT NULL""")
def flt_parse(t: Tables) -> DataFrame:
    """Records that could not be read; a severity outside the list and a missing one are both errors."""
    f = t.findings().join(t.headers().select("doc_id", "document"), "doc_id")
    err = validate.parse_error(F.col("severity"), F.col("page"), F.col("page_text"), b.SEVERITIES)
    listed = F.when(F.col("severity").isin(*b.SEVERITIES), F.col("severity"))
    missing = validate.parse_error(listed, F.col("page"), F.col("page_text"), b.SEVERITIES)
    return f.select("document", "id", err.alias("parse_error"), missing.alias("without_severity")).filter(F.col("parse_error").isNotNull())


@query("flt_prompts", """
SELECT DISTINCT transform_id, spec AS prompt_key FROM v_rules r WHERE mechanism = 'prompt' AND NOT EXISTS (
 SELECT 1 FROM conversations c WHERE c.conv_id = r.transform_id AND c.role = 'user' AND 'ask_' || (c.turn % 4) = r.spec)""")
def flt_prompts(t: Tables) -> DataFrame:
    """Prompt answers still missing, over all requested runs (checked before any record is read)."""
    need = t.rules().filter(F.col("mechanism") == "prompt").select("transform_id", F.col("spec").alias("prompt_key")).distinct()
    have = t.t("conversations").filter(F.col("role") == "user").select(
        F.col("conv_id").alias("transform_id"), F.concat(F.lit("ask_"), (F.col("turn") % 4).cast("string")).alias("prompt_key"))
    return need.join(have, ["transform_id", "prompt_key"], "left_anti")


@query("flt_draft", """
WITH refs AS (SELECT transform_id, 'profile' AS kind, profile || '@v' || (transform_id % 4 + 1) AS ref FROM v_transforms
  UNION ALL SELECT transform_id, 'template', template || '@' || (transform_id % 3 + 1) FROM v_transforms),
reg AS (SELECT DISTINCT 'profile' AS kind, 'shape_' || (s_suppkey % 6) || '@v' || (s_suppkey % 3 + 1) AS ref FROM supplier WHERE s_acctbal > 0
  UNION SELECT 'template', n_name || '@1' FROM nation UNION SELECT 'template', n_name || '@2' FROM nation WHERE n_regionkey < 3),
drafts AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'profile' ELSE 'template' END AS kind, conv_id FROM conversations GROUP BY conv_id HAVING max(turn) < 4)
SELECT transform_id, r.kind, r.ref, d.n AS drafts, d.first_draft FROM refs r
JOIN (SELECT kind, count(*) AS n, min(conv_id) AS first_draft FROM drafts GROUP BY 1) d ON d.kind = r.kind
WHERE NOT EXISTS (SELECT 1 FROM reg g WHERE g.kind = r.kind AND g.ref = r.ref)""")
def flt_draft(t: Tables) -> DataFrame:
    """Runs that name something unregistered while drafts of that kind exist."""
    x = t.transforms()
    refs = x.select("transform_id", F.lit("profile").alias("kind"),
                    F.concat("profile", F.lit("@v"), (F.col("transform_id") % 4 + 1).cast("string")).alias("ref")).unionByName(
        x.select("transform_id", F.lit("template").alias("kind"),
                 F.concat("template", F.lit("@"), (F.col("transform_id") % 3 + 1).cast("string")).alias("ref")))
    n = t.t("nation")
    reg = t.t("supplier").filter(F.col("s_acctbal") > 0).select(F.lit("profile").alias("kind"), F.concat(
        F.lit("shape_"), (F.col("s_suppkey") % 6).cast("string"), F.lit("@v"), (F.col("s_suppkey") % 3 + 1).cast("string")).alias("ref")) \
        .unionByName(n.select(F.lit("template").alias("kind"), F.concat("n_name", F.lit("@1")).alias("ref"))) \
        .unionByName(n.filter(F.col("n_regionkey") < 3).select(F.lit("template").alias("kind"), F.concat("n_name", F.lit("@2")).alias("ref"))).distinct()
    drafts = t.t("conversations").groupBy("conv_id").agg(F.max("turn").alias("m")).filter(F.col("m") < 4).groupBy(
        F.when(F.col("conv_id") % 2 == 0, "profile").otherwise("template").alias("kind")).agg(
        F.count("*").alias("drafts"), F.min("conv_id").alias("first_draft"))
    return refs.join(reg, ["kind", "ref"], "left_anti").join(drafts, "kind").select("transform_id", "kind", "ref", "drafts", "first_draft")


@query("flt_active", "SELECT 'shape_' || s_suppkey AS profile, s_name FROM supplier WHERE s_acctbal >= 0")
def flt_active(t: Tables) -> DataFrame:
    reg = t.t("supplier").withColumn("status", F.when(F.col("s_acctbal") < 0, "superseded").otherwise("active"))
    return reg.filter(F.col("status") == "active").select(
        F.concat(F.lit("shape_"), F.col("s_suppkey").cast("string")).alias("profile"), "s_name")


@query("flt_unreviewed", "SELECT transform_id, target_field, tier FROM v_rules WHERE tier IN ('T2', 'T3')")
def flt_unreviewed(t: Tables) -> DataFrame:
    return t.rules().filter(F.col("tier").isin("T2", "T3")).select("transform_id", "target_field", "tier")


@query("flt_cellsize", """
SELECT doc_id, i, j FROM v_cells WHERE trim(text) = '' AND x1 - x0 >= 12 AND bottom - top >= 8""")
def flt_cellsize(t: Tables) -> DataFrame:
    return t.cells().filter(fillable()).select("doc_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


assert (MIN_WIDTH, MIN_HEIGHT) == (12.0, 8.0)
