"""Grid target queries: axes, cells, extents, rotation, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.operators import matrix
from conform.plans.bindings import Tables
from conform.plans.catalog import query
from conform.plans.oracle import VIEWS

VIEWS["v_shape"] = r"""
SELECT g.doc_id, n_rows, n_cols, n.j AS number_col, coalesce(n.j + 1, 0) AS text_col
FROM (SELECT doc_id, max(i) + 1 AS n_rows, max(j) + 1 AS n_cols FROM v_cells GROUP BY doc_id) g
LEFT JOIN (SELECT doc_id, min(j) AS j FROM (SELECT doc_id, j FROM v_cells WHERE i >= 1 AND j < 3 AND text <> '' GROUP BY doc_id, j
  HAVING count(*) FILTER (regexp_full_match(text, '[0-9]+(\.[0-9]+)*')) >= greatest(1, count(*) // 2)) GROUP BY doc_id) n USING (doc_id)
"""
VIEWS["v_axes"] = r"""
SELECT doc_id, axis, idx, number, label, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS entry_id FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY axis DESC, idx) AS n FROM (
  SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM (
   SELECT c.doc_id, 'row' AS axis, c.i AS idx, nullif(m.text, '') AS number, coalesce(nullif(x.text, ''), nullif(m.text, ''), 'row_' || c.i) AS label
   FROM v_cells c JOIN v_shape s ON s.doc_id = c.doc_id AND s.n_cols >= 3 AND s.n_rows >= 2
   LEFT JOIN v_cells x ON x.doc_id = c.doc_id AND x.i = c.i AND x.j = s.text_col
   LEFT JOIN v_cells m ON m.doc_id = c.doc_id AND m.i = c.i AND m.j = s.number_col WHERE c.j = 0 AND c.i >= 1
   UNION ALL SELECT s.doc_id, 'col', c.j, NULL, c.text FROM v_shape s JOIN v_cells c ON c.doc_id = s.doc_id AND c.i = 0
   WHERE s.n_cols >= 3 AND s.n_rows >= 2 AND c.j <> s.text_col AND (s.number_col IS NULL OR c.j <> s.number_col))))
"""
VIEWS["v_blank"] = """
SELECT *, CASE rotation WHEN 90 THEN height - bottom WHEN 180 THEN width - x1 WHEN 270 THEN top ELSE x0 END AS bx0,
 CASE rotation WHEN 90 THEN width - x1 WHEN 180 THEN top WHEN 270 THEN x0 ELSE height - bottom END AS by0,
 CASE rotation WHEN 90 THEN height - top WHEN 180 THEN width - x0 WHEN 270 THEN bottom ELSE x1 END AS bx1,
 CASE rotation WHEN 90 THEN width - x0 WHEN 180 THEN bottom WHEN 270 THEN x1 ELSE height - top END AS by1
FROM v_cells WHERE text = '' AND x1 - x0 >= 12 AND bottom - top >= 8
"""
VIEWS["v_matrix"] = """
SELECT b.doc_id, b.i, b.j, r.entry_id AS row_id, c.entry_id AS col_id, r.label || ' × ' || c.label AS label, r.entry_id || '__' || c.entry_id AS target_field,
 'matrix' AS association, bx0, by0, bx1, by1 FROM v_blank b JOIN v_axes r ON r.doc_id = b.doc_id AND r.axis = 'row' AND r.idx = b.i
 JOIN v_axes c ON c.doc_id = b.doc_id AND c.axis = 'col' AND c.idx = b.j
"""
VIEWS["v_near"] = r"""
SELECT *, CASE WHEN s0 = '' THEN 'cell_p1_r' || i || '_c' || j ELSE s0 END AS base, CASE WHEN s0 = '' THEN 'cell_p1_r' || i || '_c' || j ELSE label0 END AS label,
 CASE WHEN s0 = '' THEN 'positional' WHEN l IS NOT NULL THEN 'row_label' ELSE 'col_header' END AS association FROM (
 SELECT b.doc_id, b.i, b.j, b.bx0, b.by0, b.bx1, b.by1, arg_max(c.text, c.j) FILTER (c.i = b.i AND c.j < b.j) AS l,
  arg_max(c.text, c.i) FILTER (c.j = b.j AND c.i < b.i) AS u, coalesce(l, u, '') AS label0,
  trim(regexp_replace(lower(label0), '[^a-z0-9]+', '_', 'g'), '_') AS s0
 FROM v_blank b LEFT JOIN v_cells c ON c.doc_id = b.doc_id AND c.text <> '' AND (c.i = b.i OR c.j = b.j) GROUP BY ALL)
"""
VIEWS["v_flat"] = """
SELECT doc_id, i, j, label, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS target_field, association, bx0, by0, bx1, by1 FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY i, j) AS n FROM v_near {where})
"""
VIEWS["v_flat_small"] = VIEWS["v_flat"].replace("{where}", "WHERE doc_id % 20 = 4")
VIEWS["v_flat"] = VIEWS["v_flat"].replace("{where}", "")


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


BOX = ("bx0", "by0", "bx1", "by1")


@query("agg_numcol", "SELECT doc_id, n_rows::BIGINT AS n_rows, n_cols::BIGINT AS n_cols, coalesce(number_col, -1)::BIGINT AS number_col, text_col::BIGINT AS text_col FROM v_shape")
def agg_numcol(t: Tables) -> DataFrame:
    return matrix.shapes(t.cells()).fillna(-1, ["number_col"]).select("doc_id", *long("n_rows", "n_cols", "number_col", "text_col"))


@query("dq_matrix", """
SELECT doc_id, i, j, label, target_field, association, bx0, by0, bx1, by1 FROM v_matrix UNION ALL SELECT * FROM v_flat_small""")
def dq_matrix(t: Tables) -> DataFrame:
    return matrix.reconstruct(t.cells()).select("doc_id", *long("i", "j"), "label", "target_field", "association", *BOX)


@query("fn_rotate", """
SELECT doc_id, i, j, bx0, by0, bx1, by1 FROM v_blank""")
def fn_rotate(t: Tables) -> DataFrame:
    return t.cells().filter(matrix.fillable()).select("doc_id", *long("i", "j"), *matrix.cell_bbox())


@query("fn_derive", "SELECT doc_id, i, j, row_id || '__' || col_id AS target_field FROM v_matrix")
def fn_derive(t: Tables) -> DataFrame:
    c = t.cells()
    return matrix.matrix_cells(c, matrix.axes(c, matrix.shapes(c))).select(
        "doc_id", *long("i", "j"), matrix.derived_field(F.col("row_id"), F.col("col_id")).alias("target_field"))


@query("agg_bbox", """
SELECT doc_id, 'row' AS axis, row_id AS entry_id, min(bx0) AS bx0, min(by0) AS by0, max(bx1) AS bx1, max(by1) AS by1, count(*) AS cells FROM v_matrix GROUP BY ALL
UNION ALL SELECT doc_id, 'col', col_id, min(bx0), min(by0), max(bx1), max(by1), count(*) FROM v_matrix GROUP BY ALL""")
def agg_bbox(t: Tables) -> DataFrame:
    c = t.cells()
    return matrix.extents(matrix.matrix_cells(c, matrix.axes(c, matrix.shapes(c)))).select("doc_id", "axis", "entry_id", *BOX, "cells")


@query("win_nearlabel", "SELECT doc_id, i, j, label, association FROM v_near")
def win_nearlabel(t: Tables) -> DataFrame:
    return matrix.near_labels(t.cells()).select("doc_id", *long("i", "j"), "label", "association")


@query("win_uniq", "SELECT doc_id, i, j, target_field FROM v_flat")
def win_uniq(t: Tables) -> DataFrame:
    return matrix.flat_cells(t.cells()).select("doc_id", *long("i", "j"), "target_field")


@query("jn_axis", """
WITH s AS (SELECT o_orderkey, o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'row' ELSE 'col' END AS axis, o_orderkey % 10 AS idx FROM orders)
SELECT s.o_orderkey AS suggestion, s.axis, s.idx, CASE WHEN idx >= CASE WHEN s.axis = 'row' THEN n_rows ELSE n_cols END THEN 'unknown_index'
 WHEN a.entry_id IS NULL THEN 'unmatched_axis_entry' ELSE 'annotated' END AS status
FROM s JOIN v_shape h USING (doc_id) LEFT JOIN v_axes a USING (doc_id, axis, idx)""")
def jn_axis(t: Tables) -> DataFrame:
    c = t.cells()
    shape = matrix.shapes(c)
    k = F.col("o_orderkey")
    s = t.t("orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"),
                             k.alias("suggestion"), F.when(k % 2 == 0, "row").otherwise("col").alias("axis"), (k % 10).alias("idx"))
    return matrix.bind_suggestions(s, shape, matrix.axes(c, shape)).select("suggestion", "axis", "idx", "status")


@query("prj_accept", """
WITH e AS (SELECT doc_id, idx - 1 AS idx, label, CASE WHEN (doc_id + idx) % 2 = 0 THEN 'S' || idx END AS suggested FROM v_axes WHERE axis = 'row'),
a AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderkey % 9 AS idx,
  ['rename','accept_suggestion','reject_suggestion','drop'][(o_orderkey // 9) % 4 + 1] AS action FROM orders),
f AS (SELECT *, min(CASE WHEN action <> 'drop' THEN seq END) OVER (PARTITION BY doc_id, idx) AS first_seq FROM a),
r AS (SELECT f.*, suggested, CASE WHEN e.label IS NULL THEN 'unknown entry' WHEN action = 'drop' THEN 'unknown action'
  WHEN action = 'accept_suggestion' AND (suggested IS NULL OR seq <> first_seq) THEN 'no suggestion' ELSE 'ok' END AS status FROM f LEFT JOIN e USING (doc_id, idx))
SELECT doc_id, idx, seq, action, status, coalesce(CASE WHEN status <> 'ok' THEN NULL WHEN action = 'rename' THEN 'N' || seq WHEN action = 'accept_suggestion' THEN suggested END, '') AS new_label FROM r""")
def prj_accept(t: Tables) -> DataFrame:
    c = t.cells()
    ax = matrix.axes(c, matrix.shapes(c)).filter(F.col("axis") == "row")
    idx = F.col("idx").cast("long")
    entries = ax.select("doc_id", (idx - 1).alias("idx"), "label", F.when(
        (F.col("doc_id") + idx) % 2 == 0, F.concat(F.lit("S"), idx.cast("string"))).alias("suggested"))
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("rename", "accept_suggestion", "reject_suggestion", "drop")))
    actions = t.t("orders").select(F.col("o_custkey").alias("doc_id"), k.alias("seq"), (k % 9).alias("idx"),
                                   F.element_at(names, (F.floor(k / 9) % 4 + 1).cast("int")).alias("action"),
                                   F.concat(F.lit("N"), k.cast("string")).alias("new_text"))
    return matrix.apply_axis_actions(actions, entries, ["doc_id", "idx"]).select(
        "doc_id", "idx", "seq", "action", "status", F.coalesce("new_label", F.lit("")).alias("new_label"))
