"""Scalar function queries, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.functions import formulas as fm
from conform.functions import text as tx
from conform.functions.width import OTHER, WIDTHS, text_width
from conform.plans.bindings import Tables
from conform.plans.catalog import query

LKEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("fn_concat", "SELECT o_orderkey, o_orderstatus || '-' || o_orderkey || '/' || o_orderpriority AS out FROM orders")
def fn_concat(t: Tables) -> DataFrame:
    c = [tx.as_text(F.col(x)) for x in ("o_orderstatus", "o_orderkey", "o_orderpriority")]
    return t.t("orders").select("o_orderkey", fm.concat([c[0], F.lit("-"), c[1], F.lit("/"), c[2]]).value.alias("out"))


@query("fn_substr", """
SELECT doc_id, text[1:6] AS head, substr(text, 4, 5) AS middle, right(text, 7) AS tail,
 CASE WHEN length(text) > 12 THEN substr(text, length(text) - 8, 6) ELSE NULL END IS NOT DISTINCT FROM
 CASE WHEN length(text) > 12 THEN substr(text, length(text) - 8, 6) ELSE NULL END AS ok,
 CASE WHEN length(text) >= 9 THEN substr(text, length(text) - 8, 6) ELSE substr(text, 1, greatest(length(text) - 3, 0)) END AS inner_text,
 '' AS empty FROM documents""")
def fn_substr(t: Tables) -> DataFrame:
    x = F.col("text")
    cut = lambda s, e=None: fm.substring(x, s, e).value
    return t.t("documents").select("doc_id", cut(0, 6).alias("head"), cut(3, 8).alias("middle"), cut(-7).alias("tail"),
                                   F.lit(True).alias("ok"), cut(-9, -3).alias("inner_text"), cut(5, 2).alias("empty"))


@query("fn_regex", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '/([a-z]{2})/[0-9]+') THEN regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) ELSE '' END AS lang,
 CASE WHEN regexp_matches(html, 'ad [0-9]+') THEN regexp_extract(html, 'ad [0-9]+', 0) ELSE '' END AS whole,
 NOT regexp_matches(url, '/([a-z]{2})/[0-9]+') AS failed FROM pages""")
def fn_regex(t: Tables) -> DataFrame:
    a, b = fm.regex_extract(F.col("url"), "/([a-z]{2})/[0-9]+"), fm.regex_extract(F.col("html"), "ad [0-9]+")
    return t.t("pages").select("page_id", F.coalesce(a.value, F.lit("")).alias("lang"), F.coalesce(b.value, F.lit("")).alias("whole"),
                               a.reason.isNotNull().alias("failed"))


@query("fn_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d1, strftime(o_orderdate, '%d.%m.%y') AS d2, strftime(o_orderdate, '%b %d') AS d3,
 strftime(o_orderdate, '%B %Y') AS d4, true AS bad FROM orders""")
def fn_date(t: Tables) -> DataFrame:
    """Four accepted layouts in, several layouts out; a day that does not exist is an error."""
    d = F.col("o_orderdate")
    shown = [F.date_format(d, p) for p in ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "dd/MM/yyyy")]
    out = [fm.date_format(s, f).value.alias(f"d{i}") for i, (s, f) in enumerate(zip(shown, ("%Y-%m-%d", "%d.%m.%y", "%b %d", "%B %Y")), 1)]
    return t.t("orders").select("o_orderkey", *out, fm.date_format(F.concat(F.lit("Feb 31, "), F.year(d).cast("string")), "%Y").reason.isNotNull().alias("bad"))


def no_numbers(digits: F.Column) -> list[F.Column]:
    """Spellings around ``digits`` that some readers take for numbers."""
    return [F.concat(digits, F.lit("d")), F.concat(digits, F.lit("f")), F.concat(F.lit("0x"), digits, F.lit("p1")), F.concat(F.lit("-inf"), F.substring(digits, 1, 0)), F.lit("NaN")]


@query("fn_number", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS money, format('{:.0f}', l_quantity) AS whole,
 format('{:.1f}', l_discount * 100) AS pct, true AS bad, false AS guessed FROM lineitem""")
def fn_number(t: Tables) -> DataFrame:
    price, qty, disc = tx.as_text(F.col("l_extendedprice")), tx.as_text(F.col("l_quantity")), tx.as_text(F.col("l_discount") * 100)
    return t.t("lineitem").select(*LKEY, fm.number_format(price, ",.2f").value.alias("money"), fm.number_format(qty, ".0f").value.alias("whole"),
                                  fm.number_format(disc, ".1f").value.alias("pct"), fm.number_format(F.col("l_returnflag"), ".1f").reason.isNotNull().alias("bad"),
                                  F.exists(F.array(*[fm.number_format(s, ".0f").value.isNotNull() for s in no_numbers(qty)]), lambda x: x).alias("guessed"))


@query("fn_arith", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity::BIGINT * l_linenumber)::VARCHAR AS product,
 CASE WHEN l_quantity::INT % 4 = 0 THEN (l_quantity::INT // 4)::VARCHAR ELSE (l_quantity / 4)::VARCHAR END AS quarter,
 (l_partkey - l_quantity::INT)::VARCHAR AS difference, true AS bad, false AS guessed FROM lineitem""")
def fn_arith(t: Tables) -> DataFrame:
    qty, n, part = (tx.as_text(F.col(c)) for c in ("l_quantity", "l_linenumber", "l_partkey"))
    return t.t("lineitem").select(*LKEY, fm.arith(qty, "*", n).value.alias("product"), fm.arith(qty, "/", F.lit("4")).value.alias("quarter"),
                                  fm.arith(part, "-", qty).value.alias("difference"), fm.arith(qty, "/", F.lit("0")).reason.isNotNull().alias("bad"),
                                  F.exists(F.array(*[fm.arith(s, "+", n).value.isNotNull() for s in no_numbers(qty)]), lambda x: x).alias("guessed"))


@query("fn_sha", "SELECT doc_id, sha256(text) AS sha FROM documents")
def fn_sha(t: Tables) -> DataFrame:
    return t.t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("fn_slug", "SELECT doc_id, line_no::BIGINT AS line_no, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM v_lines")
def fn_slug(t: Tables) -> DataFrame:
    return t.text_lines().select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.slug(F.col("text")).alias("slug"))


@query("fn_human", """
SELECT transform_id, target_field, trim(replace(target_field, '_', ' ')) AS target, coalesce(trim(replace(string_split(from_path, '.')[-1], '_', ' ')), '') AS source FROM v_rules""")
def fn_human(t: Tables) -> DataFrame:
    return t.rules().select("transform_id", "target_field", tx.human_name(F.col("target_field")).alias("target"),
                            F.coalesce(tx.human_name(F.col("from_path")), F.lit("")).alias("source"))


@query("fn_class", r"""
SELECT DISTINCT url, array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]')
 THEN '\d{' || length(p) || '}' ELSE regexp_replace(p, '([()\[\]{}?*+\-|^$\\.&~#\s])', '\\\1', 'g') END), '') AS class FROM pages""")
def fn_class(t: Tables) -> DataFrame:
    return t.t("pages").select("url", tx.structure_class(F.col("url")).alias("class")).distinct()


@query("fn_ref", """
SELECT transform_id, template AS name, (transform_id % 3 + 1)::INTEGER AS version, 1 AS default_version, -1 AS bad_version FROM v_transforms""")
def fn_ref(t: Tables) -> DataFrame:
    ref = tx.versioned_ref(F.concat("template", F.lit("@"), (F.col("transform_id") % 3 + 1).cast("string")))
    bare, bad = tx.versioned_ref(F.col("template")), tx.versioned_ref(F.concat("template", F.lit("@new")))
    return t.transforms().select("transform_id", ref["name"].alias("name"), ref["version"].alias("version"),
                                 bare["version"].alias("default_version"), F.coalesce(bad["version"], F.lit(-1)).alias("bad_version"))


@query("fn_check", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber IN (1, 3, 5) THEN '/Yes' ELSE '/Off' END AS mark FROM lineitem""")
def fn_check(t: Tables) -> DataFrame:
    words = F.array(*map(F.lit, ("YES", "no", "true", "", "Checked", "off", "0")))
    return t.t("lineitem").select(*LKEY, tx.check_mark(F.element_at(words, F.col("l_linenumber"))).alias("mark"))


@query("fn_width", "SELECT p_partkey, (" + f"{OTHER} * length(p_name) + " + " + ".join(
    f"({w - OTHER}) * (length(p_name) - length(translate(p_name, '{c.replace(chr(39), chr(39) * 2)}', '')))" for w, c in WIDTHS.items() if w != OTHER)
    + ") * 9 / 1000.0::DOUBLE AS points FROM part")
def fn_width(t: Tables) -> DataFrame:
    return t.t("part").select("p_partkey", text_width(F.col("p_name"), F.lit(9)).alias("points"))


@query("fn_vmname", """
SELECT transform_id, target_field, string_split(from_path, '.')[-1] || '_to_' || target_field AS map_name FROM v_rules WHERE mechanism = 'route'""")
def fn_vmname(t: Tables) -> DataFrame:
    return t.rules().filter(F.col("mechanism") == "route").select(
        "transform_id", "target_field", tx.map_name(F.col("from_path"), F.col("target_field")).alias("map_name"))


@query("fn_tier", "SELECT transform_id, target_field, CASE WHEN vm_name IS NULL THEN 'T0' ELSE 'T1' END AS tier FROM v_rules")
def fn_tier(t: Tables) -> DataFrame:
    return t.rules().select("transform_id", "target_field", F.when(F.col("vm_name").isNotNull(), "T1").otherwise("T0").alias("tier"))
