"""From reviewed elements to registered configuration: assembly of recipes and templates, and verification of a recipe by running it.

Elements are rows (``proposal_id``, ``seq``, ``kind``, ``state``, ``payload``); ``payload`` is a struct with the fields of ``PAYLOAD``, of
which each kind uses some. Only confirmed and corrected elements count. A proposal is a review unit of some dozens of
elements, so its configuration is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.operators import detect, recipes
from conform.sources.config import Profile

PAYLOAD = ("name string, text string, strategy string, labels array<string>, example_value string, lo double, hi double, separator string, row_pattern string, "
           "table_header string, header_regex string, recurrence long, field_kind string, max_len int, options array<string>, bbox array<double>, font_size double, cardinality string")
# States that survive a review, and what makes an assembly fail.
KEPT = ("confirmed", "corrected")
NO_TABLE, NO_ANCHORS, NOT_ONE_LAYOUT = "no confirmed record table", "no confirmed anchors", "needs form fields or overlay regions, not both"
RECIPE_ASSEMBLY = "recipe_assembly"


def _parts(elements: DataFrame) -> DataFrame:
    """One row per proposal with its kept elements in order; a proposal of which nothing was kept has none."""
    kept = F.when(F.col("state").isin(*KEPT), F.struct("seq", "kind", "state", "payload"))
    return elements.groupBy("proposal_id").agg(F.array_sort(F.collect_list(kept)).alias("parts"))


def _of(kind: str) -> Column:
    return F.transform(F.filter("parts", lambda e: e["kind"] == kind), lambda e: e["payload"])


def assemble_recipes(elements: DataFrame) -> DataFrame:
    """One row per proposal: ``profile`` (the proposal), the parts of a recipe as extraction reads them, ``error`` (or "") and the evidence.

    ``columns_confirmed`` are the names of all confirmed columns; only those with an x-range can be extracted. ``recurrence`` is the
    number of rows the reviewer saw, ``examples`` the header values that were confirmed as they stood.
    """
    df = _parts(elements).withColumn("table", F.get(_of("record_table"), F.lit(0)))
    anchors = F.transform(_of("fingerprint_anchor"), lambda p: p["text"])
    columns = _of("record_column")
    ranged = F.transform(F.filter(columns, lambda p: p["lo"].isNotNull() & p["hi"].isNotNull()), lambda p: F.struct(p["name"].alias("name"), p["lo"].alias("lo"), p["hi"].alias("hi"), p["separator"].alias("separator")))
    fields = F.transform(_of("header_field"), lambda p: F.struct(p["name"].alias("name"), p["strategy"].alias("strategy"), p["labels"].alias("labels")))
    shown = F.filter("parts", lambda e: (e["kind"] == "header_field") & (e["state"] == "confirmed") & (F.coalesce(e["payload"]["example_value"], F.lit("")) != ""))
    error = F.when(F.col("table").isNull(), NO_TABLE).when((F.size(anchors) == 0) & F.col("table.header_regex").isNull(), NO_ANCHORS).otherwise("")
    return df.select(
        F.col("proposal_id").alias("profile"), anchors.alias("required_text"), F.col("table.header_regex").alias("header_regex"), fields.alias("fields"), ranged.alias("columns"),
        F.col("table.row_pattern").alias("row_pattern"), F.col("table.table_header").alias("table_header"), F.transform(_of("furniture_line"), lambda p: p["text"]).alias("furniture"),
        error.alias("error"), F.transform(columns, lambda p: p["name"]).alias("columns_confirmed"), F.col("table.recurrence").alias("recurrence"),
        F.transform(shown, lambda e: F.struct(e["payload"]["name"].alias("name"), e["payload"]["example_value"].alias("value"))).alias("examples"))


def assemble_templates(elements: DataFrame) -> DataFrame:
    """One row per proposal: ``kind`` (pdf_form or pdf_overlay), ``cardinality`` (per_record unless reviewed otherwise), ``fields`` or ``regions``, ``error``."""
    df = _parts(elements).select("proposal_id", _of("form_field").alias("f"), _of("overlay_region").alias("r"), F.get(_of("cardinality"), F.lit(0))["cardinality"].alias("c"))
    form, overlay = F.size("f") > 0, F.size("r") > 0
    fields = F.transform("f", lambda p: F.struct(p["name"].alias("target_field"), p["field_kind"].alias("kind"), p["max_len"].alias("max_len"), p["options"].alias("options")))
    regions = F.transform("r", lambda p: F.struct(p["name"].alias("target_field"), p["field_kind"].alias("kind"), p["bbox"].alias("bbox"), p["font_size"].alias("font_size")))
    return df.select("proposal_id", F.when(form & ~overlay, "pdf_form").when(overlay & ~form, "pdf_overlay").alias("kind"), F.coalesce("c", F.lit("per_record")).alias("cardinality"),
                     fields.alias("fields"), regions.alias("regions"), F.when(form == overlay, NOT_ONE_LAYOUT).otherwise("").alias("error"))


def verify(assembled: DataFrame, exemplars: DataFrame, lines: DataFrame, lead: DataFrame, registered: Sequence[Profile]) -> DataFrame:
    """(``profile``, ``exemplar``, ``check_name``, ``ok``): every check of every assembled recipe, by extracting its exemplars with it.

    ``exemplars`` (``doc_id``, ``profile``, ``exemplar`` from 0) may be any number of documents per proposal; ``lines`` and ``lead`` are those of the
    exemplars. Row count and header values are those the reviewer saw on the first exemplar, which no active profile of ``registered``
    may claim. A proposal that could not be assembled has the one failed check ``recipe_assembly``.
    """
    good = assembled.filter("error = ''")
    table = good.select("profile", "required_text", "header_regex", "fields", "columns", "row_pattern", "table_header", "furniture")
    claimed = exemplars.select("doc_id", "profile")
    found = recipes.records(lines, claimed, table).groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.first(F.transform("cells", lambda c: c["name"])).alias("names"))
    heads = recipes.headers(lines, claimed, table).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("header"))
    whole = recipes.integrity(lead, claimed, table).select("doc_id", (F.size("anchors_missing") == 0).alias("whole"))
    df = exemplars.join(good.select("profile", "columns_confirmed", "recurrence", "examples"), "profile").join(
        found, "doc_id", "left").join(heads, "doc_id", "left").join(whole, "doc_id", "left").join(lead, "doc_id", "left")
    first, rows = F.col("exemplar") == 0, F.coalesce("rows", F.lit(0))
    got = lambda name: F.coalesce(F.try_element_at("header", name), F.lit(""))
    check = lambda name, ok: F.struct(F.lit(name).alias("check_name") if isinstance(name, str) else name.alias("check_name"), F.coalesce(ok, F.lit(False)).alias("ok"))
    checks = F.array_compact(F.array(
        check("fingerprint_self_match", F.col("whole")), check("anchors", F.col("whole")), check("records_extracted", rows > 0),
        F.when(rows > 0, check("columns_reproduced", F.size(F.array_except("columns_confirmed", "names")) == 0)),
        F.when(first & F.col("recurrence").isNotNull(), check("row_count_exact", rows == F.col("recurrence"))),
        F.when(first, check("no_collision", F.size(detect.all_matches(registered, F.col("lead_text"))) == 0))))
    shown = F.when(first, F.transform("examples", lambda e: check(F.concat(F.lit("header_"), e["name"], F.lit("_exact")), got(e["name"]) == e["value"])))
    every = df.select("profile", "exemplar", F.explode(F.concat(checks, F.coalesce(shown, F.array().cast("array<struct<check_name:string,ok:boolean>>")))).alias("c")).select("profile", "exemplar", "c.*")
    failed = assembled.filter("error <> ''").select("profile", F.lit(-1).cast("int").alias("exemplar"), F.lit(RECIPE_ASSEMBLY).alias("check_name"), F.lit(False).alias("ok"))
    return every.unionByName(failed)
