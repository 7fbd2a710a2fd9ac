"""Onboarding: find the structure of unknown reports from their lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform.functions import text as tx
from conform.operators.joins import grows
from conform.operators.layout import once
from conform.session import packed as stage

# Thresholds of the structural analysis.
LEAD_PAGES = 4
FURNITURE_SHARE = 0.6
FURNITURE_LENGTH = 8
MIN_ROWS = 3
MIN_COLUMNS = 3
CLASS_SHARE = 0.75
PATTERN_ROWS = 20
RECORD_LIKE_LINES = 5
LABEL_PATTERN = r"^([A-Z][A-Za-z ]{1,30}:)\s*(.*)$"


def column_signature(words: DataFrame, lead_pages: int = LEAD_PAGES) -> DataFrame:
    """Per text row with four or more words, the rounded starts of its first six words."""
    lead = words.filter(F.col("page") <= lead_pages)
    starts = F.slice(F.sort_array(F.collect_list("x0")), 1, 6)
    rows = lead.groupBy("doc_id", "page", F.bround("top", 0).alias("row")).agg(starts.alias("xs"), F.count("*").alias("n"))
    return rows.filter(F.col("n") >= 4).select(
        "doc_id", "page", "row", F.array_join(F.transform("xs", lambda x: F.bround(x / 10, 0).cast("long").cast("string")), ",").alias("sig"))


# -- what a source offers ---------------------------------------------------------------------------

def long_values(findings: DataFrame, keys: dict[str, bool]) -> DataFrame:
    """Findings as (doc_id, record_seq, path, values): one row per key, lists kept as lists."""
    def one(k: str, is_list: bool) -> Column:
        c = F.col(k).cast("array<string>") if is_list else F.array(F.col(k).cast("string"))
        return F.struct(F.lit(f"finding.{k}").alias("path"), c.alias("values"))

    return findings.select("doc_id", "record_seq", F.explode(F.array(*[one(k, v) for k, v in keys.items()])).alias("p")).select(
        "doc_id", "record_seq", "p.*")


def inventory(findings: DataFrame, keys: dict[str, bool]) -> DataFrame:
    """Sample value of every path: that of the first record."""
    return long_values(findings, keys).groupBy("doc_id", "path").agg(
        F.min_by(F.array_join("values", tx.LIST_JOINER), F.struct("record_seq", "values")).alias("sample"))


def observed(findings: DataFrame, keys: dict[str, bool]) -> DataFrame:
    """Every value seen per path, once as the joined text a lookup gets and once per list item."""
    forms = F.concat(
        F.array(F.struct(F.lit("joined").alias("form"), F.array_join("values", tx.LIST_JOINER).alias("value"))),
        F.transform("values", lambda v: F.struct(F.lit("single").alias("form"), v.alias("value"))))
    return long_values(findings, keys).select("doc_id", "record_seq", "path", F.explode(forms).alias("o")).select(
        "doc_id", "record_seq", "path", "o.form", "o.value")


def seed_delta(elements: DataFrame, seed: DataFrame) -> DataFrame:
    """Mark elements the seeding recipe knows and those that diverge from it."""
    known = seed.distinct().withColumn("known", F.lit(True))
    return elements.join(known, ["kind", "payload"], "left").withColumn(
        "mark", F.when(F.col("kind") == "image_region", "not compared")
        .when(F.col("known").isNull(), "seed_divergent").otherwise("seed_match"))


# -- running lines, record tables, label/value lines ---------------------------------------------------

def pages_of(lines: DataFrame) -> DataFrame:
    """One row per page with its ``lines`` from top to bottom. ``lines`` has such rows already, or a row per line; a sheet bounds a page."""
    if "lines" in lines.columns:
        return lines
    return lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_top", "words", "text"))).alias("lines"))


def furniture(lines: DataFrame) -> DataFrame:
    """Lines that recur on most pages of a document, compared without a trailing page number.

    ``lines`` has a row per line, or a row per page with its ``lines``. A page sends each of its texts once, and a null that stands for itself.
    """
    if "lines" in lines.columns:
        texts = F.array_distinct(F.transform("lines", lambda l: tx.drop_page_counter(l["text"])))
        marked = lines.select("doc_id", F.explode(F.concat(
            F.filter(texts, lambda p: F.length(p) >= FURNITURE_LENGTH), F.array(F.lit(None).cast("string")))).alias("prefix"))
    else:
        prefix = tx.drop_page_counter(F.col("text"))
        marked = lines.select("doc_id", "page", F.explode(F.array(F.when(F.length(prefix) >= FURNITURE_LENGTH, prefix), F.lit(None))).alias("prefix")).distinct()
    counts = marked.groupBy("doc_id", "prefix").agg(F.count("*").alias("on_pages"))
    # on most of several pages means on two or more: all other texts end here
    several = counts.filter(F.col("prefix").isNull() | (F.col("on_pages") > 1))
    n_pages = F.max(F.when(F.col("prefix").isNull(), F.col("on_pages"))).over(W.partitionBy("doc_id"))
    return several.withColumn("n_pages", n_pages).filter(
        F.col("prefix").isNotNull() & (F.col("n_pages") > 1) & (F.col("on_pages") / F.col("n_pages") >= FURNITURE_SHARE)).select(
        "doc_id", "prefix", "on_pages", "n_pages")


def without_table_header(running: DataFrame, tables: DataFrame) -> DataFrame:
    """Running lines less the header line that the record table repeats on its pages."""
    heads = tables.select("doc_id", tx.drop_page_counter(F.col("h_text")).alias("prefix"))
    return running.join(grows(heads), ["doc_id", "prefix"], "left_anti")


def running_of(running: DataFrame) -> DataFrame:
    """The running lines of each document side by side (a sheet bounds how many there are)."""
    return running.groupBy("doc_id").agg(F.collect_set("prefix").alias("_running"))


def _runs(text: Column) -> Column:
    return F.coalesce(F.exists("_running", lambda p: F.startswith(text, p)), F.lit(False))


def without_running(lines: DataFrame, running: DataFrame) -> DataFrame:
    """Lines that do not begin with a running line of their document."""
    return lines.join(grows(running_of(running)), "doc_id", "left").filter(~_runs(F.col("text"))).drop("_running")


def dominant_class(first_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Structure class owning most first cells of a group, if it owns enough of them."""
    classes = first_cells.withColumn("class", tx.structure_class(F.col("first_cell"))).groupBy(*keys, "class").agg(F.count("*").alias("n"))
    return classes.groupBy(*keys).agg(
        F.max_by("class", F.struct("n", "class")).alias("class"), F.max("n").alias("n"), F.sum("n").alias("rows"),
    ).filter((F.col("n") >= MIN_ROWS) & (F.col("n") / F.col("rows") >= CLASS_SHARE))


def row_pattern(first_cells: DataFrame) -> DataFrame:
    """Row-identity pattern from the first rows of a document: their common class, else any word."""
    # a row_number filter of this form is cut to its limit before the shuffle
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "line_top"))
    head = first_cells.filter(F.col("first_cell") != "").withColumn("rn", rank).filter(F.col("rn") <= PATTERN_ROWS)
    return head.groupBy("doc_id").agg(F.collect_set(tx.structure_class(F.col("first_cell"))).alias("classes")).select(
        "doc_id", F.when(F.size("classes") == 1, F.concat(F.lit("^"), F.get("classes", F.lit(0)), F.lit("$")))
        .otherwise(F.lit(r"^\S+$")).alias("pattern"))


def _header_ranges(words: Column) -> Column:
    """Column ranges a header line implies: midpoints of its word starts, open to the left edge."""
    mid = lambda i: F.bround((F.get(words, i)["x0"] + F.get(words, i + 1)["x0"]) / 2, 1)
    last = F.size(words) - 1
    return F.transform(words, lambda w, i: F.struct(
        F.when(i == 0, F.lit(0.0)).otherwise(mid(i - 1)).alias("lo"),
        F.when(i == last, w["x0"] + 60.0).otherwise(mid(i)).alias("hi")))


def _cells(words: Column, ranges: Column) -> Column:
    return F.transform(ranges, lambda r: F.array_join(F.transform(
        F.filter(words, lambda w: (w["x0"] >= r["lo"]) & (w["x0"] < r["hi"])), lambda w: w["text"]), " "))


def _wide(lines: str | Column) -> Column:
    """Of the lines of a page those with words enough to fill the columns of any header."""
    return F.filter(lines, lambda l: F.size(l["words"]) >= MIN_COLUMNS)


def _classes(lines: str | Column, ranges: Column, header: Column) -> Column:
    """Of the lines of a page those that fill the columns of a candidate header: the classes of their first cells."""
    least = F.greatest(F.lit(MIN_COLUMNS), F.size(ranges) - 2)
    cell = lambda l, r: F.array_join(F.filter(l["words"], lambda w: (w["x0"] >= r["lo"]) & (w["x0"] < r["hi"]))["text"], " ")
    # a line with fewer words than cells to fill cannot qualify: dropped before cells are cut
    able = F.filter(lines, lambda l: (F.size(l["words"]) >= least) & (l["text"] != header))
    full = F.filter(able, lambda l: F.size(F.filter(ranges, lambda r: cell(l, r) != "")) >= least)
    firsts = F.filter(F.transform(full, lambda l: cell(l, F.get(ranges, F.lit(0)))), lambda c: c != "")
    return F.transform(firsts, tx.structure_class)


def record_tables(lines: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """The record table of every document that has one.

    ``lines`` has a row per line, or a row per page with its ``lines``; ``running`` is their ``furniture`` where it is known. A
    header candidate (four or more words) meets the lines below it on its own page only, inside the row of that page. The first
    page with a qualifying candidate wins; just its candidates meet the later pages for continuation rows; most rows, then
    the upper line, decides. Pages without lines enough for a table never meet anything.
    """
    pages = pages_of(lines)
    per_doc = running_of(furniture(lines) if running is None else running)
    under = lambda l: F.filter("wide", lambda x: x["line_top"] > l["line_top"])
    wide = once(pages.filter(F.size("lines") > MIN_ROWS), ("doc_id", "page"), wide=_wide("lines")).filter(F.size("wide") > MIN_ROWS)
    tops = F.transform(F.filter("wide", lambda l: (F.size(l["words"]) >= 4) & (F.size(under(l)) >= MIN_ROWS)), lambda l: l["line_top"])
    headed = once(wide, ("doc_id", "page", "wide"), tops=tops).filter(F.size("tops") > 0)
    met = once(headed.join(grows(per_doc), "doc_id", "left"), ("doc_id", "page"), body=F.filter("wide", lambda l: ~_runs(l["text"])),
               heads=F.filter("wide", lambda l: F.array_contains("tops", l["line_top"])))
    heads = met.filter(F.size("body") >= MIN_ROWS).select("doc_id", F.col("page").alias("h_page"), "body", F.explode("heads").alias("h")).select(
        "doc_id", "h_page", F.col("h.line_top").alias("h_top"), F.col("h.text").alias("h_text"), F.col("h.words").alias("h_words"), "body")
    ranged = once(heads, ("doc_id", "h_page", "h_top", "h_text", "body"), ranges=_header_ranges(F.col("h_words")))
    head = ("doc_id", "h_page", "h_top", "h_text", "ranges")
    own = once(ranged, head, classes=_classes(F.filter("body", lambda l: l["line_top"] > F.col("h_top")), F.col("ranges"), F.col("h_text")))
    tally = lambda c: F.struct(F.size(F.filter("classes", lambda x: x == c)).cast("long").alias("n"), c.alias("class"))
    most = once(own.filter(F.size("classes") >= MIN_ROWS), (*head, "classes"), most=F.array_max(F.transform(F.array_distinct("classes"), tally)))
    good = most.select(*head, "most.*", F.size("classes").alias("rows")).filter((F.col("n") >= MIN_ROWS) & (F.col("n") / F.col("rows") >= CLASS_SHARE))
    first = good.withColumn("_first", F.min("h_page").over(W.partitionBy("doc_id"))).filter(F.col("h_page") == F.col("_first"))
    per_page = first.groupBy("doc_id", "h_page").agg(F.collect_list(F.struct("h_top", "h_text", "ranges", "class", "n")).alias("heads"))
    kept = stage(per_page.join(grows(per_doc), "doc_id", "left"), "tables")
    later = pages.join(grows(kept), "doc_id").filter(F.col("page") > F.col("h_page"))
    left = once(later, ("doc_id", "heads"), body=F.filter(_wide("lines"), lambda l: ~_runs(l["text"]))).filter(F.size("body") > 0)
    met_later = left.select("doc_id", "body", F.posexplode("heads").alias("_at", "h"))
    alike = F.filter(_classes("body", F.col("h.ranges"), F.col("h.h_text")), lambda c: c == F.col("h.class"))
    more = met_later.select("doc_id", "_at", F.size(alike).alias("_more")).groupBy("doc_id", "_at").agg(F.sum("_more").alias("more"))
    each = kept.select("doc_id", "h_page", F.posexplode("heads").alias("_at", "h")).select("doc_id", "h_page", "_at", "h.*")
    scored = each.join(grows(more), ["doc_id", "_at"], "left").withColumn("table_rows", F.col("n") + F.coalesce("more", F.lit(0)))
    best = F.struct(-F.col("table_rows"), F.col("h_top"))
    return scored.groupBy("doc_id").agg(*[F.min_by(c, best).alias(c) for c in ("h_page", "h_top", "h_text", "ranges", "class", "table_rows")])


def recount(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of each table counted the way extraction will: first cell against the row pattern.

    ``lines`` come without running lines.
    """
    t = tables.select("doc_id", "ranges", "h_text", "class")
    first = F.get(_cells(F.col("words"), F.slice("ranges", 1, 1)), F.lit(0))
    hit = lines.join(grows(t), "doc_id").filter(F.col("text") != F.col("h_text")).withColumn("first", first)
    # the row pattern is "^class$", so matching it means having that structure class
    return hit.filter((F.col("first") != "") & (tx.structure_class(F.col("first")) == F.col("class"))).groupBy("doc_id").agg(F.count("*").alias("recurrence"))


def label_values(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """``Label: value`` lines of the leading pages, above the record table where there is one.

    ``lines`` come without running lines: what stands on most pages is no field of the document.
    """
    t = tables.select("doc_id", "h_page", "h_top")
    hit = lines.filter((F.col("page") <= LEAD_PAGES) & F.col("text").rlike(LABEL_PATTERN)).join(grows(t), "doc_id", "left")
    above = F.col("h_page").isNull() | (F.col("page") != F.col("h_page")) | (F.col("top") < F.col("h_top"))
    value = F.regexp_extract("text", LABEL_PATTERN, 2)
    return hit.filter(above & (value != "")).select(
        "doc_id", "page", F.regexp_extract("text", LABEL_PATTERN, 1).alias("label"), value.alias("value"))


# -- agreement between exemplars, confidence -------------------------------------------------------------

def agreement(elements: DataFrame, group: str) -> DataFrame:
    """For the elements of each group's first exemplar: share of its other exemplars that show them.

    ``elements`` is (group, doc_id, text, ...). Counting is by (group, text) with map-side
    combining, so a group holding a third of the corpus is never gathered.
    """
    sizes = elements.select(group, "doc_id").distinct().groupBy(group).agg(
        F.min("doc_id").alias("first_doc"), (F.count("*") - 1).alias("extras"))
    shown = elements.select(group, "doc_id", "text").distinct().groupBy(group, "text").agg(F.count("*").alias("in_docs"))
    primary = elements.join(sizes.withColumnRenamed("first_doc", "doc_id"), [group, "doc_id"])
    return primary.join(shown, [group, "text"]).withColumn(
        "agreement", F.when(F.col("extras") == 0, 1.0).otherwise((F.col("in_docs") - 1) / F.col("extras"))).drop("in_docs")


def confidence(kind: Column, n: Column, agree: Column, pages: Column, has_value: Column) -> Column:
    """Structural confidence of an element; disagreement between exemplars halves it."""
    factor = F.when(agree == 1.0, 1.0).otherwise(0.5)
    rows = F.least(F.lit(0.95), n / (n + 2))
    raw = (F.when(kind == "furniture_line", F.lit(0.5) + F.when(pages > 1, F.lit(0.4) * agree).otherwise(0.0))
           .when(kind.isin("record_table", "record_column"), rows * factor)
           .when(kind == "header_field", F.when(has_value, 0.8).otherwise(0.6) * factor)
           .when(kind == "image_region", F.least(F.lit(0.9), n / (n + 2)))
           .otherwise(F.lit(0.7) * factor))
    return F.bround(F.least(raw, F.lit(0.99)), 2)


def element_flags(conf: Column, agree: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(F.when(agree < 1.0, "non_generalising"), F.when(conf < 0.5, "low_confidence"))))


# -- review -------------------------------------------------------------------------------------------

def review_state(elements: DataFrame, events: DataFrame) -> DataFrame:
    """Latest decision per element; the active payload is the correction where there is one."""
    last = events.groupBy("proposal_id", "element_id").agg(F.max_by(F.struct("state", "corrected"), "step").alias("e"))
    out = elements.join(last, ["proposal_id", "element_id"], "left")
    state = F.coalesce("e.state", F.lit("proposed"))
    return out.withColumn("state", state).withColumn(
        "active", F.when(state == "corrected", F.coalesce("e.corrected", "payload")).otherwise(F.col("payload"))).drop("e")
