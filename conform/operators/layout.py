"""Page layout from positioned words: visual lines, columns, row bands, label/value pairs.

Words are ``(doc_id, page, top, x0, x1, text)``. What a page contributes to shared state is its
set of distinct vertical positions, which the height of a sheet bounds; the words themselves are
only ever gathered per visual line.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform.functions.text import split_list
from conform.operators.validate import parse_error

# Distances in points.
LINE_TOLERANCE = 2.5
BELOW_MIN, BELOW_MAX = 2.0, 60.0
NEAR_MAX, NEAR_LEFT, NEAR_RIGHT = 25.0, 15.0, 140.0
IMAGE_REACH = 14.0
SEGMENT_GAP = 30.0

PAGE = ("doc_id", "page")
LINE_WORDS = "array<struct<x0:double,top:double,x1:double,text:string>>"
#: What a recipe reads of a word.
SLIM_WORDS = "array<struct<x0:double,text:string>>"


def anchors(tops: Column) -> Column:
    """Line anchors of a page: walking down, a position more than the tolerance below the last
    anchor starts a new line (a chain of small steps does not stretch a line)."""
    return F.aggregate(
        tops, F.array().cast("array<double>"),
        lambda acc, t: F.when(
            (F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) > LINE_TOLERANCE),
            F.concat(acc, F.array(t)),
        ).otherwise(acc),
    )


def pages(parts: DataFrame) -> DataFrame:
    """One row per page with all its ``words``, an array; ``parts`` has any number of rows per page, each with such an array.

    A sheet bounds the words of a page. Rows that lie together by page already are neither moved nor sorted again.
    """
    whole = W.partitionBy(*PAGE)
    got = parts.select(*PAGE, "words", F.monotonically_increasing_id().alias("_id")).select(
        *PAGE, "_id", F.min("_id").over(whole).alias("_first"), F.collect_list("words").over(whole).alias("_parts"))
    return got.filter("_id = _first").select(*PAGE, F.flatten("_parts").alias("words"))


def once(df: DataFrame, keep: Sequence[str], **made: Column) -> DataFrame:
    """The columns ``keep`` and ``made``, worked out once per row: no filter or later use further up repeats the work further down."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def page_lines(pages: DataFrame) -> DataFrame:
    """Per page its visual ``lines`` from top to bottom: anchor and words, which stand from top to bottom, too. Nothing is moved."""
    down = F.sort_array(F.arrays_zip("words.top", "words.x0", "words.x1", "words.text"))
    # where each line starts is looked up once, on the way from one line to the next
    topped = once(once(pages, PAGE, words=down), (*PAGE, "words"), _tops=F.col("words.top"))
    cut = once(topped, (*PAGE, "words", "_tops"), _starts=F.transform(
        anchors(F.array_distinct("_tops")), lambda a: F.array_position("_tops", a).cast("int")))
    after = lambda i: F.coalesce(F.get("_starts", i + 1), F.size("_tops") + 1)
    return once(cut, PAGE, lines=F.transform("_starts", lambda s, i: F.struct(
        F.get("_tops", s - 1).alias("line_top"), F.slice("words", s, after(i) - s).alias("words"))))


def across(words: str | Column) -> Column:
    """The words of a line from left to right."""
    words = F.col(words) if isinstance(words, str) else words
    return F.sort_array(F.arrays_zip(*[words[c] for c in ("x0", "top", "x1", "text")])).cast(LINE_WORDS)


def ruled(pages: DataFrame) -> DataFrame:
    """Per page that has words its ``words`` in reading order (line by line, each from left to right) and its ``cuts``: per line anchor, first word and number of words.

    Both orders are those of the compiled sort over a whole page: one inside a lambda compares field by field, interpreted.
    """
    down = F.sort_array(F.arrays_zip("words.top", "words.x0", "words.x1", "words.text"))
    # where each line starts is looked up once, on the way from one line to the next
    topped = once(once(pages.filter(F.size("words") > 0), PAGE, words=down), (*PAGE, "words"), _tops=F.col("words.top"))
    begun = once(topped, (*PAGE, "words", "_tops"), _starts=F.transform(
        anchors(F.array_distinct("_tops")), lambda a: F.array_position("_tops", a).cast("int")))
    after = lambda i: F.coalesce(F.get("_starts", i + 1), F.size("_tops") + 1)
    cut = once(begun, (*PAGE, "words"), cuts=F.transform("_starts", lambda s, i: F.struct(
        F.get("_tops", s - 1).alias("line_top"), s.alias("first"), (after(i) - s).alias("n"))))
    numbered = once(cut, (*PAGE, "words", "cuts"), _no=F.flatten(F.transform("cuts", lambda c, i: F.array_repeat(i, c["n"]))))
    return once(numbered, (*PAGE, "cuts"), words=F.sort_array(F.arrays_zip("_no", "words.x0", "words.top", "words.x1", "words.text")))


def slim_lines(pages: DataFrame) -> DataFrame:
    """One row per page that has words: its ``lines`` from top to bottom, each with its anchor and, from left to right, where its words begin and their texts.

    That is all a recipe reads, and less than half of what words hold. Nothing is moved.
    """
    slim = once(ruled(pages), (*PAGE, "cuts"), words=F.arrays_zip("words.x0", "words.text").cast(SLIM_WORDS))
    return once(slim, PAGE, lines=F.transform("cuts", lambda c: F.struct(
        c["line_top"].alias("line_top"), F.slice("words", c["first"], c["n"]).alias("words"))))


def whole_lines(pages: DataFrame) -> DataFrame:
    """One row per page that has words: its ``lines`` from top to bottom as ``visual_lines`` gives them (anchor, words, text). Nothing is moved."""
    plain = once(ruled(pages), (*PAGE, "cuts"), words=F.arrays_zip(*[f"words.{c}" for c in ("x0", "top", "x1", "text")]).cast(LINE_WORDS))
    own = lambda c: F.slice("words", c["first"], c["n"])
    return once(plain, PAGE, lines=F.transform("cuts", lambda c: F.struct(
        c["line_top"].alias("line_top"), own(c).alias("words"), F.array_join(own(c)["text"], " ").alias("text"))))


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """The same as ``visual_lines`` where each page is one row."""
    lines = page_lines(pages).select(*PAGE, F.explode("lines").alias("l"))
    return once(once(lines.select(*PAGE, "l.*"), (*PAGE, "line_top"), words=across("words")), (*PAGE, "line_top", "words"), text=F.array_join("words.text", " "))


def visual_lines(words: DataFrame) -> DataFrame:
    """One row per visual line: its anchor, its words from left to right, and its text.

    ``words`` has a row per word, or a row per page with its ``words`` as an array. Words are shuffled once, by page. A vertical gap
    wider than the tolerance always starts a line, so pages fall apart into clusters; a cluster no taller than the tolerance is one
    line, and only a taller one (a chain of small steps) is split at its anchors.
    """
    if "words" in words.columns:
        return lines_of_pages(words)
    page = W.partitionBy(*PAGE).orderBy("top")
    starts = F.coalesce(F.col("top") - F.lag("top").over(page) > LINE_TOLERANCE, F.lit(True)).cast("int")
    clustered = words.select(*PAGE, "top", "x0", "x1", "text", starts.alias("_start")).withColumn(
        "_cluster", F.sum("_start").over(page.rowsBetween(W.unboundedPreceding, W.currentRow)))
    groups = clustered.groupBy(*PAGE, "_cluster").agg(
        F.min("top").alias("_lo"), F.max("top").alias("_hi"), F.collect_list(F.struct("x0", "top", "x1", "text")).alias("_ws"))
    cuts = anchors(F.sort_array(F.array_distinct(F.transform("_ws", lambda w: w["top"]))))
    split = F.transform(cuts, lambda a, i: F.struct(a.alias("line_top"), F.filter(
        "_ws", lambda w: (w["top"] >= a) & (w["top"] < F.coalesce(F.get(cuts, i + 1), F.lit(float("inf"))))).alias("words")))
    whole = F.array(F.struct(F.col("_lo").alias("line_top"), F.col("_ws").alias("words")))
    lines = groups.select(*PAGE, F.explode(F.when(F.col("_hi") - F.col("_lo") <= LINE_TOLERANCE, whole).otherwise(split)).alias("l"))
    return lines.select(*PAGE, "l.line_top", F.sort_array("l.words").alias("words")).withColumn(
        "text", F.array_join("words.text", " "))


def with_line_top(words: DataFrame) -> DataFrame:
    """Words with ``line_top``, the anchor of the visual line each belongs to."""
    return visual_lines(words).select(*PAGE, "line_top", F.inline("words"))


def column_cells(words: Column, ranges: Sequence[tuple[float, float]]) -> list[Column]:
    """Cell text per half-open x-range; words outside every range are dropped."""
    return [
        F.array_join(F.transform(F.filter(words, lambda w: (w["x0"] >= lo) & (w["x0"] < hi)), lambda w: w["text"]), " ")
        for lo, hi in ranges
    ]


def column_index(x0: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Index of the first range holding ``x0``, null outside all of them."""
    return F.coalesce(*[F.when((x0 >= lo) & (x0 < hi), F.lit(i)) for i, (lo, hi) in enumerate(ranges)])


def without_furniture(lines: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    drop = F.lit(False)
    for p in prefixes:
        drop = drop | F.startswith(F.col("text"), F.lit(p))
    return lines.filter(~drop)


def without_header_lines(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(~F.col("text").rlike(f"^(?:{pattern})"))


def matching_rows(lines: DataFrame, first_cell: Column, pattern: str) -> DataFrame:
    return lines.filter(first_cell.rlike(f"^(?:{pattern})"))


def extract_records(words: DataFrame, ranges, names: Sequence[str], row_pattern: str, header_pattern: str,
                    furniture: Sequence[str]) -> DataFrame:
    """A whole recipe: words -> lines -> record rows with one text column per recipe column."""
    lines = without_header_lines(without_furniture(visual_lines(words), furniture), header_pattern)
    cells = lines.select(*PAGE, "line_top", *[c.alias(n) for n, c in zip(names, column_cells(F.col("words"), ranges))])
    return matching_rows(cells, F.col(names[0]), row_pattern)


def number_below(words: DataFrame, labels: Sequence[str]) -> DataFrame:
    """For every label word, the nearest number under it that overlaps it sideways."""
    lab = words.filter(F.col("text").isin(*labels)).select(
        *PAGE, F.col("text").alias("label"), F.col("top").alias("l_top"), F.col("x0").alias("l_x0"), F.col("x1").alias("l_x1"))
    num = words.filter(F.col("text").rlike("^[0-9]+$"))
    dy = F.col("top") - F.col("l_top")
    overlap = F.least("x1", "l_x1") - F.greatest("x0", "l_x0")
    return num.join(lab, list(PAGE)).filter((dy > BELOW_MIN) & (dy <= BELOW_MAX) & (overlap > 0)).groupBy(
        *PAGE, "label", "l_top").agg(F.min_by("text", F.struct(dy, F.col("x0"))).alias("value"))


def text_near(words: DataFrame, labels: Sequence[str]) -> DataFrame:
    """For every label word, the words just below it in reading order."""
    lab = words.filter(F.col("text").isin(*labels)).select(
        *PAGE, F.col("text").alias("label"), F.col("top").alias("l_top"), F.col("x0").alias("l_x0"))
    dy = F.col("top") - F.col("l_top")
    near = (dy > BELOW_MIN) & (dy <= NEAR_MAX) & F.col("x0").between(F.col("l_x0") - NEAR_LEFT, F.col("l_x0") + NEAR_RIGHT)
    picked = F.sort_array(F.collect_list(F.struct("top", "x0", "text")))
    return words.join(lab, list(PAGE)).filter(near).groupBy(*PAGE, "label", "l_top").agg(
        F.array_join(F.transform(picked, lambda w: w["text"]), " ").alias("value"))


def midpoints(tops: Column) -> Column:
    return F.transform(F.slice(tops, 2, F.greatest(F.size(tops) - 1, F.lit(0))), lambda x, i: (x + F.get(tops, i)) / 2)


def row_bands(ids: DataFrame) -> DataFrame:
    """Per page the sorted tops of the id words and the edges halfway between them."""
    tops = ids.groupBy(*PAGE).agg(F.sort_array(F.collect_set("top")).alias("id_tops"))
    return tops.select(*PAGE, "id_tops", midpoints(F.col("id_tops")).alias("edges"))


def band_index(top: Column, edges: Column) -> Column:
    """Zero-based band: how many edges lie at or above the word."""
    return F.size(F.filter(edges, lambda e: e <= top))


def images_to_rows(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Each image goes to the first row it reaches vertically; without one it is an orphan."""
    hit = rows.select(*PAGE, "row_top", "row_ref")
    cond = [images[k] == hit[k] for k in PAGE] + [
        hit["row_top"] >= images["img_top"] - IMAGE_REACH, hit["row_top"] <= images["img_bottom"] + IMAGE_REACH]
    joined = images.join(hit, cond, "left").select(images["*"], "row_top", "row_ref")
    return joined.groupBy(*images.columns).agg(F.min_by("row_ref", F.struct("row_top", "row_ref")).alias("row_ref"))


def header_values(lines: DataFrame, labels: Sequence[str], strategy: str, lead_pages: int = 4) -> DataFrame:
    """First hit on the leading pages: the rest of the labelled line, or the line under the label."""
    lead = lines.filter(F.col("page") <= lead_pages)
    if strategy == "label_right":
        hit = F.coalesce(*[F.when(F.startswith(F.col("text"), F.lit(l)), F.substring(F.col("text"), len(l) + 1, 1 << 30))
                           for l in labels])
        found = lead.withColumn("value", hit)
    else:
        following = F.lead("text").over(W.partitionBy(*PAGE).orderBy("top"))
        found = lead.withColumn("value", F.when(F.col("text").isin(*labels), following))
    return found.filter(F.col("value").isNotNull()).groupBy("doc_id").agg(
        F.min_by(F.trim("value"), F.struct("page", "top")).alias("value"))


def segments(line_words: DataFrame) -> DataFrame:
    """Split visual lines where the gap between neighbours is wide. Windows are bounded by a line."""
    line = W.partitionBy(*PAGE, "line_top").orderBy("x0")
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(line) > SEGMENT_GAP, F.lit(False)).cast("int")
    seg = F.sum("gap").over(line.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = line_words.withColumn("gap", gap).withColumn("segment", seg)
    ordered = F.sort_array(F.collect_list(F.struct("x0", "text")))
    return marked.groupBy(*PAGE, "line_top", "segment").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.max("x1").alias("x1"))


def page_segments(pages: DataFrame) -> DataFrame:
    """The same as ``segments`` where each page is one row: lines are cut inside it, and words are never rows."""
    word = lambda i: F.get("words", i)
    begins = lambda i: (i == 0) | (word(i)["_no"] != word(i - 1)["_no"]) | (word(i)["x0"] - word(i - 1)["x1"] > SEGMENT_GAP)
    begun = once(ruled(pages), (*PAGE, "words", "cuts"), _at=F.filter(F.sequence(F.lit(0), F.size("words") - 1), begins))
    line = lambda s: F.get("cuts", word(s)["_no"])
    cut = once(begun, PAGE, _segments=F.transform("_at", lambda s, k: F.struct(
        line(s)["line_top"].alias("line_top"), (k - F.array_position("_at", line(s)["first"] - 1) + 1).alias("segment"),
        F.slice("words", s + 1, F.coalesce(F.get("_at", k + 1), F.size("words")) - s).alias("words"))))
    return cut.select(*PAGE, F.inline("_segments")).select(
        *PAGE, "line_top", "segment", F.array_join("words.text", " ").alias("text"), F.array_max("words.x1").alias("x1"))


def column_edges(header_words: Column, columns: Sequence[str], page_width: float) -> Column:
    """Half-open column ranges from a header line: edges lie midway between neighbours."""
    return ranges_between(F.filter(header_words, lambda w: w["text"].isin(*columns)), page_width)


def ranges_between(heads: Column, page_width: float) -> Column:
    """The same where ``heads`` are the words of the column names alone."""
    return F.transform(heads, lambda w, i: F.struct(
        w["text"].alias("name"),
        F.when(i == 0, F.lit(0.0)).otherwise((F.get(heads, i - 1)["x1"] + w["x0"]) / 2).alias("lo"),
        F.when(i == F.size(heads) - 1, F.lit(page_width)).otherwise((w["x1"] + F.get(heads, i + 1)["x0"]) / 2).alias("hi")))


def table_headers(lines: DataFrame, must_have: Sequence[str]) -> DataFrame:
    """Per page the first line that carries all the given header words."""
    texts = F.transform("words", lambda w: w["text"])
    ok = F.lit(True)
    for m in must_have:
        ok = ok & F.array_contains(texts, m)
    return lines.filter(ok).groupBy(*PAGE).agg(
        F.min_by("words", "line_top").alias("head"), F.min("line_top").alias("head_top"))


def annotation_records(words: DataFrame, must_have: Sequence[str], columns: Sequence[str], id_pattern: str,
                       page_width: float, severities: Sequence[str], separator: str, optional: Sequence[str] = ()) -> DataFrame:
    """Records of an annotation table whose cells may wrap around the row of their id.

    A page whose header line lacks one of ``columns`` that is not ``optional`` gives no records: its cells would end up in a
    neighbouring column.

    Column edges come from the header words, row bands from the midpoints between id words. ``words`` has a row per word, or a
    row per page with its ``words`` as an array. Everything happens inside the row of a page: from top to bottom the words of a
    band stand side by side, so a page is cut into its bands and never spread over the words.
    """
    whole_pages = words if "words" in words.columns else pages(words.select(*PAGE, F.array(F.struct("top", "x0", "x1", "text")).alias("words")))
    texts = lambda l: l["words"]["text"]
    in_order = lambda l: F.sort_array(F.transform(l["words"], lambda w: F.struct(w["x0"], w["top"], w["x1"], w["text"].alias("text"))))["text"]
    # a line like "3 / 9" has a slash, whatever the order of its words
    numbered = lambda l: F.contains(F.array_join(texts(l), ""), F.lit("/")) & F.array_join(in_order(l), " ").rlike(r"^\d+ / \d+$")
    is_head = lambda l: reduce(and_, [F.array_contains(texts(l), m) for m in must_have], F.lit(True))
    body = once(page_lines(whole_pages), PAGE, lines=F.filter("lines", lambda l: ~numbered(l)))
    headed = once(once(body, (*PAGE, "lines"), head=F.get(F.filter("lines", is_head), F.lit(0))),
                  (*PAGE, "lines"), head_top=F.col("head.line_top"), head=across("head.words"))
    whole = F.size(F.array_except(F.array(*[F.lit(c) for c in columns if c not in optional]), F.col("head.text"))) == 0
    under = F.flatten(F.filter("lines", lambda l: l["line_top"] > F.col("head_top") + 5)["words"])
    named = once(headed.filter(whole), PAGE, words=under, heads=F.filter("head", lambda w: w["text"].isin(*columns)))
    ranged = once(named, (*PAGE, "words"), ranges=ranges_between(F.col("heads"), page_width))
    first_range = F.get("ranges", F.lit(0))
    in_first = once(ranged, (*PAGE, "words", "ranges"), lo=first_range["lo"], hi=first_range["hi"])
    ids = F.filter("words", lambda w: (w["x0"] >= F.col("lo")) & (w["x0"] < F.col("hi")) & w["text"].rlike(id_pattern))["top"]
    found = once(in_first, (*PAGE, "words", "ranges"), id_tops=F.sort_array(F.array_distinct(ids)))
    edged = once(found, (*PAGE, "words", "ranges", "id_tops"), edges=midpoints(F.col("id_tops")))
    cut = once(edged, (*PAGE, "words", "ranges", "id_tops", "edges"), _down=F.sort_array(F.concat("words.top", "edges")))
    # words and edges in one order: the words before an edge are what stands before it less the edges there
    start = lambda k: F.when(k == 0, 1).otherwise(F.array_position("_down", F.get("edges", k - 1)) - k + 1).cast("int")
    end = lambda k: F.when(k == F.size("edges"), F.size("words") + 1).otherwise(start(k + 1)).cast("int")
    pieces = once(cut, (*PAGE, "ranges"), bands=F.transform("id_tops", lambda t, k: F.struct(
        t.alias("id_top"), F.slice("words", start(k), end(k) - start(k)).alias("words"))))
    bands = pieces.select(*PAGE, "ranges", F.explode("bands").alias("b")).select(*PAGE, "ranges", "b.*").filter(F.size("words") > 0)
    name_at = lambda x0: F.get(F.filter("ranges", lambda r: (r["lo"] <= x0) & (x0 < r["hi"])), F.lit(0))["name"]
    # wrapped lines a little off the row of their id stand in one order with it
    placed = once(bands, (*PAGE, "id_top"), words=F.sort_array(F.transform("words", lambda w: F.struct(
        F.rint(w["top"]).alias("t"), w["x0"].alias("x0"), w["text"].alias("text"), name_at(w["x0"]).alias("col"), w["top"].alias("top")))))
    is_id = lambda w: (w["col"] == columns[0]) & (w["top"] == F.col("id_top")) & w["text"].rlike(id_pattern)
    cell = lambda name: F.array_join(F.filter("words", lambda w: w["col"] == name)["text"], " ")
    rows = once(placed, PAGE, id=F.array_max(F.filter("words", is_id)["text"]), **{f"c_{c}": cell(c) for c in columns[1:]})
    sev = F.split(F.col("c_Severity"), " +")
    overflow = F.array_join(F.slice(sev, 2, F.greatest(F.size(sev) - 1, F.lit(0))), " ")
    tags = F.when(overflow == "", F.col("c_User")).when(F.col("c_User") == "", overflow).otherwise(
        F.concat_ws(f" {separator} ", overflow, "c_User"))
    severity = F.element_at(sev, 1)
    page_no = F.when(F.col("c_Page").rlike("^[0-9]+$"), F.col("c_Page").try_cast("int"))
    return rows.select(
        *PAGE, "id", severity.alias("severity"), split_list(tags, separator).alias("user_tags"),
        split_list(F.col("c_Issues"), separator).alias("issues"), F.col("c_Comments").alias("comments"),
        page_no.alias("page_no"), parse_error(severity, page_no, F.col("c_Page"), severities).alias("parse_error"))
