"""Grid targets: number column, row and column axes, fillable cells, rotation, extents.

Cells are ``(doc_id, page, table_no, i, j, text, x0, top, x1, bottom, rotation, width, height)``.
A printed grid is bounded by its sheet, so windows over one grid row, column or table are small.

Cells often come out of exploded rows, whose size the optimizer takes for that of the rows before. Joins of two tables that grow
with the cells are therefore merge joins by hint; without it millions of cells would be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform.functions.text import slug
from conform.operators.joins import grows

# The smallest cell a value can be written into, in points, and label lengths.
MIN_WIDTH, MIN_HEIGHT = 12.0, 8.0
ROW_LABEL, COLUMN_LABEL, CELL_LABEL = 80, 60, 60
NUMBERISH = r"^\s*\d+(\.\d+)*\s*$"

GRID = ("doc_id", "page", "table_no")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fillable() -> Column:
    return (clean(F.col("text")) == "") & (F.col("x1") - F.col("x0") >= MIN_WIDTH) & (F.col("bottom") - F.col("top") >= MIN_HEIGHT)


def visual_bbox(x0: Column, top: Column, x1: Column, bottom: Column, rotation: Column, w: Column, h: Column) -> list[Column]:
    """Top-down cell on the unrotated page to a bottom-up box as the rotated page shows it."""
    ax, ay, bx, by = x0, h - bottom, x1, h - top

    def turned(x: Column, y: Column) -> tuple[Column, Column]:
        return (F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, h - y).otherwise(x),
                F.when(rotation == 90, w - x).when(rotation == 180, h - y).when(rotation == 270, x).otherwise(y))

    (px, py), (qx, qy) = turned(ax, ay), turned(bx, by)
    return [F.bround(F.least(px, qx), 1).alias("bx0"), F.bround(F.least(py, qy), 1).alias("by0"),
            F.bround(F.greatest(px, qx), 1).alias("bx1"), F.bround(F.greatest(py, qy), 1).alias("by1")]


def cell_bbox() -> list[Column]:
    return visual_bbox(*[F.col(c) for c in ("x0", "top", "x1", "bottom", "rotation", "width", "height")])


def shapes(cells: DataFrame) -> DataFrame:
    """Per grid: its size and, among the three left columns, the first that is mostly numeric."""
    t = clean(F.col("text"))
    data = F.col("i") >= 1
    aggs = []
    for j in range(3):
        here = data & (F.col("j") == j) & (t != "")
        aggs += [F.count_if(here).alias(f"f{j}"), F.count_if(here & t.rlike(NUMBERISH)).alias(f"n{j}")]
    g = cells.groupBy(*GRID).agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"), *aggs)
    numeric = [F.when((F.col(f"f{j}") > 0) & (F.col(f"n{j}") >= F.greatest(F.lit(1), F.floor(F.col(f"f{j}") / 2))), F.lit(j))
               for j in range(3)]
    number_col = F.coalesce(*numeric)
    return g.select(*GRID, "n_rows", "n_cols", number_col.alias("number_col"),
                    F.coalesce(number_col + 1, F.lit(0)).alias("text_col"),
                    ((F.col("n_rows") < 2) | (F.col("n_cols") < 3)).alias("too_small"))


def numbered(base: Column, scope: list[str], order: list[str]) -> Column:
    """The n-th use of a name within its scope gets ``_n`` (the first stays plain)."""
    n = F.row_number().over(W.partitionBy(*scope, base).orderBy(*order))
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("_"), n.cast("string")))


def axes(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """Row and column entries of every grid large enough: ``axis, idx, entry_id, number, label``."""
    big = shape.filter(~F.col("too_small"))
    c = cells.join(grows(big), list(GRID)).withColumn("t", clean(F.col("text")))
    rows = c.filter(F.col("i") >= 1).groupBy(*GRID, "i").agg(
        F.max(F.when(F.col("j") == F.col("number_col"), F.col("t"))).alias("number"),
        F.max(F.when(F.col("j") == F.col("text_col"), F.col("t"))).alias("named"))
    number = F.when(F.col("number") != "", F.col("number"))
    rows = rows.select(*GRID, F.lit("row").alias("axis"), F.col("i").alias("idx"), number.alias("number"),
                       F.coalesce(F.when(F.col("named") != "", F.col("named")), number,
                                  F.concat(F.lit("row_"), F.col("i").cast("string"))).alias("label"))
    label_col = (F.col("j") == F.col("text_col")) | F.coalesce(F.col("j") == F.col("number_col"), F.lit(False))
    cols = c.filter((F.col("i") == 0) & ~label_col).select(
        *GRID, F.lit("col").alias("axis"), F.col("j").alias("idx"), F.lit(None).cast("string").alias("number"),
        F.when(F.col("t") != "", F.col("t")).otherwise(F.concat(F.lit("col_"), F.col("j").cast("string"))).alias("label"))
    both = rows.unionByName(cols)
    base = F.when(slug(F.col("label")) != "", slug(F.col("label"))).otherwise(
        F.concat("axis", F.lit("_"), F.col("idx").cast("string")))
    both = both.withColumn("base", base).withColumn("rank", F.when(F.col("axis") == "row", 0).otherwise(1))
    return both.withColumn("entry_id", numbered(F.col("base"), ["doc_id"], ["page", "table_no", "rank", "idx"])).select(
        *GRID, "axis", "idx", "entry_id", "number",
        F.when(F.col("axis") == "row", F.substring("label", 1, ROW_LABEL)).otherwise(F.substring("label", 1, COLUMN_LABEL)).alias("label"))


def matrix_cells(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """Blank cells where a row entry meets a column entry, named after both."""
    rows = entries.filter(F.col("axis") == "row").select(*GRID, F.col("idx").alias("i"), F.col("entry_id").alias("row_id"),
                                                         F.col("label").alias("row_label"))
    cols = entries.filter(F.col("axis") == "col").select(*GRID, F.col("idx").alias("j"), F.col("entry_id").alias("col_id"),
                                                         F.col("label").alias("col_label"))
    return cells.filter(fillable()).join(grows(rows), [*GRID, "i"]).join(grows(cols), [*GRID, "j"]).select(
        *GRID, "i", "j", "row_id", "col_id", F.concat("row_label", F.lit(" × "), "col_label").alias("label"),
        derived_field(F.col("row_id"), F.col("col_id")).alias("target_field"), F.lit("matrix").alias("association"), *cell_bbox())


def derived_field(row_id: Column, col_id: Column) -> Column:
    return F.concat_ws("__", row_id, col_id)


def near_labels(cells: DataFrame) -> DataFrame:
    """For every cell: the nearest text to its left, else the nearest above, else its position."""
    text = F.when(clean(F.col("text")) != "", clean(F.col("text")))
    before = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    left = F.last(text, ignorenulls=True).over(before([*GRID, "i"], "j"))
    above = F.last(text, ignorenulls=True).over(before([*GRID, "j"], "i"))
    placed = cells.withColumn("left", left).withColumn("above", above).filter(fillable())
    label = F.substring(F.coalesce("left", "above", F.lit("")), 1, CELL_LABEL)
    spot = F.format_string("cell_p%d_r%d_c%d", "page", "i", "j")
    nameless = slug(label) == ""
    return placed.select(
        *GRID, "i", "j", F.when(nameless, spot).otherwise(label).alias("label"),
        F.when(nameless, spot).otherwise(slug(label)).alias("base"),
        F.when(nameless, "positional").when(F.col("left").isNotNull(), "row_label").otherwise("col_header").alias("association"),
        *cell_bbox())


def flat_cells(cells: DataFrame) -> DataFrame:
    """Every blank cell as a region of its own, named from its neighbours."""
    return near_labels(cells).withColumn("target_field", numbered(F.col("base"), ["doc_id"], ["page", "table_no", "i", "j"])).drop("base")


def reconstruct(cells: DataFrame) -> DataFrame:
    """Axes and cells where a grid allows it, flat cells where it is too small; none are lost."""
    shape = shapes(cells)
    small = shape.filter("too_small").select(*GRID)
    cols = [*GRID, "i", "j", "label", "target_field", "association", "bx0", "by0", "bx1", "by1"]
    return matrix_cells(cells, axes(cells, shape)).select(*cols).unionByName(
        flat_cells(cells.join(grows(small), list(GRID), "left_semi")).select(*cols))


def bind_suggestions(suggested: DataFrame, shape: DataFrame, entries: DataFrame) -> DataFrame:
    """Index-only suggestions against the grid: out of bounds, in bounds but unbound, or annotated."""
    s = suggested.join(grows(shape.select(*GRID, "n_rows", "n_cols")), list(GRID))
    s = s.join(grows(entries.select(*GRID, "axis", "idx", "entry_id")), [*GRID, "axis", "idx"], "left")
    limit = F.when(F.col("axis") == "row", F.col("n_rows")).otherwise(F.col("n_cols"))
    return s.withColumn("status", F.when((F.col("idx") < 0) | (F.col("idx") >= limit), "unknown_index")
                        .when(F.col("entry_id").isNull(), "unmatched_axis_entry").otherwise("annotated"))


def extents(cells: DataFrame) -> DataFrame:
    """Union box of the cells of every axis entry, rows and columns in one pass over the cells."""
    entry = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_id").alias("entry_id")) for a in ("row", "col")]))
    return cells.withColumn("entry", entry).groupBy("doc_id", "entry.axis", "entry.entry_id").agg(
        F.min("bx0").alias("bx0"), F.min("by0").alias("by0"), F.max("bx1").alias("bx1"), F.max("by1").alias("by1"),
        F.count("*").alias("cells"))


def apply_axis_actions(actions: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Rename / accept / reject on axis entries, each with its result or the reason it is refused.

    Every rename, accept or reject clears the suggestion, so an accept succeeds only as the first
    of them on an entry that has one.
    """
    known = F.col("action").isin("rename", "accept_suggestion", "reject_suggestion")
    first = actions.filter(known).groupBy(*keys).agg(F.min("seq").alias("first_seq"))
    a = actions.join(grows(entries), keys, "left").join(grows(first), keys, "left")
    has = F.col("suggested").isNotNull() & (F.col("seq") == F.col("first_seq"))
    status = (F.when(F.col("label").isNull(), "unknown entry").when(~known, "unknown action")
              .when((F.col("action") == "accept_suggestion") & ~has, "no suggestion").otherwise("ok"))
    return a.withColumn("status", status).withColumn(
        "new_label", F.when(F.col("status") != "ok", None).when(F.col("action") == "rename", F.col("new_text"))
        .when(F.col("action") == "accept_suggestion", F.col("suggested")).otherwise(None))
