"""Text helpers shared by mapping, layout and onboarding. All are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_JOINER = " | "


def as_text(col: Column, is_list: bool = False) -> Column:
    """What a target receives: null becomes "", a list is joined, anything else is cast."""
    if is_list:
        return F.coalesce(F.array_join(col, LIST_JOINER, ""), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), col, F.lit("'"))


def split_list(col: Column, separator: str, keep_blank: bool = False) -> Column:
    """Split a cell on a literal separator and trim; an empty cell is an empty list."""
    parts = F.transform(F.split(col, "\\Q" + separator + "\\E", -1), strip)
    if keep_blank:
        return F.when(col == "", F.array().cast("array<string>")).otherwise(parts)
    return F.filter(parts, lambda p: p != "")


def slug(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))


def human_name(col: Column) -> Column:
    return F.trim(F.replace(F.element_at(F.split(col, "\\."), -1), F.lit("_"), F.lit(" ")))


def map_name(path: Column, target: Column) -> Column:
    return F.concat(F.element_at(F.split(path, "\\."), -1), F.lit("_to_"), target)


# Characters a regular-expression quoter puts a backslash in front of.
REGEX_SPECIALS = r"([()\[\]{}?*+\-|^$\\.&~#\s])"


def structure_class(col: Column) -> Column:
    """Quote text for a regular expression, with every digit run replaced by its length."""
    pieces = F.regexp_extract_all(col, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit(r"\d{"), F.length(p).cast("string"), F.lit("}")))
            .otherwise(F.regexp_replace(p, REGEX_SPECIALS, r"\\$1")),
        ),
        "",
    )


def drop_page_counter(col: Column) -> Column:
    """Running lines often end in a page number; compare them without it."""
    return F.trim(F.regexp_replace(col, r"[0-9]+$", ""))


# The answers read as a ticked box.
CHECKED = ("yes", "true", "1", "on", "x", "checked")


def check_mark(col: Column) -> Column:
    return F.when(F.lower(col).isin(*CHECKED), F.lit("/Yes")).otherwise(F.lit("/Off"))


def versioned_ref(col: Column) -> dict[str, Column]:
    """Split ``name@version``; a missing version means 1, a non-number is null."""
    version = F.when(F.instr(col, "@") > 0, F.split_part(col, F.lit("@"), F.lit(2))).otherwise(F.lit(""))
    return {
        "name": F.split_part(col, F.lit("@"), F.lit(1)),
        "version": F.when(version == "", F.lit(1)).otherwise(version.try_cast("int")),
    }


# The characters outer trimming removes.
BLANKS = " \t\n\r\f\x0b"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))
