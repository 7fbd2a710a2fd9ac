"""Printed width of text in the standard sans-serif face."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyph widths of the standard Helvetica face in thousandths of the type size,
# from the public font metrics; characters listed together share a width.
WIDTHS = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^",
    500: "Jcksvxyz", 556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw",
    778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
#: Anything else is measured like an average letter.
OTHER = 556


def text_width(text: Column, size: Column) -> Column:
    """Width in points: per width class, how many of its characters the text holds.

    Counting by translation keeps this inside generated code; no array of characters is built.
    """
    total = F.lit(OTHER) * F.length(text)
    for width, chars in WIDTHS.items():
        if width == OTHER:
            continue
        held = F.length(text) - F.length(F.translate(text, chars, ""))
        total = total + F.lit(width - OTHER) * held
    return total * size / 1000.0
