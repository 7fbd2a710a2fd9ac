"""The record table is looked for inside the row of a page: same tables as from lines, and few shuffles."""

from pyspark.sql import functions as F

from conform.operators import layout, onboard
from conform.plans.bindings import Tables

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_pages_with_their_lines_give_the_tables_of_the_lines(spark):
    printed = Tables(spark, SMALL).printed_pages()
    pages, lines = layout.whole_lines(printed), layout.visual_lines(printed)
    assert rows(pages.select("doc_id", "page", F.inline("lines"))) == rows(lines)
    assert rows(onboard.furniture(pages)) == rows(onboard.furniture(lines))
    found = rows(onboard.record_tables(pages, onboard.furniture(pages)))
    assert found and found == rows(onboard.record_tables(lines))


def test_later_pages_decide_between_headers(spark):
    """Two candidates on the first page, a heading and its first row: the one with most rows wins; a document without rows enough has no table."""
    word = lambda x, t: (float(x), 0.0, float(x) + 5, t)
    line = lambda top, *ws: (float(top), [word(x, t) for x, t in ws], " ".join(t for _, t in ws))
    table = lambda top, i: line(top, (10, f"A{i}"), (100, "b"), (200, "c"), (300, "d"))
    first = [line(5, (10, "Title"), (20, "of"), (30, "a"), (40, "report")), line(10, (10, "Id"), (100, "B"), (200, "C"), (300, "D"))]
    pages = [(1, 1, first + [table(20 + 10 * i, i) for i in range(4)]), (1, 2, [table(20 + 10 * i, i) for i in range(4, 6)]), (2, 1, first[1:] + [table(20, 1), table(30, 2)])]
    schema = "doc_id long, page int, lines array<struct<line_top:double,words:array<struct<x0:double,top:double,x1:double,text:string>>,text:string>>"
    got = onboard.record_tables(spark.createDataFrame(pages, schema)).collect()
    assert [(r.doc_id, r.h_page, r.h_text, r["class"], r.table_rows) for r in got] == [(1, 1, "Id B C D", r"A\d{1}", 6)]


def test_running_lines_are_counted_with_two_shuffles(spark):
    pages = layout.whole_lines(Tables(spark, SMALL).printed_pages()).persist()
    tree = onboard.furniture(pages)._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert tree.count("Exchange hashpartitioning") == 2 and "Join" not in tree
    pages.unpersist()


def test_the_start_of_a_line_is_looked_up_once(spark):
    words = spark.createDataFrame([(1, 1, [(1.0, 2.0, 3.0, "w")])], "doc_id long, page int, words array<struct<top:double,x0:double,x1:double,text:string>>")
    assert layout.page_lines(words)._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 1
