"""What grows with the tables stays off the driver, and is written once."""

from dataclasses import replace

import pytest

import __spark_entry__ as entry
from conform.operators import checks, onboard
from conform.plans import bindings as b
from conform.plans import publish as publishing
from conform.plans.bindings import Tables
from conform.plans.checks import FORM_TEMPLATE
from conform.plans.run import Bundle
from conform.plans.scoring import make_run
from conform.sources.config import load_mapping

SMALL = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["agg_bbox", "dq_matrix", "fn_derive", "jn_axis", "prj_accept"])
def test_cells_of_grids_are_never_broadcast(spark, name):
    """Even on tables so small that the optimizer would: its sizes do not count exploded rows."""
    assert "BroadcastExchange" not in plan(spark, name)


def test_tables_of_the_line_analysis_are_never_broadcast(spark):
    """Running lines and record tables have a row per document, in few bytes on disk and many in memory."""
    word = "struct<x0:double,top:double,x1:double,text:string>"
    lines = spark.createDataFrame([(1, 1, 10.0, "Running line", [])], f"doc_id long, page int, line_top double, text string, words array<{word}>")
    tables = spark.createDataFrame([(1, 1, 10.0, "Id Name", [], "c")], "doc_id long, h_page int, h_top double, h_text string, ranges array<struct<lo:double,hi:double>>, class string")
    running = onboard.furniture(lines)
    body = onboard.without_running(lines, onboard.without_table_header(running, tables))
    for df in (running, body, onboard.recount(body, tables), onboard.label_values(body.withColumnRenamed("line_top", "top"), tables)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_values_are_spelled_out_after_rows_met(spark):
    rows = spark.createDataFrame([("d", "1", "a", "b"), ("d", "2", "c", None)], "document string, record_seq string, p string, q string")
    back = spark.createDataFrame([("d", "1", "a", "B"), ("e", "9", "x", "y")], rows.schema)
    got = checks.round_trip(rows, back, ("document", "record_seq"), ("p", "q"))
    assert sorted((r.document, r.record_seq, r.field, r.expected, r.got, r.same) for r in got.collect()) == [
        ("d", "1", "p", "a", "a", True), ("d", "1", "q", "b", "B", False), ("d", "2", "p", "c", None, False), ("d", "2", "q", None, None, True),
        ("e", "9", "p", None, "x", False), ("e", "9", "q", None, "y", False)]
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in tree and tree.index("Generate explode") < tree.index("SortMergeJoin")


def test_publishing_stores_no_copy_of_a_stored_outcome(spark, tmp_path, monkeypatch):
    t, form = Tables(spark, SMALL), Bundle(load_mapping(b.MAPPING), FORM_TEMPLATE)
    run = replace(make_run(t, form), work=str(tmp_path / "work")).freeze()
    stored = []
    real = publishing.stage
    monkeypatch.setattr(publishing, "stage", lambda df, label, folder=None: stored.append(label) or real(df, label, folder))
    shipped, withheld = publishing.publish(run, form, str(tmp_path / "out"))
    assert stored == ["bad"] and shipped.count() == run.rows(run.outcome(form), form).count() > 0 and withheld.isEmpty()
    assert not list((tmp_path / "out" / "intake_form").glob("*.json")) and list((tmp_path / "out" / "intake_form").glob("*.json.gz"))


@pytest.mark.parametrize("name", ["win_segment", "win_midedge", "win_lines", "dq_annot"])
def test_words_are_put_in_order_by_the_compiled_sort(spark, name):
    """``array_sort`` calls its comparator as an expression, once per comparison."""
    tree = plan(spark, name)
    assert "sort_array" in tree and "array_sort" not in tree


def test_rows_of_a_form_are_judged_in_one_pass(spark):
    assert plan(spark, "dq_form").count("lineitem.parquet") == 1
