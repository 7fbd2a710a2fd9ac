"""Registered queries against their SQL, and invariants of a run."""

import duckdb
import pytest

import __spark_entry__ as entry
from conform.plans import bindings as b
from conform.plans.bindings import Tables
from conform.plans.scoring import sheet_bundle, make_run
from tools.check_oracle import TABLES, canonical
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SAMPLE = ("agg_verdict", "set_exc", "prj_strict", "prj_preview", "jn_valuemap", "jn_decide", "win_dedup", "win_lines", "dq_extract", "dq_matrix", "jn_box",
          "agg_gate", "agg_rowpat", "win_review", "win_edits", "agg_drops", "top_cosine", "fn_date", "fn_number", "fn_arith", "snk_csv", "snk_pack", "dq_form",
          "str_apply", "dq_audit", "dq_recipe", "dq_replay", "dq_annot", "agg_table", "agg_furn", "dq_header", "dq_words_run", "dq_roundtrip", "dq_targets",
          "dq_assemble", "dq_template", "dq_approve")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_of_the_library_has_sql():
    from conform.plans import catalog

    catalog.load()
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), cols)


def test_rows_and_failed_records_add_up(spark):
    bundle = sheet_bundle()
    run = make_run(Tables(spark, DATA), bundle)
    out = run.outcome(bundle)
    assert run.rows(out, bundle).count() + out.filter("size(errors) > 0").count() == run.records.count()


def test_every_document_appears_once_in_the_card(spark):
    run = make_run(Tables(spark, DATA))
    docs = [r.document for r in run.verdicts().select("document").collect()]
    assert len(docs) == len(set(docs)) == run.documents.count()


def test_missing_prompt_answers_fail_before_reading(spark):
    t = Tables(spark, DATA)
    run = make_run(t)
    with pytest.raises(ValueError, match="frame_agreement"):
        type(run)(run.documents, run.findings, run.counts, run.bundles, run.value_maps, {}, b.PROFILES, run.run_profile, b.ANCHORS, b.SEVERITIES)


def test_result_does_not_depend_on_partitioning(spark):
    t = Tables(spark, DATA)
    want = sorted(map(tuple, make_run(t).verdicts().collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        run = make_run(t)
        run.findings = run.findings.repartition(9)
        assert sorted(map(tuple, run.verdicts().collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_run_is_committed_once_and_leaves_no_intermediate_tables(spark, tmp_path):
    from conform.plans import audit

    t = Tables(spark, DATA)
    audit.commit_run(make_run(t), "r1", str(tmp_path))
    assert not (tmp_path / "run=r1" / "_work").exists()
    with pytest.raises(ValueError, match="committed already"):
        audit.commit_run(make_run(t), "r1", str(tmp_path))
    assert audit.committed(spark, str(tmp_path)).count() == 1
    converted = make_run(t).gated.filter("blocked_kind = ''").count()
    assert spark.read.parquet(str(tmp_path / "run=r1" / "manifest")).count() == converted


def test_known_content_is_a_copy(spark):
    run = make_run(Tables(spark, DATA))
    sha = run.gated.filter("blocked_kind = ''").select("sha").first().sha
    again = make_run(Tables(spark, DATA))
    again.known = spark.createDataFrame([(sha,)], "sha string")
    assert {r.blocked_kind for r in again.gated.filter(F.col("sha") == sha).collect()} == {"duplicate"}
