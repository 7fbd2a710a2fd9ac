"""A run that several results read is worked out once."""

import pytest

import __spark_entry__ as entry
from conform.operators import checks, registry

SMALL = "/root/testdata/sf0.001"
REGIONS = ({"target_field": "note", "kind": "text", "bbox": (0.0, 0.0, 20.0, 9.0), "font_size": 9}, {"target_field": "photo", "kind": "image", "bbox": (0.0, 0.0, 9.0, 9.0)})


@pytest.mark.parametrize("name", ["dq_overlay", "jn_regen", "set_symdiff"])
def test_rows_are_made_once(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_partkey" in line and "Relation" in line for line in plan.splitlines()) == 1


def test_pictures_are_judged_with_the_other_regions(spark):
    rows = spark.createDataFrame([("a", "x", "p1"), ("b", "a note far too wide", "p2"), ("c", "x", None), ("d", "x", "")], "id string, note string, photo string")
    images = spark.createDataFrame([("p1",), ("p1",), ("p9",)], "sha string")
    want = [("b", "note", "oversize_value"), ("b", "photo", "bad_image"), ("c", "photo", "missing_required"), ("d", "photo", "missing_required")]
    read = lambda df: sorted((r.id, r.field, r.kind) for r in df.collect())
    got = checks.overlay_problems(rows, REGIONS, images, ["id"])
    assert read(got) == want and "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert read(checks.overlay_problems(checks.with_pictures(rows, REGIONS, images), REGIONS, None, ["id"])) == want


def test_manifests_meet_without_a_join(spark):
    m = lambda *r: spark.createDataFrame(list(r), "document string, content_hash string")
    got = registry.compare_manifests(m(("a", "1"), ("b", "2"), ("c", "3")), m(("a", "1"), ("b", "x"), ("d", "4")), ["document"])
    assert sorted((r.document, r.difference) for r in got.collect()) == [("b", "changed"), ("c", "missing"), ("d", "extra")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stream_output_is_named_from_stored_reports(spark):
    plan = entry.queries()["str_apply"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "l_orderkey" not in plan
