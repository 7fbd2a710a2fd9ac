"""Recipes that are data: two profiles in one job, header strategies, continuation pages, lists."""

from pyspark.sql import functions as F

from conform.operators import recipes
from conform.operators.layout import visual_lines

R = [("a@1", ["Report", "Site:"], r"^No\s+What", [("site", "label_right", ["Site:", "Place:"]), ("day", "label_below", ["Day"]), ("gone", "stacked_label", ["Nowhere"])],
      [("no", 0.0, 50.0, None), ("what", 50.0, 200.0, "+")], r"\d+$", r"No\s+What", ["Page "]),
     ("b@1", ["Other"], None, [("site", "label_below", ["Where"])], [("all", 0.0, 500.0, None)], None, None, None)]


def words(spark, pages):
    rows = [(d, p, 20.0 * i, 30.0 * k if not isinstance(w, tuple) else w[1], 30.0 * k + 9.0, w if isinstance(w, str) else w[0])
            for (d, p), lines in pages.items() for i, line in enumerate(lines) for k, w in enumerate(line.split(" ") if isinstance(line, str) else line)]
    return spark.createDataFrame(rows, "doc_id long, page long, top double, x0 double, x1 double, text string")


def test_profiles_in_one_job(spark):
    pages = {(1, 1): ["Report", "Place: Here Now", "Day", "May 1"], (1, 2): ["Page 2", "No What", [("1", 10.0), ("x", 60.0), ("+", 70.0), ("y", 80.0)], [("n", 10.0), ("z", 60.0)]],
             (1, 3): ["No What", [("2", 10.0), ("solo", 60.0), ("out", 300.0)], [("3", 10.0)]], (1, 9): ["Site: Late"],
             (2, 1): ["Other", "Where", "There"], (3, 1): ["Report", "nothing else"]}
    lines = visual_lines(words(spark, pages))
    claimed = spark.createDataFrame([(1, "a@1"), (2, "b@1")], "doc_id long, profile string")
    table = recipes.recipe_frame(spark, R)
    got = recipes.records(lines, claimed, table).orderBy("doc_id", "record_seq").collect()
    assert [(r.doc_id, r.page, [(c["name"], c["value"], c["items"]) for c in r["cells"]]) for r in got] == [
        (1, 2, [("no", "1", None), ("what", "x + y", ["x", "y"])]), (1, 3, [("no", "2", None), ("what", "solo", ["solo"])]), (1, 3, [("no", "3", None), ("what", "", None)]),
        (2, 1, [("all", "Other", None)]), (2, 1, [("all", "Where", None)]), (2, 1, [("all", "There", None)])]
    heads = {(r.doc_id, r["name"]): r.value for r in recipes.headers(lines, claimed, table).collect()}
    assert heads == {(1, "site"): "Here Now", (1, "day"): "May 1", (2, "site"): "There"}
    lead = spark.createDataFrame([(1, "Report\nPlace:\nNo What"), (2, "Other"), (3, "x")], "doc_id long, lead_text string")
    whole = {r.doc_id: (r.anchors_found, r.anchors_missing) for r in recipes.integrity(lead, claimed, table).collect()}
    assert whole == {1: (["Report", recipes.TABLE_ANCHOR], ["Site:"]), 2: (["Other"], [])}


def test_run_inputs_of_unclaimed_and_empty_documents(spark):
    lines = visual_lines(words(spark, {(1, 1): ["Report", "Site: A"], (1, 2): [[("7", 10.0), ("p", 60.0)]]}))
    lead = spark.createDataFrame([(1, "Report")], "doc_id long, lead_text string")
    files = spark.createDataFrame([(1, "one", "h1"), (2, "two", "h2")], "doc_id long, document string, sha string")
    claimed = spark.createDataFrame([(1, "a@1")], "doc_id long, profile string")
    docs, found, counts = recipes.run_inputs(files, lines, lead, claimed, recipes.recipe_frame(spark, R), {"place": "site"}, None, ("no",), ("what",), "no")
    assert sorted(map(tuple, docs.collect())) == [(1, "one", "h1", "Report", "A", None), (2, "two", "h2", None, "", None)]
    assert [tuple(r) for r in found.select("doc_id", "no", "what", "page").collect()] == [(1, "7", ["p"], 7)] and counts.first().extracted == 1


def test_a_missing_value_is_outside_every_vocabulary(spark):
    from conform.operators.validate import vocabulary_violations

    rows = spark.createDataFrame([("a",), ("z",), (None,)], "kind string")
    got = rows.select("kind", F.transform(vocabulary_violations(["kind"], {"kind": ("a", "b")}), lambda v: v["value"]).alias("v")).collect()
    assert {r["kind"]: r.v for r in got} == {"a": [], "z": ["z"], None: [""]}


def test_cells_are_cut_once_and_for_records_only(spark):
    import __spark_entry__ as entry

    tree = entry.queries()["dq_extract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    join = next(l for l in tree.splitlines() if "BroadcastHashJoin" in l)
    assert "struct(name" not in join and tree.count("struct(name") <= 3
