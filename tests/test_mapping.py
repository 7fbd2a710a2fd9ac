"""Formulas, mechanisms and strict resolution on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from conform.functions import formulas as fm
from conform.functions import text as tx
from conform.functions.formulas import ConfigError
from conform.operators import mapping
from conform.sources.config import check_mapping, coverage, load_mapping, rules_frame


def one(spark, result, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(result.value.alias("v"), result.reason.alias("r")).first()


@pytest.mark.parametrize("text,start,end", [("abcdef", 1, 3), ("abcdef", -3, None), ("abcdef", -4, -1), ("ab", 5, 9), ("abcdef", 4, 2),
                                            ("", 0, 2), ("abc", -9, 2)])
def test_substring_is_a_slice(spark, text, start, end):
    assert one(spark, fm.substring(F.col("t"), start, end), t=text).v == text[start:end]


@pytest.mark.parametrize("text,want", [("Jan 5, 1998", "1998-01-05"), ("january 05, 1998", "1998-01-05"), (" 1998-1-5 ", "1998-01-05"),
                                       ("5/1/1998", "1998-01-05"), ("Feb 31, 1998", None), ("1998/01/05", None), ("", None)])
def test_date_layouts(spark, text, want):
    got = one(spark, fm.date_format(F.col("t"), "%Y-%m-%d"), t=text)
    assert got.v == want and (got.r is None) == (want is not None)


@pytest.mark.parametrize("text,spec", [("1234567.891", ",.2f"), ("0.125", ".2f"), ("2.675", ".2f"), ("-0.5", ".0f"), ("12", "e"), ("0.25", ".1%")])
def test_number_format_matches_the_format_language(spark, text, spec):
    assert one(spark, fm.number_format(F.col("t"), spec), t=text).v == format(float(text), spec)


@pytest.mark.parametrize("a,op,b", [("1", "/", "4"), ("10", "*", "2.5"), ("1e8", "/", "3"), ("0.0001", "*", "1"), ("1", "/", "3e9"),
                                    ("5", "-", "5"), ("1e17", "+", "1"), ("12345678", "/", "8")])
def test_arith_prints_like_a_script(spark, a, op, b):
    r = {"/": float(a) / float(b), "*": float(a) * float(b), "-": float(a) - float(b), "+": float(a) + float(b)}[op]
    assert one(spark, fm.arith(F.col("a"), op, F.col("b")), a=a, b=b).v == (str(int(r)) if r == int(r) else str(r))


@pytest.mark.parametrize("a,op,b", [("x", "+", "1"), ("1", "/", "0"), ("", "*", "2"), ("inf", "+", "1"), ("nan", "+", "1")])
def test_arith_failures_are_data(spark, a, op, b):
    got = one(spark, fm.arith(F.col("a"), op, F.col("b")), a=a, b=b)
    assert got.v is None and got.r


def test_regex_group_rules(spark):
    assert one(spark, fm.regex_extract(F.col("t"), r"([a-z]+)-\d"), t="12 ab-3").v == "ab"
    assert one(spark, fm.regex_extract(F.col("t"), r"\d+"), t="12 ab-3").v == "12"
    assert "matched nothing" in one(spark, fm.regex_extract(F.col("t"), "z"), t="12").r
    with pytest.raises(ConfigError):
        fm.regex_extract(F.col("t"), "(?P<a>x)")


def test_list_cells(spark):
    df = spark.createDataFrame([(" a |  | b ",), ("",)], ["c"])
    rows = df.select(tx.split_list(F.col("c"), "|").alias("d"), tx.split_list(F.col("c"), "|", True).alias("k")).collect()
    assert rows[0].d == ["a", "b"] and rows[0].k == ["a", "", "b"] and rows[1].d == [] and rows[1].k == []


def test_structure_class(spark):
    df = spark.createDataFrame([("DF-001",), ("a.b 12c3",)], ["c"])
    assert [r[0] for r in df.select(tx.structure_class(F.col("c"))).collect()] == [r"DF\-\d{3}", r"a\.b\ \d{2}c\d{1}"]


DOC = {
    "routes": {"id": {"from": "finding.id", "tier": "T0"},
               "code": {"from": "finding.issues", "tier": "T1", "value_map": {"name": "m", "version": 1}},
               "pri": {"from": "finding.sev", "tier": "T1", "value_map": {"name": "n", "version": 1}},
               "lost": {"from": "finding.sev", "tier": "T1", "value_map": {"name": "n", "version": 9}}},
}
MAPS = {("m", 1): [("A", "1"), ("A | B", "2"), ("A", "9"), ("", "none")], ("n", 1): [("5", "P1")]}
SCOPE = mapping.Scope({}, {"id": "id", "sev": "sev", "issues": "issues"}, {}, frozenset({"issues"}))


def frame(spark):
    return spark.createDataFrame([("r1", "5", ["A"]), ("r2", "5", ["A", "B"]), ("r3", "7", ["C"]), ("r4", "5", [])],
                                 "id string, sev string, issues array<string>")


def test_any_problem_withholds_the_row_and_reports_each_field(spark):
    out = mapping.resolve(frame(spark), ("id", "code", "pri"), DOC, SCOPE, MAPS, ("sev",))
    rows = {r.id: r.code for r in mapping.good_rows(out, ("id", "code", "pri"), ()).collect()}
    assert rows == {"r1": "1", "r2": "2", "r4": "none"}
    bad = {(r.field, r.kind, r.value) for r in mapping.problem_rows(out, ("sev",)).collect()}
    assert bad == {("code", "oov_value", "C"), ("pri", "oov_value", "7")}


def test_missing_map_version_is_an_error_not_the_latest(spark):
    out = mapping.resolve(frame(spark), ("lost",), DOC, SCOPE, MAPS, ("sev",))
    assert {r.reason for r in mapping.problem_rows(out, ("sev",)).collect()} == {"value map n@9 not loaded"}


def test_long_maps_join_and_agree_with_inline_ones(spark):
    long = dict(MAPS)
    long[("m", 1)] = MAPS[("m", 1)] + [(f"x{i}", "z") for i in range(200)]
    a, c = (mapping.resolve(frame(spark), ("id", "code"), DOC, SCOPE, m, ("sev",)) for m in (MAPS, long))
    cols = ("id", "code")
    assert sorted(map(tuple, mapping.good_rows(a, cols, ()).collect())) == sorted(map(tuple, mapping.good_rows(c, cols, ()).collect()))


DATED = {"routes": {"id": {"from": "finding.id", "tier": "T0"}}, "formulas": {
    "on": {"fn": "date_format", "args": [{"field": "header.day"}, {"lit": "%Y-%m-%d"}]}, "both": {"fn": "concat", "args": [{"field": "header.day"}, {"field": "finding.id"}]}}}


def test_formulas_over_the_header_are_worked_out_once_per_document(spark):
    """A date was parsed for every record, in every place that asked for its outcome; results are the same."""
    scope = mapping.Scope({"day": "day"}, {"id": "id"}, {})
    heads = spark.createDataFrame([(1, "Jan 5, 1998"), (2, "some day"), (3, None)], "doc int, day string")
    records = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc int, id string")
    stored = mapping.with_header_formulas(heads, [DATED, DATED], scope)
    assert [c for c in stored.columns if c.startswith(mapping.FORMULA)] == [mapping.formula_column(DATED["formulas"]["on"])]
    plain, early = (mapping.resolve(records.join(h, "doc"), ("id", "on", "both"), DATED, scope, {}, ("doc",)) for h in (heads, stored.localCheckpoint()))
    assert "make_timestamp" in plain._jdf.queryExecution().optimizedPlan().toString()
    assert "make_timestamp" not in early._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, plain.collect())) == sorted(map(str, early.collect()))


def test_a_run_parses_no_date_per_record(spark):
    from conform.plans import bindings as b
    from conform.plans.scoring import make_run, sheet_bundle

    plan = make_run(b.Tables(spark, "/root/testdata/sf0.001")).outcome(sheet_bundle())._jdf.queryExecution().optimizedPlan().toString()
    assert "make_timestamp" not in plan and "RLIKE" not in plan


def test_content_hash_is_the_sum_of_pieces(spark):
    import hashlib

    from conform.sinks import content_hash

    got = content_hash(spark.range(300).selectExpr("id % 3 AS k", "id AS n", "cast(id AS string) AS v"), ["k"], "n", ["v"]).collect()
    for r in got:
        hashes = [hashlib.sha256(f"{n}\x1f{n}".encode()).hexdigest() for n in range(r.k, 300, 3)]
        sums = [str(sum(int(h[15 * i:15 * i + 15], 16) for h in hashes)) for i in range(4)]
        assert (r.n_rows, r.content_hash) == (100, hashlib.sha256(",".join(["100", *sums]).encode()).hexdigest())


def test_grammar(spark):
    assert check_mapping({"routes": {"a": {"from": "finding.x", "tier": "T0"}}}) == []
    bad = check_mapping({"routes": {"a": {"tier": "T9", "x": 1}}, "formulas": {"b": {"fn": "eval", "args": [{"field": "f", "lit": 1}]}}, "z": 1})
    assert len(bad) == 6
    with pytest.raises(ConfigError):
        load_mapping("routes: [")
    with pytest.raises(ConfigError):
        rules_frame(spark, {"t": {"formulas": {"b": {"fn": "eval", "args": [{"lit": 1}]}}}})


def test_tier_coverage():
    doc = {"routes": {"a": {"tier": "T1"}, "b": {"tier": "T2"}}, "constants": {"c": 1}, "prompts": [{"key": "d"}]}
    assert coverage(doc, ("a", "b", "c", "d", "e")) == 3 / 5 and coverage(doc, ()) == 1.0


def test_formulas_need_their_arguments():
    from conform.sources.config import check_mapping

    bad = lambda fn, n: check_mapping({"formulas": {"x": {"fn": fn, "args": [{"lit": "1"}] * n}}})
    assert bad("arith", 2) == ["formulas/x: 2 arguments, 3 expected"] and bad("arith", 3) == []
    assert bad("concat", 0) == ["formulas/x: 0 arguments, 1 or more expected"] and bad("substring", 4) == ["formulas/x: 4 arguments, 1 to 3 expected"]
