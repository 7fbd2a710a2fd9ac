"""Registered queries against their SQL, and the pipeline against its parts."""

import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conform.llm import catalog, langid, pii, queries, winnow  # noqa: F401
from conform.llm.catalog import table
from test_word_copies import brute
from tools.check_oracle import TABLES, canonical
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cur = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), cols)


@pytest.mark.parametrize("name", ["op3_personal_data", "op6_toxicity", "op8_simhash_classes", "op9_edit_fingerprints", "op10_language"])
def test_query_returns_every_row(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.select("doc_id").distinct().count() == df.count() == table(spark, DATA, "documents").count()


def test_pipeline_does_what_its_stages_decide(spark):
    docs = table(spark, DATA, "documents")
    extra = spark.createDataFrame([(10_001, "12 34", "en", "src0", 5), (10_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    first = corpus_pipeline.language(spark, docs, DATA)
    assert {r.doc_id for r in docs.select("doc_id").subtract(first.select("doc_id")).collect()} == {10_001, 10_002}
    second = corpus_pipeline.near_copies(spark, first, DATA)
    want = set(brute([(r.doc_id, r.text) for r in first.select("doc_id", "text").collect()]))
    assert {r.doc_id for r in second.select("doc_id").collect()} == want
    third = corpus_pipeline.benchmark(spark, second, DATA)
    bad = {r.doc_id for r in winnow.with_overlap(second, table(spark, DATA, "benchmark")).filter(winnow.contaminated()).select("doc_id").collect()}
    assert {r.doc_id for r in third.select("doc_id").collect()} == want - bad
    fourth = corpus_pipeline.personal(spark, third, DATA)
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    assert fourth.filter(F.col("text").rlike(r"@mail\d")).count() == 0 and fourth.filter(F.col("n_chars") != F.length("text")).count() == 0
    last = corpus_pipeline.mixture(spark, fourth, DATA)
    assert last.count() == fourth.count() and "slot" in last.columns


def test_pipeline_takes_an_empty_table(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_language_without_labels_and_with_clashing_names(spark):
    rows = [(1, "some words", None, "s", 10, "x", 1), (2, "12 34", None, "s", 5, "y", 2), (3, None, None, None, None, None, None), (4, "été", None, "s", 3, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _language string, _overlap long")
    kept = corpus_pipeline.language(spark, docs, DATA)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[3]]
    some = docs.unionByName(spark.createDataFrame([(5, "the words of a text", "en", "s", 19, "w", 4)], docs.schema))
    for stage in (corpus_pipeline.language, corpus_pipeline.benchmark):
        kept = stage(spark, some, DATA)
        assert kept.columns == docs.columns and {tuple(r)[5:] for r in kept.collect() if r.doc_id in (1, 4, 5)} == {("x", 1), ("z", 3), ("w", 4)}


def test_pipeline_as_a_whole_equals_brute_force(spark, tmp_path):
    """Every stage by its rule, row by row, on a small table; the finder's own spans are only those that the stage covers beyond the strict ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    item = [word() for _ in range(30)]
    base = [[word() for _ in range(rng.randint(40, 90))] for _ in range(12)]
    rows = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 9])):
            w[rng.randrange(len(w))] = word()
        if i % 9 == 0:
            w = w[:20] + item[3:25] + w[20:]
        if i % 7 == 0:
            w += ["mail", "someone@mail.org", "from", "10.1.2.3"]
        rows.append((i, " ".join(w), None if i % 10 == 3 else "en", f"src{i % 6}", 1))
    rows += [(100, "12 34", "en", "src0", 5), (101, None, None, None, None), (102, "", "en", "src1", 0), rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", " ".join(item)), ("n", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lettered = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    left = set(brute([r[:2] for r in lettered]))
    shingles = {tuple(item[i:i + 13]) for i in range(len(item) - 12)}

    def contaminated(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        hit = {j for i in range(len(w) - 12) if tuple(w[i:i + 13]) in shingles for j in range(i, i + 13)}
        return hit and 20 * len(hit) >= len(w)

    left = {r[0]: r for r in lettered if r[0] in left and not contaminated(r[1])}
    assert sorted(r.doc_id for r in got) == sorted(left)
    for r in got:
        text = left[r.doc_id][1]
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text) and r.lang == "en" and r.source == left[r.doc_id][3]
        assert r.text == text or pii.candidates(text)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r[3]}')" for i, r in left.items()) + ") t(doc_id, source)")
    want = {r[0]: r[3:] for r in con.execute(catalog.ORACLES["op5_source_mix"]).fetchall()}
    assert {r.doc_id: (r.block, r.release, r.deadline, r.slot, r.place) for r in got} == want
