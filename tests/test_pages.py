"""Words that come as one row per page: the same lines and records, and no row per word is made or moved."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conform.operators import layout

SMALL = "/root/testdata/sf0.001"
WORD = "doc_id long, page int, top double, x0 double, x1 double, text string"


def packed(words):
    return layout.pages(words.groupBy("doc_id", "page", F.floor("x0") % 3).agg(F.collect_list(F.struct("top", "x0", "x1", "text")).alias("words")))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_pages_give_the_lines_of_their_words(spark):
    rnd = random.Random(5)
    words = spark.createDataFrame([(d, p, rnd.randrange(0, 300) / 4, float(rnd.randrange(500)), 600.0, f"w{i}")
                                   for d in (1, 2) for p in (1, 2) for i in range(80)], WORD)
    assert rows(layout.visual_lines(packed(words))) == rows(layout.visual_lines(words))


def test_bands_of_many_ids_and_overlapping_heads(spark):
    """Each word against every edge and every range, one by one."""
    rnd, pattern = random.Random(3), r"^\d+$"
    head = [(60.0, x, x + 5.0 * len(t), t) for x, t in ((30.0, "Id"), (90.0, "Severity and what follows"), (90.0, "Severity"), (150.0, "User"), (260.0, "Issues"), (380.0, "Comments"), (530.0, "Page"))]
    body = [(100.0 + 20 * i + rnd.random() * 8, 30.0, 45.0, str(100 + i)) for i in range(9)]
    body += [(90.0 + rnd.random() * 190, x, x + 20.0, f"t{i}") for i in range(120) for x in [rnd.choice((20.0, 95.0, 160.0, 270.0, 400.0, 540.0)) + rnd.randrange(9)]]
    words = spark.createDataFrame([(1, 1, *w) for w in head + body], WORD)
    names = ("Id", "Severity", "User", "Issues", "Comments", "Page")
    got = {r.id: r for r in layout.annotation_records(packed(words), ("Id", "Severity", "Page"), names, pattern, 600.0, ("4",), "|").collect()}
    heads = [w for w in sorted(head, key=lambda w: (w[1], w[0], w[2], w[3])) if w[3] in names]
    edges = [0.0] + [(a[2] + b[1]) / 2 for a, b in zip(heads, heads[1:])] + [600.0]
    column = lambda x: next((h[3] for h, lo, hi in zip(heads, edges, edges[1:]) if lo <= x < hi), None)
    tops = sorted(w[0] for w in body if edges[0] <= w[1] < edges[1] and w[3].isdigit())
    cuts = [(a + b) / 2 for a, b in zip(tops, tops[1:])]
    for k, top in enumerate(tops):
        own = sorted((round(w[0]), w[1], w[3]) for w in body if sum(c <= w[0] for c in cuts) == k and column(w[1]) == "Comments")
        assert got[next(w[3] for w in body if w[0] == top)].comments == " ".join(w[2] for w in own)
    assert len(got) == len(tops) == 9


def test_words_of_annotated_pages_are_never_rows(spark):
    tree = entry.queries()["dq_annot"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange hashpartitioning") <= 2 and "ObjectHashAggregate" not in tree and "inline(words" not in tree
    assert len(tree) < 60_000
