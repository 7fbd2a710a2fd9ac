"""Lines, bands and tables on small pages; brute force where there is a simple one."""

import random

from pyspark.sql import functions as F

from conform.operators import layout, onboard

WORD = "doc_id long, page int, top double, x0 double, x1 double, text string"


def brute_lines(words):
    lines = []
    for w in sorted(words, key=lambda w: (w[2], w[3])):
        hit = next((l for l in lines if abs(l[0] - w[2]) <= 2.5), None)
        if hit is None:
            hit = (w[2], [])
            lines.append(hit)
        hit[1].append(w)
    return {(l[0], " ".join(w[5] for w in sorted(l[1], key=lambda w: w[3]))) for l in lines}


def test_a_chain_of_small_steps_is_not_one_line(spark):
    words = [(1, 1, t, 10.0 * i, 10.0 * i + 5, f"w{i}") for i, t in enumerate((0.0, 2.0, 4.0, 6.0, 20.0))]
    got = {(r.line_top, r.text) for r in layout.visual_lines(spark.createDataFrame(words, WORD)).collect()}
    assert got == {(0.0, "w0 w1"), (4.0, "w2 w3"), (20.0, "w4")}


def test_lines_match_brute_force(spark):
    rnd = random.Random(7)
    words = [(1, 1, rnd.randrange(0, 400) / 4, float(i), i + 0.5, f"w{i}") for i in range(150)]
    got = {(r.line_top, r.text) for r in layout.visual_lines(spark.createDataFrame(words, WORD)).collect()}
    assert got == brute_lines(words)


def test_annotation_rows_with_wrapped_cells_overflow_and_footer(spark):
    def word(top, x0, text):
        return (1, 3, float(top), float(x0), x0 + 5.0 * len(text), text)

    head = [word(60, x, t) for x, t in ((30, "Id"), (90, "Severity"), (150, "User"), (180, "tags"), (260, "Issues"), (380, "Comments"), (530, "Page"))]
    body = [word(100, 30, "101"), word(100, 90, "4"), word(100, 125, "N"), word(100, 150, "RGB"), word(95, 380, "long"), word(105, 380, "text"), word(100, 530, "2"),
            word(140, 30, "102"), word(140, 90, "x"), word(140, 260, "burned"), word(140, 290, "lead"), word(140, 530, "n/a"),
            word(700, 250, "3"), word(700, 262, "/"), word(700, 270, "9")]
    out = layout.annotation_records(spark.createDataFrame(head + body, WORD), ("Id", "Severity", "Page"),
                                    ("Id", "Severity", "User", "Issues", "Comments", "Page"), r"^\d+$", 600.0, ("4",), "|")
    got = {r.id: r for r in out.collect()}
    assert got["101"].user_tags == ["N", "RGB"] and got["101"].comments == "long text" and got["101"].page_no == 2 and got["101"].parse_error is None
    assert got["102"].issues == ["burned lead"] and got["102"].parse_error == "severity 'x' outside vocabulary"


def test_label_values_below_and_near(spark):
    words = [(1, 1, 10.0, 100.0, 150.0, "Total"), (1, 1, 11.0, 100.0, 110.0, "7"), (1, 1, 40.0, 140.0, 160.0, "12"), (1, 1, 30.0, 151.0, 170.0, "9"),
             (1, 1, 65.0, 100.0, 110.0, "3")]
    df = spark.createDataFrame(words, WORD)
    assert [r.value for r in layout.number_below(df, ("Total",)).collect()] == ["12"]
    assert [r.value for r in layout.text_near(df, ("Total",)).collect()] == ["9"]


def test_record_table_prefers_the_real_header_and_recounts(spark):
    rows = [(10.0, ["Survey", "register"])] + [(30.0, ["Ref", "Class", "Component", "Sheet"])]
    rows += [(50.0 + 20 * i, [f"DF-{i:03d}", "c", "part", "s"]) for i in range(4)] + [(150.0, ["note"])]
    words = [(1, 1, top, 100.0 * i, 100.0 * i + 20, t) for top, ts in rows for i, t in enumerate(ts)]
    words += [(1, 2, 50.0 + 20 * i, 100.0 * k, 100.0 * k + 20, t) for i in range(3) for k, t in enumerate([f"DF-{i + 10:03d}", "c", "part", "s"])]
    lines = layout.visual_lines(spark.createDataFrame(words, WORD))
    t = onboard.record_tables(lines).first()
    assert (t.h_text, t["class"], t.table_rows) == ("Ref Class Component Sheet", r"DF\-\d{3}", 7)
    assert onboard.recount(lines, onboard.record_tables(lines)).first().recurrence == 7


def test_furniture_needs_most_pages(spark):
    rows = [(1, p, f"Page footer {p}") for p in range(1, 6)] + [(1, p, "only twice here") for p in (1, 2)] + [(2, 1, "single page doc")]
    got = [(r.prefix, r.on_pages) for r in onboard.furniture(spark.createDataFrame(rows, "doc_id long, page int, text string")).collect()]
    assert got == [("Page footer", 5)]


def test_confidence_and_flags(spark):
    df = spark.createDataFrame([("record_table", 3, 0.5, 2, True), ("furniture_line", 1, 1.0, 2, True), ("header_field", 1, 1.0, 1, False)],
                               "kind string, n int, agree double, pages int, v boolean")
    conf = onboard.confidence(F.col("kind"), F.col("n"), F.col("agree"), F.col("pages"), F.col("v"))
    rows = df.select(conf.alias("c"), onboard.element_flags(conf, F.col("agree")).alias("f")).collect()
    assert [r.c for r in rows] == [0.3, 0.9, 0.6] and rows[0].f == ["low_confidence", "non_generalising"]
