"""Skew: one key with a third of the rows gives the same result as plain joins and windows."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform import sinks
from conform.operators import assist, detect, joins, ranking
from conform.sinks import EXCEPTION_COLUMNS


def skewed(spark, n=3000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq"))


def test_hot_keys_are_sliced_and_nothing_is_lost(spark):
    rows = skewed(spark)
    groups = rows.groupBy("k").agg(F.max("seq").alias("m"), F.count("*").alias("n"))
    assert joins.hot_keys(groups, ["k"], "n", 100).collect()[0].slices == 10
    got = joins.attach_group(rows, groups, ["k"], "n", F.col("seq"), hot_rows=100)
    assert got.exceptAll(rows.join(groups, "k").select(*got.columns)).isEmpty() and got.count() == 3000


def test_copies_of_a_hot_hash(spark, monkeypatch):
    docs = skewed(spark).select(F.col("k").cast("string").alias("sha"), F.format_string("d%05d", F.col("seq")).alias("document"))
    plain = {r.document for r in docs.groupBy("sha").agg(F.min("document").alias("document")).collect()}
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    marked = detect.mark_copies(docs)
    assert {r.document for r in marked.filter("is_first").collect()} == plain and marked.count() == 3000


def test_positions_equal_a_plain_window(spark):
    rows = skewed(spark)
    got = ranking.position_within(rows, ["k"], ["seq"], F.floor(F.col("seq") / 100))
    want = rows.withColumn("position", F.row_number().over(W.partitionBy("k").orderBy("seq")).cast("long"))
    assert got.select("k", "seq", F.col("position").cast("long")).exceptAll(want).isEmpty()


def test_packs_come_in_one_part_per_page_in_order(spark):
    rows = skewed(spark).select(F.col("k").cast("string").alias("document"), F.col("seq").alias("record_seq"), F.col("seq").cast("string").alias("v"),
                                (F.floor(F.col("seq") / 25) + 1).cast("string").alias("page"))
    heads = rows.select("document").distinct().union(spark.createDataFrame([("empty",)], "document string"))
    out = sinks.packs(rows, heads, ("v",), "page").collect()
    assert max(len(r.findings) for r in out) <= 25 and sum(len(r.findings) for r in out) == 3000
    for doc in {r.document for r in out}:
        parts = sorted((r for r in out if r.document == doc), key=lambda r: r.part)
        assert {r.n_parts for r in parts} == {len(parts)}
        read = [int(f.v) for r in parts for f in r.findings]
        assert read == sorted(read)
    assert [(r.part, r.findings) for r in out if r.document == "empty"] == [(0, [])]


def test_content_hash_sees_order_and_content_not_partitioning(spark):
    rows = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "document string, seq long, v string")
    swapped = spark.createDataFrame([("d", 2, "a"), ("d", 1, "b")], "document string, seq long, v string")
    h = lambda df: sinks.content_hash(df, ["document"], "seq", ["v"]).first().content_hash
    assert h(rows) == h(rows.repartition(7)) != h(swapped)


def test_exceptions_report_has_a_header_even_when_empty(spark, tmp_path):
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in EXCEPTION_COLUMNS))
    sinks.write_exceptions(empty, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    assert text == ",".join(EXCEPTION_COLUMNS) + "\n"


def test_csv_round_trip_of_awkward_values(spark, tmp_path):
    rows = spark.createDataFrame([("d", 'say "hi", ok'), ("e", ""), ("f", " padded "), ("g", "back\\slash")], "document string, v string")
    sinks.write_rows(rows, str(tmp_path / "y"), ("document", "v"))
    assert sorted(map(tuple, sinks.read_rows(spark, str(tmp_path / "y"), ("document", "v")).collect())) == sorted(map(tuple, rows.collect()))


def test_similarity_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    s, t = rng.normal(size=(20, 8)), rng.normal(size=(30, 8))
    t[4] = t[9]  # a tie goes to the smaller name
    sdf = spark.createDataFrame([(f"s{i:02d}", [float(x) for x in v]) for i, v in enumerate(s)], "source string, v array<double>")
    tdf = spark.createDataFrame([(f"t{i:02d}", [float(x) for x in v]) for i, v in enumerate(t)], "target string, v array<double>")
    got = {}
    for r in assist.rank_similar(sdf, tdf, 5, block=4).collect():
        got.setdefault(r.source, {})[r.rank] = r.target
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(s) @ unit(t).T
    for i in range(20):
        want = sorted(range(30), key=lambda j: (-round(sims[i, j], 12), j))[:5]
        assert [got[f"s{i:02d}"][k] for k in range(1, 6)] == [f"t{j:02d}" for j in want]


def test_edits_of_one_busy_field(spark):
    """All edits on one field, split over many buckets, against a step-by-step replay."""
    import random

    rnd = random.Random(5)
    kinds = ("create", "accept", "reject", "reroute", "pin", "constant", "formula", "redraw")
    cases = [(t, [("s", "f", i, rnd.choice(kinds), f"a{i}") for i in range(60)]) for t in ("T2", "T3", None)]
    cases.append((None, [("s", "f", i, k, f"a{i}") for i, k in enumerate(("constant", "create", "reject"))]))
    cases.append((None, [("s", "f", i, k, f"a{i}") for i, k in enumerate(("formula", "constant", "formula"))]))
    for tier, events in cases:
        fixed = {}
        st, refused = ({"m": "route", "p": "x", "t": tier, "v": None} if tier else {"m": None, "p": None, "t": None, "v": None}), []
        for _, _, i, act, arg in events:
            routed = st["m"] == "route"
            auto = "T1" if st["v"] else "T0"
            if act == "redraw" or (act == "create" and routed and st["t"] != "T3") or (act in ("accept", "reject", "reroute", "pin") and not routed) \
                    or (act == "accept" and st["t"] != "T2"):
                refused.append(i)
            elif act == "create":
                st = {"m": "route", "p": arg, "t": "T0", "v": None}
            elif act == "accept":
                st["t"] = auto
            elif act == "reject":
                st = {"m": None, "p": None, "t": None, "v": None}
            elif act == "reroute":
                st["p"], st["t"] = arg, auto
            elif act == "pin":
                st["v"], st["t"] = arg, "T1" if st["t"] in ("T0", "T1") else st["t"]
            else:
                fixed[act] = arg
                st = {"m": None, "p": None, "t": None, "v": None}
        if st["m"] is None and fixed:
            kept = "constant" if "constant" in fixed else "formula"
            st = {"m": kept, "p": fixed[kept], "t": "T0", "v": None}
        drafts = spark.createDataFrame([("s", "f", "x", tier)] if tier else [], "session_id string, target_field string, from_path string, tier string")
        edits = spark.createDataFrame(events, "session_id string, target_field string, step long, action string, arg string")
        state, lost = assist.apply_edits(drafts, edits, F.floor(F.col("step") / 7))
        got = state.first()
        assert (got.mechanism, got.from_path, got.tier, got.vm) == (st["m"], st["p"], st["t"], st["v"])
        assert sorted(r.step for r in lost.collect()) == refused


def test_salted_blocks_give_the_same_ranking(spark, monkeypatch):
    rng = np.random.default_rng(9)
    frames = [spark.createDataFrame([(f"{n}{i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(12, 4)))], f"{c} string, v array<double>")
              for n, c in (("s", "source"), ("t", "target"))]
    want = sorted(map(tuple, assist.rank_similar(*frames, 3, block=2).collect()))
    monkeypatch.setattr(assist, "BROADCAST_BLOCKS", 1)
    assert sorted(map(tuple, assist.rank_similar(*frames, 3, block=2).collect())) == want
