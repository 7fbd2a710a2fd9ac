"""Repeated passages and benchmark overlap against brute force, and their edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conform.llm import substring, winnow
from conform.llm.hashing import SPACED, covered, words_of
from conform.llm.ranges import Ranges, ranges_of
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, _range int, _text string, overlap string"


def brute_repeats(rows, n):
    """(id, text) -> n_words, n_removed, kept text, in the operator's order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if (k := tuple(w[s:s + n])) in seen:
                gone[s:s + n] = [True] * n
            seen.add(k)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def texts(seed, n=60):
    rng = random.Random(seed)
    passage = [" ".join(rng.choice("abcd") + str(rng.randint(0, 9)) for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.4 else " ".join(rng.choice("xyz\u00e9\u00df") for _ in range(rng.randint(0, 9))) for _ in range(4)]
        rows.append((i * 7, rng.choice([" ", "\n", "\t ", "\x0b"]).join(parts)))
    return rows + [(3, None), (4, ""), (5, "  \n "), (None, passage[0]), (None, None), (14, rows[2][1]), rows[5], rows[5], (9, "w " * 3000)]


@pytest.mark.parametrize("size", [8 << 20, 400])
def test_repeats_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(substring, "RANGE_BYTES", size)
    rows = texts(1)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs, 6).collect()]
    assert sorted(got, key=repr) == brute_repeats(rows, 6)


def test_removed_intervals_are_maximal(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d y a b c")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in substring.remove_repeats(docs, 3).collect()}
    assert got == {1: [], 2: [(1, 5), (6, 9)]}


def test_empty_table(spark):
    out = substring.remove_repeats(spark.createDataFrame([], DOCS), 5)
    assert out.columns == ["doc_id", "n_words", "n_removed", "removed", "kept_text"] and out.count() == 0


def test_ranges_grow_with_the_id(spark):
    ids = [None, -5, *random.Random(2).sample(range(10_000_000), 500)]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    for target in (1000, 50, 7):
        r = ranges_of(df, "i", F.lit(1), target)
        got = df.select("i", r.number(F.col("i")).alias("n")).collect()
        ordered = [x.n for x in sorted(got, key=lambda x: (x.i is not None, x.i or 0))]
        assert ordered == sorted(ordered) and 0 <= ordered[0] and ordered[-1] < r.count
    fine = Ranges([10, 20], 4, 0, 40)
    got = [r.n for r in df.sparkSession.range(41).select(fine.number(F.col("id")).alias("n")).collect()]
    assert got == sorted(got) and max(got) == 11 and got[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\u00e9\t.", max_size=30)), max_size=8))
def test_words_are_those_of_split(values):
    w = words_of(pa.array(values, pa.string()), SPACED)
    want = [(d, x) for d, t in enumerate(values) for x in (t or "").encode().split()]
    assert [(d, w.text_of(i)) for i, d in enumerate(w.doc)] == want
    assert len({x for _, x in want}) == len(set(w.hash.tolist()))


def test_word_hash_does_not_depend_on_the_step(monkeypatch):
    column = pa.array(["one two  three", "x" * 50 + " two"])
    whole = words_of(column, SPACED).hash
    monkeypatch.setattr("conform.llm.hashing.STEP_BYTES", 8)
    assert np.array_equal(words_of(column, SPACED).hash, whole)
    assert covered(np.array([1, 2]), 2, 6).tolist() == [False, True, True, True, False, False]


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_overlap(rows, items, window):
    low = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    table = {}
    for i, t in items:
        w = low(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            table.setdefault(tuple(w[s:s + window]), set()).add(i)
    out = []
    for d, t in rows:
        w, found = low(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in table}:
            for s in range(len(w) - n + 1):
                if m := table.get(tuple(w[s:s + n])):
                    found |= m
                    hit[s:s + n] = [True] * n
        out.append((d, len(w), sum(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_overlap_matches_brute_force(spark, slice_bytes):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 30)))) for i in range(12)] + [(90, None), (91, ""), (92, "a1"), (93, "E2 f3")]
    rows = []
    for d in range(80):
        words = []
        for _ in range(4):
            source = rng.choice(items)[1] or ""
            w = source.split()
            a = rng.randint(0, len(w))
            words += w[a:a + rng.randint(0, 25)] + [rng.choice("pqr\u00e4") for _ in range(rng.randint(0, 3))]
        rows.append((d, rng.choice([" ", "-", "  !"]).join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    rows += [(None, items[0][1]), (500, None), (501, ""), rows[0], (502, "z " * 4000 + items[1][1])]
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = winnow.with_overlap(docs, bench, window=8, slice_bytes=slice_bytes)
    got = [(r.doc_id, r.overlap.n_words, r.n, sorted(r.overlap["items"])) for r in out.withColumn("n", winnow.n_hit()).collect()]
    assert sorted(got, key=repr) == brute_overlap(rows, items, 8)
    assert out.columns == docs.columns


def test_overlap_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.with_overlap(docs, none).select(winnow.n_hit(), winnow.contaminated()).first()[:] == (0, False)
    assert winnow.with_overlap(docs.limit(0), none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=13, max_size=13), st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_every_shared_window_keeps_a_common_gram(shared, left, right, other):
    def kept(words):
        h = (np.array(words, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return set(winnow.kept_grams(h, np.zeros(len(h), np.int64), 5, 9)[1].tolist())

    assert kept(left + shared + right) & kept(other + shared)
