"""Near copies by the exact Jaccard similarity of word shingles, against brute force."""

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from conform.llm import jaccard, simhash
from conform.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_in(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """The least id of every class; null where a class has none."""
    sets = [words_in(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    of = {}
    for i, (d, _) in enumerate(rows):
        of.setdefault(root(i), []).append(d)
    return sorted((min((d for d in ids if d is not None), default=None) for ids in of.values()), key=repr)


def texts(seed, n):
    """Copies with one to eight words of 60 to 160 changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(60, 160))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(["new", "Été", "other", "word"])
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, " \n"), (902, "ONE two"), (903, "one  TWO"), (None, rows[0][1]), (None, "only here and nowhere else at all"), rows[3], (904, "q " * 5000)]


@pytest.mark.parametrize(("hot", "radius"), [(4096, 4), (5, 4), (4096, 0)])
def test_classes_match_brute_force(spark, monkeypatch, hot, radius):
    monkeypatch.setattr(jaccard, "SIDE", hot)
    monkeypatch.setattr(jaccard, "RADIUS", radius)
    rows = texts(3, 200)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, set string, n int, class int")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == brute(rows)
    if hot == 5:
        assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_groups_that_share_a_passage(spark, monkeypatch):
    """Many texts share a passage and stay below 0.8; a large group of copies drifts around its first text."""
    monkeypatch.setattr(jaccard, "SIDE", 40)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, base = [word() for _ in range(120)], [word() for _ in range(150)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(20, 60))] + passage + [word() for _ in range(30)])) for i in range(90)]
    for i in range(90, 240):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = word()
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in jaccard.one_of_each(docs).collect()), key=repr) == brute(rows)


def test_copies_of_an_absent_text(spark, monkeypatch):
    """Copies of a text that is not there are like each other below 0.8, save a few."""
    monkeypatch.setattr(jaccard, "SIDE", 30)
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(120)]
    rows = []
    for i in range(130):
        w = list(base)
        for _ in range(rng.choice([2, 3, 4])):
            w[rng.randrange(120)] = f"new{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id for r in jaccard.one_of_each(docs).collect()), key=repr)
    assert got == brute(rows) and 1 < len(got) < 130


def test_spanning_equals_pairwise_comparison():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.unique(rng.choice(30, rng.integers(1, 30))).astype(np.uint64) for _ in range(25)]
        block, across = rng.integers(0, 2, 25), bool(rng.integers(0, 2))
        want, got = np.arange(25), np.arange(25)
        for i, j in combinations(range(25), 2):
            if (not across or block[i] != block[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j])):
                want[want == want[j]] = want[i]
        for i, j in jaccard.spanning(sets, block, across, 60):
            got[got == got[j]] = got[i]
        assert all((want[i] == want[j]) == (got[i] == got[j]) for i, j in combinations(range(25), 2))


def test_nothing_is_left_behind(spark):
    rows = texts(6, 40)
    assert jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert not list(Path(shared_dir(spark), "copies").iterdir())


def test_pipeline_drops_copies_beyond_four_bits(spark):
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    rows = texts(4, 80)
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
    want = brute(rows)
    assert sorted((r.doc_id for r in stage(spark, docs, "").collect()), key=repr) == want
    assert sorted((r.doc_id for r in simhash.one_of_each(docs).collect()), key=repr) != want
