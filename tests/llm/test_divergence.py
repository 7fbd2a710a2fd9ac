"""Source divergence against a brute-force version with Python's own whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from conform.llm import catalog, divergence, queries  # noqa: F401

WORDS = ["the", "The", "of", "Élan", "été", "a_b", "x1y", "naïve", "中文", "☃", "zz", "don't", " ", "Q"]


def brute(rows, least, top):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), lang or "", source or "") for t, lang, source in rows]
    out, langs = [], defaultdict(list)
    for words, lang, source in docs:
        langs[lang].append((words, source))
    for lang, items in langs.items():
        df = Counter(t for words, _ in items for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for words, source in items:
            counts[source].update(w for w in words if df[w] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])]
    return sorted(out)


def made(n=900, seed=7, sources=9):
    rng = random.Random(seed)
    rows = [(" ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(0, 12))) if rng.random() > 0.05 else None,
             rng.choice(["en", "en", "de", None, ""]), rng.choice([None, ""] + [f"s{rng.randint(0, sources)}"] * 6)) for _ in range(n)]
    return rows + [("only here", "lone", "one"), (None, "lone", "two"), ("", "single", None)]


def same(spark, rows, least, top):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(docs, least, top).collect()) == brute(rows, least, top)


def test_equals_brute_force(spark):
    same(spark, made(), 30, 5)


def test_tiles_and_parts_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 3)
    monkeypatch.setattr(divergence, "TILE", 20)
    monkeypatch.setattr(divergence, "HELD", 10)
    same(spark, made(500, 8, 14), 3, 2)


def test_a_hot_source_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "STEP", 64)
    rows = [("alpha beta " * 4000 + "x" * 5000, "en", "hot"), ("alpha", "en", "cold")] + [("alpha beta gamma", "en", "hot")] * 200
    same(spark, rows, 2, 3)


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([("a a b", "en", "s", 1, "z", 2), ("a b", "en", "t", None, None, None)], "text string, lang string, source string, n long, term string, value long")
    got = divergence.audit(docs, least=1)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute([("a a b", "en", "s"), ("a b", "en", "t")], 1, 50)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_rows_accumulate_as_dense_sums():
    rng = np.random.default_rng(9)
    for _ in range(50):
        terms, sides = 7, []
        for n in rng.integers(1, 5, 2):
            zero = rng.integers(0, 50, n)
            dense = np.where(rng.random((n, terms)) < 0.5, rng.integers(0, 90, (n, terms)), -1)
            at = np.argwhere(dense >= 0)
            sides.append((zero, at[:, 0], at[:, 1], dense[dense >= 0], np.where(dense < 0, zero[:, None], dense)))
        got = divergence.accumulate(sides[0][:4], sides[1][:4]) + terms * np.abs(sides[0][0][:, None] - sides[1][0][None])
        assert (got == np.abs(sides[0][4][:, None] - sides[1][4][None]).sum(2)).all()
