"""Language, toxicity, personal data and edit fingerprints: reference versions, held-out accuracy and edge cases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conform.llm import editembed, langid, pii, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_presence_is_the_set_of_grams():
    def brute(text):
        x = [langid.FOLD[b] for b in (text or "").encode()]
        out = set()
        for g in (1, 2, 3):
            for i in range(len(x) - g + 1):
                code = 0
                for b in x[i:i + g]:
                    code = code << 8 | int(b)
                out.add(((code + (g << 24)) * 0x9E3779B1 & 0xFFFFFFFF) >> 18)
        return out

    values = ["Bonjour été!", "", None, "a", "ab", "long " * 500]
    old, langid.STEP = langid.STEP, 100
    try:
        got = langid.presence(pa.array(values))
    finally:
        langid.STEP = old
    assert [set(np.flatnonzero(r).tolist()) for r in got] == [brute(v) for v in values]


def test_language_of_held_out_documents(spark, docs):
    rows = langid.identify(docs, docs.filter(langid.in_training())).filter(~langid.in_training() & F.col("lang").isNotNull()).select("lang", "language").collect()
    assert np.mean([r.lang == r.language.lang for r in rows]) > 0.95
    assert all(0 <= r.language.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "123 !?", "en"), (4, "the thing and that of the other", None), (4, "the thing and that of the other", None), (None, "der und die das nicht", "x")],
                                "doc_id long, text string, lang string")
    got = langid.identify(odd, docs.filter(langid.in_training()).select("doc_id", "text", "lang")).select("text", "language").collect()
    assert [r.language.lang for r in got] == ["und", "und", "und", "en", "en", "de"] and got[0].language.score == 0
    none = langid.identify(odd, odd.limit(0)).select("language").collect()
    assert {r.language.lang for r in none} == {"und"}
    assert langid.identify(odd.limit(0), odd).count() == 0


@pytest.fixture(scope="module")
def tox(spark, docs):
    return toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))


def test_disguised_words_are_restored(tox):
    d = toxicity.Decoder(tox.lm)
    assert [d.word(w) for w in ("1d10t", "idiiiiot", "i.d.i.o.t", "$cum", "m0r0n", "that", "the.", "thnt!!", "tra5h")] == ["idiot", "idiot", "idiot", "scum", "moron", "that", "the", "thnt", "trash"]
    assert d.restore("You are an 1d10t, m o r o n.") == "you are an idiot moron." and d.restore(None) is None
    assert "idiot" in d.words("see i d i o t !")


def test_decoding_finds_the_likeliest_spelling(tox):
    d = toxicity.Decoder(tox.lm)

    def spellings(options):
        if not options:
            yield "", 0.0
            return
        for head, cost in options[0]:
            for rest, more in spellings(options[1:]):
                yield head + rest, cost + more

    def value(text, cost):
        s = [0, 0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 for c in text), 0]
        return cost + sum(float(tox.lm[s[i], s[i + 1], s[i + 2], s[i + 3]]) for i in range(len(s) - 3))

    for word in ("1d10t", "tra5h1ng", "a.bb.ccc", "0|1+"):
        best = max(spellings(list(d._options(word))), key=lambda x: value(*x))
        assert value(*best) == pytest.approx(max(value(t, c) for t, c in spellings(list(d._options(word))) if t == d.decode(word)))


def test_gram_counts(spark):
    rows = [("ab c",), (None,), ("",), ("éa",), ("abcab",)]
    got = toxicity.count_grams(spark.createDataFrame(rows, "text string").repartition(3), "text")
    want = collections.Counter()
    for (t,) in rows:
        s = toxicity.SYMBOL[np.frombuffer((t or "").encode(), np.uint8)]
        want.update(tuple(s[i:i + 4]) for i in range(len(s) - 3))
    grid = got.reshape((28,) * 4)
    assert got.sum() == sum(want.values()) and all(grid[k] == n for k, n in want.items())
    assert np.allclose(np.exp(toxicity.model_of(got)).sum(-1), 1, atol=1e-3)


def test_toxicity_of_held_out_documents(spark, docs, tox):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = docs.select("doc_id", "lang", toxicity.score(F.col("text"), tox).alias("s")).join(labels, "doc_id").filter("lang = 'en'").collect()
    assert all((r.s.score >= 0.5) for r in rows if r.toxic == 1 and r.s.words)
    assert np.mean([(r.s.score >= 0.5) == (r.toxic == 1) for r in rows]) > 0.95


def test_toxicity_edge_cases(spark, docs, tox):
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "!!!"), (3, "scum " + "x" * 50_000), (3, "$cum")], "doc_id long, text string")
    got = [r.s.score for r in odd.select(toxicity.score(F.col("text"), tox).alias("s")).collect()]
    assert got[0] == got[1] == got[2] < 0.5 <= got[3] and got[4] >= 0.5
    none = toxicity.fit(odd, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.s.score for r in odd.select(toxicity.score(F.col("text"), none).alias("s")).collect()} == {0.0}
    assert toxicity.fit(odd.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).weight == {}


def reference_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.b1-+ 05(%é٣", max_size=45))
def test_strict_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == reference_spans(text)


def test_strict_spans_of_documents(docs):
    for r in docs.select("text").collect():
        assert pii.base_spans(r.text) == reference_spans(r.text)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) for a in (0.95, 0.85, 0.7, 0.6)], 1).astype(float)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    rate, true = pii.reliabilities(patterns, counts.astype(float), 200)
    assert np.all(np.diff(rate[1]) < 0) and abs(rate[1][0] - 0.95) < 0.05
    by = {tuple(p): t for p, t in zip(patterns, true, strict=True)}
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.93


def test_personal_data_edge_cases(spark, docs):
    rows = [(1, None, "a"), (2, "", "b"), (3, "mail joe@x.org or 4111 1111 1111 1111", "c"), (3, "mail joe@x.org or 4111 1111 1111 1111", "c"), (4, "\U0001f600 10.0.0.1 and 999.1.1.1", "d"),
            (5, "contact jane (at) host (dot) com today", "e"), (6, "word " * 20_000 + "+1 (555) 555-0100", "f")]
    df = docs.select("doc_id", "text", F.lit("z").alias("personal")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, personal string"))
    out = pii.find_personal(df)
    assert out.columns == df.columns
    got = {r.text: r for r in out.withColumn("clean", pii.redact(F.col("text"), pii.fit(df))).filter(F.col("doc_id") < 7).collect()}
    assert got[None].personal.base == [] and got[None].clean is None and got[""].clean == ""
    assert got[rows[2][1]].clean == "mail [EMAIL] or [CARD]"
    assert [tuple(s) for s in got[rows[4][1]].personal.base] == [("ip", 2, 10)]
    assert got[rows[5][1]].personal.base == [] and [s.kind for s in got[rows[5][1]].personal["all"]] == ["email"]
    assert got[rows[6][1]].clean.endswith("[PHONE]")
    assert pii.find_personal(df.limit(0)).count() == 0


def slow_walk(text):
    """The walk step by step: pointer after each step, from the single-character table's definition of a move."""
    moves = (editembed.random_words(editembed.PERIOD * editembed.CLASSES, 9) >> np.uint64(63)).reshape(editembed.CLASSES, editembed.PERIOD)
    at, written, j = 0, [], 0
    while at < len(text):
        written.append(at)
        c = (ord(text[at]) * 0x9E3779B1 & 0xFFFFFFFF) >> 28
        at += int(moves[c, j % editembed.PERIOD])
        j += 1
    return written


@pytest.mark.parametrize("text", ["a", "ab", "abc", "hello world, été \U0001f600!", "the quick brown fox " * 30])
def test_walk_is_that_of_single_steps(text):
    w = editembed.walk(text)
    written = slow_walk(text)
    assert [written.index(3 * (i + 1)) if 3 * (i + 1) < len(text) else len(written) for i in range(len(text) // 3)] == w.steps
    length = len(written)
    for slot, places in enumerate(editembed._records(1 << 20)[:8]):
        place = max(p for p in places if p < length)
        value = editembed.mix(np.array([(ord(text[written[place]]) << 40) ^ place ^ (slot << 33)], np.uint64))[0] >> np.uint64(60)
        assert editembed.fingerprint_of(w)[slot] == value


def test_a_shared_start_is_walked_once():
    a, b = "shared start " * 9 + "one", "shared start " * 9 + "another end"
    same = 9 * 13
    assert editembed.walk(b, editembed.walk(a), same).steps == editembed.walk(b).steps


def brute_edits(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        fp, efp, nfp = (editembed.fingerprint_of(editembed.walk(x)) for x in (t, edited, after))
        out.append((i, len(t), edited, editembed.as_hex(fp), editembed.as_hex(efp), float(editembed.likeness(fp, efp)), float(editembed.likeness(fp, nfp))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [8 << 20, 300, 20])
def test_edits_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(editembed, "RANGE_BYTES", size)
    rng = random.Random(9)
    rows = [(rng.randrange(1000), "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    rows += [(None, "nobody"), (None, None), (2000, None), (2001, ""), rows[0], rows[0], (rows[1][0], "other text"), (3, "long " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _to int, fingerprint string")
    assert sorted(map(tuple, editembed.with_edits(df).collect()), key=repr) == brute_edits(rows)


def test_edits_of_few_rows(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert editembed.with_edits(one).first().edited_text == "abcabc"
    assert editembed.with_edits(one.limit(0)).count() == 0


def test_fingerprints_follow_edits(spark, docs):
    got = editembed.with_edits(docs.filter(F.length("text") > 200)).select("near_edited", "near_next").collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.99
    rng = random.Random(10)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    near = text[:1500] + "XY" + text[1500:2900] + text[2910:]
    a, b, c = (editembed.fingerprint_of(editembed.walk(t)) for t in (text, near, text[::-1]))
    assert editembed.likeness(a, a) == 1 and editembed.likeness(a, b) > 0.5 > editembed.likeness(a, c)


@pytest.mark.parametrize("hot", [4096, 8])
def test_edit_classes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(editembed.links, "__defaults__", (0.8, hot))
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij klm") for _ in range(700)) for _ in range(5)]
    rows = []
    for i in range(70):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "x", "yz"]) + t[k + rng.randint(0, 1):]
        rows.append((i, t))
    rows += [(80, None), (81, ""), (None, rows[0][1]), rows[4], (82, "alone " * 2000)]
    fps = [editembed.fingerprint_of(editembed.walk(t or "")) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if editembed.likeness(fps[i], fps[j]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    want = sorted(((d, editembed.as_hex(f), min(least[root(i)], default=None)) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=repr)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    assert sorted(map(tuple, editembed.near_copies(docs).collect()), key=repr) == want
    assert editembed.near_copies(docs.limit(0)).count() == 0
