"""Near copies, components, addresses, mixing and archives against brute force, and their edge cases."""

import collections
import hashlib
import random
import uuid

import numpy as np
import pytest
import xxhash
import zstandard

from conform.llm import graph, mixing, simhash, urls, warc
from conform.session import shared_dir


def brute_classes(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    edges = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    want = brute_classes(600, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert graph.components(edges.limit(0)).count() == 0


def reference_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies_match_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(90)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["new", "\u00c9t\u00e9"])
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "ONE two"), (903, "one TWO"), (None, rows[0][1]), (None, "only here and nowhere else at all"), rows[3], (904, "q " * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_copies(docs).collect()), key=repr)
    fps = [reference_fingerprint(t) for _, t in rows]
    root = brute_classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = collections.defaultdict(list)
    for (d, _), r in zip(rows, root, strict=True):
        least[r].append(d)
    want = sorted(((d, int(np.array([f], np.uint64).view(np.int64)[0]), min((x for x in least[r] if x is not None), default=None)) for (d, _), f, r in zip(rows, fps, root, strict=True)), key=repr)
    assert got == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((min((x for x in v if x is not None), default=None) for v in least.values()), key=repr)
    assert simhash.near_copies(docs.limit(0)).count() == simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [4096, 60])
def test_links_of_dense_groups_lose_nothing(spark, hot):
    rng = np.random.default_rng(7)
    fps = set()
    for centre in rng.integers(0, 2**64, 3, dtype=np.uint64):
        for _ in range(250):
            v = int(centre)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(b)
            fps.add(v)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), hot=hot)
    at = {v: i for i, v in enumerate(signed)}
    pairs = [(at[r.a], at[r.b]) for r in edges.collect()]
    want = brute_classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert brute_classes(len(fps), pairs) == want
    assert all((fps[a] ^ fps[b]).bit_count() <= 24 for a, b in pairs)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_addresses(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(1, "http://A.Example.com/en/1", "example.com/en/", "block"), (2, "http://www.example.com/en/?x", "www.example.com/en/", "allow"),
            (3, "https://b.net/es/q#f", "net/es/", "block"), (4, "https://b.net/esx", None, "allow"), (5, None, None, "allow"), (6, "b.net/es/", None, "allow"),
            (7, "x://notexample.com/en/", "com/", "allow"), (8, "http://example.com?en", None, "allow"), (9, "http://alias.org/a?1", None, "block"),
            (10, "http://second.org/b", None, "block"), (11, "http://mixed.org/", None, "allow"), (None, "http://b.net/fr/", "net/fr/", "block"), (12, "", None, "allow"),
            (13, "http://c.example.com/en/", "example.com/en/", "block"), (13, "http://c.example.com/en/", "example.com/en/", "block")]
    links = spark.createDataFrame([("alias.org/a?1", "b.net/es/q"), ("second.org/b", "alias.org/a?1"), ("mixed.org/", "unseen.net/fr/1"), ("mixed.org/", "ok.com/"),
                                   (None, "x"), ("www.example.com/en/", "b.net/es/q")], "a string, b string")
    links = links.filter("a is null or a <> 'www.example.com/en/'")
    pages = spark.createDataFrame([(i, u, "key", 1) for i, u, _, _ in rows], "page_id long, url string, rule string, root int")
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judge(pages, rules, links).collect()]
    assert sorted(got, key=repr) == sorted([(i, rule, v) for i, _, rule, v in rows], key=repr)
    assert urls.judge(pages.limit(0), rules, links.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0), links).collect()} == {"allow"}


def test_an_allowed_alias_is_never_blocked_through_its_class(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://www.example.com/en/"), (2, "http://x.org/")], "page_id long, url string")
    links = spark.createDataFrame([("www.example.com/en/", "x.org/"), ("x.org/", "b.net/es/")], "a string, b string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules, links).collect()} == {1: "allow", 2: "allow"}


def test_links_in_html(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1?x", '<LINK href="https://B.org/c" rel=canonical><link rel="stylesheet" href="http://no.org/">'),
                                   (2, "http://a.org/2", "<meta http-equiv='refresh' content='0; url=http://c.org/d#e'>"), (3, "http://a.org/3", '<link rel="canonical" href="/rel">'),
                                   (4, None, '<link rel="canonical" href="http://b.org/">'), (5, "http://a.org/5", None)], "page_id long, url string, html string")
    assert sorted(map(tuple, urls.page_links(pages).collect())) == [("a.org/1?x", "b.org/c"), ("a.org/2", "c.org/d"), ("a.org/3", "a.org/rel")]


def test_mixture_keeps_within_a_block(spark):
    rng = random.Random(8)
    weights = {"big": 7, "mid": 3, "small": 1}
    rows = [(i, rng.choice(["big"] * 12 + ["mid"] * 5 + ["small"] * 2 + ["rare", None]), None, i, "x") for i in range(600)]
    rows += [(None, "big", "t", 1, "y"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _range int, stream string")
    out = mixing.mix(docs, weights, other=2, block_rows=4).collect()
    assert len(out) == len(rows)
    slots, total = collections.defaultdict(set), 13
    for r in out:
        slots[r.slot].add((r.stream, r.block))
        assert r.release <= r.slot < r.deadline
    assert all(len(s) == 1 for s in slots.values())
    assert len({(r.slot, r.place) for r in out}) == len(rows)
    last = min(max(r.slot for r in out if r.stream == s) for s in [*weights, None])
    given = collections.Counter()
    for t in range(last + 1):
        given[next(iter(slots[t]))[0]] += 1
        for s, w in {**weights, None: 2}.items():
            assert abs(given[s] - (t + 1) * w / total) < 1
    assert mixing.mix(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


def test_numbering_does_not_depend_on_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i * 3, f"s{i % 3}") for i in range(200)], "doc_id long, source string")
    want = sorted(map(repr, mixing.mix(docs, {"s0": 2}).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 9)
    assert sorted(map(repr, mixing.mix(docs, {"s0": 2}).collect())) == want


def test_plan_is_schedulable_for_any_weights():
    for w in ({"a": 1}, {"a": 5, "b": 5}, {"a": 97, "b": 2, "c": 1}, {f"s{i}": i + 1 for i in range(30)}):
        total = sum(w.values())
        for s, slots in mixing.slot_plan(w).items():
            assert all(i * total // w[s] <= t < -(-(i + 1) * total // w[s]) for i, t in enumerate(slots))


def archive(spark, pages, **more):
    return warc.write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", **more)


def test_archive_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 700)
    html = ["<p>one</p>", "", None, "caf\u00e9 \u4e16" * 40, "<p>one</p>", "x\r\n\r\ny" * 300, "", "<p>one</p>"]
    rows = [(i, f"http://a/{i}", h, "k", "b") for i, h in enumerate(html)] + [(None, None, "<p>one</p>", "k", "b"), (7, "http://a/7\nb", "<p>one</p>", "k", "b"), (9, None, "z" * 70_000, "k", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _sha string, bundle string").repartition(2)
    stored = archive(spark, pages)
    got = warc.read(stored).collect()
    keeper = {"<p>one</p>": "7", "": "6"}
    want = []
    for i, url, h, *_ in rows:
        h = h or ""
        rid, k = "" if i is None else str(i), keeper.get(h)
        revisit = k is not None and k != rid
        want.append((rid, "revisit" if revisit else "response", url and " ".join(url.split()), len(h.encode()), warc.digest(h.encode()), k if revisit else None, None if revisit else h.encode()))
    assert sorted(map(repr, (tuple(r[:6]) + (None if r.payload is None else bytes(r.payload),) for r in got))) == sorted(map(repr, want))
    one = warc.read(stored, only=["3"]).collect()
    assert [(r.record_id, bytes(r.payload)) for r in one] == [("3", html[3].encode())]
    warc.export(stored, str(tmp_path))
    files = sorted(tmp_path.glob("*.warc.zst"))
    assert len(files) == stored.count() > 1
    by_name = {r.bundle: r for r in stored.collect()}
    for f in files:
        data = f.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(warc.read_frame(data, x) for x in warc.frames_of(data))
        assert len(by_name[f.name.split(".")[0]].records) == whole.count(b"WARC/1.1\r\n")


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.record_id: r.record_type for r in warc.read(archive(spark, pages, least_bytes=3)).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    assert warc.read(archive(spark, pages.limit(0))).count() == 0


def test_damage_is_noticed():
    raw = warc.record("1", None, b"payload", None)
    fields = warc.parse(raw)[0]
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length"} <= set(fields) and fields["WARC-Date"] == warc.DATE
    assert warc.parse(raw)[1] == b"payload" and warc.digest(b"payload") == __import__("base64").b32encode(hashlib.sha1(b"payload").digest()).decode()
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r", b"paYload\r"))
    with pytest.raises(ValueError):
        warc.frames_of(b"\0" * 40)
