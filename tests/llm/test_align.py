"""Token alignment against a brute-force version that walks bytes and counts pairs in a dictionary."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conform.llm import align, catalog, pieces, queries  # noqa: F401
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "the", " the", "ing", "\n", "\t", "\r\n", "é", "☃", "😀", "<s>", "<|endoftext|>", "<0x41>", "中文", "́", ".", "...", "'s", "123", "\x1c", "\x85", "\xa0", "​", "한국", "Word", "x" * 60]


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libs, text):
    """Ids and bytes of both sides; nothing where they do not spell the same."""
    a, b = libs
    letters = {}
    rest = 0
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + rest)] = byte
            rest += 1
    if not text:
        return [], []
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])


def brute(libs, texts):
    rows, counts = [], Counter()
    for text in texts:
        left, right = tokens(libs, text)
        ends_a, ends_b = (list(np.cumsum([len(x) for _, x in side])) for side in (left, right))
        groups, links, i, j = [], [], 0, 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            a, b = [], []
            while i < len(left) and ends_a[i] <= stop:
                a.append(left[i][0])
                i += 1
            while j < len(right) and ends_b[j] <= stop:
                b.append(right[j][0])
                j += 1
            groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        for (x, _), e in zip(left, ends_a):
            links += [(x, y) for (y, _), f in zip(right, ends_b) if e == f]
        counts.update(links)
        rows.append((len(left), len(right), groups, links))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", len(links),
             sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links)) for n_a, n_b, groups, links in rows]


def rows_of(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in df.collect())


def test_query_equals_brute_force(spark, libs, tmp_path, monkeypatch):
    monkeypatch.setattr(align, "STEP", 300)
    monkeypatch.setattr(align, "BLOCK", 900)
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(300)] + [None, "", " ", "▁ marked", "same text", "same text", "word " * 3000]
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(texts))]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert set(got.columns) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert rows_of(got) == sorted((str(i), *r) for i, r in zip(ids, brute(libs, texts), strict=True))


def test_query_on_given_documents(spark, libs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = catalog.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert rows_of(got) == sorted((str(d.doc_id), *r) for d, r in zip(docs, brute(libs, [d.text for d in docs]), strict=True))


def test_both_libraries_give_one_answer(libs):
    a, _ = libs
    own = align.byte_level(open(A).read())
    rng = random.Random(5)
    texts = [" " + "".join(rng.choices(PARTS, k=rng.randint(0, 20))) for _ in range(3000)]
    plain = [" " + "".join(rng.choices(["a", " ", "the", "'s", "é", "12", "\n", "\t", "-", "Ÿ", "中", "Ж", "…", "  "], k=rng.randint(0, 20))) for _ in range(3000)]
    for text in texts + plain:
        ids = own.encode(text)
        assert ids.tolist() == a.encode(text, add_special_tokens=False).ids, text


def test_coalesce_takes_any_intervals():
    rng = random.Random(6)
    for _ in range(200):
        spans = [(s, s + rng.randint(1, 4)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, 12)))]
        group = align.coalesce(np.array([s for s, _ in spans], int), np.array([e for _, e in spans], int))
        covered = {p for s, e in spans for p in range(s, e - 1)}  # the seams inside spans
        want = {}
        for i, (s, _) in enumerate(spans):
            want[i] = s - sum(1 for k in range(s) if k in covered and all(x in covered for x in range(k, s)))
        for i in range(len(spans)):
            for j in range(len(spans)):
                assert (group[i] == group[j]) == (want[i] == want[j])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "x")], "alignment long, text string, n_a long, _block string")
    got = align.with_alignment(docs, A, B)
    assert got.columns == ["text", "n_a", "_block", "alignment"] and got.first().alignment.n_groups == 2
    named = align.with_links(docs.limit(0), A, B, "n_a", F.col("alignment.groups"))
    assert named.columns == ["n_a", "groups", "n_links", "n_best", "count_sum"] and named.count() == 0


def test_long_word_and_long_text(spark, libs):
    own = align.load(open(A).read(), open(B, "rb").read())
    for text in ("ab" * 100_000, "some words here " * 100_000):
        n_a, n_b, n_groups, groups, links = next(own.align([text]))
        assert n_a == len(libs[0].encode(" " + text, add_special_tokens=False).ids) and n_b == len(libs[1].encode(text))
        assert groups.count(";") + 1 == n_groups == len(links)


def test_links_of_a_block_are_summed_in_steps(monkeypatch):
    """A block's links were looked up at once, with arrays as long as the block for every step of it."""
    import tracemalloc

    rng = np.random.default_rng(1)
    sizes = [0, 3, 0, 700_000, 1, 0, 2_300_000, 5, 0]
    off = np.concatenate(([0], np.cumsum(sizes)))
    lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(rng.integers(0, 1000, off[-1])))[1:]
    want = [(len(x), int((x % 7).sum()), int((x == 5).sum())) for x in (np.asarray(v.values) for v in lists)]
    tracemalloc.start()
    got = align.sums_by_row(lists, lambda v: (v % 7, v == 5), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(int(a), int(b)) for a, b in zip(*got, strict=True)] == [w[1:] for w in want]
    assert peak < 16 << 20 < 8 * off[-1]
    monkeypatch.setattr(align, "LINKS", 1)
    few = pa.array([[1, 2], [], [9]], pa.list_(pa.int64()))
    assert [list(x) for x in align.sums_by_row(few, lambda v: (v,), 1)] == [[3, 0, 9]]
