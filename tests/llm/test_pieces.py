"""Encoding and decoding with a merge-type vocabulary against the sentencepiece library."""

import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conform.llm import catalog, pieces, queries  # noqa: F401

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "a", "b", "the", " the", "ing", "\n", "\t", "é", "☃", "😀", "<s>", "</s>", "<unk>", "<0x41>", "\0", "中文", "的", "́", "﻿", ".", "..", "1", "23",
         "​", "한국", "　", "internationalisation" * 3, "x" * 40]


@pytest.fixture(scope="module")
def loaded():
    return pieces.load(Path(PATH).read_bytes())


def test_agenda_equals_library_on_mixed_texts(loaded):
    agenda, lib = loaded
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, agenda.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(text, add_bos=True, add_eos=True), text
        assert agenda.decode(ids) == lib.decode(ids.tolist()), text


def test_decode_equals_library_on_any_ids(loaded):
    agenda, lib = loaded
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 8))]
        assert agenda.decode(np.array(ids, "<u4")) == lib.decode(ids), ids


def test_rows_and_single_agenda_join_alike(loaded):
    agenda, _ = loaded
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choices("abcdefghinorst▁é中☃\t", k=rng.randint(0, 30))) for _ in range(3000)]
    for word, got in zip(words, agenda.join_all(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == agenda.join(word)


def test_long_texts_are_whole(loaded):
    agenda, lib = loaded
    one, spaced = "ab" * 150_000, "some words of a long text, " * 120_000
    for text in (one, " " * 200_000, spaced):
        ids = next(agenda.encode([text]))
        assert np.array_equal(ids[1:-1], pieces.library_ids(lib, text)) and agenda.decode(ids) == text
    assert "".join(pieces.parts_of(spaced)) == spaced and max(map(len, pieces.parts_of(spaced))) < pieces.PART + 100


def test_memory_of_stretches_is_bounded(loaded, monkeypatch):
    agenda, lib = loaded
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    texts = [f"w{i} x{i * 7} same" for i in range(500)]
    for text, ids in zip(texts, agenda.encode(texts), strict=True):
        assert ids[1:-1].tolist() == lib.encode(text)


def test_rows_of_any_kind(spark, loaded):
    _, lib = loaded
    rows = [(1, "a text", "p"), (1, "a text", "p"), (None, None, "q"), (3, "", None), (4, "☃ \n", "r"), (5, "z" * 60_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = pieces.with_pieces(docs, PATH, out="out")
    assert got.columns == ["doc_id", "text", "pieces", "out"]
    for r in got.collect():
        assert r.out.ids == lib.encode(r.text or "", add_bos=True, add_eos=True) and r.out.decoded == (r.text or "") and r.out.agrees
    assert pieces.with_pieces(docs, PATH).columns == docs.columns
    assert pieces.with_pieces(docs.limit(0), PATH).count() == 0


def test_query_equals_library(spark, tmp_path):
    rows = [(1, "Some text, twice."), (2, None), (3, ""), (4, "▁ marks ▁"), (5, "naïve 中文 ☃☃ \u0007"), (5, "naïve 中文 ☃☃ \u0007")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    _, lib = pieces.load(Path(PATH).read_bytes())

    def want(i, text):
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest(), True

    got = catalog.QUERIES["op11_sentencepiece"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want(*r) for r in rows)


def test_query_on_the_given_table(spark):
    got = catalog.QUERIES["op11_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert got.filter(~F.col("agrees")).count() == 0 and got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_stretches_that_come_again_are_joined_once(monkeypatch):
    """All were forgotten at once when they had become many, also those that every text repeats."""
    agenda, lib = pieces.load.__wrapped__(Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    monkeypatch.setattr(pieces, "TOGETHER", 1)
    joined, join_all = [], agenda.join_all
    agenda.join_all = lambda stretches: joined.extend(stretches) or join_all(stretches)
    texts = [f"the usual words again {i}x{i} y{i}z " + "long" * 20 for i in range(200)]
    for text, ids in zip(texts, agenda.encode(texts), strict=True):
        assert ids[1:-1].tolist() == lib.encode(text) and pieces.library_agrees(lib, text, ids.tolist(), text)
        assert not pieces.library_agrees(lib, text, ids.tolist(), text + ".") and not pieces.library_agrees(lib, text + " a", ids.tolist(), text)
    assert joined.count("▁usual") == 1 and len(joined) == 4 + 400
    assert len(agenda.known) + len(agenda.older) < 200
