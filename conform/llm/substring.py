"""Remove passages that repeat anywhere in a corpus, word for word.

Method: Rabin-Karp hashes of every window of ``words`` consecutive words. Documents are dealt out by ranges of their id. A
range sends each of its distinct window hashes once, in one packed array per hash bucket; the bucket learns which of them
already occur in an earlier range and answers with one bit per hash. Back in the range, overlapping repeated windows merge
into maximal removal intervals. So a passage that a third of all documents share costs one entry per range, the answers are
tiny, and nothing but the text itself is dealt out twice.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.llm.hashing import SPACED, covered, runs, windows, words_of
from conform.llm.ranges import ranges_of

#: Bytes of text in a range of documents, and of window hashes in a bucket, that one task holds.
RANGE_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20


def _ordered(table: pa.Table) -> pa.Table:
    """Documents by id (null first); equal ids by text, so that the result does not depend on the order of arrival."""
    return table.take(pa.compute.sort_indices(table, [("_id", "ascending"), ("_text", "ascending")], null_placement="at_start"))


def _packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def remove_repeats(docs: DataFrame, words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every word covered by a window of ``words`` words that also starts earlier.

    Words stand between ASCII white space and stay as they are. "Earlier" means a smaller id, or the same document and an
    earlier start; windows are judged on the input. Result, one row per input row: the id, ``n_words``, ``n_removed``,
    ``removed`` (maximal intervals of word numbers, end exclusive) and ``kept_text`` (kept words joined by one space).

    Null text: no words. Null id: counts as smaller than any other. Rows with one id are separate documents, ordered by
    text, so of equal rows one keeps its words. Fewer words than a window: nothing is removed. Other columns of ``docs``
    are not read. An empty table gives an empty result. Windows are compared by 64-bit hashes: with n windows the chance
    of any wrong match is about n^2 / 2^65.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    ranges = ranges_of(base, "_id", size, RANGE_BYTES)
    # about one window per 5 bytes of text, 7 bytes each
    bits = max(1, math.ceil(math.log2(max(1, ranges.count * RANGE_BYTES * 1.4 / BUCKET_BYTES))))
    width = 8 - bits // 8
    shift = np.uint64(64 - bits)
    ranged = base.withColumn("_range", ranges.number(F.col("_id")))

    def send(table: pa.Table) -> pa.Table:
        w = words_of(_ordered(table)["_text"], SPACED)
        values = np.unique(windows(w.hash, w.doc, words)[1])
        cut = np.searchsorted(values >> shift, np.arange((1 << bits) + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1])
        number = table["_range"][0].as_py()
        return pa.table({"_bucket": pa.array(some, pa.int32()), "_range": pa.array(np.full(len(some), number), pa.int32()),
                         "_values": pa.array([_packed(values[cut[b]:cut[b + 1]], width) for b in some], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("_range")
        parts = [_unpacked(v.as_py(), width) for v in table["_values"]]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        seen = np.zeros(len(values), bool)
        seen[order[1:]] = ranked[1:] == ranked[:-1]
        ends = np.cumsum([len(p) for p in parts])
        flags = [np.packbits(seen[e - len(p):e]).tobytes() for p, e in zip(parts, ends, strict=True)]
        return pa.table({"_range": table["_range"], "_bucket": table["_bucket"], "_seen": pa.array(flags, pa.binary())})

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _ordered(left), right.sort_by("_bucket")
        w = words_of(left["_text"], SPACED)
        at, hashes = windows(w.hash, w.doc, words)
        values, first = np.unique(hashes, return_index=True)
        counts = np.diff(np.searchsorted(values >> shift, np.arange((1 << bits) + 1)))
        seen = [np.unpackbits(np.frombuffer(s.as_py(), np.uint8))[:counts[b.as_py()]] for b, s in zip(right["_bucket"], right["_seen"], strict=True)]
        repeated = np.ones(len(at), bool)
        repeated[first] = np.concatenate(seen).astype(bool) if seen else False
        gone = covered(at[repeated], words, len(w.hash))
        n_words = np.bincount(w.doc, minlength=w.n_docs)
        n_gone = np.bincount(w.doc[gone], minlength=w.n_docs)
        since = np.concatenate(([0], np.cumsum(n_words)))
        start, end = runs(gone, w.doc)
        spans_from = np.searchsorted(start, since)
        start, end = start - since[w.doc[start]], end - since[w.doc[end - 1]]
        kept = []
        for d, text in enumerate(left["_text"]):
            split = (text.as_py() or "").encode().split()
            kept.append(b" ".join(compress(split, ~gone[since[d]:since[d + 1]]) if n_gone[d] else split))
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
        return pa.table({
            id_col: left["_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(spans_from, pa.int32()), spans),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    sent = ranged.groupBy("_range").applyInArrow(send, "_bucket int, _range int, _values binary")
    seen = sent.groupBy("_bucket").applyInArrow(answer, "_range int, _bucket int, _seen binary")
    kind = dict(base.dtypes)["_id"]
    return ranged.groupBy("_range").cogroup(seen.groupBy("_range")).applyInArrow(
        apply, f"`{id_col}` {kind}, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string")
