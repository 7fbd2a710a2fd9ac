"""Find test passages in training text by winnowed word k-grams.

Method: of every ``gap`` consecutive k-gram hashes the smallest is kept, in test items and documents alike. With
gap = window - k + 1 every shared span of ``window`` words holds a kept k-gram on both sides, so matching the kept ones misses
no span. Each match is then extended: the (at most gap) windows around it are tested whole against the item windows.

The item side meets the documents as a hash table in each task. Its size is checked: test items beyond ``slice_bytes`` of text
are handled slice after slice, with the hits so far carried along in a stored table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.llm.hashing import ALNUM, LOWER, Words, blocks, runs, windows, words_of
from conform.session import stage

GRAM = 5
#: Text of the test items that one task holds as a hash table.
SLICE_BYTES = 64 << 20


def _sliding(x: np.ndarray, n: int, pick: Callable) -> np.ndarray:
    """Extreme of every ``n`` consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def kept_grams(hashes: np.ndarray, doc: np.ndarray, k: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of the k-grams that are the smallest of some ``gap`` consecutive ones of a text.

    Ties are all kept. A text with fewer k-grams than ``gap`` counts as one stretch.
    """
    at, value = windows(hashes, doc, k)
    if not len(at):
        return at, value
    # pad each text with the largest value so that no stretch crosses texts and short ones count
    first = np.flatnonzero(np.concatenate(([True], doc[at][1:] != doc[at][:-1])))
    shift = np.zeros(len(at), np.int64)
    shift[first] = gap
    place = np.arange(len(at)) + np.cumsum(shift)
    padded = np.full(place[-1] + gap + 1, np.iinfo(np.uint64).max, np.uint64)
    padded[place] = value
    least = _sliding(padded, gap, np.minimum)
    best = _sliding(least, gap, np.maximum)
    keep = best[place - gap + 1] == value
    return at[keep], value[keep]


@dataclass
class Items:
    """Test items as sorted hash tables: kept k-grams, and per window length the windows with their items."""

    ids: pa.Array
    window: int
    gram: int
    kept: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _table(hashes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs = np.unique(np.rec.fromarrays([hashes, items], names="h,i"))
    values, first = np.unique(pairs.h, return_index=True)
    return values, np.append(first, len(pairs)), np.asarray(pairs.i)


def index_items(ids: pa.Array, texts: pa.Array, window: int = 13, gram: int = GRAM) -> Items:
    w = words_of(texts, ALNUM, LOWER)
    n = np.bincount(w.doc, minlength=w.n_docs)
    tables = {}
    long = n[w.doc] >= window
    for length in [window, *sorted({int(x) for x in n if 0 < x < window})]:
        own = long if length == window else n[w.doc] == length
        at, value = windows(w.hash[own], w.doc[own], length)
        if len(at):
            tables[length] = _table(value, w.doc[own][at])
    _, kept = kept_grams(w.hash[long], w.doc[long], gram, window - gram + 1)
    return Items(ids, window, gram, np.unique(kept), tables)


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` occur in the table, and where."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    hit = np.flatnonzero(sorted_values[at] == wanted)
    return hit, at[hit]


def match(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word is hit, text of each text-item pair, item of each pair)."""
    steps = np.zeros(len(w.hash) + 1, np.int64)
    docs, found = [], []
    for length, (values, first, members) in items.tables.items():
        if length == items.window:
            gap = length - items.gram + 1
            at, value = kept_grams(w.hash, w.doc, items.gram, gap)
            near, _ = _find(items.kept, value)
            start = np.unique((at[near][:, None] - np.arange(gap)).ravel())
            start = start[(start >= 0) & (start + length <= len(w.hash))]
            start = start[w.doc[start] == w.doc[start + length - 1]]
            rows = np.unique((start[:, None] + np.arange(length)).ravel())  # only the words around the matches
            here = np.searchsorted(rows, start)
            group = np.concatenate(([0], np.cumsum(np.diff(rows) > 1))) if len(rows) else rows
            all_at, all_value = windows(w.hash[rows], group, length)
            value = all_value[np.searchsorted(all_at, here)]
        else:
            start, value = windows(w.hash, w.doc, length)
        hit, where = _find(values, value)
        np.add.at(steps, start[hit], 1)
        np.add.at(steps, start[hit] + length, -1)
        size = first[where + 1] - first[where]
        docs.append(np.repeat(w.doc[start[hit]], size))
        found.append(members[np.repeat(first[where], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)])
    pairs = np.unique(np.rec.fromarrays([np.concatenate([*docs, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])], names="d,i"))
    return np.cumsum(steps[:-1]) > 0, np.asarray(pairs.d), np.asarray(pairs.i)


def _scanner(items: Items, id_type: str) -> Callable[[Column, Column], Column]:
    kind = f"struct<n_words: long, hits: array<struct<start: long, end: long>>, items: array<{id_type}>>"

    def scan_block(texts: pa.Array, before: pa.Array) -> pa.StructArray:
        w = words_of(texts, ALNUM, LOWER)
        n_words = np.bincount(w.doc, minlength=w.n_docs)
        since = np.concatenate(([0], np.cumsum(n_words)))
        hit, pair_doc, pair_item = match(w, items)
        old_hits, old_items = before.field("hits"), before.field("items")
        if len(old_hits.flatten()):
            doc = np.repeat(np.arange(len(before)), np.diff(old_hits.offsets))
            flat = old_hits.flatten()
            for d, s, e in zip(doc, flat.field("start").to_numpy(), flat.field("end").to_numpy(), strict=True):
                hit[since[d] + s:since[d] + e] = True
        start, end = runs(hit, w.doc)
        cut = np.searchsorted(start, since)
        spans = pa.StructArray.from_arrays([pa.array(start - since[w.doc[start]], pa.int64()), pa.array(end - since[w.doc[end - 1]], pa.int64())], ["start", "end"])
        new = items.ids.take(pa.array(pair_item, pa.int64()))
        doc = np.concatenate((np.repeat(np.arange(len(before)), np.diff(old_items.offsets)), pair_doc))
        order = np.argsort(doc, kind="stable")
        ids = pa.concat_arrays([old_items.flatten(), new]).take(pa.array(order))
        return pa.StructArray.from_arrays([
            pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(w.n_docs + 1)), pa.int32()), ids)], ["n_words", "hits", "items"])

    @F.arrow_udf(kind)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        parts = [scan_block(texts.slice(i, j - i), pa.concat_arrays([before.slice(i, j - i)])) for i, j in blocks(texts)]
        return pa.concat_arrays(parts) if parts else before

    return scan


def with_overlap(docs: DataFrame, items: DataFrame, window: int = 13, text_col: str = "text", id_col: str = "item_id",
                 item_text_col: str = "text", slice_bytes: int = SLICE_BYTES, out: str = "overlap") -> DataFrame:
    """Add a struct column: ``n_words``, ``hits`` (maximal hit intervals of word numbers), ``items`` (ids with a hit).

    A-Z count as a-z; words are runs of digits, letters a-z and non-ASCII characters. A window is ``window`` consecutive words
    of an item; an item with fewer words (but not none) is one window. A word inside any occurrence of a window is hit.

    Null or empty text: no words, no hits. Null item text: no windows. Items with one text or one id: each counts (an id once
    per row of the items table that occurs). Rows of ``docs`` are independent, so repeated rows get equal results. ``docs``
    keeps all its columns; one named like ``out`` is replaced. Empty items: no hits. Hashes have 64 bits.
    """
    own = items.select(F.col(id_col).alias("_item"), F.col(item_text_col).alias("_text"))
    kind = dict(own.dtypes)["_item"]
    total = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_slices = max(1, -(-total // slice_bytes))
    df = docs.withColumn(out, F.expr(f"named_struct('n_words', 0L, 'hits', cast(array() as array<struct<start: bigint, end: bigint>>), 'items', cast(array() as array<{kind}>))"))
    for s in range(n_slices):
        got = own.filter(F.pmod(F.xxhash64("_item"), F.lit(n_slices)) == s).toArrow()
        scan = _scanner(index_items(got["_item"].combine_chunks(), got["_text"].combine_chunks(), window), kind)
        df = (df if s == 0 else stage(df, "overlap")).withColumn(out, scan(F.col(text_col), F.col(out)))
    return df


def contaminated(overlap: str = "overlap", one_in: int = 20) -> Column:
    """True where hit words make up at least one in ``one_in`` of the words."""
    hit = n_hit(overlap)
    return (hit > 0) & (hit * one_in >= F.col(f"{overlap}.n_words"))


def n_hit(overlap: str = "overlap") -> Column:
    return F.aggregate(f"{overlap}.hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
