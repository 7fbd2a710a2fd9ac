"""Near copies by 64-bit SimHash, found with tables of distances to reference fingerprints.

Method: every distinct fingerprint gets a row of Hamming distances to fixed pivots. Two fingerprints within ``radius`` bits
differ by at most ``radius`` in every coordinate, so a pair with a larger difference anywhere is discarded unseen; the others
are verified bit by bit. Which pairs meet at all is decided by bands: of radius + 2 bands two must be equal, so a pair meets
under one of its two-band keys. Only distinct fingerprints take part, and a key passes on a spanning forest of its links
instead of all pairs. A key above ``HOT`` fingerprints is dealt out in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.llm.graph import components
from conform.llm.hashing import random_words
from conform.session import stage

#: Reference fingerprints of the distance table.
PIVOTS = random_words(12, 8)
#: Distinct fingerprints under one key that one task compares.
HOT = 4096
#: Rows of a comparison block.
BLOCK = 256


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """SimHash of the lower-cased (A-Z) word shingles of a text, repeats included; no words: 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - shingle + 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    start = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    end = ends[-n:].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(start, end, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(h[i:i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of ``text`` as a long (the 64 bits read as a signed number)."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return simhash(text)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of linked positions; a label is the least position of its class."""
    pairs = np.unique(np.stack([label[a], label[b]]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    if not pairs.shape[1]:
        return label
    up = np.arange(len(label))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for x, y in pairs.T.tolist():
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    while not np.array_equal(up[up], up):
        up = up[up]
    return up[label]


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) that span the classes of fingerprints within ``radius`` bits."""
    order = np.argsort(np.bitwise_count(fp ^ PIVOTS[0]), kind="stable")
    fp = fp[order]
    table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    label = np.arange(len(fp))
    for i in range(0, len(fp), BLOCK):
        block = slice(i, min(i + BLOCK, len(fp)))
        reach = int(np.searchsorted(table[:, 0], table[block.stop - 1, 0] + radius, "right"))  # the first coordinate is sorted
        near = np.ones((block.stop - i, reach - i), bool)
        for p in range(table.shape[1]):
            near &= np.abs(table[block, p, None] - table[None, i:reach, p]) <= radius
        x, y = np.nonzero(near)
        x, y = x[x < y], y[x < y]
        hit = np.bitwise_count(fp[i + x] ^ fp[i + y]) <= radius
        label = _unite(label, i + x[hit], i + y[hit])
    member = np.flatnonzero(label != np.arange(len(fp)))
    return fp[member], fp[label[member]]


def _linker(radius: int):
    """Per partition sorted by key: small keys together, by distance in the order; large ones by blocks."""

    def small(fp: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
        here, d = np.arange(len(fp) - 1), 1
        while len(here := here[here + d < len(fp)]):
            here = here[key[here] == key[here + d]]
            near = here[(np.abs(table[here] - table[here + d]) <= radius).all(1)]
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= radius]
            yield fp[near + d], fp[near]
            d += 1

    def finish(fp: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        many = np.repeat(size, size)
        parts = list(small(fp[(many > 1) & (many <= 48)], key[(many > 1) & (many <= 48)]))
        parts += [_forest(fp[f:f + s], radius) for f, s in zip(first[size > 48], size[size > 48], strict=True)]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            pairs = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate((fp, batch["fp"].to_numpy().view(np.uint64)))
            key = np.concatenate((key, batch["_key"].to_numpy()))
            open_from = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            if open_from:
                yield from finish(fp[:open_from], key[:open_from])
                fp, key = fp[open_from:], key[open_from:]
        if len(key):
            yield from finish(fp, key)

    return link


def links(fingerprints: DataFrame, radius: int = 4, hot: int = HOT) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints that span every class of fingerprints within ``radius`` bits.

    ``fingerprints`` has one distinct long ``fp`` per row; null is left out. Complete for any number of fingerprints per key.
    """
    bands, low = [], 0
    for i in range(radius + 2):
        width = (64 - low) // (radius + 2 - i)
        bands.append((low, width))
        low += width
    keys = []
    for n, ((l1, w1), (l2, w2)) in enumerate(combinations(bands, 2)):
        # the number of the pair of bands, then both bands
        part = [F.shiftrightunsigned("fp", l).bitwiseAND(F.lit((1 << w) - 1)) for l, w in ((l1, w1), (l2, w2))]
        keys.append(F.lit(n << 24).cast("long").bitwiseOR(F.shiftleft(part[0], w2)).bitwiseOR(part[1]))
    keyed = fingerprints.filter("fp is not null").select("fp", F.explode(F.array(*keys)).alias("_key"))
    busy = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select("_key", F.ceil(F.col("_n") / hot).cast("int").alias("_blocks"))
    # a busy key becomes one key per pair of blocks; keys below 2^40 leave room for the pair
    busy = stage(busy, "busy")
    block = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("long")
    tile = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda other: F.least(block, other) * F.col("_blocks") + F.greatest(block, other) + 1)
    tiled = keyed.join(busy, "_key", "left").select("fp", "_key", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(tile)).alias("_tile"))
    dealt = tiled.select("fp", F.col("_key").bitwiseOR(F.shiftleft("_tile", 28)).alias("_key"))
    return dealt.repartition("_key").sortWithinPartitions("_key").mapInArrow(_linker(radius), "a long, b long")


def classes(fingerprints: DataFrame, radius: int = 4) -> DataFrame:
    """(``fp``, ``class``) of every fingerprint that is linked to another one."""
    return components(links(fingerprints, radius)).select(F.col("node").alias("fp"), F.col("root").alias("class"))


def near_copies(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and class of every document: the id, ``fp`` and ``component_id``, the smallest id reachable over links.

    Documents with one fingerprint are linked, and those whose fingerprints differ in at most ``radius`` bits. Null, empty
    and blank texts have fingerprint zero and are linked like any other. A null id takes part but is never the smallest one;
    a class without ids has a null ``component_id``. Repeated rows each give a row. Other columns are not read.
    """
    each = stage(docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    known = stage(each.groupBy("fp").agg(F.min("_id").alias("_least")), "known")
    linked = stage(classes(known.select("fp"), radius), "classes")
    least = known.join(linked, "fp").groupBy("class").agg(F.min("_least").alias("_root"))
    roots = stage(known.join(linked.join(least, "class"), "fp", "left").select("fp", F.coalesce("_root", "_least").alias("component_id")), "roots")
    return each.join(roots, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each class of ``near_copies``: that with the smallest id, with all its columns.

    Of rows that share this id, that with the smallest fingerprint stays, and of rows equal in both too any one. A class
    without ids keeps one row. The texts are stored once with their fingerprints, so these are made once.
    """
    each = stage(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    known = stage(each.groupBy("fp").agg(F.min("id").alias("least")), "known")
    linked = stage(classes(known.select("fp"), radius), "classes")
    member = known.join(linked, "fp", "left").select("fp", F.coalesce("class", "fp").alias("class"), "least")
    # the fingerprint that keeps a row: the one with the smallest id of its class
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    keeper = stage(member.groupBy("class").agg(first.alias("k")).select("k.fp", F.col("k.least").alias("keep")), "keeper")
    kept = each.join(keeper, "fp").filter(F.col("id").eqNullSafe(F.col("keep")))
    # equal ids under one fingerprint are rare: only their rows are dealt out again
    twice = stage(kept.groupBy("fp").count().filter("count > 1").select("fp"), "twice")
    if not twice.isEmpty():
        kept = kept.join(twice, "fp", "left_anti").unionByName(kept.join(twice, "fp", "left_semi").dropDuplicates(["fp"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
