"""Document fingerprints that follow edit distance.

Method: all texts take the same random walk. At each step the walk writes the character under its pointer, and a shared
random bit for (step, character) says whether the pointer moves on; after an edit two walks fall into step again, so edit
distance becomes Hamming distance of what they write. A fingerprint samples ``SLOTS`` places of the walk. Slot k takes the
place with the least of k's random values among those the walk has reached, which two walks of similar length share. Banding
compares texts that agree in all slots of some band; the fingerprints of such pairs are then compared in full.

Speed: the random bits repeat after ``PERIOD`` steps and see 16 classes of characters, so the number of steps for three
characters is one table entry.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform.llm.graph import components
from conform.llm.hashing import mix, random_words
from conform.llm.ranges import ranges_of
from conform.session import stage

SLOTS, PERIOD, CLASSES = 128, 256, 16
RANGE_BYTES = 8 << 20
#: Borders of ranges that are sent to every task; more are dealt out.
BROADCAST_BORDERS = 500_000


@cache
def _walks() -> tuple[np.ndarray, list[list[int]]]:
    """Steps that one character (class, step) and three characters (classes, step) take."""
    moves = (random_words(PERIOD * CLASSES, 9) >> np.uint64(63)).reshape(CLASSES, PERIOD).astype(bool)
    moves[:, -1] |= ~moves.any(1)
    one = np.empty((CLASSES, PERIOD), np.int64)
    for c in range(CLASSES):
        twice = np.flatnonzero(np.tile(moves[c], 2))
        one[c] = twice[np.searchsorted(twice, np.arange(PERIOD))] - np.arange(PERIOD) + 1
    j = np.arange(PERIOD)
    two = one[:, None, :] + one[np.arange(CLASSES)[None, :, None], (j + one[:, None, :]) % PERIOD]
    three = two[:, :, None, :] + one[np.arange(CLASSES)[None, None, :, None], (j + two[:, :, None, :]) % PERIOD]
    return one, three.reshape(-1, PERIOD).tolist()


@cache
def _records(limit: int) -> list[list[int]]:
    """Per slot, the places below ``limit`` whose random value is less than that of all earlier places."""
    out = []
    for slot in range(SLOTS):
        at, n, places = 0, 0, []
        while at < limit:
            places.append(at)
            u = int(mix(np.array([slot * 1_000_003 + n], np.uint64) + np.uint64(77))[0] >> np.uint64(11)) + 1
            at, n = max(at + 1, ((at + 1) * (1 << 53)) // u), n + 1
        out.append(places)
    return out


@dataclass
class Walk:
    """Code points and classes of a text, and the step after each three characters."""

    points: np.ndarray
    classes: np.ndarray
    steps: list[int]


def walk(text: str, shared: Walk | None = None, same: int = 0) -> Walk:
    """Walk over ``text``; its first ``same`` characters are those of ``shared`` and are not walked again."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = (points * np.uint32(0x9E3779B1)) >> np.uint32(28)
    n = len(points) // 3
    known = min(same // 3, n)
    steps = shared.steps[:known] if shared else []
    j = steps[-1] if steps else 0
    c = classes[3 * len(steps):3 * n].reshape(-1, 3)
    table, add = _walks()[1], steps.append
    for code in (c[:, 0] * 256 + c[:, 1] * 16 + c[:, 2]).tolist():
        j += table[code][j & 255]
        add(j)
    return Walk(points, classes, steps)


def fingerprint_of(w: Walk) -> np.ndarray:
    """One 4-bit value per slot; of no characters all zero."""
    if not len(w.points):
        return np.zeros(SLOTS, np.uint8)
    one = _walks()[0]
    steps = np.array(w.steps, np.int64)
    length = int(steps[-1]) if len(steps) else 0
    for c in w.classes[3 * len(steps):].tolist():  # the last one or two characters
        length += int(one[c][length % PERIOD])
    limit = 1 << max(20, (length - 1).bit_length())
    places = np.array([p[bisect_left(p, length) - 1] for p in _records(limit)], np.int64)
    third = np.searchsorted(steps, places, "right")
    i = 3 * third
    j = np.where(third > 0, steps[third - 1], 0) if len(steps) else np.zeros(SLOTS, np.int64)
    for _ in range(3):
        then = j + one[w.classes[np.minimum(i, len(w.points) - 1)], j % PERIOD]
        go = then <= places
        i, j = i + go, np.where(go, then, j)
    written = w.points[np.minimum(i, len(w.points) - 1)].astype(np.uint64)
    return (mix((written << np.uint64(40)) ^ places.astype(np.uint64) ^ (np.arange(SLOTS, dtype=np.uint64) << np.uint64(33))) >> np.uint64(60)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray | float:
    """Share of equal slots, less what unequal places agree in by chance."""
    return np.maximum(0.0, ((a == b).mean(-1) - 1 / 16) / (1 - 1 / 16))


def as_hex(fp: np.ndarray) -> str:
    return (fp[::2] << 4 | fp[1::2]).tobytes().hex()


def _descending(table: pa.Table) -> pa.Table:
    return table.take(pa.compute.sort_indices(table, [("_id", "descending"), ("_text", "descending")], null_placement="at_end"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in one pass over the texts.

    The edited text of a document has its last floor(n / 2) code points replaced by the first as many (or all) of the next
    document in descending order of ids; after the last comes the first. Result per row: the id, ``n_chars``, ``edited_text``,
    ``fingerprint``, ``edited_fingerprint`` (hexadecimal), ``near_edited`` and ``near_next``: likeness (0 to 1) of the
    fingerprint to the edited text's and to the next document's.

    Null text is empty: zero fingerprint, like any other empty text. A null id comes after all others; rows that share an id
    follow each other by descending text. A single row is its own next. Other columns are not read; no rows give no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ranges = ranges_of(base, "_id", F.octet_length("_text").cast("long"), RANGE_BYTES)
    ranged = base.withColumn("_range", ranges.number(F.col("_id")))
    # the largest document of each range is lent to the next range above, that of the highest one to the lowest
    tops = stage(ranged.groupBy("_range").agg(F.max("_id").alias("_top")), "tops")
    low = F.min("_range").over(W.partitionBy())
    lent = tops.select(F.col("_range").alias("_r"), "_top", F.coalesce(F.lead("_range").over(W.orderBy("_range")), low).alias("_above"))
    on = (F.col("_range") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_top"))
    joined = ranged.join(F.broadcast(lent) if ranges.count <= BROADCAST_BORDERS else lent, on, "left")
    own = F.struct(F.col("_range").alias("_to"), F.lit(False).alias("_lent"))
    other = F.struct(F.col("_above").alias("_to"), F.lit(True).alias("_lent"))
    dealt = joined.select("_id", "_text", F.explode(F.when(F.col("_above").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("_x")).select("_id", "_text", "_x.*")

    def embed(table: pa.Table) -> pa.Table:
        mine = _descending(table.filter(pa.compute.invert(table["_lent"])))
        guest = _descending(table.filter(table["_lent"]))["_text"][0].as_py()
        n = mine.num_rows
        rows = {"n_chars": [], "edited_text": [], "fingerprint": [], "edited_fingerprint": [], "near_edited": [], "near_next": []}
        text = mine["_text"][0].as_py()
        w = walk(text)
        fp = fingerprint_of(w)
        for i in range(n):
            after = mine["_text"][i + 1].as_py() if i + 1 < n else guest
            same = len(text) - len(text) // 2
            edited = text[:same] + after[:len(text) // 2]
            efp = fingerprint_of(walk(edited, w, same))
            w = walk(after)
            next_fp = fingerprint_of(w)
            for name, value in zip(rows, (len(text), edited, as_hex(fp), as_hex(efp), float(likeness(fp, efp)), float(likeness(fp, next_fp))), strict=True):
                rows[name].append(value)
            text, fp = after, next_fp
        return pa.table({id_col: mine["_id"], **rows})

    return dealt.groupBy("_to").applyInArrow(embed, f"`{id_col}` {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Sampled places per band, and distinct fingerprints under one band key that one task compares.
BAND, HOT = 6, 4096


def _unite(up: dict[int, int], a: int, b: int) -> None:
    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    a, b = root(a), root(b)
    up[max(a, b)] = min(a, b)


def _forest(hexes: list[str], least: float) -> list[tuple[str, str]]:
    """Links that span the classes of fingerprints with a likeness of ``least`` or more, compared in blocks."""
    x = np.frombuffer(bytes.fromhex("".join(hexes)), np.uint8).reshape(len(hexes), -1)
    x = np.stack([x >> 4, x & 15], 2).reshape(len(hexes), -1)
    up: dict[int, int] = {}
    step = max(1, (16 << 20) // x.size)
    for i in range(0, len(x), step):
        near = likeness(x[i:i + step, None], x[None]) >= least
        for a, b in zip(*np.nonzero(near), strict=True):
            if i + a < b:
                _unite(up, int(i + a), int(b))
    out = []
    for i in up:
        r = i
        while up[r] != r:
            r = up[r]
        if r != i:
            out.append((hexes[i], hexes[r]))
    return out


def links(fingerprints: DataFrame, least: float = 0.8, hot: int = HOT) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints (column ``fingerprint``) that span their classes of likeness ``least``.

    Only fingerprints that agree in all ``BAND`` sampled places of some band meet; these are verified in full. At 0.8 a pair is
    missed with a chance of about 0.002. A key with more than ``hot`` fingerprints is dealt out in tiles, so none is dropped.
    Null is left out.
    """
    n = SLOTS // BAND
    keys = F.array(*[F.concat(F.lit(f"{b}:"), F.substring("fingerprint", 1 + b * BAND, BAND)) for b in range(n)])
    keyed = fingerprints.filter("fingerprint is not null").select("fingerprint", F.explode(keys).alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    sizes = stage(sizes.select("_key", F.ceil(F.col("_n") / hot).cast("int").alias("_blocks")), "bands")
    block = F.pmod(F.xxhash64("fingerprint"), F.col("_blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda other: F.least(block, other) * F.col("_blocks") + F.greatest(block, other))
    dealt = keyed.join(sizes, "_key").select("fingerprint", "_key", F.explode(tiles).alias("_tile"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, pairs = None, [], []
        for batch in batches:
            for k, t, f in zip(batch["_key"].to_pylist(), batch["_tile"].to_pylist(), batch["fingerprint"].to_pylist(), strict=True):
                if (k, t) != key:
                    pairs += _forest(group, least) if len(group) > 1 else []
                    key, group = (k, t), []
                group.append(f)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["a", "b"])
            pairs = []
        pairs = _forest(group, least) if len(group) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["a", "b"])

    return dealt.repartition("_key", "_tile").sortWithinPartitions("_key", "_tile").mapInArrow(link, "a string, b string").distinct()


def near_copies(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``fingerprint`` and ``component_id`` (smallest id reachable over links) of every document.

    Equal fingerprints are linked without a comparison. Null and empty texts share the zero fingerprint. A null id is never the
    smallest; a class without ids has a null ``component_id``. Repeated rows each give a row; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    @F.arrow_udf("string")
    def embed(texts: pa.Array) -> pa.Array:
        return pa.array([as_hex(fingerprint_of(walk(t.as_py() or ""))) for t in texts], pa.string())

    each = stage(docs.select(F.col(id_col).cast(kind).alias("_id"), embed(F.col(text_col)).alias("fingerprint")), "embedded")
    known = stage(each.groupBy("fingerprint").agg(F.min("_id").alias("_least")), "known")
    linked = stage(components(links(known.select("fingerprint"), least)), "classes").withColumnRenamed("node", "fingerprint")
    roots = known.join(linked, "fingerprint").groupBy("root").agg(F.min("_least").alias("_root"))
    named = stage(known.join(linked.join(roots, "root"), "fingerprint", "left").select("fingerprint", F.coalesce("_root", "_least").alias("component_id")), "named")
    return each.join(named, "fingerprint").select(F.col("_id").alias(id_col), "fingerprint", "component_id")
