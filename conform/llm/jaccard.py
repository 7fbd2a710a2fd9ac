"""Near copies by the exact Jaccard similarity of word shingles, searched with SimHash first and MinHash keys for the rest.

Method: every text becomes a set of shingle hashes, known by one hash. Distinct sets get a SimHash of these hashes, MinHash keys (48 bands of
five least values) and 240 single bits of the least values. Classes form in turns: first along the pairs that the SimHash operator links
and between every set and one leader of its keys, then again between sets and leaders of other classes until leaders find little
more; last, the sets that open keys still connect are compared group by group, each with all others at once through an index of the
group's shingles. Each pair counts only if its whole texts have the similarity. Leaders
join a large group of copies with about as many comparisons as it has members; the bits keep apart what only shares a passage; and
groups that never link, however large, never become rows of pairs.

What can be missed: a pair at similarity 0.8 shares no key with a chance of 5e-9, and differs in more than a quarter of the bits (a
tenth is expected) with a chance below 1e-10; both are far smaller for more similar pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.llm import simhash
from conform.llm.graph import components
from conform.llm.hashing import LOWER, SPACED, blocks, random_words, windows, words_of
from conform.session import discard, shared_dir, stage

BANDS, ROWS = 48, 5
XORS, TIMES = random_words(BANDS * ROWS, 21).astype(np.uint32)[:, None], random_words(BANDS * ROWS, 22).astype(np.uint32)[:, None] | np.uint32(1)
#: Shingles hashed at a time.
STEP = 2048
#: Bits of the least values, and how many may differ.
BITS = BANDS * ROWS
APART = BITS // 4
#: Bits of a SimHash within which a pair is compared first.
RADIUS = 4
#: Sets, and shingles, of a tile's side: a larger group is dealt out in tiles.
SIDE, SIDE_SHINGLES = 1024, 500_000


def shingles(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the lower-cased (A-Z) shingles of every text; a shorter text is one shingle, without words none."""
    for i, j in blocks(column):
        w = words_of(column[i:j], SPACED, LOWER)
        at, h = windows(w.hash, w.doc, words)
        cut = np.searchsorted(w.doc[at], np.arange(j - i + 1))
        first = np.searchsorted(w.doc, np.arange(j - i + 1))
        for d in range(j - i):
            if cut[d] < cut[d + 1]:
                yield np.unique(h[cut[d]:cut[d + 1]])
            else:
                own = w.hash[first[d]:first[d + 1]]
                yield np.array([xxhash.xxh64_intdigest(own.tobytes())] if len(own) else [], np.uint64)


def least_values(h: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the fixed orders."""
    least = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), STEP):
        np.minimum(least, ((short[i:i + STEP] ^ XORS) * TIMES).min(1), out=least)
    return least


def set_number(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes())


def sketch(text: Column, words: int) -> Column:
    """``set`` (a hash of the shingle set), ``n`` (its size), ``fp`` (its SimHash), ``bits`` (four numbers) and ``bands`` of a text."""

    @F.arrow_udf("set long, n long, fp long, bits array<long>, bands array<long>")
    def sketched(texts: pa.Array) -> pa.Array:
        sets, sizes, prints, bits, bands = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h in shingles(texts, words):
            sets.append(set_number(h))
            sizes.append(len(h))
            ones = sum((np.unpackbits(h[i:i + STEP].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64) for i in range(0, len(h), STEP)), np.zeros(64, np.int64))
            prints.append(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])
            least = least_values(h)
            bits.append(np.packbits(np.pad(least >> np.uint32(9) & np.uint32(1), (0, 256 - BITS)).astype(np.uint8)).view(np.int64))
            bands.append(np.array([xxhash.xxh64_intdigest(least[b * ROWS:(b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * k, pa.int32()), pa.array(np.concatenate(x))) for x, k in ((bits, 4), (bands, BANDS))]
        return pa.StructArray.from_arrays([pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), *lists], ["set", "n", "fp", "bits", "bands"])

    return sketched(text)


def set_of(text: Column, words: int) -> Column:
    """The hash of a text's shingle set."""

    @F.arrow_udf("long")
    def numbered(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([set_number(h) for h in shingles(texts, words)], np.uint64).view(np.int64))

    return numbered(text)


def _shared(words: int):
    @F.arrow_udf("long")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(shingles(a, words), shingles(b, words), strict=True)], pa.int64())

    return shared


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bits of the structs ``a`` and ``b`` leave the similarity possible."""
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(4)), F.lit(0))
    return (F.col(f"{a}.class") != F.col(f"{b}.class")) & sizes & (differ <= APART)


class _Search:
    """The working tables of one search, in a folder of its own."""

    def __init__(self, texts: DataFrame, known: DataFrame, words: int, percent: int, folder: str):
        self.words, self.percent, self.folder = words, percent, folder
        self.info = known.select("set", "n", "fp", "bits")
        keyed = known.select("set", F.explode("bands").alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
        self.keyed = stage(keyed.join(shared, "key"), "keyed", folder)
        prints = stage(self.info.groupBy("fp").agg(F.min("set").alias("lead")), "prints", folder)
        alike = self.info.join(prints, "fp").filter("set <> lead").select(F.col("set").alias("a"), F.col("lead").alias("b"))
        near = simhash.links(prints.select("fp"), RADIUS)
        for end in ("a", "b"):
            near = near.join(prints.select(F.col("fp").alias(end), F.col("lead").alias(f"lead_{end}")), end)
        self.first = stage(alike.unionByName(near.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))).distinct(), "first", folder)
        wanted = self.keyed.select("set").unionByName(self.first.select(F.explode(F.array("a", "b")).alias("set"))).distinct()
        own = texts.select(set_of(F.col("text"), words).alias("set"), "text").join(wanted, "set", "left_semi")
        self.texts = stage(own.groupBy("set").agg(F.min("text").alias("text")), "texts", folder)
        self.found, self.known_classes = None, None

    def verify(self, pairs: DataFrame) -> tuple[int, int]:
        """Add those of ``pairs`` (``a``, ``b``) to the links found that are similar enough; how many were compared and linked."""
        both = self.texts.join(pairs.withColumnRenamed("a", "set"), "set").select(F.col("set").alias("a"), F.col("text").alias("text_a"), "b")
        both = both.join(self.texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
        judged = both.select("a", "b", _shared(self.words)("text_a", "text_b").alias("both"))
        for end in ("a", "b"):
            judged = judged.join(self.info.select(F.col("set").alias(end), F.col("n").alias(f"n_{end}")), end)
        # both / (n_a + n_b - both) >= percent / 100
        similar = F.col("both") * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")) * self.percent
        judged = stage(judged.select("a", "b", similar.alias("similar")), "judged", self.folder)
        self._add(judged.filter("similar").select("a", "b"))
        return tuple(judged.agg(F.count("*"), F.count_if("similar")).first())

    def _add(self, links: DataFrame) -> None:
        if self.found is None or not links.isEmpty():
            self.found, self.known_classes = links if self.found is None else self.found.unionByName(links), None

    def classes(self) -> DataFrame:
        """Classes by the links found so far; made anew only after links were found."""
        if self.known_classes is None:
            linked = components(self.found, folder=self.folder).select(F.col("node").alias("set"), F.col("root").alias("class"))
            self.known_classes = stage(linked, "classes", self.folder)
        return self.known_classes

    def open_keys(self) -> DataFrame | None:
        """Rows (``key``, ``own``) under the keys that several classes share; None if there are none."""
        known = self.info.withColumn("class", F.col("set")) if self.found is None else self.info.join(self.classes(), "set", "left").withColumn("class", F.coalesce("class", "set"))
        labels = known.select("set", F.struct("set", "class", "n", "bits").alias("own"))
        now = self.keyed.join(labels, "set").select("key", "own")
        mixed = now.groupBy("key").agg(F.min("own.class").alias("low"), F.max("own.class").alias("high")).filter("low < high").select("key")
        now = stage(now.join(mixed, "key"), "open", self.folder)
        return None if now.isEmpty() else now

    def to_leaders(self, now: DataFrame, turn: int) -> DataFrame:
        """For each set one leader of another class: of the leaders of its keys that which leads most of them."""
        lead = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("own.set", F.lit(turn)).alias("order"), F.col("own"))).alias("l")).select("key", F.col("l.own").alias("lead"))
        met = now.join(lead, "key").filter(_may_link("own", "lead", self.percent))
        votes = met.groupBy(F.col("own.set").alias("a"), F.col("lead.set").alias("b")).agg(F.count("*").alias("votes"))
        return stage(votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b")), "pairs", self.folder)

    def whole_groups(self, now: DataFrame) -> None:
        """Add the links among all sets that keys connect, group by group: each text goes to its group's tiles, pairs are no rows."""
        edges = now.select(F.col("own.set").alias("a"), F.col("key").alias("b"))
        group = components(edges, folder=self.folder).withColumnRenamed("node", "set").withColumnRenamed("root", "group")
        sets = now.select("own.set", "own.n").distinct().join(group, "set")
        sets = stage(sets, "groups", self.folder)
        blocks = F.ceil(F.greatest(F.count("*") / SIDE, F.sum("n") / SIDE_SHINGLES))
        sizes = sets.groupBy("group").agg(blocks.alias("blocks"))
        dealt = sets.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks"))).join(self.texts, "set")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        dealt = dealt.select("group", "set", "block", "text", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
        links = dealt.groupBy("group", "low", "high").applyInArrow(_tile(self.words, self.percent), "a long, b long")
        self._add(stage(links, "links", self.folder))


def spanning(sets: list[np.ndarray], block: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Links (places) that span what is similar enough among the sets; ``across``: only pairs of different blocks count.

    Every set gathers, through an index from shingles to sets, how many shingles it shares with each later one.
    """
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(flat, return_inverse=True)
    index = np.argsort(code, kind="stable")
    holder, at = owner[index], np.concatenate(([0], np.cumsum(np.bincount(code))))
    begin = np.concatenate(([0], np.cumsum(size)))
    label, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        term = code[begin[i]:begin[i + 1]]
        length = at[term + 1] - at[term]
        place = np.arange(length.sum()) + np.repeat(at[term] - (np.cumsum(length) - length), length)
        both = np.bincount(holder[place], minlength=len(sets))
        near = np.flatnonzero(both * (100 + percent) >= (size + size[i]) * percent)
        near = near[near > i]
        for j in near[block[near] != block[i]] if across else near:
            if label[i] != label[j]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _tile(words: int, percent: int):
    def link(table: pa.Table) -> pa.Table:
        number, block = table.column("set").to_numpy(), table.column("block").to_numpy()
        across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        pairs = spanning(list(shingles(table.column("text").combine_chunks(), words)), block, across, percent)
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return pa.Table.from_arrays([pa.array(number[a]), pa.array(number[b])], ["a", "b"])

    return link


def classes(texts: DataFrame, known: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """(``set``, ``class``) of every shingle set that is linked to another one.

    ``known`` has one row per distinct set that is not empty, with the fields of ``sketch``; ``texts`` has a ``text`` for each. Working
    tables go to ``folder``.
    """
    search = _Search(texts, known, words, percent, folder)
    now, turn = search.open_keys(), 0
    search.verify(search.first if now is None else search.first.unionByName(search.to_leaders(now, turn)).distinct())
    while (now := search.open_keys()) is not None:
        turn += 1
        compared, linked = search.verify(search.to_leaders(now, turn))
        if linked * 4 < compared or not compared:  # leaders are of little more use: any later turn gives the same classes
            now = search.open_keys() if linked else now
            if now is not None:
                search.whole_groups(now)
            break
    return search.classes()


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each class of near copies: that with the smallest id, with all its columns.

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word shingles is ``percent`` or more; texts without words
    (null, empty, blank) are linked to each other. A class without ids keeps one row; of rows that share id and shingle set any one
    stays. Very long texts are whole. Columns of any name pass through. An empty table stays empty. Working tables are removed before
    the result is returned; it reads ``docs`` again and a table of one small row per class.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/copies/{uuid.uuid4().hex}"
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = stage(plain.select("id", sketch(F.col("text"), words).alias("s")).select("id", "s.*"), "sketched", folder)
    known = each.filter("n > 0").groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bits", "bands")])
    linked = classes(plain, stage(known, "known", folder), words, percent, folder)
    member = each.groupBy("set").agg(F.min("id").alias("least")).join(linked, "set", "left").select("set", F.coalesce("class", "set").alias("class"), "least")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "set"))
    keeper = stage(member.groupBy("class").agg(first.alias("k")).select("k.set", F.col("k.least").alias("keep")), "keeper", folder)
    rows = each.join(keeper, "set").filter(F.col("id").eqNullSafe(F.col("keep"))).groupBy("set").agg(F.first("keep").alias("keep"), F.count("*").alias("rows"))
    keeper = stage(rows, "keeper")
    repeated = not keeper.filter("rows > 1").isEmpty()
    discard(spark, folder)
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), set_of(F.col(text_col), words).alias("set"))
    kept = kept.join(keeper, "set").filter(F.col("id").eqNullSafe(F.col("keep")))
    if repeated:  # equal ids under one set are rare: only their rows are dealt out again
        kept = kept.filter("rows = 1").unionByName(kept.filter("rows > 1").dropDuplicates(["set"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
