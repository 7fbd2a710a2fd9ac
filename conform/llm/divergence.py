"""How far the sources of a language differ in their words.

Method: Gustavson row accumulation. The smoothed shares of a language's kept terms are a sparse matrix, one row per source. A tile holds
a block of rows, a block of peers and a part of the terms; every row scatters its terms through the term-major index of the peers into
one dense accumulator, so no pair of postings is ever a row of a table. A term that a source lacks still has its smoothed share (the
zero baseline): the accumulator starts from the sum as if no term were common, which sorted shares and their running sums give
for all peers at once, and each common term corrects it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.llm.hashing import text_bytes
from conform.session import discard, shared_dir, stage

#: Bytes of a text that are split at once, and different terms that a task counts before it hands them on.
STEP, HELD = 4 << 20, 400_000
#: Sources of a tile's side, and postings that a tile holds on average.
SIDE, TILE = 256, 400_000
#: Bytes of terms, A-Z folded; every other byte parts terms.
FOLD = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, step by step."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        to = folded.find(b" ", at + STEP) if len(folded) - at > STEP else -1
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, source) to (lang, source, term, docs, n); a term may come more than once."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            terms, within = sorted(counts), docs[lang, source]
            for i in range(0, len(terms), 100_000):
                these = terms[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(these), pa.string()), pa.array([source] * len(these), pa.string()), pa.array(these, pa.binary()).cast(pa.string()),
                    pa.array([within[t] for t in these], pa.int64()), pa.array([counts[t] for t in these], pa.int64())], ["lang", "source", "term", "docs", "n"])
        n.clear()
        docs.clear()

    for batch in batches:
        data, off = text_bytes(batch.column(0))
        for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            counts, seen = n.setdefault(key, Counter()), set()
            for terms in terms_of(data[off[i]:off[i + 1]].tobytes()):
                counts.update(terms)
                seen.update(terms)
            docs.setdefault(key, Counter()).update(seen)
            if i % 64 == 63 and sum(map(len, n.values())) > HELD:
                yield from out()
    yield from out()


def share(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term in thousand-millionths, in whole numbers: 1 + floor(10^9 (count + 5) / (total + 5 terms))."""
    exact = "decimal(28,0)"
    part = F.call_function("div", (count + 5).cast(exact) * F.lit(1_000_000_000).cast("decimal(10,0)"), (total + terms * 5).cast(exact))
    return F.when(terms > 0, part.cast("long") + 1)


def postings(docs: DataFrame, least: int, folder: str) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of the terms in at least ``least`` documents of their language; ``first`` marks one row per term.

    One shuffle, by (language, term), of counts that every task has summed.
    """
    parts = docs.select("text", "lang", "source").mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    of_term = Window.partitionBy("lang", "term")
    counts = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("n_lang"),
                          (F.col("source") == F.min("source").over(of_term)).alias("first"))
    return stage(whole.filter(F.col("docs") >= least).drop("docs"), "postings", folder)


def groups_of(docs: DataFrame, kept: DataFrame, folder: str) -> DataFrame:
    """Every (lang, source) with its total, its language's total and number of terms, and the tiles of the language."""
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum(F.col("first").cast("long")).alias("terms"), F.count("*").alias("rows"))
    every = docs.select("lang", "source").distinct()
    sides = every.groupBy("lang").agg(F.ceil(F.count("*") / SIDE).alias("sides"))
    joined = every.join(sides, "lang").join(of_lang, "lang", "left").join(total, ["lang", "source"], "left")
    out = joined.na.fill(0, ["total", "total_lang", "terms", "rows"])
    out = out.withColumn("parts", F.ceil((F.col("rows") * 2 + 1) / (F.col("sides") * TILE)))
    return stage(out.withColumn("side", F.pmod(F.xxhash64("source"), "sides")).withColumn("zero", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))), "groups", folder)


def _absent(p: np.ndarray, zero: int, zeros: np.ndarray) -> np.ndarray:
    """For each peer, the sum over a row's terms of |p - peer's zero| - |own zero - peer's zero|: the row as if no peer had its terms."""
    p = np.sort(p)
    upto = np.concatenate(([0], np.cumsum(p)))
    k = np.searchsorted(p, zeros)
    return zeros * (2 * k - len(p)) + upto[-1] - 2 * upto[k] - len(p) * np.abs(zero - zeros)


def _rows(source: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings in the order of their source, and where each source's begin."""
    return np.argsort(source, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(source, minlength=n))))


def accumulate(rows: tuple[np.ndarray, ...], peers: tuple[np.ndarray, ...]) -> np.ndarray:
    """Differences of every row and every peer over one part of the terms, without what all terms have by their zeros alone.

    Each side is (zero per source, source per posting, term per posting, share per posting); terms are numbers from 0.
    """
    (zero_r, source_r, term_r, p_r), (zero_p, source_p, term_p, p_p) = rows, peers
    by_row, row_at = _rows(source_r, len(zero_r))
    by_peer, peer_at = _rows(source_p, len(zero_p))
    out = np.zeros((len(zero_r), len(zero_p)), np.int64)
    for h in range(len(zero_p)):
        out[:, h] += _absent(p_p[by_peer[peer_at[h]:peer_at[h + 1]]], zero_p[h], zero_r)
    # the term-major index of the peers
    index, at = _rows(term_p, int(max(term_p.max(initial=-1), term_r.max(initial=-1))) + 1)
    peer, share_of = source_p[index], p_p[index]
    for g in range(len(zero_r)):
        mine = by_row[row_at[g]:row_at[g + 1]]
        term, p, z = term_r[mine], p_r[mine], zero_r[g]
        out[g] += _absent(p, z, zero_p)
        length = at[term + 1] - at[term]
        place = np.arange(length.sum()) + np.repeat(at[term] - (np.cumsum(length) - length), length)
        h, q, p = peer[place], share_of[place], np.repeat(p, length)
        y = zero_p[h]
        np.add.at(out[g], h, np.abs(p - q) - np.abs(p - y) - np.abs(z - q) + np.abs(z - y))
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Rows of one tile (postings, and one row without a term per source) to its part of the values of its pairs."""
    names = table.column("source").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    source, zero, side = names.indices.to_numpy(), np.zeros(len(names.dictionary), np.int64), np.zeros(len(names.dictionary), np.int64)
    zero[source], side[source] = table.column("zero").to_numpy(), table.column("side").to_numpy()
    terms = table.column("term").combine_chunks()
    has = terms.is_valid().to_numpy(zero_copy_only=False)
    term = terms.filter(pa.array(has)).dictionary_encode().indices.to_numpy().astype(np.int64)
    source, p = source[has], table.column("p").combine_chunks().filter(pa.array(has)).to_numpy()
    first, last = table.column("row_side")[0].as_py(), table.column("peer_side")[0].as_py()
    sets = []
    for number in (first, last):
        members = np.flatnonzero(side == number)
        place = np.full(len(side), -1)
        place[members] = np.arange(len(members))
        own = side[source] == number
        sets.append((members, (zero[members], place[source[own]], term[own], p[own])))
    (rows, left), (peers, right) = sets
    out = accumulate(left, right)
    if table.column("part")[0].as_py() == 0:
        out += table.column("terms")[0].as_py() * np.abs(zero[rows][:, None] - zero[peers][None, :])
    a, b = (np.triu_indices(len(rows), 1, len(peers)) if first == last else np.indices(out.shape).reshape(2, -1))
    value = out[a, b]
    both = [names.dictionary.take(pa.array(np.concatenate(x))) for x in ((rows[a], peers[b]), (peers[b], rows[a]))]
    lang = pa.array([table.column("lang")[0].as_py()] * (2 * len(value)), pa.string())
    return pa.Table.from_arrays([lang, *both, pa.array(np.concatenate((value, value)))], ["lang", "source", "item", "value"])


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways."""
    keys = ["lang", "source", "side", "sides", "zero", "terms"]
    own = shares.select(*keys, "term", "p", F.pmod(F.xxhash64("term"), "parts").alias("part"))
    marks = groups.select(*keys, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    tiled = own.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    tiled = tiled.withColumn("row_side", F.least("side", "other")).withColumn("peer_side", F.greatest("side", "other")).drop("other", "sides")
    parts = tiled.groupBy("lang", "row_side", "peer_side", "part").applyInArrow(_tile, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of each language apart.

    Part ``pair`` ranks the other sources of the language by the sum over kept terms of the differences of their shares; part ``term``
    ranks, up to ``top``, the terms that stand out in a source against its language. A term is kept in a language if ``least`` of its
    documents hold it. Null text, language and source count as ''. Documents are counted row by row: repeated rows count as often as
    they come, ids and other columns (whatever their names) are not looked at. Ties rank by the item's UTF-8 bytes. Languages
    without kept terms have pairs of value 0; a language's only source has no pairs; no rows, no result. Texts are whole, very
    long ones are split step by step. What is held at once: a task's counts (``HELD`` terms), one tile of postings.

    The result is a stored table; what was stored on the way is removed.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/divergence/{uuid.uuid4().hex}"
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    kept = postings(plain, least, folder)
    groups = groups_of(plain, kept, folder)
    joined = kept.join(groups, ["lang", "source"])
    shares = joined.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("terms")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    standing = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    standing = standing.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = pair_values(shares, groups).withColumn("rank", F.row_number().over(order))
    named = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for d, part in ((pairs, "pair"), (standing, "term"))]
    done = stage(named[0].unionByName(named[1]), "divergence")
    discard(spark, folder)
    return done
