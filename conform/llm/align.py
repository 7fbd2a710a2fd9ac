"""Align the tokens of two tokenizers over the same bytes, and count which token ids end together.

Method: interval coalescing. All tokens A and B of a block of texts are byte intervals, sorted by start; the running maximum of their
ends says how far the tokens so far reach, and a group breaks where a start reaches it. Within a group the overlapping A-B pairs are
expanded; a link is such a pair that ends at the same byte. Links are counted over the corpus without sending every link through
a shuffle by its pair: a block of texts asks once for each of its distinct pairs, and the answers meet the block's links.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conform.llm import pieces
from conform.llm.hashing import blocks
from conform.session import discard, shared_dir, stage

#: Bytes of text that one numpy step aligns, and that one block of the link count holds.
STEP, BLOCK = 512 << 10, 16 << 20
#: Links of a block that are looked up at a time.
LINKS = 1 << 18
#: Characters that every edition of Unicode classes alike, so that both libraries cut words at the same places.
PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u024f\u0410-\u044f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: The longest run without a space that goes the faster way, whose time grows with the square of a run.
RUN = re.compile(r"[^ ]{2000}")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, the others follow from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class ByteLevel:
    """A byte-level vocabulary: the library of its definition, and a faster one over the same vocabulary for plain texts."""

    lib: object
    fast: object | None
    bytes_of: list[bytes]

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN.fullmatch(text) and not RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def byte_level(definition: str) -> ByteLevel:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(definition)
    lib.encode_special_tokens = True
    letters = _byte_letters()
    special = {i: t.content for i, t in lib.get_added_tokens_decoder().items()}
    bytes_of = [special[i].encode() if i in special else bytes(letters[c] for c in lib.id_to_token(i)) for i in range(lib.get_vocab_size())]
    # merges in the order of ids, and no other steps: then ids are ranks, which is all that the faster library wants
    d = json.loads(definition)
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in d["model"]["merges"]]
    same = d["normalizer"] is None and d["pre_tokenizer"]["type"] == "ByteLevel" and d["pre_tokenizer"]["use_regex"] and not d["pre_tokenizer"]["add_prefix_space"]
    same = same and [lib.token_to_id(m) for m in merges] == list(range(256, 256 + len(merges)))
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(bytes_of) if i not in special}, special_tokens={}) if same else None
    return ByteLevel(lib, fast, bytes_of)


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of each interval: one that begins where all earlier ones have ended opens a new group."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    opens = np.ones(len(order), bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair (index in A, index in B) of overlapping intervals; each side is in order and without overlaps of its own."""
    first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(start_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


@dataclass
class Alignment:
    """Both tokenizers, and how their ids are written in groups."""

    a: ByteLevel
    b: pieces.Agenda
    lib_b: object
    length_a: np.ndarray
    length_b: np.ndarray
    written: list[str]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Numbers of A tokens, B tokens and groups, the groups as text, and the links (A id x size of B + B id) of every text."""
        ids_a, ids_b = [], []
        for t in texts:
            a, b, raw = self.a.encode(" " + t if t else ""), pieces.library_ids(self.lib_b, t, not self.b.marks_lead), b" " + t.encode() if t else b""
            spelled = b"".join(map(self.a.bytes_of.__getitem__, a.tolist())) == raw == b"".join(map(self.b.bytes_of.__getitem__, b.tolist()))
            ids_a.append(a if spelled else a[:0])
            ids_b.append(b if spelled else b[:0])
        n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a, b = (np.concatenate(x).astype(np.int64) for x in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        start_a, start_b = end_a - self.length_a[a], end_b - self.length_b[b]
        group = coalesce(np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b)))
        group_a, group_b = group[:len(a)], group[len(a):]
        many = int(group_a[-1]) + 1 if len(a) else 0
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=many)), np.cumsum(np.bincount(group_b, minlength=many))
        # written order: the A tokens of a group, then its B tokens
        code = np.empty(len(a) + len(b), np.int64)
        last = np.zeros(len(a), np.int64)
        last[upto_a - 1] = 1
        code[np.arange(len(a)) + np.concatenate(([0], upto_b))[group_a]] = 2 * a + last
        last = np.zeros(len(b), np.int64)
        last[upto_b - 1] = 1
        code[np.arange(len(b)) + upto_a[group_b]] = 2 * (len(self.length_a) + b) + last
        in_a, in_b = overlaps(start_a, end_a, start_b, end_b)
        ends = end_a[in_a] == end_b[in_b]
        in_a = in_a[ends]
        link = a[in_a] * len(self.length_b) + b[in_b[ends]]
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        groups_to = np.concatenate(([0], group_a + 1))[stop_a]
        links_to = np.searchsorted(in_a, stop_a, "left")
        codes, at = code.tolist(), 0
        for i in range(len(texts)):
            to, g, k = int(stop_a[i] + stop_b[i]), int(groups_to[i - 1]) if i else 0, int(links_to[i - 1]) if i else 0
            yield int(n_a[i]), int(n_b[i]), int(groups_to[i]) - g, "".join(map(self.written.__getitem__, codes[at:to]))[:-1], link[k:links_to[i]]
            at = to


@lru_cache(maxsize=1)
def load(definition: str, model: bytes) -> Alignment:
    a, (b, lib_b) = byte_level(definition), pieces.load(model)
    marks = [(",", "|"), (",", ";")]
    written = [f"{i}{m}" for size, mark in zip((len(a.bytes_of), len(b.bytes_of)), marks, strict=True) for i in range(size) for m in mark]
    return Alignment(a, b, lib_b, np.array([len(x) for x in a.bytes_of]), np.array([len(x) for x in b.bytes_of]), written)


FIELDS = "n_a long, n_b long, n_groups long, groups string, links array<long>, block long"


def with_alignment(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", out: str = "alignment") -> DataFrame:
    """Add ``out`` to every row: the alignment of the byte-level tokens A of the text with a space before it, and its pieces B.

    ``groups`` writes the ids of every group as ``a1,a2|b1`` with ``;`` between groups, ``links`` holds A id x (number of B ids) + B id
    of each link, ``block`` numbers stretches of rows for ``link_counts``. Null and empty texts, and texts whose tokens do not
    spell the space and the text (a text with U+2581), have no tokens: zeros, '' and no links. Rows are judged one by one: repeated
    rows get equal answers, ids are not looked at, an empty table stays empty. Very long texts are whole, in steps of their own. Other
    columns stay; ``out`` is replaced. The files are read on the driver and travel with the function; an Arrow batch is handled in
    steps of ``STEP`` bytes.
    """
    definition, model = Path(path_a).read_text(), Path(path_b).read_bytes()
    rest = docs.drop(out)
    struct = T.StructType.fromDDL(FIELDS)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, struct)])
    names = schema.names

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(definition, model)
        base, taken = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for i, j in blocks(column, STEP):
                texts = [t or "" for t in column[i:j].to_pylist()]
                n_a, n_b, n_groups, groups, links = zip(*both.align(texts), strict=True)
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in links])))
                columns = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()),
                           pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(links), pa.int64())),
                           pa.array(np.full(j - i, base + taken // BLOCK), pa.int64())]
                taken += sum(map(len, texts))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.StructArray.from_arrays(columns, struct.names)], names)

    return rest.mapInArrow(aligned, schema)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, links) to (block, link, n)."""
    for batch in batches:
        block, lists = batch.column(0).to_numpy(), batch.column(1)
        values, off = lists.values.to_numpy(), lists.offsets.to_numpy()
        edge = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)] if len(block) else [0]
        for i, j in zip(edge, edge[1:]):
            link, n = np.unique(values[off[i]:off[j]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(link), block[i])), pa.array(link), pa.array(n.astype(np.int64))], ["block", "link", "n"])


def sums_by_row(lists: pa.ListArray, numbers: Callable[[np.ndarray], Sequence[np.ndarray]], many: int) -> list[np.ndarray]:
    """For every list the sums of ``many`` numbers per member, which ``numbers`` gives for ``LINKS`` members at a time."""
    values, off = lists.values.to_numpy(), lists.offsets.to_numpy()
    upto = [np.zeros(len(off), np.int64) for _ in range(many)]
    carry = [0] * many
    for p in range(int(off[0]), int(off[-1]), LINKS):
        q = min(p + LINKS, int(off[-1]))
        lo, hi = np.searchsorted(off, (p, q), "right")
        for k, each in enumerate(numbers(values[p:q])):
            so_far = np.cumsum(each, dtype=np.int64)
            upto[k][lo:hi] = carry[k] + so_far[off[lo:hi] - p - 1]
            carry[k] += int(so_far[-1])
    return [np.diff(u) for u in upto]


def link_counts(rows: DataFrame, size_b: int, folder: str, links: str = "_links", block: str = "_block") -> DataFrame:
    """Replace ``links`` and ``block`` by ``n_links``, ``n_best`` and ``count_sum``; other columns stay.

    A link's count is the number of equal links in all rows; ``n_best`` counts links whose count no other link with the same B id
    exceeds. ``rows`` must be stored (block numbers belong to one reading). Rows without links get zeros; no rows, no rows.
    Within a block the distinct links are few and bounded by its bytes, so only they are joined with the counts, and a task
    holds one block, of whose links it looks up some at a time. Of the counts, the best per B id are broadcast: at most ``size_b`` rows.
    """
    asked = stage(rows.select(F.col(block).alias("block"), F.col(links).alias("links")).mapInArrow(_distinct, "block long, link long, n long"), "asked", folder)
    counts = asked.groupBy("link").agg(F.sum("n").alias("count")).withColumn("b", F.col("link") % size_b)
    counts = stage(counts, "counts", folder)
    best = counts.groupBy("b").agg(F.max("count").alias("top"))
    judged = counts.join(F.broadcast(best), "b").select("link", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = asked.select("block", "link").join(judged, "link")
    rest = [f for f in rows.schema.fields if f.name not in (links, block)]
    schema = T.StructType([*rest, *T.StructType.fromDDL("n_links long, n_best long, count_sum long").fields])

    def summed(mine: pa.Table, known: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what earlier blocks and stages left in this worker
        link = known.column("link").to_numpy()
        order = np.argsort(link, kind="stable")
        link = link[order]
        count, top = known.column("count").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order]
        columns = [[], [], []]

        def numbers(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(link, some)
            return top[at], count[at]

        for lists in mine.column(links).chunks:
            for column, each in zip(columns, (np.diff(lists.offsets.to_numpy()), *sums_by_row(lists, numbers, 2)), strict=True):
                column.append(each)
        made = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns]
        return pa.Table.from_arrays([*[mine.column(f.name) for f in rest], *made], names=schema.names)

    return rows.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(summed, schema)


def with_links(docs: DataFrame, path_a: str, path_b: str, *columns: Column, text_col: str = "text") -> DataFrame:
    """``columns`` (of ``docs`` and of the struct ``alignment``) of every row, and ``n_links``, ``n_best`` and ``count_sum``.

    The result is a stored table; what was stored on the way is removed.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/align/{uuid.uuid4().hex}"
    size_b = len(pieces.load(Path(path_b).read_bytes())[0].bytes_of)
    rows = with_alignment(docs, path_a, path_b, text_col).select(*columns, F.col("alignment.links").alias("_links"), F.col("alignment.block").alias("_block"))
    done = stage(link_counts(stage(rows, "rows", folder), size_b, folder), "aligned")
    discard(spark, folder)
    return done
