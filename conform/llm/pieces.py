"""Encode and decode texts with a merge-type SentencePiece vocabulary.

Method: the symbols of a text are its characters. An agenda holds the adjacent pairs whose join is a piece, ordered by score and
then by place; the best pair is joined and its new neighbours enter the agenda, until it is empty. A character that is no piece
becomes its bytes. A text is cut first where no piece can reach across (before a space mark that follows another character, and
between two characters that stand side by side in no piece), which changes no join; a worker remembers short stretches and
forgets those that did not come again for long. Inside every Arrow batch the sentencepiece library encodes and decodes the same texts, and ``agrees`` says whether both
its ids and its text are ours.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from conform.llm.hashing import blocks

#: The mark that stands for a space inside pieces.
MARK = "▁"
#: Stretches of at most this many characters are remembered, and so many of them until the ones before are forgotten.
SHORT, REMEMBERED = 32, 250_000
#: Characters whose stretches are joined together, and rows of one such step.
TOGETHER, ROWS = 2 << 20, 1 << 12
#: Bytes of text that one step of a batch handles.
STEP = 2 << 20
NO_PAIR = np.int32(np.iinfo(np.int32).max)
#: A longer text reaches the library in parts of about this many characters.
PART = 1 << 20
PROBE = " a  ééﬁ\tB\n "


codecs.register_error("each_byte", lambda error: ("�" * (error.end - error.start), error.end))


@dataclass
class Pairs:
    """Which two symbols join, as sorted numbers. Symbols are piece ids, then characters that stand in pieces only, then ``none``."""

    of_char: np.ndarray
    none: int
    keys: np.ndarray
    rank: np.ndarray
    joined: np.ndarray

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NO_PAIR`` if the two do not join), and its piece."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NO_PAIR), self.joined[at]


def pairs_of(ids: dict[str, int], rank: dict[str, int], n_ids: int, byte_id: list[int] | None) -> Pairs:
    """Every way to make a piece from two symbols. An ASCII character that stands in no piece is the piece of its byte."""
    bare = sorted({c for piece in ids for c in piece} - ids.keys())
    symbols = ids | {c: n_ids + i for i, c in enumerate(bare)}
    none = n_ids + len(bare)
    of_char = np.full(0x110000, none, np.int32)
    if byte_id:
        of_char[:128] = byte_id[:128]
    for c, i in symbols.items():
        if len(c) == 1:
            of_char[ord(c)] = i
    made = sorted((symbols[piece[:k]] * (none + 1) + symbols[piece[k:]], rank[piece], i) for piece, i in ids.items()
                  for k in range(1, len(piece)) if piece[:k] in symbols and piece[k:] in symbols)
    keys, ranks, joined = (np.array(x) for x in zip(*made, strict=True)) if made else (np.full(1, -1),) * 3
    return Pairs(of_char, none, keys, ranks.astype(np.int32), joined.astype(np.int32))


@dataclass
class Agenda:
    """Pieces of one vocabulary, and the stretches that were joined before."""

    ids: dict[str, int]
    rank: dict[str, int]
    bytes_of: list[bytes]
    byte_id: list[int] | None
    unknown: int
    begin: int
    end: int
    silent: np.ndarray
    led: frozenset[int]
    pairs: Pairs
    beside: frozenset[str] = frozenset()
    marks_lead: bool = True
    cut: re.Pattern = re.compile(".+", re.DOTALL)
    known: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    def join(self, s: str) -> list[int]:
        """The ids of one stretch, by the agenda."""
        total, rank = len(s), self.rank
        bits = total.bit_length()
        mask = (1 << bits) - 1
        size, before = [1] * total, list(range(-1, total - 1))
        # an entry is one number: rank of the join, where it starts, where it ends
        agenda = [(rank[piece] << bits | i) << bits | i + 2 for i in range(total - 1) if (piece := s[i:i + 2]) in rank]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            after, i = entry & mask, entry >> bits & mask
            j = i + size[i]
            if j == i or j >= after or j + size[j] != after:
                continue  # these places were joined otherwise meanwhile
            size[i], size[j] = after - i, 0
            if after < total:
                before[after] = i
                end = after + size[after]
                if (piece := s[i:end]) in rank:
                    heappush(agenda, (rank[piece] << bits | i) << bits | end)
            left = before[i]
            if left >= 0 and (piece := s[left:after]) in rank:
                heappush(agenda, (rank[piece] << bits | left) << bits | after)
        out, i = [], 0
        while i < total:
            piece = s[i:i + size[i]]
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_id:
                out.extend([self.byte_id[b] for b in piece.encode()])
            else:
                out.append(self.unknown)
            i += size[i]
        return out

    def join_all(self, stretches: list[str]) -> list[bytes]:
        """The ids of many short stretches: a row each holds its pairs, and every round joins the best pair of each row that has one."""
        size = np.array([len(s) for s in stretches])
        width, pairs = int(size.max()), self.pairs
        symbol = np.full((len(stretches), width + 1), pairs.none, np.int32)
        symbol[np.arange(width + 1) < size[:, None]] = pairs.of_char[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)]
        strange = np.flatnonzero((symbol >= len(self.bytes_of)).sum(1) > width + 1 - size)
        rank, new = pairs.look_up(symbol[:, :-1], symbol[:, 1:])
        ids, rows = symbol.copy(), np.arange(len(stretches))
        column = np.arange(width + 1)
        while len(rows):
            best = rank.argmin(1)
            going = rank[np.arange(len(rows)), best] < NO_PAIR
            ids[rows[~going]] = symbol[~going]
            rows, symbol, rank, new, best = rows[going], symbol[going], rank[going], new[going], best[going]
            n = np.arange(len(rows))
            size[rows] -= 1
            symbol[n, best] = new[n, best]
            moved = np.minimum(column + (column > best[:, None]), width)
            symbol = np.take_along_axis(symbol, moved, 1)
            moved = np.minimum(moved[:, :-1], width - 1)
            rank, new = np.take_along_axis(rank, moved, 1), np.take_along_axis(new, moved, 1)
            for at in (np.maximum(best - 1, 0), best):
                rank[n, at], new[n, at] = pairs.look_up(symbol[n, at], symbol[n, at + 1])
        flat, row = ids.astype("<u4").tobytes(), 4 * (width + 1)
        out = [flat[i:i + 4 * k] for i, k in zip(range(0, len(flat), row), size.tolist())]
        for i in strange.tolist():  # characters that are no piece become bytes
            out[i] = array("I", self.join(stretches[i])).tobytes()
        return out

    def remember(self, stretches: set[str]) -> None:
        """Join those short stretches that are not known yet; of the older ones, those that come again stay known."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = stretches.difference(self.known)
        self.known.update((s, self.older[s]) for s in new.intersection(self.older))
        missing = sorted((s for s in new.difference(self.older) if len(s) <= SHORT), key=len)
        at = 0
        while at < len(missing):
            to = min(len(missing), at + ROWS)
            self.known.update(zip(missing[at:to], self.join_all(missing[at:to])))
            at = to

    def long(self, s: str) -> bytes:
        """The ids of a long stretch, cut where no piece reaches across."""
        cuts = [0, *[i for i in range(1, len(s)) if s[i - 1:i + 1] not in self.beside], len(s)]
        return array("I", [t for a, b in zip(cuts, cuts[1:]) for t in self.join(s[a:b])]).tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text (32-bit, unsigned) with the begin and end ids."""
        waiting, body, chars = [], [], 0
        for text in texts:
            parts = parts_of(" " + text) if text and self.marks_lead else [" " + text] if text else []
            for part in parts:
                marked = part.replace(" ", MARK)
                waiting.append(self.cut.findall(marked))
                chars += len(part)
                if chars > TOGETHER:
                    yield from self._finish(waiting, body)
                    waiting, chars = [], 0
            waiting.append(None)
        yield from self._finish(waiting, body)

    def _finish(self, waiting: list[list[str] | None], body: list[bytes]) -> Iterator[np.ndarray]:
        """Join the stretches at hand; None closes a text, whose ids so far are in ``body``."""
        self.remember(set().union(*filter(None, waiting)))
        known = self.known
        for row in waiting:
            if row is None:
                ids = np.frombuffer(b"".join(body), "<u4")
                body.clear()
                yield np.concatenate(([self.begin], ids, [self.end])).astype("<u4")
            else:
                try:
                    body.append(b"".join(map(known.__getitem__, row)))
                except KeyError:  # one of them is long
                    body.append(b"".join([known.get(s) or self.long(s) for s in row]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are silent, the mark that leads the first piece is dropped, a bad byte is one U+FFFD."""
        silent = np.flatnonzero(self.silent[ids])
        out, first = [], True
        for a, b in zip([0, *(silent + 1)], [*silent, len(ids)]):
            listed = ids[a:b].tolist()
            joined = b"".join(map(self.bytes_of.__getitem__, listed))
            if first and listed:
                first, joined = False, joined[1:] if listed[0] in self.led else joined
            out.append(joined.decode(errors="each_byte"))
        return "".join(out)


@lru_cache(maxsize=2)
def load(model: bytes) -> tuple[Agenda, sentencepiece.SentencePieceProcessor]:
    """The agenda of a model file's content, and the library's own processor."""
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    every = range(lib.get_piece_size())
    if lib.normalize(PROBE) != MARK + PROBE.replace(" ", MARK) or any(lib.is_unused(i) for i in every):
        raise ValueError("only vocabularies that change nothing but spaces, and use all their pieces")
    text = [lib.id_to_piece(i) for i in every]
    plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    raw = [b"" if lib.is_control(i) else bytes([int(text[i][3:5], 16)]) if lib.is_byte(i) else " ⁇ ".encode() if lib.is_unknown(i)
           else text[i].replace(MARK, " ").encode() for i in every]
    byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(lib.is_byte(i) for i in every) else None
    order = {score: n for n, score in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
    ids, rank = {text[i]: i for i in plain}, {text[i]: order[lib.get_score(i)] for i in plain}
    marks_lead = not any(re.search(f"[^{MARK}]{MARK}", text[i]) for i in plain)
    alone = "".join(re.escape(chr(c)) for c in sorted(set(range(128)) - {ord(c) for i in plain for c in text[i]}))
    # a stretch: marks and what follows them, or characters that stand in no piece
    cut = f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if marks_lead else f"[^{alone}]+" if alone else ".+"
    return Agenda(
        ids=ids, rank=rank, pairs=pairs_of(ids, rank, len(text), byte_id), bytes_of=raw, byte_id=byte_id, unknown=lib.unk_id(),
        begin=lib.bos_id(), end=lib.eos_id(), silent=np.array([lib.is_control(i) for i in every]),
        led=frozenset(i for i in plain if text[i].startswith(MARK)),
        beside=frozenset(text[i][k:k + 2] for i in plain for k in range(len(text[i]) - 1)),
        marks_lead=marks_lead, cut=re.compile(cut + (f"|[{alone}]+" if alone else ""), re.DOTALL),
    ), lib


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts that begin with the space before a word; a vocabulary without pieces across such a place encodes the parts
    without that space exactly as it does the whole."""
    at = 0
    while len(text) - at > size:
        found = WORD_START.search(text, at + size)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


WORD_START = re.compile(r"(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")


def library_ids(lib: sentencepiece.SentencePieceProcessor, text: str, whole: bool = False) -> np.ndarray:
    """The library's ids of a text, without begin and end."""
    if whole or len(text) <= PART:
        return np.array(lib.encode(text), "<u4")
    return np.concatenate([np.array(lib.encode(p[1:] if i else p), "<u4") for i, p in enumerate(parts_of(text))])


def library_agrees(lib: sentencepiece.SentencePieceProcessor, text: str, ids: list[int], decoded: str, whole: bool = False) -> bool:
    """Whether the library encodes a text to these ids (begin and end included), and decodes them to ``decoded``."""
    own = lib.encode(text) if whole or len(text) <= PART else library_ids(lib, text).tolist()
    return ids[1:-1] == own and lib.decode(ids) == decoded


def with_pieces(docs: DataFrame, path: str, text_col: str = "text", out: str = "pieces", binary: bool = False) -> DataFrame:
    """Add ``out`` (struct of ``ids``, ``decoded``, ``agrees``) to every row, by the vocabulary in the file ``path``.

    ``ids`` (begin and end ids included) is an array, or with ``binary`` the ids as little-endian unsigned 32-bit numbers, as readers of
    token files want them. The vocabulary file (some hundred kilobytes) is read on the driver and travels with the function. Rows are
    judged one by one, so repeated rows get equal answers and empty tables stay empty. Null and empty texts are the begin and end id
    alone. An Arrow batch is handled in steps of ``STEP`` bytes; a very long text is a step of its own and encoded whole; only the
    library, which needs some hundred bytes per character, gets it in parts. Other columns stay; ``out`` is replaced.
    """
    model = Path(path).read_bytes()
    rest = docs.drop(out)
    struct = T.StructType.fromDDL(f"ids {'binary' if binary else 'array<int>'}, decoded string, agrees boolean")
    schema = T.StructType([*rest.schema.fields, T.StructField(out, struct)])
    names = schema.names

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda, lib = load(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for i, j in blocks(column, STEP):
                texts = [t or "" for t in column[i:j].to_pylist()]
                ids = list(agenda.encode(texts))
                decoded = [agenda.decode(x) for x in ids]
                agrees = [library_agrees(lib, t, x.tolist(), d, not agenda.marks_lead) for t, x, d in zip(texts, ids, decoded, strict=True)]
                if binary:
                    lists = pa.array([x.tobytes() for x in ids], pa.binary())
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
                made = pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], struct.names)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, made], names)

    return rest.mapInArrow(encoded, schema)
