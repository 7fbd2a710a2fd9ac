"""Toxicity of texts, seen through disguised spelling.

Method: a disguised word is a noisy channel's output. Look-alike characters, letters set apart and repeated letters span a
lattice of spellings; Viterbi decoding under a character language model (4-grams counted over the whole corpus) picks the
likeliest. Restored words and their beginnings are then scored by how often they occur in labelled toxic texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.llm.hashing import blocks, text_bytes
from conform.llm.langid import in_training

#: Symbols of the language model: 0 a gap, 1-26 the letters, 27 any other letter's byte.
ALPHABET = 28
SYMBOL = np.array([c - 0x60 if 0x61 <= c <= 0x7A else c - 0x40 if 0x41 <= c <= 0x5A else 27 if c >= 0x80 else 0 for c in range(256)], np.int64)
#: What look-alike characters may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Characters that may stand between the letters of a word.
SEPARATORS = frozenset(".-_*~'")
#: Log-probabilities of the channel: a look-alike, a separator, a dropped repetition.
SWAP, SEPARATE, DROP = -1.0, -1.0, -0.5

_APART = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S){3,}(?=[.,;:!?]*(?:\s|\Z))")
_SPECIAL, _LETTER, _TRIPLE = re.compile(r"[0-9@$!|+€.\-_*~']"), re.compile(r"[^\W\d_]"), re.compile(r"([^\W\d_])\1\1")
_LEAD, _TAIL = re.compile(r"\A[^\w$@!|+€]++"), re.compile(r"(?<!\W)\W++\Z")
_LETTERS = re.compile(r"[\W\d_]+")


#: A longer word is decoded in stretches of this length: the spellings kept on the way grow with it.
LONG = 256


def _odd(token: str) -> bool:
    """Whether a letter follows a special character, or stands three times in a row."""
    first = _SPECIAL.search(token)
    return bool(first and _LETTER.search(token, first.end()) or _TRIPLE.search(token))


def _trim(token: str) -> str:
    """A token without the signs around it."""
    return _TAIL.sub("", _LEAD.sub("", token))


def count_grams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all character 4-grams of the corpus; one table per task, summed in Spark."""
    size = ALPHABET ** 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for i, j in blocks(texts, 1 << 20):
                data, off = text_bytes(texts.slice(i, j - i))
                if len(data) < 4:
                    continue
                s = SYMBOL[data]
                code = ((s[:-3] * ALPHABET + s[1:-2]) * ALPHABET + s[2:-1]) * ALPHABET + s[3:]
                inside = np.ones(len(code), bool)
                for back in (1, 2, 3):
                    cut = off[1:-1] - back
                    inside[cut[(cut >= 0) & (cut < len(code))]] = False
                table += np.bincount(code[inside], minlength=size)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(table[some])], ["gram", "n"])

    # at most ALPHABET ** 4 rows, whatever the corpus
    got = docs.select(text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


def model_of(counts: np.ndarray, strength: float = 8.0) -> np.ndarray:
    """Log-probability of a symbol after three others, smoothed by those after two, one and none."""
    n = counts.reshape((ALPHABET,) * 4).astype(np.float64)
    p = np.full(ALPHABET, 1 / ALPHABET)
    for order in range(1, 5):
        m = n.sum(axis=tuple(range(4 - order))) if order < 4 else n
        p = (m + strength * p) / (m.sum(-1, keepdims=True) + strength)
    return np.log(p).astype(np.float32)


@dataclass
class Decoder:
    """Restores single words under the language model."""

    lm: np.ndarray
    known: dict[str, str] = field(default_factory=dict)

    def _options(self, word: str) -> Iterator[list[tuple[str, float]]]:
        i = 0
        while i < len(word):
            c, j = word[i], i + 1
            if c.isalpha():
                while j < len(word) and word[j] == c:
                    j += 1
                if j - i > 2:
                    yield [(c, DROP), (c + c, DROP)]
                else:
                    yield [(word[i:j], 0.0)]
            else:
                inside = 0 < i and j < len(word)
                yield [(x, SWAP) for x in LOOKALIKES.get(c, "")] + ([("", SEPARATE)] if c in SEPARATORS and inside or c not in LOOKALIKES else [])
            i = j

    def decode(self, word: str) -> str:
        """The likeliest spelling: Viterbi over the lattice, the state being the last three symbols."""
        if len(word) > LONG:
            return "".join(self.decode(word[i:i + LONG]) for i in range(0, len(word), LONG))
        states = {(0, 0, 0): (0.0, "")}
        for options in self._options(word):
            then: dict[tuple[int, int, int], tuple[float, str]] = {}
            for (a, b, c), (p, text) in states.items():
                for letters, cost in options:
                    x, y, z, q = a, b, c, p + cost
                    for ch in letters:
                        s = ord(ch) - 96 if "a" <= ch <= "z" else 27
                        q += float(self.lm[x, y, z, s])
                        x, y, z = y, z, s
                    if (x, y, z) not in then or q > then[x, y, z][0]:
                        then[x, y, z] = (q, text + letters)
            states = then or states
        return max((p + float(self.lm[(*k, 0)]), text) for k, (p, text) in states.items())[1]

    def word(self, token: str) -> str:
        """A lower-cased token as a plain word: decoded where its spelling is odd."""
        if token.isalpha() and not _odd(token):
            return token
        core = _trim(token)
        return self.decode(core) if _odd(core) else _LETTERS.sub("", core)

    def words(self, text: str | None) -> set[str]:
        """The distinct restored words of a text, words set apart letter by letter included."""
        low = (text or "").lower()
        out, known = set(), self.known
        for token in set(low.split()):
            w = known.get(token)
            if w is None:
                if len(known) > 400_000:  # what a task remembers
                    known.clear()
                w = known[token] = self.word(token)
            out.add(w)
        for m in _APART.finditer(low):
            joined = self.decode(re.sub(r"[ .\-_*]", "", m[0]))
            out |= {joined, joined[1:], joined[:-1], joined[1:-1]}
        return out

    def restore(self, text: str | None) -> str | None:
        """The text with oddly spelled words decoded, in lower case."""
        if text is None:
            return None
        apart = _APART.sub(lambda m: self.decode(re.sub(r"[ .\-_*]", "", m[0])), text.lower())
        return re.sub(r"\S+", lambda m: self.word(m[0]) if _odd(_trim(m[0])) else m[0], apart)


def marks(word: str) -> tuple[str, ...]:
    """What a word is scored by: itself and its first 4, 5 and 6 letters."""
    return (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k))


@dataclass
class Model:
    lm: np.ndarray
    weight: dict[str, float]
    base: float


def _count_marks(docs: DataFrame, lm: np.ndarray, only: frozenset[str] | None) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, seen = Decoder(lm), Counter()
        for batch in batches:
            for t in batch.column(0):
                found = {m for w in decoder.words(t.as_py()) if w for m in marks(w)}
                seen.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["mark", "n"])

    return docs.mapInArrow(count, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))


def _credit(docs: DataFrame, lm: np.ndarray, weight: dict[str, float]) -> DataFrame:
    """How many of the texts each mark explains best; of equal marks the longest word, then the whole one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, seen = Decoder(lm), Counter()
        for batch in batches:
            for t in batch.column(0):
                found = {m for w in decoder.words(t.as_py()) if w for m in marks(w) if m in weight}
                if found:
                    seen[max(found, key=lambda m: (weight[m], len(m), m))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["mark", "n"])

    return docs.mapInArrow(count, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 100_000, least: int = 3, doubt: float = 8.0, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    """Language model from all texts; weights of words from labelled ones whose id is open to training.

    About ``fit_rows`` labelled ids at most are used, chosen by a hash of the id, so the label table each task gets is bounded.
    Null labels are left out; an id with several labels counts as toxic if one says so. A word's weight is its share of toxic
    texts, drawn towards the overall share by ``doubt`` pseudo-texts. Only words as telling as those that explain toxic texts
    best keep a weight: what merely stands next to them, as in copies of one text, is explained away. Without labels every
    weight is missing.
    """
    lm = model_of(count_grams(docs, text_col))
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter(F.col("_y").isNotNull() & in_training("_id"))
    own = own.groupBy("_id").agg(F.max(F.col("_y").cast("int")).alias("_y"))
    n = own.count()
    if n > fit_rows:
        own = own.filter(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 30)) < F.lit(int(fit_rows / n * (1 << 30))))
    sizes = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(own), "_id")
    # marks of at least so many of the bounded set of toxic texts
    least = max(least, sizes.get(1, 0) // 4000)
    toxic = {r.mark: r.n for r in _count_marks(texts.filter("_y = 1").select("_text"), lm, None).filter(F.col("n") >= least).collect()}
    clean = {r.mark: r.n for r in _count_marks(texts.filter("_y = 0").select("_text"), lm, frozenset(toxic)).collect()} if toxic else {}
    weight = {m: (a + doubt * prior) / (a + clean.get(m, 0) + doubt) for m, a in toxic.items()}
    weight = {m: w for m, w in weight.items() if w >= max(0.25, 2 * prior)}
    credit = {r.mark: r.n for r in _credit(texts.filter("_y = 1").select("_text"), lm, weight).collect()} if weight else {}
    enough = max(2, sizes.get(1, 0) * 3 // 1000)
    # as telling as the least telling mark that explains texts on its own
    least_told = min((w for m, w in weight.items() if credit.get(m, 0) >= enough), default=1.0)
    return Model(lm, {m: w for m, w in weight.items() if w >= least_told}, min(0.4, prior / 4))


def score(text: Column, model: Model) -> Column:
    """Struct of ``score`` (0 to 1) and ``words``: the restored words that speak for toxicity, in order.

    The score is that of the strongest word; without such a word, null and empty texts included, a small constant.
    """
    lm, weight, base = model.lm, model.weight, model.base

    @F.arrow_udf("struct<score: double, words: array<string>>")
    def judge(texts: pa.Array) -> pa.Array:
        decoder, values, found = Decoder(lm), [], []
        memo: dict[str, float] = {}
        for t in texts:
            best, hits = base, []
            for w in decoder.words(t.as_py()):
                v = memo.get(w)
                if v is None:
                    if len(memo) > 400_000:
                        memo.clear()
                    v = memo[w] = max((weight.get(m, 0.0) for m in marks(w)), default=0.0) if w else 0.0
                if v >= 0.5:
                    hits.append(w)
                if v > best:
                    best = v
            values.append(best)
            found.append(sorted(hits))
        return pa.StructArray.from_arrays([pa.array(values, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["score", "words"])

    return judge(text)


def restored(text: Column, model: Model) -> Column:
    """The text with disguised words spelled out (lower case); null stays null."""
    lm = model.lm

    @F.arrow_udf("string")
    def spell(texts: pa.Array) -> pa.Array:
        decoder = Decoder(lm)
        return pa.array([decoder.restore(t.as_py()) for t in texts], pa.string())

    return spell(text)
