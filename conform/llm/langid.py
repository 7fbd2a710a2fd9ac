"""Language identification with a string kernel.

Method: a text is the set of byte n-grams (n = 1 to 3, letters only) that it holds. The kernel of two texts is the share of
n-grams they have in common, |A & B| / sqrt(|A| |B|). A few labelled texts serve as Nystroem landmarks; one-versus-rest kernel
ridge regression in their space gives one weight per landmark and language, so a batch of texts is scored by two matrix
products: presence x landmarks, kernel values x weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.llm.hashing import text_bytes

#: Slots of the hashed n-gram set, and texts per matrix product.
SLOTS, BATCH = 1 << 14, 128
GRAMS = (1, 2, 3)
UNKNOWN = "und"
#: Letters and non-ASCII bytes stand for themselves, all other bytes for a gap.
FOLD = np.array([c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)], np.uint8)
STEP = 1 << 20


def presence(texts: pa.Array) -> np.ndarray:
    """One row per text: which hashed n-grams occur."""
    data, off = text_bytes(texts)
    n = len(off) - 1
    out = np.zeros((n, SLOTS), np.uint8)
    flat = out.ravel()
    for d in range(n):
        for lo in range(off[d], off[d + 1], STEP):  # neighbouring steps share two bytes, so no n-gram is missed
            x = FOLD[data[lo:min(off[d + 1], lo + STEP + 2)]].astype(np.uint32)
            code = np.zeros(len(x), np.uint32)
            for g in GRAMS:
                code = (code[:len(x) - g + 1] << 8) | x[g - 1:] if g > 1 else x
                if not len(code):
                    break
                flat[d * SLOTS + (((code + np.uint32(g << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(18))] = 1
    return out


@dataclass
class Model:
    """Landmark n-gram sets, the inverse root of their sizes, and a weight per landmark and language."""

    langs: list[str]
    marks: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def kernel(self, p: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(p.sum(1, dtype=np.float32), 1))
        return (p.astype(np.float32) @ self.marks) * self.scale / size[:, None]

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Share of each language in the positive part of the regression values."""
        raw = np.maximum(self.kernel(p) @ self.weights, 1e-6)
        return raw / raw.sum(1, keepdims=True)


def sample(train: DataFrame, per_language: int, id_col: str, lang_col: str) -> DataFrame:
    """About ``per_language`` rows of each language (all of a rarer one), chosen by a hash of the id."""
    counts = train.groupBy(lang_col).count().collect()  # one row per language
    if not counts:
        return train.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, per_language / r[1]))])
    return train.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30)) < share[F.col(lang_col)] * (1 << 30))


def fit(train: DataFrame, per_language: int = 300, landmarks: int = 96, ridge: float = 1e-2, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the labelled rows of ``train``; null text or language is left out. None where nothing is left.

    Only about ``per_language`` rows per language are used. Their n-gram sets (2 KB each) are made in Spark from whole texts.
    """
    own = train.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(
        F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        rows = [np.packbits(presence(texts.slice(i, BATCH)), axis=1) for i in range(0, len(texts), BATCH)]
        return pa.array([r.tobytes() for part in rows for r in part], pa.binary())

    got = sample(own, per_language, "_id", "_lang").select("_lang", F.xxhash64(F.lit("order"), "_id", "_text").alias("_o"), packed("_text").alias("p")).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["_lang"], r["_o"]))
    langs = sorted({r["_lang"] for r in got})
    label = np.array([langs.index(r["_lang"]) for r in got])
    p = np.unpackbits(np.frombuffer(b"".join(r["p"] for r in got), np.uint8).reshape(len(got), -1), axis=1)
    each = max(1, landmarks // len(langs))
    picked = np.concatenate([np.flatnonzero(label == c)[:each] for c in range(len(langs))])
    scale = 1 / np.sqrt(np.maximum(p[picked].sum(1, dtype=np.float32), 1))
    model = Model(langs, np.ascontiguousarray(p[picked].T, dtype=np.float32), scale.astype(np.float32), np.zeros((len(picked), len(langs)), np.float32))
    k = model.kernel(p).astype(np.float64)
    values, vectors = np.linalg.eigh(k[picked])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k @ root
    target = np.eye(len(langs))[label]
    beta = np.linalg.solve(phi.T @ phi + ridge * len(got) * np.eye(phi.shape[1]), phi.T @ target)
    model.weights = (root @ beta).astype(np.float32)
    return model


def predict(text: Column, model: Model | None) -> Column:
    """Struct of ``lang`` (``und`` for null, for texts without a letter, and without a model) and ``score`` (0 to 1)."""
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return none

    @F.arrow_udf("struct<lang: string, score: double>")
    def score(texts: pa.Array) -> pa.Array:
        best, value = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(0, len(texts), BATCH):
            s = model.scores(presence(texts.slice(i, BATCH)))
            best.append(s.argmax(1))
            value.append(s.max(1).astype(np.float64))
        return pa.StructArray.from_arrays([pa.array(model.langs).take(pa.array(np.concatenate(best))), pa.array(np.concatenate(value))], ["lang", "score"])

    # so marked, a filter on the answer is not pushed below it, which would judge every text twice
    once = score.asNondeterministic()
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), once(text)).otherwise(none)


def in_training(id_col: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text is no multiple of 5. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", out: str = "language") -> DataFrame:
    """Add ``out`` (struct of ``lang`` and ``score``) to every row of ``docs``, learning from the rows of ``train``.

    Rows are judged one by one from their whole text alone, so repeated rows get equal answers. Null or letterless text, and
    every text where there is nothing to learn from: ``und`` with score 0. Columns of ``docs`` stay; ``out`` is replaced.
    """
    return docs.withColumn(out, predict(F.col(text_col), fit(train, id_col=id_col, text_col=text_col, lang_col=lang_col)))
