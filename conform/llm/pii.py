"""Personal data in text: strict patterns, and a weakly supervised classifier for looser spellings.

Method: candidates come from strict and loose patterns. Labelers vote on each: the strict pattern, a gazetteer of known
endings and number ranges, words in the context, the characters around the span. Expectation-maximisation over the vote
patterns estimates how reliable each labeler is, without labels; the resulting probabilities train the final classifier, a
logistic regression over votes and shape. Votes are few, so a corpus is summed up in a short table of patterns with counts,
made in Spark over all texts; only that table reaches the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where its run of digits (or of name characters) does: so every run is read a few times, however long
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Loose spellings.
_SPOKEN = re.compile(r"(?<![A-Za-z0-9_%+-])(?<![A-Za-z0-9_%+-]\.)[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]+)+", re.I)
_V6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:00[1-9][0-9 ().-]{8,18}[0-9]|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4})(?![\w-])")
#: Fixed values of the gazetteer and the context labeler.
ENDINGS = frozenset("com org net edu gov info io co de fr es uk eu int".split())
CUES = {"email": re.compile(r"mail|contact|write|courriel|correo", re.I), "ip": re.compile(r"\bip\b|host|server|address|adres", re.I),
        "card": re.compile(r"card|visa|credit|pay|karte|carte|tarjeta", re.I), "phone": re.compile(r"phone|call|tel|fax|mobile|anruf|appel", re.I)}
LABELERS = ("strict", "gazetteer", "context", "edges")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern; only places with an @ are looked at."""
    at, free = text.find("@"), 0
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        m = _EMAIL.match(text, left) if left < at else None
        if m:
            yield m.span()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the strict spans: leftmost, non-overlapping per kind; a match that fails its test is dropped."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _gazetteer(kind: int, span: str) -> bool:
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        return re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in ENDINGS
    if kind == 1:
        return ":" in span or 1 <= int((span.split(".")[0].lstrip("0") or "0")[:4]) <= 223
    if kind == 2:
        return digits[0] in "23456" and _luhn(digits)
    return len(digits) in (10, 11, 12) and digits[-10] not in "01"


def candidates(text: str) -> list[tuple[int, int, int, tuple[int, ...], int]]:
    """(kind, start, end, votes, shape) of every span that a strict or loose pattern finds."""
    strict = base_spans(text)
    low = text.lower() if "dot" in text or "DOT" in text or "Dot" in text else ""
    loose = [(0, *m.span()) for m in _SPOKEN.finditer(text)] if low and ("(at)" in low or "[at]" in low or " at " in low) else []
    if _DIGIT.search(text):
        loose += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        if text.count(":") > 6:
            loose += [(1, *m.span()) for m in _V6.finditer(text)]
    loose = [c for c in loose if not any(k == c[0] and s < c[2] and c[1] < e for k, s, e in strict)] if loose else []
    out = []
    for is_strict, spans in ((1, strict), (0, loose)):
        for k, s, e in spans:
            span = text[s:e]
            edges = not (s and (text[s - 1].isalnum() or text[s - 1] in "._-")) and not (e < len(text) and (text[e].isalnum() or text[e] in "_-"))
            votes = (is_strict, int(_gazetteer(k, span)), int(bool(CUES[KINDS[k]].search(text, max(0, s - 40), s))), int(edges))
            out.append((k, s, e, votes, min(3, (e - s) // 8)))
    return out


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (rate of votes given truth 0 and 1 per labeler, probability of each pattern to be true)."""
    rate = np.stack([np.full(votes.shape[1], 0.2), np.full(votes.shape[1], 0.8)])
    share = 0.5
    for _ in range(rounds):
        like = [np.log(s) + (votes * np.log(r) + (1 - votes) * np.log(1 - r)).sum(1) for s, r in ((1 - share, rate[0]), (share, rate[1]))]
        true = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        share = float(np.clip((true @ counts + 1) / (counts.sum() + 2), 0.02, 0.98))
        for c, w in ((0, (1 - true) * counts), (1, true * counts)):
            # two pseudo-counts keep the labelers better than chance where data are few
            rate[c] = np.clip((w @ votes + 2 * (0.2 + 0.6 * c)) / (w.sum() + 2), 0.02, 0.98)
    return rate, true


def train(patterns: dict[tuple, int]) -> dict[int, np.ndarray]:
    """Per kind the weights of a logistic regression over votes and shape, fitted to the EM probabilities."""
    out = {}
    for kind in range(len(KINDS)):
        own = sorted((p, n) for p, n in patterns.items() if p[0] == kind)
        if not own:
            continue
        votes, n = np.array([p[1] for p, _ in own], float), np.array([n for _, n in own], float)
        _, true = reliabilities(votes, n)
        x = _inputs(votes, np.array([p[2] for p, _ in own]))
        w = np.zeros(x.shape[1])
        weight = n / n.sum()
        for _ in range(200):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (true - p)) - 1e-3 * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        out[kind] = w
    return out


def _inputs(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(votes)), 2 * votes - 1, np.eye(4)[shape]])


def fit(docs: DataFrame, text_col: str = "text") -> dict[int, np.ndarray]:
    """Count the vote patterns of all texts in Spark (a few hundred rows at most) and train the classifier on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update((k, v, shape) for k, _, _, v, shape in candidates(t.as_py() or ""))
        rows = [{"kind": k, "votes": list(v), "shape": shape, "n": n} for (k, v, shape), n in seen.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.int32()), ("votes", pa.list_(pa.int32())), ("shape", pa.int32()), ("n", pa.int64())]))

    got = docs.select(text_col).mapInArrow(count, "kind int, votes array<int>, shape int, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).collect()
    return train({(r["kind"], tuple(r["votes"]), r["shape"]): r["n"] for r in got})


def accepted(text: str | None, model: dict[int, np.ndarray], threshold: float) -> tuple[list[tuple], list[tuple]]:
    """Strict candidates of a text, and all that count: these and the loose ones that the classifier takes; in order."""
    found = candidates(text or "")
    strict = [c for c in found if c[3][0]]
    loose = [c for c in found if not c[3][0]]
    if loose:
        p = [float(_inputs(np.array([c[3]], float), np.array([c[4]])) @ model.get(c[0], np.zeros(9))) for c in loose]
        loose = [c for c, x in zip(loose, p, strict=True) if 1 / (1 + np.exp(-x)) > threshold]
    order = lambda c: (c[1], c[0], c[2])
    return sorted(strict, key=order), sorted(strict + loose, key=order)


SPAN = "array<struct<kind: string, start: long, end: long>>"


def spans(text: Column, model: dict[int, np.ndarray], threshold: float = 0.5) -> Column:
    """Struct of ``base`` (strict spans) and ``all`` (these and accepted loose ones), by start, then kind; null text: none.

    Positions count code points, ends are exclusive. Spans of different kinds may overlap.
    """
    place = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf(f"struct<base: {SPAN}, all: {SPAN}>")
    def find(texts: pa.Array) -> pa.Array:
        base, every = [], []
        for t in texts:
            for out, cs in zip((base, every), accepted(t.as_py(), model, threshold), strict=True):
                out.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e, *_ in cs])
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(place)), pa.array(every, pa.list_(place))], ["base", "all"])

    return find(text)


def find_personal(docs: DataFrame, text_col: str = "text", out: str = "personal") -> DataFrame:
    """Add the spans of personal data to every row; all columns stay (one named like ``out`` is replaced).

    The classifier is fitted to the votes of all rows. Repeated rows get equal spans; an empty table stays empty.
    """
    return docs.withColumn(out, spans(F.col(text_col), fit(docs, text_col)))


def covered(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with spans (kind, start, end; by start) replaced by their kind in brackets; overlapping ones by the first's."""
    parts, at = [], 0
    for kind, start, end in found:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(text: Column, model: dict[int, np.ndarray], threshold: float = 0.5) -> Column:
    """The text with all accepted spans replaced by their kind in brackets; null stays null."""

    @F.arrow_udf("string")
    def cover(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py()
            out.append(None if t is None else covered(t, [(KINDS[k], s, e) for k, s, e, *_ in accepted(t, model, threshold)[1]]))
        return pa.array(out, pa.string())

    return cover(text)
