"""Deal rows out by ranges of an id, so that a range's number grows with the id."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that are cut by quantiles; finer ranges divide these evenly.
CUTS = 1000


@dataclass
class Ranges:
    """Quantile cuts of an id, each stretch between two of them divided into ``fine`` equal parts."""

    cuts: list[int]
    fine: int
    low: int = 0
    high: int = 0

    @property
    def count(self) -> int:
        return (len(self.cuts) + 1) * self.fine

    def number(self, key: Column) -> Column:
        """The range of ``key`` (null: 0), found by halving."""
        if not self.cuts:
            return F.lit(0)
        table = F.from_json(F.lit(json.dumps(self.cuts)), "array<bigint>")
        steps = [1 << b for b in reversed(range(len(self.cuts).bit_length()))]
        cut = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                          lambda p, s: F.when(F.get(table, p + s - 1) <= key, p + s).otherwise(p))
        if self.fine == 1:
            return cut
        low = F.coalesce(F.get(table, cut - 1), F.lit(self.low))
        high = F.coalesce(F.get(table, cut), F.lit(self.high + 1))
        part = F.floor((key - low).cast("double") / (high - low).cast("double") * self.fine)
        return F.coalesce(cut * self.fine + F.greatest(F.lit(0), F.least(part, F.lit(self.fine - 1))), F.lit(0)).cast("int")


def ranges_of(df: DataFrame, key: str, size: Column, target: int) -> Ranges:
    """Ranges of a whole-number ``key`` that hold about ``target`` (in the unit of ``size``) each; two scans.

    The cuts only balance the work; any cuts give the same results.
    """
    total, low, high = df.agg(F.sum(size), F.min(key), F.max(key)).first()
    n = max(1, -(-(total or 0) // target))
    if n == 1 or low is None:
        return Ranges([], 1)
    coarse = min(n, CUTS)
    cut = df.agg(F.percentile_approx(key, [i / coarse for i in range(1, coarse)], 10_000)).first()[0] if coarse > 1 else []
    return Ranges(sorted(set(cut or [])), -(-n // coarse), low, high)
