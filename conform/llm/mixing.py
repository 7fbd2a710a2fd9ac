"""Interleave sources so that every stretch of the mixture follows the target weights to within one block.

Method: proportionate-fair scheduling. With integer weights that sum to W, block i (from 0) of a source of weight w is released
at slot floor(i W / w) and due by slot ceil((i + 1) W / w). In every slot, earliest deadline first picks among the released
blocks. Releases and deadlines repeat after W slots, so the plan of W slots is made once from the weights alone; a document
gets its slot by arithmetic on its block number. Everything that touches rows is DataFrame functions.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from conform.llm.ranges import ranges_of
from conform.session import stage

#: Slots of a plan: weights are configuration, and finer ones than this are refused.
MAX_SLOTS = 1_000_000
#: Documents of a source and id range that are numbered in one task.
RANGE_ROWS = 5_000
#: Counts of streams and ranges that are sent to every task; more are dealt out.
BROADCAST_COUNTS = 100_000


def slot_plan(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source within a period of sum(weights) slots, earliest deadline first."""
    total = sum(weights.values())
    if any(int(w) != w or w < 1 for w in weights.values()) or total > MAX_SLOTS:
        raise ValueError(f"weights must be whole numbers from 1, with a sum of at most {MAX_SLOTS}")
    coming = [(0, -(-total // w), s, 0) for s, w in weights.items()]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    plan: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, due, s, i = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, i))
        _, s, i = heapq.heappop(ready)
        plan[s].append(slot)
        if (i := i + 1) < weights[s]:
            heapq.heappush(coming, (i * total // weights[s], -(-(i + 1) * total // weights[s]), s, i))
    return plan


def mix(docs: DataFrame, weights: Mapping[str, int], other: int = 1, block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Add the place of every document in the mixture; no document is dropped or repeated.

    New columns: ``stream`` (the source if it has a weight, else null: all unlisted and null sources share the weight
    ``other``), ``block`` (from 0), ``release`` and ``deadline`` (slots), ``slot`` (unique per block) and ``place`` (from 0,
    inside the block). The mixture is the order by (``slot``, ``place``). While every stream still has blocks, the slots
    before any t hold each stream's share of t to within less than one block; the slots of a stream that ran out stay empty.

    Documents of a stream are numbered by id, null first; rows that share an id are ordered by a hash of the whole row,
    so equal rows take neighbouring places in either order. Columns of ``docs`` stay; those with the new names are
    replaced. An empty table gives no rows. Weights that are no whole numbers from 1 are refused.
    """
    names = {"stream", "block", "release", "deadline", "slot", "place"}
    own = [c for c in docs.columns if c not in names]
    plan = slot_plan({**{f"={s}": w for s, w in weights.items()}, "*": other})
    total = sum(map(len, plan.values()))
    table = json.dumps([{"s": s[1:] if s != "*" else None, "w": len(p), "slots": p} for s, p in plan.items()])
    spark = docs.sparkSession
    # as many rows as there are weights
    streams = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<s: string, w: int, slots: array<int>>>"))))

    listed = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)) if weights else F.lit(None).cast("string")
    ranges = ranges_of(docs.select(id_col), id_col, F.lit(1), RANGE_ROWS)
    rows = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), F.xxhash64(*own).alias("hash"), listed.alias("stream"), ranges.number(F.col(id_col)).alias("range"))
    counts = stage(rows.groupBy("stream", "range").agg(F.count("*").alias("n")), "mixing")
    # one row per stream and range: the running count is over short lists
    before = F.coalesce(F.sum("n").over(W.partitionBy("stream").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("stream").alias("of"), F.col("range").alias("part"), before.alias("before"))
    rank = F.row_number().over(W.partitionBy("stream", "range").orderBy(F.asc_nulls_first("id"), "hash"))
    ranked = rows.withColumn("rank", rank)
    number = F.col("before") + F.col("rank") - 1
    few = ranges.count * len(plan) <= BROADCAST_COUNTS
    numbered = ranked.join(F.broadcast(starts) if few else starts, F.col("stream").eqNullSafe(F.col("of")) & (F.col("range") == F.col("part")))
    numbered = numbered.select("row", "stream", F.floor(number / block_rows).cast("long").alias("block"), F.pmod(number, F.lit(block_rows)).cast("int").alias("place"))
    slot = F.expr(f"(block div w) * {total} + slots[cast(block % w as int)]")
    placed = numbered.join(streams, F.col("stream").eqNullSafe(F.col("s")))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in own], "stream", "block", F.expr(f"(block * {total}) div w").alias("release"),
                         F.expr(f"((block + 1) * {total} + w - 1) div w").alias("deadline"), slot.cast("long").alias("slot"), "place")
