"""Join helpers that stay correct and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.session import MAX_CONFIG_ROWS

#: A key with more rows than this is "hot": its rows are spread over several tasks.
HOT_ROWS = 2_000_000


def config_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A frame of driver-side configuration, broadcast while it is small and joined like a table beyond that."""
    frame = spark.createDataFrame(list(rows), schema)
    return F.broadcast(frame) if len(rows) <= MAX_CONFIG_ROWS else frame


def grows(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never broadcast, whatever its estimated size.

    The optimizer knows exploded rows by the size of the rows before, and stored columns by their compressed size: a table of
    repetitive texts that it takes for some megabytes may fill the driver.
    """
    return side.hint("merge")


def hot_keys(sizes: DataFrame, keys: Sequence[str], count: str, hot_rows: int) -> DataFrame:
    """Keys above ``hot_rows`` with the number of slices each needs.

    At most total_rows / hot_rows keys qualify, so the result is small by construction.
    """
    return sizes.filter(F.col(count) > hot_rows).select(
        *keys, F.ceil(F.col(count) / F.lit(hot_rows)).cast("int").alias("slices")
    )


def attach_group(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    count: str,
    spread: Column,
    hot_rows: int | None = None,
    how: str = "left",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join per-group values (one row per key, with its row count) back onto the rows.

    A plain equi join would send every row of a hot key to one task, and adaptive skew handling
    cannot split a side that comes straight out of an aggregation. Hot keys are therefore sliced:
    their rows get a slice number from ``spread``, their group row is repeated once per slice.
    Keys that are not hot keep one slice, so nothing is replicated for them. ``sizes`` (keys and
    count) may be given where the row counts are cheaper to get than the group values.
    """
    hot_rows = hot_rows or HOT_ROWS
    hot = F.broadcast(hot_keys(groups if sizes is None else sizes, keys, count, hot_rows))
    sliced = (
        rows.join(hot, list(keys), "left")
        .withColumn("_slice", F.when(F.col("slices").isNotNull(),
                                     F.pmod(F.xxhash64(spread), F.col("slices"))).otherwise(F.lit(0)).cast("int"))
        .drop("slices")
    )
    n = F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(hot_rows)).cast("int"))
    repeated = groups.withColumn("_slice", F.explode(F.sequence(F.lit(0), n - 1)))
    return sliced.join(repeated, [*keys, "_slice"], how).drop("_slice")
