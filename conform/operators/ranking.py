"""Positions inside a group without putting the whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def position_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Add ``position`` (1-based) of every row within its group.

    ``bucket`` must grow with ``order``. Rows are ranked inside (group, bucket) and shifted by the
    sizes of the earlier buckets, so only the short list of bucket sizes is ordered per group.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return b.join(offsets, [*keys, "_bucket"]).withColumn("position", F.col("_offset") + rank).drop("_bucket", "_offset")
