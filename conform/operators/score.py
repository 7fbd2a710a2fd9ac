"""Verdicts and the batch card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.functions import messages as msg

# The verdicts, in order.
VERDICTS = ("pass", "warn", "block")


def value_coverage(oov: Column, findings: Column) -> Column:
    """Share of findings whose lookups all succeeded; rounded half to even at four places."""
    share = F.lit(1.0) - F.try_divide(oov, findings)
    return F.when(findings == 0, 1.0).otherwise(F.bround(F.greatest(F.lit(0.0), share), 4))


def verdicts_from_counts(gated: DataFrame, per_doc: DataFrame, tier_coverage: float) -> DataFrame:
    """One row for every document of the batch, whatever became of it.

    ``per_doc`` holds rows_converted, n_exc and n_oov per converted document; a quarantined
    document has exactly one exception of its own.
    """
    blocked = F.col("blocked_kind") != ""
    unread = F.col("blocked_kind").isin(msg.DUPLICATE, msg.UNKNOWN_PROFILE)
    df = gated.select(
        "doc_id", "document", "sha", "blocked_kind", "reason",
        F.when(unread, F.lit(0)).otherwise(F.col("extracted")).cast("long").alias("findings_total"),
    ).join(per_doc, "doc_id", "left").fillna(0, ["rows_converted", "n_exc", "n_oov"])
    n_exc = F.col("n_exc") + F.when(blocked, 1).otherwise(0)
    return df.select(
        "doc_id", "document", "sha",
        F.when(blocked, "block").when(n_exc > 0, "warn").otherwise("pass").alias("verdict"),
        "blocked_kind", "reason", "findings_total", F.col("rows_converted").cast("long").alias("rows_converted"),
        n_exc.cast("long").alias("exception_count"),
        value_coverage(F.col("n_oov"), F.col("findings_total")).alias("value_coverage"),
        F.lit(float(round(tier_coverage, 4))).alias("tier_coverage"),
    )


def batch_card(verdict: DataFrame) -> DataFrame:
    """Totals of a batch. Blocked documents stay a relation (``verdict = 'block'``), not one list."""
    return verdict.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS],
        F.coalesce(F.sum("exception_count"), F.lit(0)).cast("long").alias("exceptions_total"),
    )


def run_summary(verdict: DataFrame) -> DataFrame:
    return verdict.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("verdict") != "block").alias("converted"),
        F.count_if(F.col("verdict") == "block").alias("blocked"),
        F.coalesce(F.sum("exception_count"), F.lit(0)).cast("long").alias("exceptions"),
    )
