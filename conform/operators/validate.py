"""Record checks: what extraction could not read, and values outside a target's vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conform.functions import messages as msg
from conform.functions.text import quoted


def outside(value: Column, allowed: Sequence[str]) -> Column:
    """True where ``value`` is none of ``allowed``; a missing value is none of them."""
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def parse_error(severity: Column, page: Column, page_text: Column, vocabulary: Sequence[str]) -> Column:
    """Reason a record could not be read, or null. The document still converts."""
    return F.when(
        outside(severity, vocabulary), F.concat(F.lit("severity "), F.coalesce(quoted(severity), F.lit("None")), F.lit(" outside vocabulary"))
    ).when(page.isNull(), F.concat(F.lit("page column unparseable: "), quoted(page_text)))


def vocabulary_violations(columns: Sequence[str], vocabularies: Mapping[str, Sequence[str]]) -> Column:
    """Array of violations of one row; fields without a rule always pass, a missing value passes no rule."""
    checks = [
        F.when(
            outside(F.col(f), allowed),
            F.struct(
                F.lit(f).alias("field"), F.lit(msg.INVALID_VALUE).alias("kind"), F.coalesce(F.col(f), F.lit("")).alias("value"),
                F.concat(F.lit("value "), F.coalesce(quoted(F.col(f)), F.lit("None")),
                         F.lit(f" for '{f}' is none of the values the template allows")).alias("reason"),
                F.lit("give the value map or the vocabulary of the template a newer version").alias("suggestion"),
            ),
        )
        for f, allowed in vocabularies.items() if f in columns
    ]
    empty = F.array().cast("array<struct<field:string,kind:string,value:string,reason:string,suggestion:string>>")
    return F.array_compact(F.array(*checks)) if checks else empty


def split_by_vocabulary(rows: DataFrame, vocabularies: Mapping[str, Sequence[str]]) -> DataFrame:
    return rows.withColumn("violations", vocabulary_violations(rows.columns, vocabularies))

