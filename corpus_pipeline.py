"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and hands it on. All but the last
return the columns of ``documents``. Stages judge every row of their input from whole texts; empty input gives empty output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.llm import jaccard, langid, mixing, pii, winnow
from conform.llm.catalog import table
from conform.llm.queries import MIX_BLOCK, MIX_OTHER, MIX_WEIGHTS
from conform.session import shared_dir


#: Rows of an Arrow batch: documents are long, and both sides of a Python worker hold a batch or two.
BATCH_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words of a shingle, and the Jaccard similarity in percent from which two documents are near copies.
COPY_WORDS, COPY_PERCENT = 5, 80


def small_batches(spark: SparkSession) -> None:
    """A stage's plan runs after the stage returned, so the setting stays; ``run`` puts the caller's back."""
    spark.conf.set(BATCH_KEY, str(min(BATCH_ROWS, int(spark.conf.get(BATCH_KEY)))))


def spare(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language; ``lang`` becomes the language found where it was null.

    Null texts and texts without a letter go, and nothing else does: where no row is labelled there is no model, and all other
    texts stay as they are. Rows are judged one by one from whole texts, so repeated rows share their fate. Extra columns stay,
    whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    model = langid.fit(docs.filter(langid.in_training()))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    out = spare(docs, "_language")
    judged = docs.withColumn(out, langid.predict(F.col("text"), model))
    kept = judged.filter(F.col(f"{out}.lang") != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", f"{out}.lang")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies by five-word shingles: that with the smallest id.

    Pairs that the SimHash operator links are compared first, keys of least values find the rest, and a pair counts from an exact
    Jaccard similarity of 0.8. Texts without words (null, empty, blank) are copies of each other; a class without ids keeps one
    row; of rows that share id and text one stays. Extra columns stay, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, COPY_WORDS, COPY_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words stands in passages of the benchmark.

    Texts without words stay; repeated rows share their fate. Extra columns stay, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    out = spare(docs, "_overlap")
    found = winnow.with_overlap(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.filter(~winnow.contaminated(out)).select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the new text.

    Every row stays. A null text stays null, as does its ``n_chars``; repeated rows get equal texts. Extra columns stay, whatever
    their names; an empty table stays empty.
    """
    small_batches(spark)
    clean = docs.withColumn("text", pii.redact(F.col("text"), pii.fit(docs)))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its place in the mixture of sources.

    Every row gets a place of its own, repeated rows too; null sources share the stream of sources without a weight, and rows with
    null ids come first in their stream. No text is read. An empty table gives no places.
    """
    return mixing.mix(docs, MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal", personal), ("mixture", mixture)]

#: The stages learn models and hash with XXH64, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_KEY)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(BATCH_KEY, before)
    return docs
