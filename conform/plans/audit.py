"""Audited runs: outputs first, the run record last; readers only see committed runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform import sinks
from conform.operators import score
from conform.operators.joins import grows
from conform.plans.run import Bundle, Run
from conform.session import discard, packed as stage
from conform.sources.config import Template


def pins(bundle: Bundle) -> dict:
    """What a later run needs to repeat this one: versions of the mapping, its value maps and its target."""
    meta = bundle.doc["meta"]
    maps = sorted({(r["value_map"]["name"], r["value_map"]["version"]) for r in bundle.doc.get("routes", {}).values() if r.get("value_map")})
    return {"source_profile": meta["source_profile"], "target_template": meta["target_template"], "version": meta["version"], "value_maps": maps}


def manifest(run: Run) -> DataFrame:
    """One entry per converted document and target, also where a document gave no row."""
    heads = run.gated.filter(F.col("blocked_kind") == "").select("document", "sha")
    out = None
    for b in run.bundles:
        hashed = sinks.content_hash(run.rows(run.outcome(b), b), ["document"], "record_seq", b.template.columns)
        m = heads.join(hashed, "document", "left").select("document", "sha", F.lit(b.template.ref).alias("template"),
            F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))
        out = m if out is None else out.unionByName(m)
    return out


def commit_run(run: Run, run_id: str, path: str) -> None:
    """Write rows, exceptions, card and manifest of a run under ``path``, then its record.

    The gate and the outcome of every target are stored once in a folder of the run, which goes after the commit; all outputs
    are branches of them. An interrupted run leaves no record and is never read. A run id is committed once only. Rows, exceptions
    and card are packed (gzip), tables are zstd: a run is kept for long.
    """
    spark = run.documents.sparkSession
    if not committed(spark, path).filter(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id!r} is committed already")
    home = f"{path}/run={run_id}"
    run.work = f"{home}/_work"
    run.freeze()
    for b in run.bundles:
        sinks.write_documents(run.rows(run.outcome(b), b), f"{home}/{b.template.name}", b.template.columns, compression="gzip")
    sinks.write_exceptions(run.exceptions(), f"{home}/exceptions", "gzip")
    table = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{home}/{name}")
    judged = run.verdicts()
    table(judged, "verdicts")
    verdicts = spark.read.schema(judged.schema).parquet(f"{home}/verdicts")
    table(run.exceptions().groupBy("doc_id", "kind").agg(F.count("*").alias("exceptions")), "exception_kinds")
    sinks.write_card(verdicts, score.batch_card(verdicts), f"{home}/card", "gzip")
    table(manifest(run), "manifest")
    digest = sinks.content_hash(run.documents, [], "document", ["sha"])
    this = F.lit(run_id).alias("run_id")
    record = score.run_summary(verdicts).select(this, "*").join(digest.select(this, F.col("content_hash").alias("batch_digest")), "run_id").select(
        "*", F.lit(",".join(b.doc["meta"]["target_template"] for b in run.bundles)).alias("mappings"),
        F.lit(json.dumps(dict(run.answers), sort_keys=True)).alias("answers"),
        F.lit(json.dumps([pins(b) for b in run.bundles], sort_keys=True)).alias("pins"))
    record.write.mode("append").parquet(f"{path}/runs")
    discard(spark, run.work)


RECORD = ("run_id string, documents long, converted long, blocked long, exceptions long, batch_digest string, mappings string, answers string, pins string")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The records of all committed runs; none where nothing was committed yet."""
    try:
        return spark.read.schema(RECORD).parquet(f"{path}/runs")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def replay(spark: SparkSession, path: str, run_id: str, make: Callable[[Sequence[Bundle], Mapping[str, str]], Run],
           mappings: Mapping[tuple[str, str, int], dict], templates: Mapping[str, Template]) -> DataFrame:
    """Run again what the record of ``run_id`` pinned and compare with the stored manifest.

    ``mappings`` holds definitions by (source profile, target template, version), also newer ones than the record names;
    ``make`` builds the run from bundles and answers. One row per document and target of either side: ``n_rows`` as stored
    (null if not stored) and ``verified``, true where document and output have the recorded hashes. Both hashes of a side meet the
    other's as one. One target alone is worked out on the way to its hashes and not stored; what is stored goes when both met.
    """
    record = committed(spark, path).filter(F.col("run_id") == run_id).first()
    if record is None:
        raise ValueError(f"no committed run {run_id!r}")
    bundles = [Bundle(mappings[p["source_profile"], p["target_template"], p["version"]], templates[p["target_template"]]) for p in json.loads(record.pins)]
    run = make(bundles, json.loads(record.answers))
    run.work = f"{path}/_replay/{uuid.uuid4().hex}"
    if len(bundles) > 1:
        run.freeze()
    both = lambda df, name, *more: df.select("document", "template", *more, F.unhex(F.sha2(F.concat_ws(
        ",", *[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in ("sha", "content_hash")]), 256)).alias(name))
    again = both(manifest(run), "now")
    stored = both(spark.read.parquet(f"{path}/run={run_id}/manifest"), "then", "n_rows")
    met = stage(stored.join(grows(again), ["document", "template"], "full").select("document", "template", "n_rows", F.col("then").eqNullSafe(F.col("now")).alias("verified")), "replay")
    discard(spark, run.work)
    return met


def run_detail(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Every document of a committed run with its verdict and its exceptions by kind, from the stored tables."""
    home = f"{path}/run={run_id}"
    kinds = spark.read.parquet(f"{home}/exception_kinds")
    return spark.read.parquet(f"{home}/verdicts").select("doc_id", "document", "verdict").join(kinds, "doc_id", "left").select(
        "document", "verdict", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("exceptions", F.lit(0)).cast("long").alias("exceptions"))
