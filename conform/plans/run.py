"""One conversion run: gate documents, resolve records for each target, validate, score.

The gate's narrow result (one row per document) is stored once and feeds records, exceptions and scores. Everything else is
lazy; ``freeze`` stores the outcome of a target for runs that write several things from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conform.functions import messages as msg
from conform.operators import checks, detect, mapping, score, validate
from conform.operators.joins import attach_group
from conform.session import discard, packed as stage
from conform.sources.config import Profile, Template, coverage, required_prompts

HEADER_PATHS = {k: k for k in ("inspection_name", "report_date", "inspection_type", "company")}
FINDING_PATHS = {k: k for k in ("id", "severity", "user_tags", "issues", "comments", "page")}
LISTS = frozenset({"user_tags", "issues"})


@dataclass(frozen=True)
class Bundle:
    """One mapping into one target template."""

    doc: dict
    template: Template


@dataclass
class Run:
    documents: DataFrame
    findings: DataFrame
    counts: DataFrame
    bundles: Sequence[Bundle]
    value_maps: Mapping
    answers: Mapping[str, str]
    profiles: Sequence[Profile]
    run_profile: str
    anchors: Mapping[str, str]
    severities: Sequence[str]
    #: Content hashes (column ``sha``) that earlier runs converted: documents with one are copies.
    known: DataFrame | None = None
    #: Registered pictures (column ``sha``), for targets that show some.
    images: DataFrame | None = None
    #: Where intermediate tables go; the shared folder if not given.
    work: str | None = None
    frozen: dict[str, DataFrame] = field(default_factory=dict)
    #: Whether ``records`` is a stored table.
    stored: bool = False

    def __post_init__(self) -> None:
        missing = sorted({k for b in self.bundles for k in required_prompts(b.doc)} - set(self.answers))
        if missing:
            raise ValueError("missing per-batch prompt answers: " + ", ".join(missing))
        if not self.bundles:
            raise ValueError("a run needs at least one mapping")

    @cached_property
    def gated(self) -> DataFrame:
        judged = detect.gate(self.documents, self.counts, self.profiles, self.run_profile, self.anchors, self.known)
        headed = mapping.with_header_formulas(judged.drop("lead_text"), [b.doc for b in self.bundles], self.scope)
        return stage(headed, "gated", self.work)

    @property
    def scope(self) -> mapping.Scope:
        return mapping.Scope(HEADER_PATHS, FINDING_PATHS, self.answers, LISTS)

    @cached_property
    def records(self) -> DataFrame:
        """Findings of the documents that passed the gate, with their header."""
        made = [c for c in self.gated.columns if c.startswith(mapping.FORMULA)]
        open_docs = self.gated.filter(F.col("blocked_kind") == "").select("doc_id", "document", "extracted", *HEADER_PATHS.values(), *made)
        joined = attach_group(self.findings, open_docs, ["doc_id"], "extracted", F.col("record_seq"), how="inner")
        return joined.withColumn(
            "parse_error", validate.parse_error(F.col("severity"), F.col("page"), F.col("page_text"), self.severities))

    KEEP = ("doc_id", "document", "record_seq", "id")

    def resolved(self, bundle: Bundle) -> DataFrame:
        return mapping.resolve(self.records, bundle.template.columns, bundle.doc, self.scope, self.value_maps,
                               (*self.KEEP, "parse_error"))

    def freeze(self, *bundles: Bundle) -> Run:
        """Store the outcomes of these targets (of all by default), so that each is computed once; several share the stored records."""
        todo = [b for b in bundles or self.bundles if b.template.ref not in self.frozen]
        if len(todo) > 1:
            self.keep_records()
        for b in todo:
            if b.template.ref not in self.frozen:
                self.frozen[b.template.ref] = stage(self.outcome(b), "outcome", self.work and f"{self.work}/{b.template.name}")
        return self

    def keep_records(self) -> None:
        """Store the records, for targets that are frozen one after the other."""
        if not self.stored:
            self.records, self.stored = stage(self.records, "records", self.work), True

    def release(self, bundle: Bundle) -> None:
        """Remove the stored outcome of a target that nothing reads any more."""
        if self.work and self.frozen.pop(bundle.template.ref, None) is not None:
            discard(self.documents.sparkSession, f"{self.work}/{bundle.template.name}")

    def outcome(self, bundle: Bundle) -> DataFrame:
        """Every record with its target values, its problems and its vocabulary violations."""
        if bundle.template.ref in self.frozen:
            return self.frozen[bundle.template.ref]
        cols = bundle.template.columns
        df = self.resolved(bundle)
        df = df.select(*self.KEEP, "parse_error", "problems", *[F.col(f"t_{c}.value").alias(c) for c in cols])
        bad = F.col("parse_error").isNotNull() | (F.size("problems") > 0)
        empty = F.array().cast("array<struct<field:string,kind:string,value:string,reason:string,suggestion:string>>")
        unread = F.array(F.struct(
            F.lit("").alias("field"), F.lit(msg.RECORD_PARSE).alias("kind"), F.lit("").alias("value"),
            F.col("parse_error").alias("reason"),
            F.lit("look at this line of the source").alias("suggestion")))
        errors = F.when(F.col("parse_error").isNotNull(), unread).when(F.size("problems") > 0, F.col("problems")).otherwise(
            validate.vocabulary_violations(cols, bundle.template.vocabularies))
        df = df.withColumn("errors", F.coalesce(errors, empty)).withColumn("unresolved", bad).drop("problems")
        return self._laid_out(df, bundle.template)

    def _laid_out(self, df: DataFrame, template: Template) -> DataFrame:
        """Add what a form or an overlay cannot take to the errors of rows that have none so far."""
        if not template.layout:
            return df
        pictures = [r["target_field"] for r in template.layout if r["kind"] == "image"]
        tests = checks.form_checks(template.layout) if template.kind == "pdf_form" else checks.overlay_checks(template.layout)
        for name in pictures:
            stored = self.images.select(F.col("sha").alias(name)).distinct().withColumn(f"_has_{name}", F.lit(True))
            df = df.join(stored, name, "left")
            tests.append(F.when((F.coalesce(name, F.lit("")) != "") & F.col(f"_has_{name}").isNull(), F.struct(
                F.lit(name).alias("field"), F.lit(checks.BAD_IMAGE).alias("kind"), F.col(name).alias("value"), F.lit(checks.NO_IMAGE).alias("reason"))))
        found = F.transform(F.array_compact(F.array(*tests)), lambda p: F.struct(
            p["field"].alias("field"), F.lit(msg.INVALID_VALUE).alias("kind"), F.coalesce(p["value"], F.lit("")).alias("value"), p["reason"].alias("reason"),
            F.lit("correct the mapping or the value, or give the template a new version").alias("suggestion")))
        return df.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")).otherwise(found)).drop(*[f"_has_{n}" for n in pictures])

    @staticmethod
    def rows(outcome: DataFrame, bundle: Bundle) -> DataFrame:
        """Legal rows of a target; a per-batch target has the first of each document."""
        cols = bundle.template.columns
        legal = outcome.filter(F.size("errors") == 0).select("doc_id", "document", "record_seq", *cols)
        if bundle.template.cardinality == "per_record":
            return legal
        first = F.min_by(F.struct("record_seq", *cols), "record_seq").alias("r")
        return legal.groupBy("doc_id", "document").agg(first).select("doc_id", "document", "r.*")

    @staticmethod
    def record_exceptions(outcome: DataFrame, bundle: Bundle) -> DataFrame:
        return outcome.select("doc_id", "document", F.coalesce("id", F.lit("?")).alias("record_ref"), F.explode("errors").alias("e")).select(
            "doc_id", "document", "record_ref", "e.kind", "e.field", "e.value", "e.reason", "e.suggestion",
            F.lit(bundle.template.ref).alias("template"))

    def exceptions(self) -> DataFrame:
        out = detect.document_exceptions(self.gated)
        for b in self.bundles:
            out = out.unionByName(self.record_exceptions(self.outcome(b), b))
        return out

    def tier_coverage(self) -> float:
        return min(coverage(b.doc, b.template.required) for b in self.bundles)

    def verdicts(self) -> DataFrame:
        """Scores need only counts, so one narrow aggregate per bundle feeds them."""
        per_doc = None
        for b in self.bundles:
            legal = F.count_if(F.size("errors") == 0)
            counted = self.outcome(b).groupBy("doc_id").agg(
                (legal if b.template.cardinality == "per_record" else F.least(legal, F.lit(1))).alias("rows_converted"),
                F.sum(F.size("errors")).alias("n_exc"),
                F.sum(F.size(F.filter("errors", lambda e: e["kind"] == msg.OOV_VALUE))).alias("n_oov"))
            per_doc = counted if per_doc is None else per_doc.unionByName(counted)
        if len(self.bundles) > 1:
            per_doc = per_doc.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("rows_converted", "n_exc", "n_oov")])
        return score.verdicts_from_counts(self.gated, per_doc, self.tier_coverage())
