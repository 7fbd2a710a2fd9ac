"""The registered queries: each operator over its whole table, reduced to the columns that are compared."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.llm import align, divergence, editembed, langid, mixing, pieces, pii, simhash, substring, toxicity, urls, warc, winnow
from conform.llm import oracle as sql
from conform.llm.catalog import query, table
from conform.session import shared_dir

#: Target weights of the mixture; sources without one share the last.
MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK = {"src0": 4, "src1": 3, "src2": 3, "src3": 2}, 8, 16

#: Rules of the address query: host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def hex_digest(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query("op1_warc_bundles", sql.WARC)
def warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back and list their records."""
    stored = warc.write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")
    return warc.read(stored).select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))


@query("op2_repeated_passages", sql.REPEATS)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove passages of 20 words and more that also start earlier."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), words=20)
    return out.select("doc_id", "n_words", "n_removed", hex_digest(F.col("kept_text")).alias("kept_sha256"))


def joined_spans(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in every document."""
    found = pii.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("personal.base", lambda s: s["kind"])
    count = [F.size(F.array_remove(kinds, k)).cast("long") for k in pii.KINDS]
    count = [(F.size(kinds) - n).alias(f"n_{k}") for k, n in zip(pii.KINDS, count, strict=True)]
    return found.select("doc_id", *count, hex_digest(joined_spans(F.col("personal.base"))).alias("base_sha256"), joined_spans(F.col("personal.all")).alias("spans"))


@query("op4_benchmark_overlap", sql.OVERLAP)
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find passages of the benchmark in every document."""
    found = winnow.with_overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("overlap.items", lambda i: i.cast("string"))))
    return found.select("doc_id", "overlap.n_words", winnow.n_hit().alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        hex_digest(F.array_join(items, ",")).alias("items_sha256"), winnow.contaminated().alias("contaminated"))


@query("op5_source_mix", sql.mix(MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK))
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place every document in a mixture of its sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK)


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, learning from the labels open to training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (~langid.in_training()).alias("held_out"), toxicity.score(F.col("text"), model).alias("_s"))
    return scored.select("doc_id", "held_out", F.col("_s.score").alias("score"), (F.col("_s.score") >= 0.5).cast("int").alias("predicted"))


@query("op7_url_verdicts", sql.URLS)
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's address, aliases included."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge(pages, rules, urls.page_links(pages))


@query("op8_simhash_classes")
def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents."""
    out = simhash.near_copies(table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_edit_fingerprints")
def edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    out = editembed.with_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", hex_digest(F.col("edited_text")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op10_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows open to training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = langid.identify(docs, docs.filter(langid.in_training()))
    return judged.select("doc_id", (~langid.in_training()).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query("op11_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and the text they decode to."""
    found = pieces.with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), binary=True)
    ids = F.col("pieces.ids")
    return found.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        hex_digest(F.col("pieces.decoded")).alias("decoded_sha256"), F.col("pieces.agrees").alias("agrees"))


@query("op12_source_divergence", sql.divergence(30, 50))
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources of a language differ most, and by which terms."""
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    groups = F.col("alignment.groups")
    return align.with_links(
        table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        "doc_id", "alignment.n_a", "alignment.n_b", "alignment.n_groups",
        F.when(groups == "", "").otherwise(hex_digest(groups)).alias("groups_sha256"))
