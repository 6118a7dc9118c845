"""The registered queries of this subpackage: each applies one operator to its whole table.

``QUERIES`` and ``ORACLE`` have the form of the driver's contract. Tokenizer files are a parameter of the operators; the
queries name the public files that the contract names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, decontamination, exact, html, licences, line_chunks, manifest, near_duplicates, perplexity, spelling, substrings, token_counts
from .common import importable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            importable(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = classifier.with_scores(docs, table(spark, folder, "labels"), keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op10_html_main_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html.with_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op5_perplexity_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return perplexity.with_verdicts(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper"
    )


@query("op9_substring_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    spans = substrings.repeated_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return spans.select(F.col("doc").alias("doc_id"), "start", "end", "n_words", "removed", F.col("first_doc").alias("first_doc_id"))


@query("op2_near_duplicates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.with_components(table(spark, folder, "documents"))


@query("op4_line_dedup", line_chunks.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    text = F.coalesce("text", F.lit(""))
    return line_chunks.deduplicated(docs, removed="n_removed_lines").select(
        "doc_id", "n_lines", "n_removed_lines", F.char_length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5")
    )


@query("op6_licence_scan", licences.SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.with_licences(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("licence_sentences", ",").alias("licence_sentences"))


@query("op1_decontamination")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    doc = F.when(F.col("doc") != (1 << 63) - 1, F.col("doc"))
    return found.select(doc.alias("doc_id"), "item_id", F.col("similarity"), F.col("start").cast("long").alias("start_word"), F.col("n").cast("long").alias("n_words")).distinct()


@query("op11_spelling_variants", spelling.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    runs = spelling.runs(table(spark, folder, "documents"), "text", 7, "doc_id")
    words = runs.select(spelling.planted(F.col("run"), F.col("doc_id")).alias("word"))
    return spelling.groups(spelling.vocabulary(words)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_merkle_manifest", manifest.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    shorter = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select("doc_id", "source", manifest.leaf(*fields.values()).alias("leaf"), F.when(changed, manifest.leaf(*(fields | {"text": shorter}).values())).alias("tampered"))
    proved = manifest.manifest(leaves)
    folded = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_exact_dedup", exact.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", exact.text_digest("text").alias("text_sha256"))
    return exact.with_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
