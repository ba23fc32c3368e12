"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import (
    chat,
    decontaminate,
    exactdup,
    html_text,
    langid,
    licenses,
    manifest,
    neardup,
    packing,
    periodic_runs,
    pii,
    repeats,
    url_rules,
)
from ticketlens.session import use_utc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  role.alias("role"), F.lit(said).alias("text"))
    return chat.chat_digest(chat.format_chat(turns.unionByName(extra)))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.exact_duplicates(_table(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return licenses.license_summary(licenses.scan_licenses(docs))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, folder, "pages").select("page_id", "url")).drop("url")


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.pii_summary(pii.find_pii(docs))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.find_contamination(docs, _table(spark, folder, "benchmark"))
    return decontaminate.contamination_summary(marked)


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit_language_model(docs, public_tokenizers.path("piece_bpe_32k.model"))
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                        "language.lang_pred", "language.score")


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    read = html_text.extract_text(pages, html_text.fit_labeller(pages))
    return read.select("page_id", "url", F.col("main_text").alias("text"),
                       F.length("main_text").cast("long").alias("n_chars"))


def op2_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), width=4)


def op11_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = repeats.remove_repeats(docs, digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.col("kept").cast("string").alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    built = manifest.build_manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"],
        changed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return manifest.climb(built).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.planted_runs(_table(spark, folder, "documents"))
    return periodic_runs.run_digest(periodic_runs.find_runs(docs))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_minhash_neardup, op3_html_text, op4_url_filter, op5_best_fit_packing, op6_exact_dedup, op7_license_scan, op8_language_id, op9_decontaminate, op10_pii, op11_repeated_passages, op12_merkle_manifest, op13_periodic_runs)}
