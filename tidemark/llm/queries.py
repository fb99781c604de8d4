"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    jaccard_join,
    license_scan,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    substring_dedup,
    suffix_array,
    token_store,
    warc,
    whitening,
)
from .common import shared_dir, table


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), "quality")
    scored = quality_classifier.with_scores(docs.select("doc_id", "text"), model)
    held_out = quality_classifier.fold(F.col("doc_id")) == 1
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(table(spark, sf_dir, "documents"), 50)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), 50).drop("kept_text")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "op4-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end=2)
    stored = token_store.read_store(spark, folder)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, items).drop("tiles")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.findings(docs, secret_scan.fitted(docs))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), 3, 90)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "op9-warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    pages = warc.read_archives(spark, folder)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = sentencepiece_codec.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeat_some_words(table(spark, sf_dir, "documents"))
    found = periodic_runs.collapse_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.on_grid(table(spark, sf_dir, "embeddings"))
    return whitening.by_component(rows, whitening.fit(rows, 32))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_suffix_array": op2_suffix_array,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_store": op4_token_store,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_whitening": op12_whitening,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {
    "op8_quality_rules": quality_rules.ORACLE,
    "op13_license_scan": license_scan.ORACLE,
}
