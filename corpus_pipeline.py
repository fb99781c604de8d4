"""A corpus from documents: quality, near duplicates, decontamination, secrets, tokens.

Each stage reads what the stage before it kept, from the written table; all but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, quality_classifier, secret_scan, sentencepiece_codec
from tidemark.llm.common import table, written
from tidemark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier scores below one half go.

    Null and empty texts score by the bias alone; every row is judged by its own text, so repeated ids and rows share
    nothing but their texts' scores; null ids are judged too; without labels nothing goes."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality_classifier.with_scores(docs, model).filter("score >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on five-word shingles at 0.8: of each group one row of the smallest doc_id stays.

    Rows are judged by their texts: unlike texts under one doc_id do not stand for each other. Null and empty texts
    and null ids stay; an empty table stays empty."""
    return jaccard_join.deduplicated(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that cover half of a benchmark item or more go.

    Rows are judged by their texts, whatever their ids: the verdict is on a hash of the text, so a clean text stays where
    another one of its id goes. Null and empty texts and null ids stay; an empty table stays empty."""
    hashed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontamination.contaminated(hashed, table(spark, sf_dir, "benchmark")).select("doc_id").distinct().alias("f")
    return docs.alias("d").join(found, F.xxhash64("d.text") == F.col("f.doc_id"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: secrets are replaced in the texts; no document goes.

    Null and empty texts, null and repeated ids stay as they are; n_chars follows the text."""
    return secret_scan.redacted(docs, secret_scan.fitted(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids of every text, and digests of what they decode to; a row for every row, null text as empty."""
    coded = sentencepiece_codec.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("sentencepiece", tokens),
]

#: The classifier, the tiling and the merge rounds have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
