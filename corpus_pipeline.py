"""Corpus pipeline: from raw documents to packed training sequences, stage by stage.

Every stage reads the table that the one before wrote. Rejected documents go in stage one,
exact copies in stage two, near copies in stage three; stage four masks secrets and keeps
every document; stage five packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from token_ledger.llm import exact_dedup, ngram_jaccard, packing, quality, runtime, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the model is fitted on the documents that come in.

    Null and empty texts go (too few words); repeated rows get one verdict and stay repeated;
    very long texts are read whole; other columns pass through. No rows give no rows.
    """
    ratio = quality.fit_log_ratio(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, ratio)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id.

    Null and empty texts are one text; a null id stays only if its text has no other; of rows
    that repeat id and text one stays, by a hash of its columns. Other columns pass through,
    whatever their names. No rows give no rows.
    """
    return exact_dedup.one_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Documents without words are copies of each other; ties of an id go by a hash of id and
    text; of rows that repeat both one stays. A null id stays only if its group has no other.
    Very long texts are compared whole; other columns pass through, whatever their names. No
    rows give no rows.
    """
    found = ngram_jaccard.ngram_jaccard_join(docs).filter("kept").select("row_key")
    kept = runtime.staged(found, "pipeline-kept")
    out = docs.join(kept, F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit(""))) == kept["row_key"], "left_semi")
    return out if kept.groupBy("row_key").count().filter("count > 1").isEmpty() else exact_dedup.one_of_each(out)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked.

    Null texts stay null, rows without a secret stay as they are, repeated rows stay
    repeated, very long texts are read whole, other columns pass through; ``n_chars`` follows
    the text where there is such a column. No rows give no rows.
    """
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    A null or empty text is one end token; a repeated row has pieces of its own; only texts
    of more than 2048 tokens are cut; other columns are not read. No rows give no rows.
    """
    import public_tokenizers as tokenizers

    return packing.pack_documents(docs, tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Models, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
