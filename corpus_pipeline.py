"""A corpus pipeline: language identification, line dedup, near-dedup, secret scan and packing of `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which `run`
writes as Parquet to the shared folder and rereads as the next stage's docs. All stages but the last return the columns
of docs.

Null ids, and ids that several rows share, are fine: stages go by row or by id and text. Null texts go with the first stage, as do
empty ones; repeated rows count as copies of each other from near-dedup on; extra columns stay until packing, whatever their names;
an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _batches(spark: SparkSession) -> None:
    """Texts are long and executors serve all stages in turn: fewer rows go to Python at a time than Spark's default of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null text, or no letter); a document's predicted language becomes its lang."""
    from rasterloom.llm.op10_language_id import fit, predict_rows

    _batches(spark)
    predicted = predict_rows(docs, fit(docs))
    kept = predicted.where("lang_pred <> 'und'")
    return kept.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _with_text(docs: DataFrame, text: Column) -> list:
    """The columns of docs out of `row`, with another text and its length."""
    return [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier one; a document of which nothing but white space is left goes."""
    from rasterloom.llm.op2_line_dedup import deduplicate

    found = deduplicate(docs)
    left = found.where((F.col("n_removed") == 0) | F.rlike("clean", F.lit(r"[^\x20\x09-\x0D]")))
    return left.select(*_with_text(docs, F.col("clean")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near duplicates."""
    from rasterloom.llm.op7_minmax_dedup import keep_one

    _batches(spark)
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; no document goes."""
    from rasterloom.llm.op1_secret_scan import redact

    cleaned = redact(docs)
    return cleaned.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places in sequences of 1024 tokens."""
    import public_tokenizers

    from rasterloom.llm.op6_best_fit_packing import pack_documents

    _batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=32 << 20)  # workers also serve the other stages


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]
#: SQL can't express the trained classifier nor the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.shared import fresh_dir

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
