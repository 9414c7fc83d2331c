"""A corpus pipeline of five stages, each calling one of the training-data operators.

language   the byte network labels every document; one that is null or has no letter goes.
near_dups  one row of each SimHash component stays: that with the smallest doc_id, null being the largest.
benchmark  a document that holds a benchmark passage goes.
secrets    secrets found in a text are masked; all documents stay.
encode     byte-level BPE: the ids of what is left, with their digests.

Every stage but the last returns the columns of `documents`; `n_chars` follows the text. Rows that
share a doc_id, or have none, are decided one by one, by doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import bpe, common, decontaminate, langid, secrets, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is in no language at all."""
    labelled = langid.identify(docs, langid.learnt(docs), keep=COLUMNS)
    return labelled.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component, by doc_id and text."""
    stay = simhash.kept_rows(docs).select(F.col("doc_id").alias("stays"), F.col("tk").alias("stays_tk"))
    keyed = docs.select(*COLUMNS, common.text_key(F.col("text")).alias("tk"))
    if _repeats(docs):  # copies of a row become one before any exchange
        one = keyed.groupBy("doc_id", "tk").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        keyed = one.select("doc_id", "row.*", "tk")
    same = F.col("doc_id").eqNullSafe(F.col("stays")) & (F.col("tk") == F.col("stays_tk"))
    return keyed.join(stay.hint("shuffle_hash"), same, "left_semi").select(*COLUMNS)


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id stands in more than one row."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    found = decontaminate.find_phrases(docs, common.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; n_chars is that of the masked text."""
    scanned = secrets.scan_documents(docs, with_text=True, keep=COLUMNS)
    return scanned.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long")).alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the ids."""
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [("language", language), ("near_dups", near_dups), ("benchmark", benchmark), ("secrets", mask_secrets), ("encode", encode)]
#: No SQL: networks, XXH64 fingerprints and tokenizers are beyond it; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
