"""The thin queries of the training-data operators: each applies one, whole, to its tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    # a deployment sets its own secret; the tables here are invented
    return pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.framequarry.pii.key", "key of the invented tables"))


def op9_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitplanes import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verify_tampered

    return verify_tampered(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_substring_dedup, op2_simhash_near_dedup, op3_secret_scan, op4_decontamination, op5_quality_classifier, op6_language_id, op7_minhash_fingerprints, op8_pii_pseudonyms, op9_bitplane_ids, op10_byte_bpe, op11_merkle_manifest, op12_quality_rules, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in every}
