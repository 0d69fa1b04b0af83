"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import crossentropy, fertility, langid, licenses, minhash, nbest, ordering, packing, simhash, toxicity
from lathe.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op3_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fitted(docs))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossentropy.difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_tokenizer_fertility, op3_nbest_segmentation, op4_language_id, op5_best_fit_packing, op6_simhash, op7_minhash_dedup, op8_toxicity, op9_cross_entropy_difference, op10_training_order)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.ORACLE, "op6_simhash": simhash.ORACLE, "op9_cross_entropy_difference": crossentropy.ORACLE}
