"""Corpus pipeline: toxicity, language identification, near-duplicate removal, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes every
stage's table as Parquet in the shared folder and reads it again as the next
stage's documents.  All stages but the last return the columns of documents.

The models of the first two stages are fitted on the stage's own input: on all
labelled rows (toxicity) and on a bounded sample (``langid.SAMPLE``).  Without
any labelled row a stage rejects nothing but what its operator says it does
then; null and empty texts pass the first stage, are rejected as ``und`` by the
second, and an empty table gives an empty result of the last stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import langid, minhash, packing, toxicity
from lathe.storage import materialise
from lathe.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window is not toxic."""
    return toxicity.keep_clean(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is mostly in an identified language."""
    return langid.keep_identified(docs, langid.fitted(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokens of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: A trained network, a fitted language model and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
