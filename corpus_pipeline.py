"""Corpus pipeline: language identification, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last return
the columns of documents. Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns are handled as the
operators' docstrings state; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import languages, mixing, near_dups, packing, secrets
from textquarry.llm.shared import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifies every text; those that get no language (`und`) go."""
    return languages.filtered(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of similarity 0.8 or more in shingles of five words, stays."""
    return near_dups.deduplicate(docs, percent=80)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in training order."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence."""
    return packing.pack(docs)


STAGES = [("language", language), ("dedup", dedup), ("secrets", secret), ("mixing", mixture), ("packing", packed)]

#: SQL has neither the learned languages nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
