"""Extension: postings of text files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import postings


def stream_postings(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return postings(spark.readStream.schema(schema).parquet(path).select("doc_id", "text"))
