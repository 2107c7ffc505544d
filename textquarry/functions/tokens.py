"""Tokens: maximal runs of ASCII letters and digits, cut at 255 bytes, lower-cased after extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = "[0-9A-Za-z]+"
#: The crawler's words: Latin and Cyrillic letters and digits.
WORD = "[A-Za-zА-Яа-яЁё0-9]+"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def tokens(text: Column) -> Column:
    return F.transform(raw_tokens(text), lambda x: F.lower(F.substring(x, 1, 255)))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def stable_id(pageid: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat(pageid.cast("string"), F.lit(":"), title).cast("binary")), 1, 12)


def page_url(title: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(title, F.lit(" "), F.lit("_")))


def normal_title(title: Column) -> Column:
    return F.trim(F.replace(title, F.lit("_"), F.lit(" ")))


def token_stats(docs: DataFrame) -> DataFrame:
    """bytes, tokens, avg_token_len of the whole corpus; tokens are not cut here."""
    t = docs.select(F.octet_length("text").cast("long").alias("b"), raw_tokens(F.col("text")).alias("t"))
    one = t.select("b", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("l"))
    s = one.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.sum("l").alias("l"))
    return s.select("bytes", "tokens", F.when(F.col("tokens") > 0, F.col("l").cast("double") / F.col("tokens")).otherwise(0.0).alias("avg_token_len"))


def term_counts(docs: DataFrame) -> DataFrame:
    """term, freq: partial sums before the shuffle."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
