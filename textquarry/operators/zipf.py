"""Term frequencies of stems: counted raw, then stemmed once a word and summed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemmer import with_stem
from ..functions.tokens import term_counts
from .index import ordered


def stem_counts(docs: DataFrame) -> DataFrame:
    return with_stem(term_counts(docs)).groupBy(F.col("stem").alias("term")).agg(F.sum("freq").alias("freq"))


def ranked(docs: DataFrame) -> DataFrame:
    """rank, term, freq: by frequency, ties by term. The vocabulary alone is ordered, in range partitions."""
    counts = stem_counts(docs).withColumn("_less", -F.col("freq"))
    return ordered(counts, "_less", "term", name="rank", first=1).select("rank", "term", "freq")


def top(docs: DataFrame, n: int = 20) -> DataFrame:
    few = stem_counts(docs).orderBy(F.desc("freq"), "term").limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "term")).cast("long")).select("rank", "term", "freq")


def summary(docs: DataFrame, n: int = 20) -> DataFrame:
    counts = stem_counts(docs).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens_total"), F.count(F.lit(1)).alias("unique_terms"))
    size = docs.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes_total"))
    return size.join(counts, F.lit(True)).select("files", "bytes_total", "tokens_total", "unique_terms", F.lit(n).cast("long").alias("top_n"))


def expected(curve: DataFrame, points: int = 200_000) -> DataFrame:
    """rank, freq, expected: the first frequency over the rank, for the first points of the curve."""
    some = curve.orderBy("rank").limit(points)
    first = some.agg(F.max(F.struct(-F.col("rank"), F.col("freq")))["freq"].alias("c"))
    return some.join(F.broadcast(first), F.lit(True)).select("rank", "freq", (F.col("c").cast("double") / F.col("rank")).alias("expected"))  # one row


def stem_stats(docs: DataFrame) -> DataFrame:
    v = with_stem(term_counts(docs)).select("freq", F.length("term").alias("a"), F.length("stem").alias("b"), (F.col("term") != F.col("stem")).cast("long").alias("c"))
    s = v.agg(F.sum("freq").alias("n"), F.sum(F.col("freq") * F.col("a")).alias("a"), F.sum(F.col("freq") * F.col("b")).alias("b"), F.sum(F.col("freq") * F.col("c")).alias("changed"))
    n = F.col("n")
    return s.select(n.alias("raw_tokens"), (F.col("a").cast("double") / n).alias("avg_raw"), n.alias("stem_tokens"), (F.col("b").cast("double") / n).alias("avg_stem"), "changed", (F.lit(100.0) * F.col("changed") / n).alias("changed_pct"))


def write(docs: DataFrame, path: str, n: int = 20) -> None:
    curve = ranked(docs)
    curve.select("rank", "freq").write.mode("overwrite").csv(f"{path}/rank_freq", header=True)
    top(docs, n).write.mode("overwrite").csv(f"{path}/top_terms", header=True)
    s = summary(docs, n)
    s.select(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("files", "files"), ("bytes_total", "bytes_total"), ("tokens_total", "tokens_total"), ("unique_terms", "unique_terms"), ("topN", "top_n"))]).alias("value")).write.mode("overwrite").text(f"{path}/summary")
