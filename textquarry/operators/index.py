"""Documents, postings and lexicon of the inverted index, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemmer import with_stem
from ..functions.tokens import tokens
from ..sources.store import small_splits, stored

#: Postings and bytes of text of a task when an index is written: some 200 MB of its memory, so sorts do not spill, however large
#: the table and however few spark.sql.shuffle.partitions.
TASK_POSTINGS, TASK_BYTES = 2_000_000, 32 << 20


def _parts(spark, total: int | None, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // each))


def ordered(rows: DataFrame, *order: str, name: str = "ordinal", first: int = 0, parts: int = 0, then=None) -> DataFrame:
    """rows with a dense number by `order`. It comes from range partitions and their counts, not from one task; rows are stored
    first, so that both passes see the same partitions. parts: least number of them. then: what to make of the ordered rows before
    they are stored."""
    cells = rows.repartitionByRange(max(parts, _parts(rows.sparkSession, 0, 1)), *order).sortWithinPartitions(*order)
    cells = then(cells) if then else cells
    columns = cells.columns
    cells = stored(cells.select("*", F.monotonically_increasing_id().alias("_m")), "ordered").withColumn("_p", F.shiftrightunsigned("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition, so few that every task gets them
    counts = cells.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return cells.join(F.broadcast(counts), "_p").select(*columns, (F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + first).alias(name))


def numbered(rows: DataFrame, key: str = "doc_id", order: str | None = None, parts: int = 0, then=None) -> DataFrame:
    """doc_id (dense ordinal in the order of `order`, else of the key), doc_key, title, url, and text if rows have it, or what
    `then` makes of it. Documents, postings and pages all take their ordinals from here. Rows that repeat a key have ordinals of
    their own."""
    optional = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("title", "url", "text")]
    named = rows.select(F.col(order or key).alias("_o"), F.col(key).alias("_k"), *optional)
    text = F.col("_k").cast("string")
    out = ordered(named, "_o", name="doc_id", parts=parts, then=then)
    rest = [c for c in out.columns if c not in ("_o", "_k", "title", "url", "doc_id")]
    return out.select("doc_id", text.alias("doc_key"), F.coalesce(F.nullif("title", F.lit("")), text).alias("title"), F.coalesce("url", F.lit("")).alias("url"), *rest)


def docs_table(rows: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """doc_id (dense ordinal), doc_key, title, url."""
    return numbered(rows.drop("text"), key, order).drop("text")


def postings(docs: DataFrame, stem_index: bool = False) -> DataFrame:
    """term, doc_id: one row for each distinct term of a document. Terms are raw unless stem_index."""
    out = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    if not stem_index:
        return out.select("term", "doc_id")
    stems = with_stem(out.select("term").distinct())  # each word once
    return out.join(stems, "term").select("doc_id", F.col("stem").alias("term")).distinct()


def lexicon(p: DataFrame) -> DataFrame:
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexicon_stats(lex: DataFrame) -> DataFrame:
    return lex.agg(F.count(F.lit(1)).alias("term_count"), F.coalesce(F.avg(F.length("term")), F.lit(0.0)).alias("avg_term_len"), (40 + 4 * F.coalesce(F.sum("df"), F.lit(0))).alias("postings_bytes"))


def totals(docs: DataFrame) -> DataFrame:
    t = docs.select(F.octet_length("text").cast("long").alias("b"), tokens(F.col("text")).alias("t"))
    s = t.select("b", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("u"))
    s = s.agg(F.count(F.lit(1)).alias("docs"), F.sum("b").alias("total_bytes"), F.sum("n").alias("total_tokens"), F.sum("u").alias("u"))
    return s.select("docs", "total_bytes", "total_tokens", (F.col("u").cast("double") / F.col("docs")).alias("avg_unique_terms_per_doc"))


def compact(p: DataFrame) -> DataFrame:
    """term, df, doc_ids: a sorted list a term. A list holds all documents of its term, so it is for terms that are not too common;
    the long form has no such bound."""
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def write(docs: DataFrame, path: str, key: str = "doc_id", order: str | None = None) -> None:
    """docs, postings and lexicon as Parquet under one set of ordinals; terms are range-partitioned and sorted, so that a lookup
    reads few row groups. Texts are shuffled once and cut into terms once; only the terms are stored."""
    spark = docs.sparkSession
    with small_splits(spark):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] if "text" in docs.columns else 0
        words = lambda x: x.withColumn("text", F.array_distinct(tokens(F.col("text")))).withColumnRenamed("text", "terms").withColumn("n", F.size("terms"))
        rows = numbered(docs, key, order, _parts(spark, size, TASK_BYTES), words)
        rows.drop("terms", "n").write.mode("overwrite").parquet(f"{path}/docs")
        n = _parts(spark, rows.agg(F.sum("n")).first()[0], TASK_POSTINGS)
        long = rows.select(F.explode("terms").alias("term"), "doc_id")
        long.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        lex = lexicon(spark.read.parquet(f"{path}/postings"))
        lex.repartitionByRange(_parts(spark, 0, 1), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")


SCHEMAS = {"docs": "doc_id long, doc_key string, title string, url string", "postings": "term string, doc_id long", "lexicon": "term string, df long"}


def read(spark, path: str) -> dict[str, DataFrame]:
    """The tables of a written index; ValueError if their columns are not those of an index."""
    out = {}
    for name, schema in SCHEMAS.items():
        found = spark.read.parquet(f"{path}/{name}")
        want = [tuple(x.split()) for x in schema.split(", ")]
        if sorted((f.name, {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in found.schema) != sorted(want):
            raise ValueError(f"{path}/{name} is no table of an index: {found.schema.simpleString()}")
        out[name] = found
    return out
