"""Registered queries and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemmer, tokens
from ..operators import index, search, zipf
from ..sources import corpus, store

PREFIX = "https://example.org/wiki/"
T = "list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda x: lower(substr(x, 1, 255)))"
POSTINGS = f"postings AS (SELECT DISTINCT doc_id, unnest({T}) AS term FROM documents)"
ORDINALS = "d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, doc_id AS doc_key, text FROM documents)"
INDEX = f"{ORDINALS}, p AS (SELECT DISTINCT doc_id, unnest({T}) AS term FROM d)"
COUNTS = f"counts AS (SELECT term, count(*) AS freq FROM (SELECT unnest({T}) AS term FROM documents) GROUP BY term)"
STEMS = f"{COUNTS},\n{stemmer.stem_sql('counts')}"
STEMMED = f"{STEMS},\nz AS (SELECT stem AS term, CAST(sum(freq) AS BIGINT) AS freq FROM stems JOIN counts USING (term) GROUP BY stem)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _table(spark, d):
    return index.docs_table(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"))


def _over(f):
    return lambda spark, d: f(_docs(spark, d))


#: The written indexes of this session, by application and folder of the documents.
_INDEXES: dict[tuple[str, str], str] = {}


def written_index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The index of the folder's documents, written on first use; queries read its sorted postings with the terms pushed down."""
    where = (spark.sparkContext.applicationId, d)
    if where not in _INDEXES:
        path = store.fresh(spark, "index")
        index.write(_docs(spark, d), path)
        _INDEXES[where] = path
    return index.read(spark, _INDEXES[where])


def _bool(line: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = written_index(spark, d)
        return search.hits(line, found["docs"], found["postings"])

    return run


def _page(line: str, limit: int, offset: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = written_index(spark, d)
        return search.page(search.hits(line, found["docs"], found["postings"]), found["docs"], limit, offset)

    return run


BOOLEAN = {
    "bool_term": "the", "bool_and": "the of", "bool_or": "der | la", "bool_not": "!the", "bool_precedence": "the | la de", "bool_implicit_and": "(the || la) !de", "bool_paren_not": "(!ci) (the || la)",
    "bool_double_not": "!!the", "bool_dangling_and": "the &", "bool_dangling_or": "the |", "bool_bare_not": "!", "bool_unknown_term": "!nosuchterm", "bool_query_stemmed": "thes",
}


HITS = "(SELECT doc_id FROM p WHERE term = '{}')".format
ALL = "(SELECT doc_id FROM d)"
#: The sets that the queries above mean, written by hand.
BOOLEAN_SQL = {
    "bool_term": HITS("the"),
    "bool_and": f"{HITS('the')} INTERSECT {HITS('of')}",
    "bool_or": f"{HITS('der')} UNION {HITS('la')}",
    "bool_not": f"{ALL} EXCEPT {HITS('the')}",
    "bool_precedence": f"{HITS('the')} UNION ({HITS('la')} INTERSECT {HITS('de')})",
    "bool_implicit_and": f"({HITS('the')} UNION {HITS('la')}) EXCEPT {HITS('de')}",
    "bool_paren_not": f"({HITS('the')} UNION {HITS('la')}) EXCEPT {HITS('ci')}",
    "bool_double_not": HITS("the"),
    "bool_dangling_and": f"{ALL} EXCEPT {ALL}",
    "bool_dangling_or": HITS("the"),
    "bool_bare_not": ALL,
    "bool_unknown_term": ALL,
    "bool_query_stemmed": HITS("the"),
}


flagship = _page("(the || la) !de", 50, 0)


def _manifest(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    title = tokens.normal_title(F.regexp_extract("url", "[^/]*$", 0))
    return p.select("page_id", tokens.stable_id(F.col("page_id"), title).alias("doc_key"), title.alias("title"), tokens.page_url(title, PREFIX).alias("page_url"), tokens.word_count(F.col("html")).cast("long").alias("word_count"))


def _crawl(spark, d):
    """Nations reach each other along orders: a supplier's nation is reached from that of a customer whose order holds its line."""
    t = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    lines = t("lineitem").where("l_quantity = 50").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    near = both.where("s_nationkey between c_nationkey + 1 and c_nationkey + 3")
    return corpus.crawl_levels(near.select(F.col("c_nationkey").cast("string").alias("parent"), F.col("s_nationkey").cast("string").alias("child")), "0")


def _left(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    labels = labels.withColumn("quality", F.col("quality").cast("int"))
    return _docs(spark, d).select("doc_id").join(labels, "doc_id", "left")


QUERIES = {
    "tokenize_stats": _over(tokens.token_stats),
    "doc_token_counts": _over(lambda x: x.select("doc_id", F.size(tokens.tokens(F.col("text"))).cast("long").alias("tokens"))),
    "term_freq_raw": _over(tokens.term_counts),
    "stem_vocab": _over(lambda x: stemmer.with_stem(tokens.term_counts(x).select("term")).select("term", "stem")),
    "stem_stats": _over(zipf.stem_stats),
    "zipf_rank_freq": _over(lambda x: zipf.ranked(x).select("rank", "freq")),
    "zipf_top_terms": _over(zipf.top),
    "zipf_summary": _over(zipf.summary),
    "zipf_expected": _over(lambda x: zipf.expected(zipf.ranked(x).select("rank", "freq"))),
    "docs_table": _table,
    "postings": _over(index.postings),
    "postings_stemmed": _over(lambda x: index.postings(x, True)),
    "lexicon": _over(lambda x: index.lexicon(index.postings(x))),
    "index_stats": _over(lambda x: index.lexicon_stats(index.lexicon(index.postings(x)))),
    "index_totals": _over(index.totals),
    "search_page": _page("the of", 20, 10),
    "search_stats": lambda s, d: search.stats("the of", _bool("the of")(s, d), 50, 10),
    "index_docs": lambda s, d: written_index(s, d)["docs"],
    "index_postings": lambda s, d: written_index(s, d)["postings"],
    "index_lexicon": lambda s, d: written_index(s, d)["lexicon"],
    "doc_count": lambda s, d: _docs(s, d).agg(F.count(F.lit(1)).alias("doc_count")),
    "manifest_records": _manifest,
    "corpus_min_words": _over(lambda x: x.where(tokens.word_count(F.col("text")) >= 1100).select("doc_id")),
    "manifest_left_join": _left,
    "crawl_bfs": _crawl,
} | {k: _bool(q) for k, q in BOOLEAN.items()}

SQL = {
    "tokenize_stats": "WITH t AS (SELECT strlen(text) AS b, regexp_extract_all(text, '[0-9A-Za-z]+') AS t FROM documents) SELECT CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(list_sum(list_transform(t, lambda x: length(x)))) AS DOUBLE) / sum(len(t)) AS avg_token_len FROM t",
    "doc_token_counts": f"SELECT doc_id, len({T}) AS tokens FROM documents",
    "term_freq_raw": f"WITH {COUNTS} SELECT * FROM counts",
    "stem_vocab": f"WITH {STEMS} SELECT * FROM stems",
    "stem_stats": f"WITH {STEMS}, v AS (SELECT freq, length(term) AS a, length(stem) AS b, term <> stem AS c FROM stems JOIN counts USING (term)) SELECT CAST(sum(freq) AS BIGINT) AS raw_tokens, CAST(sum(freq * a) AS DOUBLE) / sum(freq) AS avg_raw, CAST(sum(freq) AS BIGINT) AS stem_tokens, CAST(sum(freq * b) AS DOUBLE) / sum(freq) AS avg_stem, CAST(sum(freq) FILTER (c) AS BIGINT) AS changed, 100.0::DOUBLE * CAST(sum(freq) FILTER (c) AS DOUBLE) / sum(freq) AS changed_pct FROM v",
    "zipf_rank_freq": f"WITH {STEMMED} SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, freq FROM z",
    "zipf_top_terms": f"WITH {STEMMED} SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq FROM z ORDER BY freq DESC, term LIMIT 20",
    "zipf_summary": f"WITH {STEMMED} SELECT (SELECT count(*) FROM documents) AS files, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes_total, CAST(sum(freq) AS BIGINT) AS tokens_total, count(*) AS unique_terms, CAST(20 AS BIGINT) AS top_n FROM z",
    "zipf_expected": f"WITH {STEMMED}, r AS (SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, freq FROM z) SELECT rank, freq, CAST((SELECT max(freq) FROM r) AS DOUBLE) / rank AS expected FROM r WHERE rank <= 200000",
    "docs_table": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, CAST(doc_id AS VARCHAR) AS doc_key, CAST(doc_id AS VARCHAR) AS title, '' AS url FROM documents",
    "postings": f"WITH {POSTINGS} SELECT * FROM postings",
    "postings_stemmed": f"WITH {POSTINGS}, v AS (SELECT DISTINCT term FROM postings), {stemmer.stem_sql('v')} SELECT DISTINCT doc_id, stem AS term FROM postings JOIN stems USING (term)",
    "lexicon": f"WITH {POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY term",
    "index_stats": f"WITH {POSTINGS}, l AS (SELECT term, count(*) AS df FROM postings GROUP BY term) SELECT count(*) AS term_count, avg(length(term)) AS avg_term_len, CAST(40 + 4 * sum(df) AS BIGINT) AS postings_bytes FROM l",
    "index_totals": f"WITH t AS (SELECT strlen(text) AS b, {T} AS t FROM documents) SELECT count(*) AS docs, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(sum(len(t)) AS BIGINT) AS total_tokens, CAST(sum(len(list_distinct(t))) AS DOUBLE) / count(*) AS avg_unique_terms_per_doc FROM t",
    "search_page": f"WITH {INDEX}, h AS ({HITS('the')} INTERSECT {HITS('of')}) SELECT doc_id, CAST(doc_key AS VARCHAR) AS title, '' AS url FROM h JOIN d USING (doc_id) ORDER BY doc_id LIMIT 20 OFFSET 10",
    "search_stats": f"WITH {INDEX}, h AS ({HITS('the')} INTERSECT {HITS('of')}) SELECT 'the of' AS query, count(*) AS hits, CAST(least(50, greatest(count(*) - 10, 0)) AS BIGINT) AS shown, CAST(10 AS BIGINT) AS \"offset\" FROM h",
    "index_docs": f"WITH {ORDINALS} SELECT doc_id, CAST(doc_key AS VARCHAR) AS doc_key, CAST(doc_key AS VARCHAR) AS title, '' AS url FROM d",
    "index_postings": f"WITH {INDEX} SELECT term, doc_id FROM p",
    "index_lexicon": f"WITH {INDEX} SELECT term, count(*) AS df FROM p GROUP BY term",
    "doc_count": "SELECT count(*) AS doc_count FROM documents",
    "manifest_records": f"WITH p AS (SELECT page_id, html, trim(replace(regexp_extract(url, '[^/]*$'), '_', ' ')) AS title FROM pages) SELECT page_id, substr(sha1(page_id || ':' || title), 1, 12) AS doc_key, title, '{PREFIX}' || replace(title, ' ', '_') AS page_url, len(regexp_extract_all(html, '[A-Za-zА-Яа-яЁё0-9]+')) AS word_count FROM p",
    "corpus_min_words": "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё0-9]+')) >= 1100",
    "manifest_left_join": "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)",
    "crawl_bfs": "WITH RECURSIVE e AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS parent, CAST(s_nationkey AS VARCHAR) AS child FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity = 50 AND s_nationkey BETWEEN c_nationkey + 1 AND c_nationkey + 3), w(node, level) AS (SELECT '0', CAST(0 AS BIGINT) UNION SELECT child, level + 1 FROM w JOIN e ON parent = node WHERE level < 30) SELECT node, min(level) AS level FROM w GROUP BY node",
} | {k: f"WITH {INDEX} SELECT doc_id FROM ({q})" for k, q in BOOLEAN_SQL.items()}
