"""Secret scan by a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression; trigrams.query() derives its Boolean trigram query. One pass lists the postings (trigram,
doc_id) of the trigrams that rules name; grouping by document intersects them; the documents whose sets satisfy a rule are its
candidates, and only they run its expression. Rules without a mandatory trigram (long runs of hex digits) scan every text. Rows
that share a doc_id share their postings, so candidates are never lost.

Spans come from running sums over the gaps and lengths of a text's matches, in CHUNK pieces, so a text of many matches costs time
in proportion to them. Null texts count as empty: no spans. Null doc_ids form one group of postings, joined null-safely. Long
texts are scanned whole. Repeated rows give a row each. Extra columns, of any name, stay; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigrams
from .shared import table

#: name, expression, group whose length counts, least length.
RULES = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 1),
]
BASE = ("assign", "access", "hex")
CHUNK = 256
SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def satisfied(query, held: Column) -> Column:
    """A Boolean trigram query over the array of a document's trigrams."""
    if isinstance(query, str):
        return F.array_contains(held, query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [satisfied(q, held) for q in query[1]])


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """(trigram, doc_id) for the trigrams that the rules' queries name."""
    wanted = sorted(set().union(*[trigrams.named(trigrams.query(r[1])) for r in rules]))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in wanted], F.lit(None).cast("string")))
    return docs.select("doc_id", low.alias("_low")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id (as _key) and the names of the rules whose query it satisfies (as _rules)."""
    held = postings(docs, rules).groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    named = [(r[0], trigrams.query(r[1])) for r in rules]
    names = F.array_compact(F.array(*[F.when(satisfied(q, F.col("held")), F.lit(name)) for name, q in named if q is not True], F.lit(None).cast("string")))
    return held.select(F.col("doc_id").alias("_key"), names.alias("_rules")).where(F.size("_rules") > 0)


def _chunked(values: Column, start: Column, total, step) -> Column:
    """Runs `step` over an array in chunks: an aggregate of (at, out) whose `at` each chunk gets from total() of those before it."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))
    chunks = F.when(F.size(values) > 0, chunks).otherwise(F.slice(F.array(values), 1, 0))
    ahead = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, c: F.struct(total(a["at"], c).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    none = F.struct(F.lit(0).alias("at"), start.alias("out"))
    return F.flatten(F.zip_with(chunks, ahead, lambda c, at: F.aggregate(c, none.withField("at", at), step, lambda a: a["out"])))


def _found(name: str, pattern: str, group: int, least: int, rank: int, text: Column) -> Column:
    """Array of (start, rank, stop, kind): the gaps that split() leaves and the matches alternate."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)) if group else hits
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), counted.alias("counted"))
    after = lambda at, x: at + x["gap"] + F.coalesce(x["hit"], F.lit(0))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        one = F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + x["hit"]).alias("stop"), F.lit(name).alias("kind"))
        more = F.when(x["hit"].isNotNull() & (x["counted"] >= least), F.concat(a["out"], F.array(one))).otherwise(a["out"])
        return F.struct(after(a["at"], x).alias("at"), more.alias("out"))

    return _chunked(parts, F.array().cast(SPANS), lambda at, c: F.aggregate(c, at, after), step)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """`row`, a struct of the columns of docs, with `_spans`, an array of (start, rank, stop, kind) in code points, end exclusive, ordered."""
    found = candidates(docs, rules)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("_key")), "left")
    text, none, each = F.coalesce("row.text", F.lit("")), F.array().cast(SPANS), []
    for rank, (name, pattern, group, least) in enumerate(rules):
        gate = F.regexp_like(text, F.lit(pattern)) if trigrams.query(pattern) is True else F.array_contains("_rules", name)
        each.append(F.when(F.coalesce(gate, F.lit(False)), _found(name, pattern, group, least, rank, text)).otherwise(none))
    return joined.select("row", F.array_sort(F.concat(*each)).alias("_spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    s = F.col("_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs.select("doc_id", "text")).select("row.doc_id", *map(count, BASE), F.sha2(_joined(F.filter(s, lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"), _joined(s).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by [SECRET]; overlapping spans are replaced together. A chunk of spans cuts its part out
    of the text once, and its spans cut that part."""
    text, reach = F.col("row.text"), lambda at, x: F.greatest(at, x["stop"])

    def step(a: Column, x: Column) -> Column:
        return F.struct(reach(a["at"], x).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("done"), x["start"].alias("start"), x["stop"].alias("stop")))).alias("out"))

    spans = _chunked(F.col("_spans"), F.array().cast("array<struct<done:int,start:int,stop:int>>"), lambda at, c: F.aggregate(c, at, reach), step)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / CHUNK).cast("int")), lambda k: F.slice("_cuts", k * CHUNK + 1, CHUNK))
    part = lambda c: F.struct(c.alias("cuts"), c[0]["done"].alias("base"), F.substring(text, c[0]["done"] + 1, F.greatest(c[F.size(c) - 1]["start"] - c[0]["done"], F.lit(0))).alias("part"))
    piece = lambda p: F.array_join(F.transform(p["cuts"], lambda x: F.when(x["start"] >= x["done"], F.concat(F.substring(p["part"], x["done"] - p["base"] + 1, x["start"] - x["done"]), F.lit("[SECRET]"))).otherwise("")), "")
    end = F.aggregate("_cuts", F.lit(0), lambda a, x: F.greatest(a, x["stop"]))
    masked = F.concat(F.array_join(F.transform(F.transform(parts, part), piece), ""), F.substring(text, end + 1, F.length(text)))
    out = scan(docs).select("row", spans.alias("_cuts"))
    out = out.select("row", F.when(F.size("_cuts") > 0, masked).otherwise(text).alias("_text"))
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def _sql() -> str:
    parts = []
    explicit = {"assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""}
    for rank, (name, pattern, group, least) in enumerate(RULES):
        p = explicit.get(name, pattern)
        parts.append(f"""SELECT rid, '{name}' AS kind, {rank} AS rank, i AS n, gaps, hits, counted[i] AS c FROM (SELECT rid, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x)) AS hits, list_transform(regexp_extract_all(text, '{p}', {group}), lambda x: length(x)) AS counted FROM d WHERE regexp_matches(text, '{p}')) q, unnest(range(1, len(hits) + 1)) AS u(i) WHERE counted[i] >= {least}""")
    count = lambda k: f"CAST(count(kind) FILTER (kind = '{k}') AS BIGINT) AS n_{k}"
    one = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({' UNION ALL '.join(parts)}),
    s AS (SELECT rid, kind, rank, CAST(list_sum(gaps[1:n]) + coalesce(list_sum(hits[1:n - 1]), 0) AS BIGINT) AS start, CAST(list_sum(gaps[1:n]) + list_sum(hits[1:n]) AS BIGINT) AS stop FROM m)
    SELECT any_value(doc_id) AS doc_id, {', '.join(map(count, BASE))}, sha256(coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({one}, ',' ORDER BY start, rank), '') AS spans
    FROM d LEFT JOIN s USING (rid) GROUP BY rid"""


SQL = _sql()
