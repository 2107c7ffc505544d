"""Sources and sinks of corpora: text files, manifests, rank curves, crawled graphs."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import WORD
from .store import stored

MANIFEST = "doc_id string, pageid long, title string, category_seed string, word_count long, url string, source string"


def text_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """doc_key, bytes, text of the *.txt files; names that start with `_` or `.` are hidden, as in all Spark file sources."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive).load(path)
    key = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    return rows.select(key.alias("doc_key"), F.octet_length("content").cast("long").alias("bytes"), F.decode(F.col("content"), "UTF-8").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines that have a doc_id, with `place`: file, offset of the split and line in it, which orders them as written."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    return spark.read.schema(MANIFEST).json(path).select("*", place.alias("place")).where("doc_id is not null")


def with_text(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with their texts; a missing file leaves a null text and the row stays."""
    return rows.join(files.select(F.col("doc_key").alias("doc_id"), "text"), "doc_id", "left")


def write_corpus(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def rank_curve(spark: SparkSession, path: str, points: int = 200_000) -> DataFrame:
    return spark.read.schema("rank long, freq long").csv(path, header=True).orderBy("rank").limit(points)


def crawl_levels(edges: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """node, level of all nodes that (parent, child) edges reach from root, breadth first; `most` levels at most, if given. Each
    level is written as a table and read again, so no level is computed twice and no plan grows."""
    edges = stored(edges.select("parent", "child").distinct(), "edges")
    seen = front = edges.sparkSession.createDataFrame([(root, 0)], "node string, level long")
    for level in itertools.count(1) if most is None else range(1, most + 1):
        new = edges.join(front, edges["parent"] == front["node"]).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        front = stored(new.withColumn("level", F.lit(level).cast("long")), "level")
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front), "seen")
    return seen


def pages_of(fetch: Callable[[dict], dict], category: str, kind: str):
    """Members of a category, page by page, by an injected fetcher of API answers."""
    more: dict = {}
    while True:
        got = fetch({"action": "query", "list": "categorymembers", "cmtitle": category, "cmtype": kind, "cmlimit": 500, "format": "json", **more})
        yield from got.get("query", {}).get("categorymembers", [])
        if "cmcontinue" not in (more := got.get("continue", {})):
            return


def page_text(fetch: Callable[[dict], dict], title: str) -> tuple[int, str, str]:
    """pageid, title and plain text of a page after redirects; a missing page has an empty text, no answer the id -1."""
    got = fetch({"action": "query", "prop": "extracts", "explaintext": 1, "redirects": 1, "titles": title, "format": "json"})
    for page in got.get("query", {}).get("pages", {}).values():
        return page.get("pageid", -1), page.get("title", title), "" if "missing" in page else page.get("extract", "")
    return -1, title, ""


def _walk(fetch: Callable[[dict], dict], root: str):
    """(categories done, categories seen, members) of each category, breadth first, each category once."""
    queue, seen, done = deque([root]), {root}, 0
    while queue:
        category = queue.popleft()
        done += 1
        for m in pages_of(fetch, category, "subcat"):
            if m["title"] not in seen:
                seen.add(m["title"])
                queue.append(m["title"])
        yield done, len(seen), category, pages_of(fetch, category, "page")


def dry_run_count(fetch: Callable[[dict], dict], root: str, limit_pages: int | None = None, limit_cats: int | None = None) -> dict:
    """What a crawl would meet: categories processed and seen, distinct pages of the main namespace, and why it stopped. It stops
    before the end at a limit only if the caller gives one."""
    pages: set[int] = set()
    out = {"categories_processed": 0, "categories_seen": 1, "unique_pages": 0, "stopped_reason": "done"}
    for done, seen, _, members in _walk(fetch, root):
        for m in members:
            if m.get("ns", 0) == 0:
                pages.add(m["pageid"])
                if limit_pages is not None and len(pages) >= limit_pages:
                    return {"categories_processed": done, "categories_seen": seen, "unique_pages": len(pages), "stopped_reason": "limit_pages"}
        out |= {"categories_processed": done, "categories_seen": seen, "unique_pages": len(pages)}
        if limit_cats is not None and done >= limit_cats:
            return out | {"stopped_reason": "limit_cats"}
    return out


def build_corpus(spark: SparkSession, fetch: Callable[[dict], dict], root: str, need_docs: int, min_words: int, prefix: str, chunk: int = 1000) -> DataFrame:
    """Manifest rows with their texts of the first need_docs pages of at least min_words words, in the order of the crawl. Pages
    that several categories list are fetched once; two that redirect to one page give its doc_id twice. The frontier of a crawl over
    an API is sequential; fetched pages go to tables in chunks, so the driver holds no more than one."""
    kept, listed, held, tables = 0, set(), [], []
    schema = f"{MANIFEST}, text string"

    def flush() -> None:
        if held:
            tables.append(stored(spark.createDataFrame(held, schema), "crawl"))
            held.clear()

    for _, _, category, members in _walk(fetch, root):
        for m in members:
            if kept >= need_docs:
                break
            if m["pageid"] in listed:
                continue
            listed.add(m["pageid"])
            pageid, title, text = page_text(fetch, m["title"])
            words = len(re.findall(WORD, text))
            if words >= min_words:
                title = title.replace("_", " ").strip()
                held.append((hashlib.sha1(f"{pageid}:{title}".encode()).hexdigest()[:12], pageid, title, category, words, prefix + title.replace(" ", "_"), "api", text))
                kept += 1
                if len(held) >= chunk:
                    flush()
        if kept >= need_docs:
            break
    flush()
    return functools.reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schema)


def write_files(rows: DataFrame, path: str) -> None:
    """A text file <doc_id>.txt for each row and manifest.jsonl, on a file system that all executors share: each document is
    written by the task that holds it."""
    folder = re.sub("^file:(//)?", "", path)
    os.makedirs(folder, exist_ok=True)

    def run(part) -> None:
        for r in part:
            with open(f"{folder}/{r.doc_id}.txt", "w", encoding="utf-8", newline="") as f:
                f.write(r.text or "")

    rows.select("doc_id", "text").foreachPartition(run)
    write_corpus(rows.drop("text"), f"{path}/manifest.jsonl")
