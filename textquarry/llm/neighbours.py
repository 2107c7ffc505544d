"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a unit vector to HASHES values floor((a.v + b) / WIDTH), a Gaussian. A query visits PROBES buckets
a table: its own, then perturbed ones, in order of the sum of squared distances to the crossed borders. Candidates of all tables
are merged and reranked by exact cosine in double precision on the original vectors. A query that finds fewer than it should
meets all rows, in blocks, so small tables and far vectors get whole answers.

Equal vectors form a class with its smallest vec_ids, as no more can be among the nearest, and are one query. Buckets are dealt
to cells of about BLOCK rows, and a bucket beyond BLOCK rows to cells of its own; a query goes once to each cell that holds a
bucket it visits, so no task holds a whole hot bucket and vectors are not copied for each bucket. All rows are indexed.

Within a cell every row within rounding of the last place is scored exactly, so ties are whole and go to smaller vec_ids.
Vectors are scaled by powers of two first, which changes no cosine but keeps norms of tiny and huge ones in range. Vectors null,
zero, or with null or non-finite components take no part; a table without any gives an empty result. Vectors of other lengths
than the query's are not its candidates. Repeated vec_ids count once (their least vector). Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, mixed, table

TABLES, HASHES, WIDTH, PROBES, BLOCK, NEAREST, EVERY = 3, 6, 2.0, 90, 4096, 5, 50


def _planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    return rng.standard_normal((TABLES, HASHES, dim)), rng.uniform(0, WIDTH, (TABLES, HASHES))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, times a power of two that brings their largest component to 0.5 to 1."""
    x = np.asarray(x, float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of y with x, both scaled."""
    return (y * x).sum(1) / (np.sqrt((y * y).sum(1)) * np.sqrt((x * x).sum()))


def _keys(cells: np.ndarray, dim: int) -> np.ndarray:
    """A 64-bit key for each row of integer cells."""
    out = np.full(len(cells), dim, np.uint64)
    for c in cells.T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def probes(f: np.ndarray, many: int) -> list[np.ndarray]:
    """Cells by estimated success: f is the projection in units of WIDTH."""
    cell, inside = np.floor(f), f - np.floor(f)
    moves = []
    for i in range(len(f)):
        for s in range(1, 4):
            moves += [((inside[i] + s - 1) ** 2, i, -s), ((s - inside[i]) ** 2, i, s)]
    moves.sort()
    out, heap = [cell], [(moves[0][0], (0,))]
    while heap and len(out) < many:
        cost, chosen = heapq.heappop(heap)
        if len({moves[k][1] for k in chosen}) == len(chosen):
            new = cell.copy()
            for k in chosen:
                new[moves[k][1]] += moves[k][2]
            out.append(new)
        last = chosen[-1]
        if last + 1 < len(moves):
            step = cost - moves[last][0] + moves[last + 1][0]
            heapq.heappush(heap, (step, chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (cost + moves[last + 1][0], chosen + (last + 1,)))
    return out


def _hashed(rows: DataFrame, many: int) -> DataFrame:
    """(rep, t, key) of the buckets that each row (rep, vec) is in (many = 1) or visits."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                p = b.slice(i, 512)
                reps, vecs = p["rep"].to_numpy(), p["vec"].to_pylist()
                sizes = np.array([len(v) for v in vecs])
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    x = scaled([vecs[k] for k in at])
                    planes, shift = _planes(int(dim))
                    for t in range(TABLES):
                        f = (x / np.linalg.norm(x, axis=1, keepdims=True) @ planes[t].T + shift[t]) / WIDTH
                        cells = [probes(row, many) for row in f] if many > 1 else [[np.floor(row)] for row in f]
                        n = [len(c) for c in cells]
                        key = _keys(np.concatenate([np.stack(c) for c in cells]), int(dim))
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps[at], n)), pa.array(np.full(len(key), t, np.int32)), pa.array(key)], ["rep", "t", "key"])

    return rows.select("rep", "vec").mapInArrow(run, "rep long, t int, key long")


def _met(asked: DataFrame, held: DataFrame, nearest: int) -> DataFrame:
    """query, rep, score of the best of each cell: asked (t, cell, rep, keys, vec) meets held (t, cell, rep, key, vec) on keys."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, r, s = [], [], []
        if len(left) and len(right):
            visitors: dict[int, list[int]] = {}
            for i, keys in enumerate(left["keys"]):
                for k in keys:
                    visitors.setdefault(k, []).append(i)
            key, order = right["key"].to_numpy(), np.argsort(right["key"].to_numpy(), kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=key[order][0] - 1))
            here = [(visitors[k], rows) for k, rows in zip(key[order][cuts].tolist(), np.split(order, cuts[1:])) if k in visitors]
            ids, reps, asks, holds = left["rep"].to_numpy(), right["rep"].to_numpy(), left["vec"].tolist(), right["vec"].tolist()
            lengths = np.array([len(v) for v in holds])
            of = {}  # a bucket's vectors, scaled, of its visitors' length
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for who, rows in here:
                for dim in {len(asks[i]) for i in who}:
                    same, those = [i for i in who if len(asks[i]) == dim], rows[lengths[rows] == dim]
                    if not len(those):
                        continue
                    y = scaled([holds[k] for k in those])
                    unit = (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                    for k, v in zip(those.tolist(), y):
                        of[k] = v
                    for at in range(0, len(same), 256):
                        part = same[at : at + 256]
                        x = scaled([asks[i] for i in part])
                        c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit
                        last = np.partition(c, c.shape[1] - min(nearest, c.shape[1]), axis=1)[:, c.shape[1] - min(nearest, c.shape[1])]
                        for i, row, least in zip(part, c, last):
                            best = np.flatnonzero(row >= least - 1e-9)
                            found.setdefault(i, []).append((those[best], row[best]))
            for i, parts in found.items():
                rows, near = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                if len(rows) > nearest:
                    rows = rows[near >= np.partition(near, len(near) - nearest)[len(near) - nearest] - 1e-9]
                score = cosines(scaled([asks[i]])[0], np.stack([of[k] for k in rows.tolist()]))
                first = np.lexsort((reps[rows], -score))[:nearest]
                q += [ids[i]] * len(first)
                r += reps[rows[first]].tolist()
                s += score[first].tolist()
        return pd.DataFrame({"query": np.array(q, np.int64), "rep": np.array(r, np.int64), "score": np.array(s, float)})

    found = asked.groupBy("t", "cell").cogroup(held.groupBy("t", "cell")).applyInPandas(meet, "query long, rep long, score double")
    return found.groupBy("query", "rep").agg(F.max("score").alias("score"))


def _first(found: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """query, score, vec_id: the first ids of (query, rep, score), ties to smaller ids."""
    few = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= most).drop("n")
    each = few.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= most).drop("n")


def search(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    vec = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null")
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    rows = materialise(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    most = nearest + 1  # one of them may be the query itself
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= most)
    classes = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialise(classes.withColumn("rep", F.col("ids")[0]), "vector-classes")
    asks = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("_vec"))
    queries = materialise(asks.join(classes.select("rep", "vec"), asks["_vec"] == F.col("vec")).select("query_id", "rep"), "queries")
    asked = materialise(classes.select("rep", "vec").join(queries.select("rep").distinct(), "rep"), "asked")
    many = F.lit(-(-classes.count() // BLOCK) or 1).cast("long")
    index = materialise(_hashed(classes, 1), "buckets")
    large = index.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).where("blocks > 1")
    own = lambda block: F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("key"), many)).otherwise(-1 - F.abs(F.xxhash64("key", block) % (1 << 60)))
    held = index.join(large, ["t", "key"], "left").select("t", own(F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("cell"), "rep", "key").join(classes.select("rep", "vec"), "rep")
    sent = _hashed(asked, PROBES).join(large, ["t", "key"], "left")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).select("rep", "t", "key", own(F.col("block")).alias("cell"))
    sent = sent.groupBy("rep", "t", "cell").agg(F.collect_list("key").alias("keys")).join(asked, "rep")
    found = materialise(_first(_met(sent, held, most), classes, most), "found")
    short = asked.join(found.groupBy("query").count().where(F.col("count") >= most), asked["rep"] == F.col("query"), "left_anti")
    size = F.size("vec").cast("long")
    blocked = classes.select(F.lit(0).alias("t"), F.pmod(F.xxhash64("rep"), many).alias("cell"), "rep", size.alias("key"), "vec")
    again = short.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("cell"), "rep", F.array(size).alias("keys"), "vec")
    exact = _first(_met(again, blocked, most), classes, most) if not short.isEmpty() else found.limit(0)
    found = found.join(exact.select("query").distinct(), "query", "left_anti").unionByName(exact)
    out = queries.join(found, queries["rep"] == found["query"]).where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
