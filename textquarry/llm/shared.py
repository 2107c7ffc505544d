"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import types
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: the warehouse on a cluster, and a temporary folder in local mode,
    where all tasks run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="textquarry-"))
        atexit.register(shutil.rmtree, _LOCAL[0][7:], ignore_errors=True)
    return _LOCAL[0]


def _stored(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors cost no rerun.
    The table goes when it is dropped, or when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, where = _stored(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes the table of a materialised df that nothing reads any more."""
    if df is not None:
        store, where = _stored(df.sparkSession, df._stored_at)
        store.delete(where, True)
        store.cancelDeleteOnExit(where)


def worker_cache() -> dict:
    """A dictionary that lasts as long as the Python worker. Functions sent by value bring globals of their own for each task; what
    is costly to build is held here, under a module that the worker registers for itself."""
    return vars(sys.modules.setdefault("textquarry_worker_cache", types.ModuleType("textquarry_worker_cache")))


def smallest(df: DataFrame, order: Column, most: int) -> DataFrame:
    """The `most` rows of df of the smallest 64-bit hashes `order`, which is also returned as _order. Where df has more, a threshold by count
    goes first, so that the last sort meets little more than `most` rows in all, not from each task. df is read twice."""
    df = df.withColumn("_order", order)
    share = 1.3 * (most + 20) / max(df.count(), 1)
    few = df.where(F.col("_order") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else df
    return few.orderBy("_order", *[c for c in df.columns if c != "_order"]).limit(most)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def map_texts(df: DataFrame, fn, schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """A row per row of df: `keep` columns, then the values of fn(text as bytes) under the names of `schema`. Null text: b""."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    whole = StructType([df.schema[k] for k in keep] + list(added))
    arrow = to_arrow_schema(added)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                x = b.slice(i, 1024)
                rows = [fn(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in x["_text"]]
                cols = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays([x[k] for k in keep] + cols, keep + arrow.names)

    return df.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, whole)


class WordHashes(dict):
    """64-bit hashes of words, kept for the frequent ones; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = out
        return out

    def __reduce__(self) -> tuple:
        return WordHashes, ()  # tasks start with an empty one


_HASHES = WordHashes()


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(len(h), width)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):  # word hashes are uniform: odd factors tell places apart
        out += h[k : len(h) - n + 1 + k] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 + 2 * n & 0xFFFFFFFFFFFFFFFF)
    return np.unique(mixed(out))
