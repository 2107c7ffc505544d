"""Packing as a cutting-stock problem by column generation.

Texts become byte-pair ids plus the end id; a document is cut into pieces of LENGTH and a rest. The histogram of piece lengths,
in steps of STEP, is the demand. A restricted linear program over patterns (multisets of lengths that fit a sequence) is solved
by revised simplex; a knapsack dynamic program prices new patterns until none helps. Pattern counts are rounded down, what is
left is placed first-fit decreasing, and the pieces, ranked within their length, take the patterns' slots in turn.

Only histograms go to the driver: a count a length, and then a count for each of the length's salts, of which there are
sqrt(count / EACH), so both the tasks of a very common length and the counts stay small. Ranks are made in two levels, within
salted groups and from their counts. Null and empty texts are the end id alone. Repeated rows are packed
each; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table, worker_cache

LENGTH, STEP, EACH, END = 2048, 8, 500, 1
SIZES = LENGTH // STEP


class Encoder:
    """Ids of a byte-pair vocabulary as packed 32-bit integers, by a bounded cache of pre-tokens."""

    def __init__(self, vocabulary: str = "byte_bpe_50k") -> None:
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.slow = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        owner = self

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) > 300_000:
                    self.clear()
                out = np.array(owner.slow.encode_ordinary(word), "<u4").tobytes()
                if len(word) < 64:
                    self[word] = out
                return out

        self.cache = Cache()

    def ids(self, text: str) -> bytes:
        get = self.cache.__getitem__
        parts = [b"".join(map(get, self.split(x))) for x in text.split("<|endoftext|>")]
        return np.array([50256], "<u4").tobytes().join(parts)


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and its turn in its task."""

    def run(batches):
        from pyspark import TaskContext

        held = worker_cache()
        encoder = held.get("encoder") or held.setdefault("encoder", Encoder())
        end, turn = np.array([END], "<u4").tobytes(), (TaskContext.get().partitionId() if TaskContext.get() else 0) * 7
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                p = b.slice(i, 1024)
                out = []
                for d, t in zip(p["doc_id"].to_pylist(), p["text"]):
                    ids = encoder.ids(t.as_py() or "") + end
                    n = len(ids) // 4
                    for at in range(0, n, LENGTH):
                        part = ids[4 * at : 4 * (at + LENGTH)]
                        turn += 1
                        out.append((d, at, len(part) // 4, zlib.crc32(part), n, turn))
                cols = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type)] + [pa.array(c, pa.int64()) for c in cols[1:]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "turn"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, turn long")


def priced(values: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over the sequence: best value and how many of each size."""
    best, last = np.zeros(SIZES + 1), np.full(SIZES + 1, -1)
    for c in range(1, SIZES + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        best[c] = best[c - 1]
        if k:
            got = best[c - sizes[:k]] + values[:k]
            j = int(np.argmax(got))
            if got[j] > best[c] + 1e-12:
                best[c], last[c] = got[j], j
    counts, c = np.zeros(len(sizes), np.int64), SIZES
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[SIZES]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, stalls: int = 1000) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often each is used; together they cover the demand exactly or beyond. Columns are
    added until the program's optimum is proved within 1e-3; should so many steps in a row not lower it, a warning names the gap."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(SIZES // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    least, idle = x.sum(), 0
    while True:
        value, column = priced(np.maximum(inverse.sum(0), 0), sizes)
        if value <= 1 + 1e-3:  # the optimum is at most this factor away
            break
        idle = 0 if x.sum() < least * (1 - 1e-12) else idle + 1
        least = min(least, x.sum())
        if idle > stalls:
            warnings.warn(f"packing: the program is proved to a factor of {value:.4f} only", stacklevel=2)
            break
        d = inverse @ column
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = x - step * d
        x[r] = step
        row = inverse[r] / d[r]
        inverse = inverse - np.outer(d, row)
        inverse[r] = row
        basis[:, r] = column
    out, left = [], demand.copy()
    for k in np.argsort(-x):
        column = basis[:, k].astype(np.int64)
        used = int(max(0, np.floor(x[k] + 1e-9)))
        fits = left[column > 0] // column[column > 0]
        used = min(used, int(fits.min(initial=used)))
        if used > 0:
            out.append((column, used))
            left = left - used * column
    while left.sum():  # fewer than one sequence a basic pattern is left
        column, room = np.zeros(m, np.int64), SIZES
        for j in range(m - 1, -1, -1):
            n = min(int(left[j]), room // int(sizes[j]))
            column[j], room = n, room - n * int(sizes[j])
        used = int((left[column > 0] // column[column > 0]).min())
        out.append((column, used))
        left = left - used * column
    return out


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    cut = materialise(pieces(docs).withColumn("size", F.ceil(F.col("length") / STEP).cast("int")), "pieces")
    total = np.zeros(SIZES + 1, np.int64)
    for r in cut.groupBy("size").count().collect():  # a row for each size
        total[r["size"]] = r["count"]
    salts = np.maximum(1, np.ceil(np.sqrt(total / EACH))).astype(np.int64)
    cut = cut.withColumn("salt", F.pmod("turn", F.get(F.array(*map(F.lit, salts.tolist())), F.col("size")).cast("long")))
    first_salt = np.cumsum(salts) - salts
    table_ = np.zeros(int(salts.sum()), np.int64)
    for r in cut.groupBy("size", "salt").count().collect():
        table_[first_salt[r["size"]] + r["salt"]] = r["count"]
    before = np.cumsum(table_) - table_
    ahead = before - np.repeat(before[first_salt], salts)
    sizes = np.where(total > 0)[0]
    slots: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    done, base = np.zeros(len(sizes), np.int64), 0
    for column, used in patterns(sizes, total[sizes]):
        for j in np.where(column)[0]:
            slots[int(sizes[j])].append((int(done[j]), int(column[j]), base, int(column[:j].sum())))
            done[j] += column[j] * used
        base += used
    index = {s: tuple(np.array(v, np.int64).reshape(-1, 4).T) for s, v in slots.items()}
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1)

    def place(batches):
        for b in batches:
            size, salt, rank = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "salt", "rank"))
            rank = rank + ahead[first_salt[size] + salt]
            seq, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(size):
                rows = size == s
                first, each, start, order = index[int(s)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                n = rank[rows] - first[k]
                seq[rows], slot[rows] = start[k] + n // each[k], order[k] + n % each[k]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([b[c] for c in keep] + [pa.array(seq), pa.array(slot)], keep + ["sequence_id", "slot"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
