"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting adds shallow trees of one feature at a time (two cuts), then of chosen pairs of features (one cut each); what
they add up to is a lookup table for each feature and pair. A score is a sum of looked-up bins, for all rows at once.

Fit on at most SAMPLE labelled documents (a documented bound; the smallest hashes of doc_id whose crc32 mod 5 is not 0).
Features come from the text alone. Null and empty texts have zero features and get a score like any other. A doc_id labelled
more than once counts as the majority (ties: 1). With no labels of two classes all scores equal the share of label 1 (0.5 if there is none).
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, smallest, table

SAMPLE, BINS, COARSE, ROUNDS, PAIRS, RATE = 20_000, 32, 8, 120, 6, 0.15
SYMBOLS = b"#*$%&|<>!@{}[]=+\\/~^_"
FEATURES = ["log_words", "word_bytes", "distinct", "runs", "top", "symbols", "ends", "upper", "digits", "lines", "same_lines", "stops", "high"]


def features(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(FEATURES)
    low = [w.lower() for w in words]
    counts = Counter(low)
    lines = [x for x in text.split(b"\n") if x.strip()]
    some = len(text.translate(None, SYMBOLS))
    letters = len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ten = sum(c for _, c in counts.most_common(10))
    return [
        np.log1p(n), sum(map(len, words)) / n, len(counts) / n, sum(map(eq, low, low[1:])) / n, max(counts.values()) / n, (size - some) / size, sum(w[-1] in SYMBOLS for w in words) / n,
        (size - letters) / size, (size - len(text.translate(None, b"0123456789"))) / size, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), ten / n, sum(len(w) > 20 for w in words) / n,
    ]


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of the best tree of two cuts over the bins, from sums of gradient and weight."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 5.0)
    i, j = np.triu_indices(len(g) + 1)
    k = np.argmax(gain(np.zeros_like(i), i) + gain(i, j) + gain(j, np.full_like(j, len(g))))
    out = np.zeros(len(g))
    for a, b in ((0, i[k]), (i[k], j[k]), (j[k], len(g))):
        if b > a:
            out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 5.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The same for a pair: the best cut of each of two features."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, at = -1.0, None
    for i in range(1, COARSE):
        for j in range(1, COARSE):
            s = [(x[i, j], x[i, -1] - x[i, j], x[-1, j] - x[i, j], x[-1, -1] - x[i, -1] - x[-1, j] + x[i, j]) for x in (cg, ch)]
            v = sum(a * a / (b + 5.0) for a, b in zip(*s))
            if v > best:
                best, at = v, (i, j, [a / (b + 5.0) for a, b in zip(*s)])
    i, j, leaf = at
    out = np.empty_like(g)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = leaf
    return out, best


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.base, self.tables, self.pairs = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))) if len(y) else 0.0, [], {}
        self.base = float(np.clip(self.base, -8, 8))
        if len(set(y.tolist())) < 2:
            self.cuts = []
            return
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        bins = self.bins(x)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        score = np.full(len(y), self.base)

        def sums(index, n):
            p = 1 / (1 + np.exp(-score))
            return np.bincount(index, y - p, n), np.bincount(index, p * (1 - p), n)

        for _ in range(ROUNDS):
            for k, t in enumerate(self.tables):
                step = RATE * _tree(*sums(bins[k], len(t)))
                t += step
                score += step[bins[k]]
        coarse = [b * COARSE // (len(c) + 1) for b, c in zip(bins, self.cuts)]
        both = lambda a, b: coarse[a] * COARSE + coarse[b]
        square = lambda v: tuple(s.reshape(COARSE, COARSE) for s in v)
        gains = sorted(((_quarters(*square(sums(both(a, b), COARSE**2)))[1], a, b) for a, b in combinations(range(len(self.cuts)), 2)), reverse=True)
        self.pairs = {(a, b): np.zeros((COARSE, COARSE)) for _, a, b in gains[:PAIRS]}
        for _ in range(ROUNDS // 4):
            for (a, b), t in self.pairs.items():
                step = RATE * _quarters(*square(sums(both(a, b), COARSE**2)))[0]
                t += step
                score += step[coarse[a], coarse[b]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.cuts:
            bins = self.bins(x)
            for t, b in zip(self.tables, bins):
                out += t[b]
            coarse = [b * COARSE // (len(c) + 1) for b, c in zip(bins, self.cuts)]
            for (a, b), t in self.pairs.items():
                out += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-out))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(batches, keep):
    for b in batches:
        for i in range(0, b.num_rows, 512):
            p = b.slice(i, 512)
            yield p, np.array([features(t.as_py() or b"") for t in p["_text"]], dtype=float).reshape(p.num_rows, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y")).where(~held_out())
    ids = materialise(smallest(known, F.xxhash64("doc_id"), SAMPLE).select("doc_id", "_y"), "sample")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(F.broadcast(ids), "doc_id").select("_y", "_text")  # SAMPLE rows at most

    def run(batches):
        for p, x in _vectors(batches, ()):
            yield pa.RecordBatch.from_arrays([p["_y"], pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    found = materialise(rows.mapInArrow(run, "y int, x array<double>"), "vectors")
    got = smallest(found, F.xxhash64("x"), SAMPLE).select("y", "x").collect()
    return Model(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("_text"))

    def run(batches):
        for p, x in _vectors(batches, ()):
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([p["doc_id"], p["held_out"], pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
