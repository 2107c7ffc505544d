"""Quality rules with robust multivariate outliers.

Base rules fail texts of fewer than 20 words or with over 30 % of words in repeated 8-word windows. Beyond them, each language
and source has a minimum-covariance-determinant estimate of its transformed statistic vectors: the mean and covariance of that
SHARE of its documents whose covariance has the least determinant. A document goes if its squared Mahalanobis distance is over CUT.

Starts: for each group, STARTS random subsets of a sample of at most START_ROWS distinct vectors (a documented bound) take two
concentration steps; the TRIED of least determinant go on until they settle, and the BEST of these are starts for the whole
group. Concentration: steps over all documents as grouped sums, until no group's log determinant moves by SETTLED or more (at
most STEPS, then a warning); then the start of least determinant is the group's. FLOOR is added to covariances, so constant
statistics are not singular. Every group has its own estimate; it is joined with that of all documents as if PRIOR of those
belonged to the group, which matters for groups of few documents only. Shares and medians of distances are approximate quantiles
over all rows (1 in 10,000).

Hot groups: all passes over documents are partial sums; estimates (a row a group) are broadcast while there are at most GROUPS,
and joined by sorting, where Spark splits skewed keys, beyond.

Null and empty texts have zero statistics and fail the base rules. Null lang or source is a value of its own. Repeated rows give
a row each; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, materialise, table

DIMS, SHARE, CUT, FLOOR, PRIOR, GROUPS = 5, 0.75, 60.0, 0.1, 10, 20_000
START_ROWS, STARTS, TRIED, BEST, STEPS, SETTLED = 600, 40, 8, 2, 20, 0.01
#: Median of the chi-square distribution with DIMS degrees of freedom.
MEDIAN = 4.3515
ESTIMATE = "g long, start int, n long, mean array<double>, cov array<double>, inverse array<double>, log_det double"


def _repeated(words: list[bytes], width: int = 8) -> int:
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    span = 1
    while span < width:  # ranks of windows of 2, 4, 8 words: exact
        both = rank[:-span] * (len(words) + 1) + rank[span:]
        rank = np.unique(both, return_inverse=True)[1]
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(b"".join(words).translate(None, bytes(range(128, 192))))  # no continuation bytes: code points
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(n) / 2, F.log(F.col("word_chars") / n + 0.1), F.sqrt(F.least(F.col("n_symbols") / n, F.lit(4.0))), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(i, DIMS):
            total = total + (F.col(f"x{i}") - F.col("mean")[i]) * (F.col(f"x{j}") - F.col("mean")[j]) * F.col("inverse")[i * DIMS + j] * (1 if i == j else 2)
    return total


def _estimate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance (with FLOOR) and log determinant of rows."""
    c = np.cov(x, rowvar=False, bias=True).reshape(DIMS, DIMS) + np.eye(DIMS) * FLOOR**2
    return x.mean(0), c, float(np.linalg.slogdet(c)[1])


def concentrated(x: np.ndarray, start: np.ndarray, steps: int, share: float = SHARE) -> tuple[float, tuple[int, ...]]:
    """Log determinant and rows after so many concentration steps from the rows `start`, fewer if they settle."""
    keep, rows = int(np.ceil(share * len(x))), start
    for _ in range(steps):
        m, c, _ = _estimate(x[rows])
        far = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
        new = np.sort(np.argsort(far, kind="stable")[:keep])
        if len(new) == len(rows) and (new == rows).all():
            break
        rows = new
    return _estimate(x[rows])[2], tuple(rows.tolist())


def searched(x: np.ndarray, seed: int, best: int = BEST) -> list[tuple[int, ...]]:
    """The best subsets of a search for the least determinant, best first."""
    if len(x) <= DIMS + 1:
        return [tuple(range(len(x)))]
    rng = np.random.default_rng(seed)
    first = sorted({concentrated(x, np.sort(rng.choice(len(x), DIMS + 1, replace=False)), 2) for _ in range(STARTS)})[:TRIED]
    return [rows for _, rows in sorted({concentrated(x, np.array(rows), 100) for _, rows in first})[:best]]


def _starts(part: pd.DataFrame) -> pd.DataFrame:
    g = int(part["g"].iloc[0])
    x = part.sort_values("h").head(START_ROWS)[[f"x{i}" for i in range(DIMS)]].to_numpy()
    out = []
    for k, rows in enumerate(searched(x, g & 0xFFFFFFFF)):
        m, c, d = _estimate(x[list(rows)])
        out.append((g, k, len(rows), m.tolist(), c.ravel().tolist(), np.linalg.inv(c).ravel().tolist(), d))
    return pd.DataFrame(out, columns=["g", "start", "n", "mean", "cov", "inverse", "log_det"])


def _estimates(sums: DataFrame) -> DataFrame:
    """An estimate for each row of grouped sums."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = np.array([r[f"s{i}"] for i in range(DIMS)]) / r["n"]
                c = np.eye(DIMS) * FLOOR**2
                for i in range(DIMS):
                    for j in range(i, DIMS):
                        v = r[f"q{i}{j}"] / r["n"] - m[i] * m[j]
                        c[i, j] += max(v, 0.0) if i == j else v
                        c[j, i] = c[i, j]
                out.append((r["g"], r["start"], r["n"], m.tolist(), c.ravel().tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64()]
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["g", "start", "n", "mean", "cov", "inverse", "log_det"])

    return sums.mapInArrow(run, ESTIMATE)


def _joined_with_all(known: DataFrame) -> DataFrame:
    """g, mean, inverse: the estimates (scaled by the median distance) as if PRIOR of all documents belonged to each group."""
    every = known.where("g = 0").select(F.col("mean").alias("m0"), (F.col("scale")).alias("s0"), F.col("cov").alias("c0"))
    both = known.join(F.broadcast(every), F.lit(True))  # one row

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n, m, m0 = r["n"], np.array(r["mean"]), np.array(r["m0"])
                c = (n * r["scale"] * np.array(r["cov"]) + PRIOR * r["s0"] * np.array(r["c0"])) / (n + PRIOR)
                out.append((r["g"], ((n * m + PRIOR * m0) / (n + PRIOR)).tolist(), np.linalg.inv(c.reshape(DIMS, DIMS)).ravel().tolist()))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *[pa.list_(pa.float64())] * 2))], ["g", "mean", "inverse"])

    return both.select("g", "n", "mean", "cov", "scale", "m0", "c0", "s0").mapInArrow(run, "g long, mean array<double>, inverse array<double>")


def estimates(good: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """g, mean, inverse of the groups of good (g, x0 ...), of which 0 is all documents; and how to join
    tables of a row a group: broadcast if there are at most GROUPS, else as they are."""
    xs = [f"x{i}" for i in range(DIMS)]
    both = good.select(F.explode(F.array(F.col("g"), F.lit(0).cast("long"))).alias("g"), *xs)
    counts = materialise(both.groupBy("g").agg(F.approx_count_distinct(F.xxhash64(*xs), 0.02).alias("distinct")), "counts")
    sized = F.broadcast if counts.count() <= GROUPS else lambda x: x
    few = both.withColumn("h", F.xxhash64(*xs)).join(sized(counts), "g")
    few = few.where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("distinct") <= 1.4 * START_ROWS).select("g", "h", *xs).dropDuplicates(["g", *xs])
    known = materialise(few.groupBy("g").applyInPandas(_starts, ESTIMATE), "estimates")
    for step in range(STEPS):
        d = both.join(sized(known.select("g", "start", "mean", "inverse")), "g").select("g", "start", *xs, _distance().alias("far"))
        near = d.groupBy("g", "start").agg(F.percentile_approx("far", SHARE, 10_000).alias("most"))
        core = d.join(sized(near), ["g", "start"]).where(F.col("far") <= F.col("most"))
        sums = core.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIMS) for j in range(i, DIMS)])
        new = materialise(_estimates(sums), "estimates")
        moved = new.select("g", "start", F.col("log_det").alias("now")).join(known.select("g", "start", "log_det"), ["g", "start"]).agg(F.max(F.abs(F.col("now") - F.col("log_det")))).first()[0]
        known = new
        if moved is None or moved < SETTLED:
            break
    else:
        warnings.warn(f"quality rules: log determinants still move by {moved:.3f} after {STEPS} steps", stacklevel=2)
    least = known.groupBy("g").agg(F.min_by(F.struct("n", "mean", "cov", "inverse"), F.struct("log_det", "start")).alias("e")).select("g", "e.*")
    d = both.join(sized(least.select("g", "mean", "inverse")), "g").select("g", _distance().alias("far"))
    scale = d.groupBy("g").agg(F.greatest(F.percentile_approx("far", 0.5, 10_000) / MEDIAN, F.lit(0.25)).alias("scale"))
    return materialise(_joined_with_all(least.join(scale, "g")), "estimates"), sized


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and far (squared distance) of each row of docs."""
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    stats = map_texts(docs.select("doc_id", "text", F.xxhash64(F.to_json(F.struct("lang", "source"))).alias("g")), statistics, kinds, ["doc_id", "g"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = materialise(stats.withColumn("base_failed", failed), "statistics").select("*", *[x.alias(f"x{i}") for i, x in enumerate(_vector())])
    known, sized = estimates(stats.where(~F.col("base_failed")))
    out = stats.join(sized(known), "g", "left").withColumn("far", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("far"), F.lit(0.0)) <= CUT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "far")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
