"""Hierarchical language identification: linear support vector machines choose the family, then one-versus-one machines vote
among the languages of that family. Features: square roots of the counts of hashed byte trigrams of the whole lower-cased text.

Fit on at most PER_LANGUAGE rows a language and TOTAL rows of the LANGUAGES most frequent ones (documented bounds), those of the
smallest hashes; lang, source and doc_id are never inputs of a prediction. Null texts and texts without a letter get `und` and score 0. With no labelled
document at all, everything is `und`. Repeated rows give a row each; extra columns are not read.
"""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, table

DIM, PER_LANGUAGE, LANGUAGES, TOTAL = 2048, 1000, 64, 16_000
#: Public language families; a language not listed is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic"}


def features(text: bytes) -> np.ndarray:
    out = np.zeros(DIM)
    for i in range(0, max(len(text), 1), 1 << 20):  # bounded memory for very long texts
        b = np.frombuffer(text[i : i + (1 << 20) + 2].lower(), np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
            out += np.bincount(code >> np.uint32(21), minlength=DIM)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-9)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, steps: int = 300, cost: float = 30.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient descent; y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = z = np.zeros(x.shape[1], np.float32)
    rate = 1 / (1 + 2 * cost * 2)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (z - 2 * cost * (x.T @ (share * y * slack)))
        z, w = new + k / (k + 3) * (new - w), new
    return w


def fit(x: np.ndarray, lang: np.ndarray) -> dict:
    family = np.array([FAMILIES.get(v, f"={v}") for v in lang])
    pairs = lambda names, of: {(a, b): machine(x[(of == a) | (of == b)], np.where(of[(of == a) | (of == b)] == a, 1, -1).astype(np.float32)) for a, b in itertools.combinations(names, 2)}
    names = sorted(set(family))
    return {"families": names, "top": pairs(names, family), "below": {f: (sorted(set(lang[family == f])), pairs(sorted(set(lang[family == f])), lang)) for f in names}}


def vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """The name of most votes (ties: larger sum of margins), and the least margin of its duels."""
    n = len(names)
    votes, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), 4.0)
    for (a, b), w in machines.items():
        m, i, j = x @ w[:-1] + w[-1], names.index(a), names.index(b)
        for k, s in ((i, m), (j, -m)):
            votes[:, k] += s > 0
            sums[:, k] += s
            least[:, k] = np.minimum(least[:, k], s)
    best = np.argmax(votes + np.tanh(sums) * 1e-3, axis=1)
    return best, least[np.arange(len(x)), best]


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    best, margin = vote(x, model["families"], model["top"])
    out = np.empty(len(x), object)
    for f, (names, machines) in model["below"].items():
        rows = np.where(best == model["families"].index(f))[0]
        if len(rows):
            k, m = vote(x[rows], names, machines)
            out[rows] = [names[i] for i in k]
            margin[rows] = np.minimum(margin[rows], m)
    return list(out), 1 / (1 + np.exp(-2.0 * margin))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame) -> DataFrame:
    """_lang, _hash, text: rows that may be learned from, those of the smallest hashes of each language. Counts by language set the
    thresholds, so no language is sorted in one task; the fit then takes the exact number. Rows are sampled, not ids: a doc_id
    with several rows or languages brings in no more rows than others."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").alias("_lang"), F.xxhash64("doc_id", "lang", "text").alias("_hash"), "text")
    counts = known.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES).collect()
    each = min(PER_LANGUAGE, TOTAL // max(len(counts), 1))
    condition = F.lit(False)
    for r in counts:
        share = min(1.0, 1.3 * (each + 20) / r["count"])
        condition = condition | ((F.col("_lang") == r["_lang"]) & (F.col("_hash") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)))
    return known.where(condition)


def train(docs: DataFrame) -> dict | None:
    """A model fit in one task on the bounded sample; only its weights go to the driver."""
    rows = map_texts(sampled(docs), lambda t: (features(t).tobytes(),), "x binary", ["_lang", "_hash"])

    def run(batches):
        held: dict[str, list] = {}
        for b in batches:
            for lang, h, x in zip(b["_lang"].to_pylist(), b["_hash"].to_pylist(), b["x"]):
                held.setdefault(lang, []).append((h, x.as_py()))
        each = min(PER_LANGUAGE, TOTAL // max(len(held), 1))
        best = [(lang, x) for lang in sorted(held) for _, x in sorted(held[lang])[:each]]
        held.clear()
        model = fit(np.stack([np.frombuffer(x, np.float32) for _, x in best]), np.array([lang for lang, _ in best])) if best else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first()[0])


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs, by a model of docs unless one is given."""
    model = model or train(docs)
    some = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), some.alias("_letters"), F.col("text").cast("binary").alias("_text"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                p = b.slice(i, 512)
                lang, score = ["und"] * p.num_rows, np.zeros(p.num_rows)
                where = [k for k, v in enumerate(p["_letters"].to_pylist()) if v and model]
                if where:
                    said, s = predict(model, np.stack([features(p["_text"][k].as_py()) for k in where]))
                    score[where] = s
                    for k, v in zip(where, said):
                        lang[k] = v
                yield pa.RecordBatch.from_arrays([p["doc_id"], p["held_out"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def filtered(docs: DataFrame) -> DataFrame:
    """docs without the rows that get `und`; a null lang gets the prediction. The model is fit on docs, so texts of any learned
    language stay, whatever their score. Extra columns of any name pass through."""
    model = train(docs)
    some = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    names, at, lang = docs.columns, docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                p = b.slice(i, 512)
                if model and p.num_rows:
                    said = predict(model, np.stack([features(t.as_py().encode()) for t in p.column(at)]))[0]
                    new = pa.array([x if old is None else old for old, x in zip(p.column(lang).to_pylist(), said)], pa.string())
                    yield pa.RecordBatch.from_arrays([new if k == lang else p.column(k) for k in range(len(names))], names)

    return docs.where(some).mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
