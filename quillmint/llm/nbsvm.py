"""Linear hinge-loss models over n-gram indicators scaled by naive Bayes log-count ratios.

Operator 6 (quality) uses word 1- and 2-grams, operator 8 (toxicity) character 4- to 6-grams. Features are hashed
into ``1 << BITS`` places. A model is fitted on at most ``sample_rows`` labelled rows (those of the smallest id
hashes) with at most ``sample_features`` features in all: log-count ratios from the indicators, then dual coordinate
descent. A logistic curve over margins that models fitted without the row gave makes scores of them; both kinds weigh
in it to the ``balance``-th power of their share's inverse (0: as they come, 1: alike), so that a fixed threshold means
much the same whether label 1 is rare or common. Every whole text is scored in Arrow batches with the weights alone, so
scoring needs no shuffle.

Defined results: a null or empty text has no features and gets the score of the bias; a null id is scored and not
held out; rows repeat as often as they come; labels that are null or other than 0 and 1, and labels of unknown ids, do
not count; with labels of one kind or none every score is the share of label 1 (0.5 where there is none); other columns are
left alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.llm import textkit as tk
from quillmint.llm.staging import stage, tidy

BITS = 20
SAMPLE_ROWS, SAMPLE_FEATURES = 10_000, 12_000_000
Features = Callable[[tk.Slice], tuple[np.ndarray, np.ndarray]]  # places, and the texts' offsets in them


def _place(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def word_ngrams(part: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and pairs of neighbouring words of each text, repeats included."""
    w = tk.words(part)
    h = tk.word_hashes(part, w, lower=True)
    pair = tk.mix(h[:-1] * np.uint64(0xFF51AFD7ED558CCD) + h[1:]) if len(h) > 1 else h[:0]
    inside = w.doc[1:] == w.doc[:-1]
    doc = np.concatenate([w.doc, w.doc[1:][inside]])
    order = np.argsort(doc, kind="stable")
    return _place(np.concatenate([h, pair[inside]]))[order], np.searchsorted(doc[order], np.arange(len(part.offsets)))


def char_ngrams(part: tk.Slice, sizes: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of 4 to 6 characters (code points, A-Z in lower case) of each text, repeats included."""
    lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    limits = lead[part.offsets]
    x = np.frombuffer(part.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    x += np.uint64(32) * ((x >= 65) & (x <= 90)).astype(np.uint64)
    left = np.repeat(limits[1:], np.diff(limits)) - np.arange(len(x))  # characters up to the text's end
    found = np.full((len(sizes), len(x)), -1, np.int32)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(sizes) + 1):
        h[: len(x) - n + 1] = h[: len(x) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + x[n - 1 :] + np.uint64(n)
        if n in sizes:
            g = h ^ (h >> np.uint64(29))
            found[sizes.index(n)] = np.where(left >= n, _place(g), -1)
    flat = found.T.reshape(-1)
    kept = flat >= 0
    return flat[kept], np.concatenate([[0], np.cumsum(kept)])[limits * len(sizes)]


def _distinct(places: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The different places of one text; ``last`` is scratch of 1 << BITS."""
    at = np.arange(len(places), dtype=np.int32)
    last[places] = at
    return places[last[places] == at]


class Model(NamedTuple):
    weights: np.ndarray  # ratio times weight of each place
    bias: float
    slope: float
    level: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.level, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, alpha: float) -> np.ndarray:
    """Log ratio of the rates at which rows of either kind hold a place; ``alpha`` rows of either kind's share smooth it."""
    counts = np.zeros((2, 1 << BITS))
    for x, y in zip(rows, positive, strict=True):
        counts[int(y), x] += 1
    n = np.array([(~positive).sum(), positive.sum()], float)
    rates = (counts + alpha * (n / n.sum())[:, None]) / n[:, None]
    return np.log(rates[1] / rates[0])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over scaled indicators, by coordinate descent in the dual (box 0 to ``cost`` a row)."""
    rng = np.random.default_rng(seed)
    values = [scale[x] for x in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    weight = np.sum(y > 0), np.sum(y < 0)
    upper = np.where(y > 0, len(y) / (2 * max(weight[0], 1)), len(y) / (2 * max(weight[1], 1))) * cost
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (float(w[x] @ v) + bias) - 1
            if (alpha[i] <= 0 and slope >= 0) or (alpha[i] >= upper[i] and slope <= 0):
                continue
            most = max(most, abs(slope))
            new = min(max(alpha[i] - slope / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[x] += step * v
            bias += step
        if most < 1e-3:
            break
    return w, bias


def _curve(margin: np.ndarray, positive: np.ndarray, balance: float) -> tuple[float, float]:
    """Slope and level of a logistic curve through margins by Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = (len(margin) / (2 * np.where(positive, n1, n0))) ** balance
    spread = max(float(margin.std()), 1e-9)
    x = np.column_stack([margin / spread, np.ones(len(margin))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-6) / spread), float(beta[1])


def _weights(rows: list[np.ndarray], positive: np.ndarray, alpha: float, cost: float) -> tuple[np.ndarray, float]:
    ratio = log_count_ratios(rows, positive, alpha)
    w, bias = dual_descent(rows, np.where(positive, 1.0, -1.0), ratio, cost)
    return w * ratio, bias


def fit_rows(rows: list[np.ndarray], positive: np.ndarray, alpha: float = 30.0, cost: float = 0.1, balance: float = 0.0, parts: int = 3) -> Model:
    if positive.all() or not positive.any():
        share = float(positive.mean()) if len(positive) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    weights, bias = _weights(rows, positive, alpha, cost)
    margin = np.array([weights[x].sum() + bias for x in rows])
    # Every part of either kind is set apart once; where a kind has too few rows, the model's own margins must do.
    part = np.zeros(len(rows), int)
    for kind in (positive, ~positive):
        part[kind] = np.arange(kind.sum()) % parts
    if min(positive.sum(), (~positive).sum()) > 1:
        for k in range(parts):
            own, apart = np.flatnonzero(part != k), np.flatnonzero(part == k)
            if len(set(positive[own])) == 2:
                w, b = _weights([rows[i] for i in own], positive[own], alpha, cost)
                margin[apart] = [w[rows[i]].sum() + b for i in apart]
    return Model(weights, bias, *_curve(margin, positive, balance))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, features: Features, usable: Column, id_col: str, text_col: str, sample_rows: int, sample_features: int, alpha: float, cost: float, balance: float) -> Model:
    """Model from the usable labelled rows (``usable``: a condition on doc_id), within both bounds."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for part in tk.slices(batch.column(2)):
                places, limits = features(part)
                n = len(part.offsets) - 1
                sets = [_distinct(places[limits[i] : limits[i + 1]], last) for i in range(n)]
                ids, kinds = (batch.column(k).slice(part.first, n) for k in (0, 1))
                packed = pa.array([x.astype("<i4").tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, kinds, pa.array([len(x) for x in sets], pa.int64()), packed], names=["doc_id", "kind", "n", "places"])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("kind"))
    known = known.where(F.col("kind").isin(0, 1) & usable).groupBy("doc_id").agg(F.min("kind").alias("kind"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = known.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    some = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "kind", "text")  # bounded by sample_rows
    sample = stage(some.mapInArrow(featured, "doc_id long, kind int, n long, places binary"), "training-rows").withColumn("h", F.xxhash64("doc_id"))
    sizes = sample.select("h", "doc_id", "n").orderBy("h", "doc_id", "n").limit(sample_rows).toPandas()
    within = sizes[sizes["n"].cumsum() <= sample_features]
    if not len(within):
        return fit_rows([], np.zeros(0, bool))
    end = int(within["h"].iloc[-1])
    # An id can repeat, so the limit bounds what is sent as well.
    held = sample.where(F.col("h") <= end).orderBy("h", "doc_id", "n").limit(len(within)).select("kind", "places").toArrow()
    rows_of = [np.frombuffer(x.as_buffer(), "<i4") for x in held.column("places")]
    return fit_rows(rows_of, held.column("kind").to_numpy() == 1, alpha, cost, balance)


def scored(docs: DataFrame, model: Model, features: Features, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 1 << BITS weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << BITS, np.int32)
        m = shared.value
        for batch in batches:
            for part in tk.slices(batch.column(1), 1 << 20):
                places, limits = features(part)
                n = len(part.offsets) - 1
                margin = np.array([m.weights[_distinct(places[limits[i] : limits[i + 1]], last)].sum() for i in range(n)])
                score = m.score(margin)
                ids = batch.column(0).slice(part.first, n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, score double, predicted int")


@tidy
def classify(
    docs: DataFrame, labels: DataFrame, label_col: str, features: Features, folds: int, fold: int, threshold: float,
    id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES, alpha: float = 30.0, cost: float = 0.1, balance: float = 0.0,
) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of rows in ``fold`` (crc32 of the id's text) are never learned."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    model = fit(docs, labels, label_col, features, ~held_out, id_col, text_col, sample_rows, sample_features, alpha, cost, balance)
    return scored(docs, model, features, threshold, id_col, text_col).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, "quality", word_ngrams, 5, 0, 0.3, alpha=1.0, cost=0.01, balance=1.0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, "toxic", char_ngrams, 3, 1, 0.7, sample_rows=8000, balance=0.75)
