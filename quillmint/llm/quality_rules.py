"""Operator 5: quality rules with an isolation forest over rule statistics.

One pass over whole texts measures every document where it lies. A forest of random splits grows from the statistics: each
tree draws its few points, as the method says, from good labelled rows, over the box of all labelled rows. The path-length
threshold is calibrated on a histogram of the scores of every labelled row.

Defined results: a null or empty text has no words and fails the base rule; rows repeat as often as they come,
null ids included; other columns of the input are left alone; an empty table gives an empty table; with no
labelled rows there is nothing to calibrate on, and the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.llm import textkit as tk
from quillmint.llm.staging import stage, tidy

#: Statistics of the rules, each a long.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_punct", "n_upper", "n_stubs")
BINS = 1 << 16  # of scores, which lie between 0 and 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?'\"()-")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    if b"\n" not in data:
        return 0, int(bool(data.split(None, 1)))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines)), len(lines)


def _repeat_words(w: tk.Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each text inside a five-word window that the text holds twice or more."""
    s = tk.shingles(w, hashes, 5, short=False)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(s.value):
        value = tk.mix(s.value ^ (s.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(value)
        same = value[order][1:] == value[order][:-1]
        twice = np.zeros(len(value), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = s.word[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    hit = np.cumsum(covered)[:-1] > 0
    return np.bincount(w.doc[hit], minlength=len(w.count))


def measured(part: tk.Slice) -> dict[str, np.ndarray]:
    """The statistics of each text of a slice."""
    n, data, offsets = len(part.offsets) - 1, part.data, part.offsets
    w, space, raw = tk.words(part), tk.IS_SPACE[part.data], part.data.tobytes()
    lines = np.array([_duplicate_lines(raw[offsets[i] : offsets[i + 1]]) for i in range(n)], np.int64).reshape(n, 2)
    values = (
        w.count,
        _per_text(((data & 0xC0) != 0x80) & ~space, offsets),
        _per_text(_SYMBOL[data], offsets),
        lines[:, 0],
        _repeat_words(w, tk.word_hashes(part, w, lower=False)),
        lines[:, 1],
        _per_text(_DIGIT[data], offsets),
        _per_text(_PUNCT[data], offsets),
        _per_text(_UPPER[data], offsets),
        np.bincount(w.doc[w.end - w.start <= 2], minlength=n),
    )
    return {k: v.astype(np.int64) for k, v in zip(STATS, values, strict=True)}


def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) become (id, statistics)."""
    for batch in batches:
        for part in tk.slices(batch.column(1)):
            ids = batch.column(0).slice(part.first, len(part.offsets) - 1)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, measured(part).values())], names=["doc_id", *STATS])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the rules: what the random splits look at."""
    x = {k: np.asarray(stats[k], float) for k in STATS}
    words, chars, lines = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1), np.maximum(x["n_lines"], 1)
    rates = [
        np.minimum(x["n_words"], 40) / 40,
        np.minimum(x["n_symbols"] / words, 1),
        np.minimum(x["n_dup_lines"] / lines, 1),
        x["n_repeat_words"] / words,
        np.minimum(x["n_digits"] / chars, 1),
        np.minimum(x["n_punct"] / words, 1),
        np.minimum(x["n_upper"] / words, 1),
        x["n_stubs"] / words,
    ]
    return np.sqrt(np.column_stack(rates))


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits; a short mean path marks a point that few splits set apart.

    The trees grow from ordinary rows, but every split is drawn over the whole box of the labelled rows, so a
    region without ordinary rows is cut off after few splits even where all ordinary rows agree.
    """

    def __init__(self, trees: int = 100, points: int = 256, deepest: int = 12, seed: int = 7):
        self.trees, self.points, self.deepest, self.seed = trees, points, deepest, seed
        self.grown: list[tuple[np.ndarray, ...]] = []
        self.norm = 1.0

    def fit(self, x: np.ndarray, box: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        points = min(self.points, len(x))
        self.norm = max(float(_mean_path(np.array(points))), 1e-9)
        for _ in range(self.trees):
            column, cut, left, right, depth = [], [], [], [], []

            def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
                at = len(column)
                for to in (column, left, right):
                    to.append(-1)
                cut.append(0.0)
                depth.append(level + float(_mean_path(np.array(len(rows)))))
                wide = np.flatnonzero(high > low)
                if level < self.deepest and len(rows) > 1 and len(wide):
                    c = int(rng.choice(wide))
                    value = rng.uniform(low[c], high[c])
                    column[at], cut[at] = c, value
                    upper, lower = high.copy(), low.copy()
                    upper[c] = lower[c] = value
                    left[at] = grow(rows[rows[:, c] <= value], low, upper, level + 1)
                    right[at] = grow(rows[rows[:, c] > value], lower, high, level + 1)
                return at

            grow(x[rng.choice(len(x), points, replace=False)], box.min(0), box.max(0), 0)
            self.grown.append((np.array(column), np.array(cut), np.array(left), np.array(right), np.array(depth)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row in (0, 1): 2 to the minus mean path over its norm."""
        total = np.zeros(len(x))
        for column, cut, left, right, depth in self.grown:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(column[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(x[inner, column[at]] <= cut[at], left[at], right[at])
            total += depth[node]
        return 2.0 ** (-total / max(len(self.grown), 1) / self.norm)


def measured_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(measure_batches, "doc_id long, " + ", ".join(f"{x} long" for x in STATS))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000, keep_rate: float = 0.995) -> tuple[IsolationForest, float] | None:
    """Forest and threshold from every labelled row (doc_id and STATS) that passes the base rule.

    The trees draw their points from at most ``sample_rows`` good rows (those of the smallest id hashes) and split the box of
    all rows. The threshold comes from all rows, counted in BINS of their scores: it lets at least ``keep_rate`` of the good rows
    pass and, above that, lies where the rejected bad rows outnumber the rejected good ones the most.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passing = (F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words"))
    rows = stage(stats.where(passing).join(known, "doc_id"), "rule-labelled")
    # Rows of one id can repeat; the first sample_rows in order are the bound.
    good = rows.where("quality = 1").orderBy(F.xxhash64("doc_id"), *STATS).limit(sample_rows).toPandas()
    if not len(good):
        return None
    names = [f"x{n}" for n in range(features({k: np.zeros(1) for k in STATS}).shape[1])]

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = features({k: batch.column(k).to_numpy() for k in STATS})
                yield pa.RecordBatch.from_arrays([pa.array([a, b]) for a, b in zip(x.min(0), x.max(0), strict=True)], names=names)

    box = rows.select(*STATS).mapInArrow(corners, ", ".join(f"{x} double" for x in names)).agg(*(f(x) for f in (F.min, F.max) for x in names)).first()
    forest = IsolationForest().fit(features({k: good[k].to_numpy() for k in STATS}), np.array(box, float).reshape(2, -1))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(features({k: batch.column(k).to_numpy() for k in STATS}))
            yield pa.RecordBatch.from_arrays([pa.array((score * BINS).astype(np.int32)), batch.column("quality")], names=["bin", "quality"])

    counted = rows.select(*STATS, "quality").mapInArrow(bins, "bin int, quality int").groupBy("bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    held = counted.orderBy("bin").toPandas()  # at most BINS rows
    at, n_good, n_bad = held["bin"].to_numpy(), np.cumsum(held["good"].to_numpy()), np.cumsum(held["bad"].to_numpy())
    least = int(np.searchsorted(n_good, keep_rate * n_good[-1]))
    weigh = (n_bad[-1] - n_bad) / max(n_bad[-1], 1) - (n_good[-1] - n_good) / n_good[-1]
    best = least + int(np.argmax(weigh[least:]))
    above = at[best + 1] if best + 1 < len(at) else at[best] + 1
    return forest, float((at[best] + 1 + above) / 2 / BINS)


def _judge(fitted: tuple[IsolationForest, float] | None, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, anomaly and kept of measured texts."""
    failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
    if fitted is None:
        return failed, np.zeros(len(failed)), ~failed
    score = fitted[0].score(features(stats))
    return failed, score, ~failed & (score <= fitted[1])


@tidy
def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """Per row: doc_id, STATS, base_failed, anomaly (double) and kept."""
    stats = stage(measured_rows(docs, id_col, text_col), "rule-stats")
    fitted = fit(stats, labels, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = _judge(fitted, {k: batch.column(k).to_numpy() for k in STATS})
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, judged)], names=["doc_id", *STATS, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(judge, "doc_id long, " + ", ".join(f"{x} long" for x in STATS) + ", base_failed boolean, anomaly double, kept boolean")


@tidy
def passing_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """The input rows that the rules keep, with their own columns."""
    fitted = fit(measured_rows(docs, id_col, text_col), labels, sample_rows)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch.column(at)):
                kept = _judge(fitted, measured(part))[2]
                yield batch.slice(part.first, len(kept)).filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
