"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

``statistics`` turns whole texts into a fixed vector of transformed shares and counts. Class counts, means
and scatter matrices are summed over all labelled training rows (no sample: each task sends one
small matrix for each class). Class covariances are shrunk towards the pooled one and its diagonal;
their Cholesky factors are computed once and a score is the logistic function of the difference of the Mahalanobis
log densities plus the log prior ratio.

Defined results: null and empty texts have the statistics of a text without words and get a score like
any other; a document with several labels counts once for each, null labels and unlabelled
documents don't train; a label of 0 is class 0, of 1 class 1, others are left out; with fewer than two rows of a class
every score is the share of class 1 (0.5 with no labels at all); a null doc_id has the remainder of the empty
text and never joins a label; repeated rows get equal scores; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdrspark.llm.common import from_texts, id_remainder, written

#: The statistics, in order.
NAMES = (
    "words", "word_length", "word_spread", "upper", "letters", "digits", "stops", "bangs", "bars", "symbols",
    "line_words", "distinct_words", "top_word", "repeated_next", "repeated_triples", "distinct_lines",
)
FLOOR = 1e-3


def _logit(part: float, whole: float, usual: float, weight: float) -> float:
    """Log odds of a share, drawn to a usual one as if `weight` more units had been seen (short texts say little)."""
    p = min(max((part + usual * weight) / (whole + weight), 0.0), 1.0) * (1 - 2 * FLOOR) + FLOOR
    return math.log(p / (1 - p))


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    count = np.bincount(raw, minlength=256)
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    tally = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    # Latin-1 capitals are 0xC3 followed by 0x80 to 0x9E.
    capitals = int(count[65:91].sum()) + int(((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)).sum())
    small = int(count[97:123].sum()) + int((count[128:].sum() + 1) // 2)
    letters = int(count[65:91].sum()) + small
    digits, stops = int(count[48:58].sum()), int(count[46] + count[44])
    ascii_rest = int(count[33:127].sum()) - int(count[65:91].sum()) - int(count[97:123].sum()) - digits - stops
    lines = text.split("\n")
    ids = {w: i for i, w in enumerate(tally)}
    seq = np.fromiter((ids[w] for w in words), np.int64, len(words))
    # Pairs are numbered first: a number of a pair and a word never leaves 64 bits.
    pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
    triples = pairs[:-1] * len(ids) + seq[2:] if len(seq) > 2 else seq[:0]
    return [
        math.log1p(len(words)),
        math.log1p(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        _logit(capitals, letters, 0.03, 60),
        _logit(letters, chars, 0.8, 60),
        _logit(digits, chars, 0.002, 120),
        _logit(stops, n, 0.15, 10),
        _logit(count[33], n, 0, 10),
        _logit(count[124], n, 0, 10),
        _logit(ascii_rest, chars, 0.002, 120),
        math.log1p(len(words) / len(lines)),
        _logit(len(tally), n, 0.8, 20),
        _logit(max(tally.values(), default=0), n, 0.05, 20),
        _logit(float((seq[1:] == seq[:-1]).sum()), n, 0.005, 20),
        _logit(len(triples) - len(np.unique(triples)), len(triples), 0.01, 20),
        _logit(len(lines) - len(set(lines)), len(lines), 0.02, 5),
    ]


@dataclass(frozen=True)
class Model:
    """Prior log odds, and for each class its mean, Cholesky factor and log determinant (none: only the prior)."""

    prior: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    logdets: tuple[float, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        gap = np.full(len(x), self.prior)
        for sign, mean, factor, logdet in zip((-1, 1), self.means, self.factors, self.logdets, strict=True) if self.means else ():
            z = np.linalg.solve(factor, (x - mean).T)
            gap += sign * -0.5 * ((z * z).sum(axis=0) + logdet)
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def moments(x: np.ndarray) -> np.ndarray:
    """Count, sums and products of rows, as one flat vector that adds up."""
    return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])


def fit(sums: dict[int, np.ndarray], to_pooled: float = 0.1, to_diagonal: float = 0.02, floor: float = 1e-3) -> Model:
    """A model from each class's added moments."""
    d = len(NAMES)
    n = {k: float(sums[k][0]) if k in sums else 0.0 for k in (0, 1)}
    prior = math.log((n[1] + 0.5) / (n[0] + 0.5))
    if min(n.values()) < 2:
        return Model(prior)
    means, scatter = [], []
    for k in (0, 1):
        mean = sums[k][1 : d + 1] / n[k]
        means.append(mean)
        scatter.append(sums[k][d + 1 :].reshape(d, d) - n[k] * np.outer(mean, mean))
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    factors, logdets = [], []
    for k in (0, 1):
        # The fewer rows a class has, the more it leans on the pooled matrix.
        lean = to_pooled + (1 - to_pooled) * d / (d + n[k])
        cov = (1 - lean) * scatter[k] / n[k] + lean * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled)) + floor * np.eye(d)
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        logdets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Model(prior, tuple(means), tuple(factors), tuple(logdets))


def vectors(docs: DataFrame) -> DataFrame:
    """docs with the column stats (array of doubles) in place of the text."""

    def start():
        return lambda texts: {"stats": [statistics(t) for t in texts]}

    return from_texts(docs, {"stats": "array<double>"}, start)


def train(labelled: DataFrame) -> Model:
    """From rows (stats, label): every task adds up its rows, the driver adds up a vector for each task and class."""
    width = 1 + len(NAMES) + len(NAMES) ** 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False)
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
            for k in (0, 1):
                total[k] += moments(x[label == k])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total))], names=["label", "sums"])

    rows = labelled.filter(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "stats").mapInArrow(add, "label int, sums array<double>")
    # Tasks' vectors meet in one row for each class, element by element: its size does not grow with the data.
    wide = rows.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    sums = {k: np.zeros(width) for k in {r["label"] for r in wide}}
    for r in wide:
        sums[r["label"]][r["i"]] = r["v"]
    return fit(sums)


def score(table: DataFrame, model: Model) -> DataFrame:
    """table with score in place of stats."""

    def start():
        return lambda rows: {"score": model.scores(np.array(rows, np.float64).reshape(len(rows), -1)).tolist()}

    return from_texts(table, {"score": "double"}, start, column="stats")


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("of"), F.col("quality").alias("label"))
    table = written(vectors(docs).withColumn("held_out", id_remainder(F.col("doc_id"), 5) == 0), "quality-stats")
    model = train(table.filter(~F.col("held_out")).join(labels, F.col("doc_id") == F.col("of")))
    scored = score(table, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
