"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Severity grades come from the labels: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in one of bad quality. The model is
``P(grade <= j) = sigmoid(theta_j - w . x)`` with one weight vector shared by all thresholds theta_0 <= theta_1; x marks which
features (words and beginnings of words) a text has. Features are kept as 64-bit hashes, so no two share a weight. A text's
expected severity is the sum of ``P(grade > j)``; it is toxic where that reaches THRESHOLD.

The model is fitted on at most MAX_TRAIN labelled texts, those with the least hashes of their doc_id, by maximising the likelihood
less PENALTY times the sum of absolute weights. Every feature of those texts takes part; the penalty leaves a weight to those
that need one. The features stay in a table: a distributed aggregate finds those whose gradient exceeds the penalty, only these
come to the driver for the fit, and the aggregate is taken again with the fitted residuals until no feature is left out wrongly.
Scoring covers every row and whole text; what is shipped to executors is the model, whose size the bounded sample bounds.

Defined cases: null and empty texts have no words and get the base severity; very long texts are scored whole; labels with null
toxicity or without a document are ignored, null quality counts as good; with labels of one kind, or none, no text is toxic;
repeated labels and rows count once, labels and texts of a repeated doc_id once each; an empty table gives an empty result; extra
columns are ignored by score() and pass through clean().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrain.llm.common import LOWER, mix64, saved, slices, small_batches, span_hashes, utf8, word_spans

GRADES = 3
MAX_TRAIN = 6000
#: The weight of the absolute weights against the mean log likelihood.
PENALTY = 3e-4
#: Features that enter the fit in one round, and the excess of a gradient over the penalty that is taken as none.
ENTER, TOLERANCE = 256, 1.05
THRESHOLD = 0.5

#: Bytes that no word holds: ASCII but letters and digits.
APART = np.ones(256, dtype=bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


#: Besides its words, a text has as features the first so many bytes of its longer words, which inflected forms share.
STEMS = (4, 5, 6)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the features of each text: its words of letters and digits, lower-cased (A-Z), and their beginnings."""
    data, off = utf8(column)
    data = LOWER[data]
    start, end, bounds = word_spans(data, off, APART)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    rows, hashes = [row], [span_hashes(data, start, end)]
    for size in STEMS:
        longer = end - start > size
        rows.append(row[longer])
        hashes.append(mix64(span_hashes(data, start[longer], start[longer] + size) ^ np.uint64(size)))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thetas: np.ndarray

    def severity(self, scores: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(self.thetas[None, :] - scores[:, None]))).sum(1)

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        row, found = features(column)
        if not len(self.words) or not len(found):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
        hit = self.words[at] == found
        seen = np.unique(row[hit] * len(self.words) + at[hit])
        return np.bincount(seen // len(self.words), self.weights[seen % len(self.words)], n)


def base(grades: np.ndarray) -> np.ndarray:
    """Ascending thresholds without any features: log odds of the grades' shares, smoothed."""
    share = np.array([((grades <= j).sum() + 1) / (len(grades) + 2) for j in range(GRADES - 1)])
    return np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(GRADES - 1) * 1e-3) + np.arange(GRADES - 1) * 1e-3


def residuals(eta: np.ndarray, theta: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log likelihood: by each text's score, and by each theta."""
    n = len(grades)
    cut = np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - eta[:, None], np.full((n, 1), np.inf)], 1)
    c = 1 / (1 + np.exp(-cut))
    d = c * (1 - c)
    of = lambda a, i: np.take_along_axis(a, i[:, None], 1)[:, 0]
    q = np.maximum(of(c, grades + 1) - of(c, grades), 1e-12)
    high, low = of(d, grades + 1) / q, of(d, grades) / q
    return low - high, np.array([high[grades == j].sum() - low[grades == j + 1].sum() for j in range(GRADES - 1)])


def fit_weights(row: np.ndarray, col: np.ndarray, w: np.ndarray, theta: np.ndarray, grades: np.ndarray, penalty: float = PENALTY, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the features col that texts row have, by proximal gradient steps with momentum (Adam)."""
    k, n = len(w), len(grades)
    p = np.concatenate([w, [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[k + 1 :])
        by_score, by_theta = residuals(np.bincount(row, p[:k][col], n), p[k] + np.concatenate([[0], np.cumsum(gaps)]), grades)
        grad = np.concatenate([np.bincount(col, by_score[row], k), [by_theta.sum()], np.cumsum(by_theta[::-1])[::-1][1:] * gaps]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p = p + rate * m / (1 - 0.9**step)
        p[:k] = np.sign(p[:k]) * np.maximum(np.abs(p[:k]) - rate[:k] * penalty, 0)
    return p[:k], p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct feature of each text."""
    for whole in batches:
        for batch in slices(whole):
            row, found = features(batch.column("text"))
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            yield pa.RecordBatch.from_pydict({"text": batch.column("nth").take(pa.array(row[new])), "feature": pa.array(found[new].astype(np.int64))})


def sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, DataFrame]:
    """Grades of the labelled texts in the sample, and a table of their features (text, feature)."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) > 0, 1).otherwise(2)
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", grade.alias("grade"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(F.col("doc_id").alias("d"), tie.alias("tie"), "text")
    ids = known.join(texts.select("d", "tie"), F.col("doc_id") == F.col("d")).select("doc_id", "tie", "grade").distinct()
    ids = ids.orderBy(F.xxhash64(F.lit("train"), F.col("doc_id")), "doc_id", "grade", "tie").limit(most)
    rows = [(i, r["doc_id"], r["tie"], r["grade"]) for i, r in enumerate(ids.collect())]  # most rows of a few numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame([r[:3] for r in rows], f"nth int, doc_id {kind}, t long")
    chosen = texts.join(F.broadcast(ids), (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("tie"))).select("nth", "text").dropDuplicates(["nth"])
    return np.array([r[3] for r in rows], np.int64), saved(chosen.mapInArrow(_distinct, "text int, feature long"), "features")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, penalty: float = PENALTY) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    grades, table = sample(docs, labels, most)
    theta = base(grades)
    words, w = np.zeros(0, np.int64), np.zeros(0)
    row = col = np.zeros(0, np.int64)
    if (grades > 0).all() or not (grades > 0).any():  # nothing tells toxic texts: none is
        return Model(words.astype(np.uint64), w, np.maximum(theta, [4.0, 5.0]))
    while True:
        by_score, _ = residuals(np.bincount(row, w[col], len(grades)), theta, grades)
        shares = spark.createDataFrame(list(enumerate((by_score / len(grades)).tolist())), "text int, r double")
        pull = table.join(F.broadcast(shares), "text").groupBy("feature").agg(F.abs(F.sum("r")).alias("pull")).where(F.col("pull") > penalty * (TOLERANCE if len(words) else 1.0))
        found = np.array([r["feature"] for r in pull.orderBy(F.desc("pull"), "feature").limit(ENTER).collect()], np.int64)
        fresh = np.setdiff1d(found, words)
        if not len(fresh):
            break
        grown = np.union1d(words, fresh)
        start = np.zeros(len(grown))
        start[np.searchsorted(grown, words)] = w
        words, w = grown, start
        chosen = spark.createDataFrame([(x,) for x in words.tolist()], "feature long")
        cells = table.join(F.broadcast(chosen), "feature").toArrow()
        row, col = cells.column("text").to_numpy().astype(np.int64), np.searchsorted(words, cells.column("feature").to_numpy())
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        w, theta = fit_weights(row, col, w, theta, grades, penalty)
    keep = w != 0
    order = np.argsort(words[keep].astype(np.uint64))
    return Model(words[keep].astype(np.uint64)[order], w[keep][order], theta)


def scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                severity = model.value.severity(model.value.score(batch.column("text")))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "severity": pa.array(np.round(severity, 6)), "grade": pa.array(np.minimum(np.floor(severity + 0.5), GRADES - 1).astype(np.int32)), "toxic": pa.array(severity >= THRESHOLD)}
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (nearest), toxic for each row of docs."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scorer(shipped), f"doc_id {kind}, severity double, grade int, toxic boolean")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                severity = shipped.value.severity(shipped.value.score(batch.column("text")))
                yield batch.filter(pa.array(severity < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
