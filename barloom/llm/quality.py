"""Document quality by regularised quadratic discriminants.

Every whole text becomes a vector of transformed statistics. Each class has a
mean and a covariance that is shrunk towards the pooled covariance and its
diagonal; the Cholesky factors are kept, and a score is the logistic of the
difference of the two log densities, whose Mahalanobis terms are lengths of
products with the inverses of the factors, which are cached with the model.

Counts, means and covariances are sums over all labelled rows outside the
held-out fold, formed where the rows are; only the sums reach the driver.

Defined cases: null and empty texts have the statistics of an empty text and are
scored; without two labelled classes every score is the share of label 1, or 0.5;
labels that are null or neither 0 nor 1 teach nothing; repeated rows count as
often as they occur.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_arrow, is_held_out, materialize

NAMES = (
    "chars", "words", "word_length", "upper", "digits", "stops", "symbols", "spaces", "distinct_words", "top_word", "repeats",
    "lines", "line_length", "distinct_lines", "wordless", "short_words", "wide", "entropy",
)
K = len(NAMES)
_CLASS = np.zeros((7, 256))
for _row, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\x0b\x0c", bytes(range(128, 256)))):
    _CLASS[_row, list(_set)] = 1


def _share(part: float, whole: float) -> float:
    """A smoothed log odds of a share; its spread shrinks on short texts."""
    return float(np.log((part + 0.5) / (max(0.0, whole - part) + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics, in the order of ``NAMES``."""
    raw = text.encode("utf-8", "replace")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, stops, symbols, spaces, wide = (_CLASS @ histogram).tolist()
    n, words, lines = len(raw), text.split(), text.split("\n")
    letters = upper + lower + wide
    counts = Counter(words)
    top = max(counts.values(), default=0)
    repeats = sum(map(operator.eq, words, words[1:]))
    lengths = list(map(len, words))
    short = sum(x <= 3 for x in lengths)
    bare = sum(not w.isalpha() and not w[:-1].isalpha() for w in counts)
    p = histogram[histogram > 0] / max(1, n)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(sum(lengths) / max(1, len(words))), _share(upper, letters), _share(digits, n), _share(stops, n),
        _share(symbols, n), _share(spaces, n), _share(len(counts), len(words)), _share(top, len(words)), _share(repeats, len(words)), np.log1p(len(lines)),
        np.log1p(n / len(lines)), _share(len(set(lines)), len(lines)), _share(bare, len(counts)), _share(short, len(words)), _share(wide, n), float(-(p * np.log(p)).sum()),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [np.array(statistics(t.as_py() or ""), "<f4").tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and packed statistics of every whole text."""
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _statistics, "doc_id long, stats binary")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 + K + K * K))
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, K).astype(np.float64)
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[label == c]
            sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    c, at = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(at.ravel(), pa.int32()), pa.array(sums.ravel())], ["label", "at", "value"])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes."""

    prior: float
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        if not len(self.means):
            return np.full(len(x), self.prior)
        log_p = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        z = log_p[1] - log_p[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(moments: np.ndarray, shrink: float = 0.4, ridge: float = 0.1) -> Discriminant:
    """From (class, 1 + K + K * K) sums; ``shrink`` mixes in the pooled covariance, ``ridge`` its diagonal."""
    n = moments[:, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5, np.zeros((0, K)), np.zeros((0, K, K)), np.zeros(0))
    means = moments[:, 1 : 1 + K] / n[:, None]
    own = np.stack([m[1 + K :].reshape(K, K) / k - np.outer(u, u) for m, k, u in zip(moments, n, means)])
    pooled = (own * (n / n.sum())[:, None, None]).sum(axis=0)
    goal = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled))
    floor = np.diag(1e-3 + 1e-3 * np.diag(pooled))
    chol = [np.linalg.cholesky((1 - shrink) * c + shrink * goal + floor) for c in own]
    factors = np.stack([np.linalg.inv(c) for c in chol])
    return Discriminant(float(n[1] / n.sum()), means, factors, np.array([2 * np.log(np.diag(c)).sum() for c in chol]))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learn from the labelled rows of ``stats`` outside the held-out fold."""
    value = F.col(label).cast("int")
    known = labels.filter(value.isin(0, 1) & ~is_held_out("doc_id", 3, 1)).select(F.col("doc_id").cast("long").alias("_id"), value.alias("_label"))
    rows = stats.join(known, stats["doc_id"] == known["_id"]).select("_label", "stats")
    sums = in_arrow(rows, _moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    moments = np.zeros((2, 1 + K + K * K))
    for r in sums:
        moments[r["label"], r["at"]] = r["value"]
    return fit(moments)


def _score(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, K).astype(np.float64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    stats = materialize(document_statistics(docs), "stats")
    model = train(stats, labels)

    def run(batches):
        return _score(batches, model)

    scored = in_arrow(stats, run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
