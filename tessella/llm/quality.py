"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of the whole text (sizes, shares of character classes, repetition of words and lines) are transformed to be roughly
normal. Each class has a mean and a covariance, shrunk towards its own diagonal and a small multiple of the identity. A
score is the logistic of the difference of the classes' log-densities, each a Mahalanobis distance through a cached Cholesky
factor, plus the log prior. Fitting needs sums of products only, which Spark adds up over all labelled rows.

Null and empty texts have the statistics of an empty text and a score like any other. Rows that repeat count each when fitted and have one score;
other columns, whatever their names, aren't looked at. With fewer than two labelled rows in a
class every score is the share of class 1 (0.5 if there are no labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of each off-diagonal covariance that is given up, and what is added to variances, as a share of the pooled ones.
SHRINK = 0.5
RIDGE = 0.3
#: Log-odds are divided by this before the logistic: class densities of correlated statistics are overconfident.
TEMPERATURE = 4.0
THRESHOLD = 0.7

NAMES = (
    "mean_word", "long_words", "upper", "digits", "marks", "rare_marks", "stops", "pipes", "vocabulary",
    "top_word", "twice", "repeated_lines", "shouted_words", "marked_words", "burst", "worst_marks", "worst_upper", "worst_repeat",
)
#: Bytes, words and lines of ordinary prose that every share is diluted with, so that short texts are not extreme by chance.
BYTES, WORDS, LINES = 150, 20, 20
#: Width of the windows, in bytes, in which the worst share is sought: texts may be bad in part only.
WIDTH = 400
#: Shares in ordinary prose: capitals of letters, marks of bytes, sentence ends of words.
USUAL_UPPER, USUAL_MARKS, USUAL_STOPS = 0.03, 0.015, 0.1
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_LETTER = (_BYTE >= 97) & (_BYTE <= 122) | _UPPER | (_BYTE >= 128)
_COMMON = np.isin(_BYTE, [ord(c) for c in ".,;:'\"()-?"])
_MARK = ~(_LETTER | _DIGIT | _SPACE)
_ENDS = re.compile(rb"[^\w\s\x80-\xff.,;:'\")?-]")


def _worst(raw: np.ndarray, flags: np.ndarray, usual: float) -> float:
    """Greatest share of flagged bytes in a window; a shorter text is filled up with ordinary prose."""
    hits = flags[raw]
    if len(raw) <= WIDTH:
        return float(hits.sum() + usual * (WIDTH - len(raw))) / WIDTH
    total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
    return float((total[WIDTH:] - total[:-WIDTH]).max() / WIDTH)


def statistics(text: bytes) -> list[float]:
    raw = np.frombuffer(text, np.uint8)
    bytes_of = np.bincount(raw, minlength=256)
    n = len(raw) + BYTES
    words = text.split()
    m = len(words) + WORDS
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words, words[1:]))
    spans = [(len(set(part)) + WORDS) / (len(part) + WORDS) for k in range(0, len(words), 50) if (part := words[k : k + 50])]
    marked = sum(map(bool, map(_ENDS.search, words)))
    root, log = np.sqrt, np.log
    return [
        log((len(raw) + BYTES) / m),
        sum(map((20).__lt__, map(len, words))) / m,
        root((bytes_of[_UPPER].sum() + USUAL_UPPER * BYTES) / (bytes_of[_LETTER].sum() + BYTES)),
        root(bytes_of[_DIGIT].sum() / n),
        root((bytes_of[_MARK].sum() + USUAL_MARKS * BYTES) / n),
        root(bytes_of[_MARK & ~_COMMON].sum() / n),
        root((bytes_of[46] + bytes_of[33] + bytes_of[63] + USUAL_STOPS * WORDS) / m),
        root(bytes_of[124] / m),
        (len(counts) + WORDS) / m,
        root((max(counts.values(), default=0) + 1) / m),
        root(again / m),
        root((len(lines) - len(set(lines))) / (len(lines) + LINES)),
        root(sum(map(bytes.isupper, words)) / m),
        root(marked / m),
        1 - min(spans, default=1.0),
        root(_worst(raw, _MARK & ~_COMMON, 0)),
        root(_worst(raw, _UPPER, USUAL_UPPER)),
        1 - float(np.mean(spans or [1.0])),
    ]


def _stated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([np.array(statistics(x)) for x in batch], dtype=object)


def stated(text: Column) -> Column:
    """Statistics of a column of bytes, as array<double>."""
    return F.pandas_udf(_stated, "array<double>")(text)


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None  # class, statistic
    factors: np.ndarray | None = None  # Cholesky factors, lower
    logdets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * ((z * z).sum(axis=0) + logdet))
        odds = (density[1] - density[0] + np.log(self.prior / (1 - self.prior))) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, list] = {}
    for batch in batches:
        x, y = np.array(batch["x"].tolist(), float).reshape(len(batch), -1), batch["y"].to_numpy()
        for label in (0, 1):
            own = x[y == label]
            if len(own):
                s = sums.setdefault(label, [0, 0.0, 0.0])
                s[0] += len(own)
                s[1] = s[1] + own.sum(axis=0)
                s[2] = s[2] + own.T @ own
    yield pd.DataFrame([(k, n, s, p.ravel()) for k, (n, s, p) in sums.items()], columns=["label", "n", "s", "p"])


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """rows: x array<double>, y 0 or 1. Each task returns at most one row of sums for each class, and sums are added by position."""
    parts = rows.select("x", "y").mapInPandas(_summed, "label int, n long, s array<double>, p array<double>")
    cells = parts.select("label", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "p")).alias("k", "v"))
    size = len(NAMES)
    flat = np.zeros((2, 1 + size + size * size))
    for r in cells.groupBy("label", "k").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + size + size^2) rows
        flat[r["label"], r["k"]] = r["v"]
    (n0, n1), flat = map(int, flat[:, 0]), flat[:, 1:]
    if n0 < 2 or n1 < 2:
        return Model(n1 / (n0 + n1) if n0 + n1 else 0.5)
    means, covariances = [], []
    for k, n in enumerate((n0, n1)):
        mean = flat[k, :size] / n
        means.append(mean)
        covariances.append(flat[k, size:].reshape(size, size) / n - np.outer(mean, mean))
    pooled = np.maximum(np.diag((n0 * covariances[0] + n1 * covariances[1]) / (n0 + n1)), 1e-6)
    factors, logdets = [], []
    for cov in covariances:
        shrunk = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.diag(pooled)
        factor = np.linalg.cholesky(shrunk)
        factors.append(factor)
        logdets.append(2 * np.log(np.diag(factor)).sum())
    return Model(n1 / (n0 + n1), np.array(means), np.array(factors), np.array(logdets))


def scored(model: Model, x: Column) -> Column:
    """Scores from statistics; the model is some kilobytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(np.array(batch.tolist(), float).reshape(len(batch), -1)) if len(batch) else [], dtype=float)

    return F.pandas_udf(run, "double")(x)


def one_label(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """key, y: rows without a 0 or 1 are left out, and so are keys with both."""
    valid = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    return valid.groupBy(F.col(key).alias("key")).agg(F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most").select("key", "y")
