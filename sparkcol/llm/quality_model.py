"""Quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics, taken over all of its words and lines. For each class the mean and covariance
come from sums of doubles over all labelled rows; covariances are shrunk towards the pooled one and then towards a sphere. A score
is the logistic function of ``temper`` times the log odds: the difference of the two Mahalanobis log densities, from Cholesky
factors that are computed once, plus that of the log shares of the classes. ``temper`` = 0.5 halves the log odds, for the statistics
aren't independent enough for their full weight; it moves scores towards 0.5 and leaves their order as it is.

Null texts count as empty; the empty text has the statistics of no words and gets a score like any other. Labels of ids that
no document has teach nothing; repeated rows teach as often as they occur. Without labels of both classes every score is
the share of class 1 (0.5 without any). An empty table gives an empty result. One text is held in memory with its words, whatever its length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_as_text_crc

SYMBOLS = "#*$%&|<>"
STATISTICS = ("words", "word_length", "distinct", "echo", "most_common", "upper", "symbols", "marks", "bare_bars", "line_ends", "line_words", "equal_lines", "digits", "pair_echo")


def _odds(part: float, of: float) -> float:
    """Log odds of a share, with half an event of either kind added."""
    return math.log((part + 0.5) / (max(of - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text: logarithms of sizes, log odds of shares."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    distinct = set(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = text.count
    symbols = sum(map(count, SYMBOLS))
    upper = sum(map(len, filter(str.isupper, words)))
    echo = sum(map(str.__eq__, words, words[1:]))
    most = max(Counter(words).values(), default=0)
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(x.rstrip()[-1] in ".!?:;\"'”’»)" for x in lines)
    letters = sum(map(len, words))
    return [
        math.log1p(n),
        math.log1p(letters / n if n else 0),
        _odds(len(distinct), n),
        _odds(echo, max(n - 1, 0)),
        _odds(most, n),
        _odds(upper, letters),
        _odds(symbols, chars),
        _odds(sum(map(count, "!?=~^_")), chars),
        _odds(count(" | "), n),
        _odds(ends, len(lines)),
        math.log1p(n / len(lines) if lines else 0),
        _odds(len(lines) - len(set(lines)), len(lines)),
        _odds(sum(map(count, "0123456789")), chars),
        _odds(max(n - 1 - pairs, 0), max(n - 1, 0)),
    ]


def with_statistics(docs: DataFrame, text: str = "text", out: str = "x") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([np.array(statistics(t)) for t in series], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


@dataclass
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, and the constant of the log density, log share included."""

    means: np.ndarray
    whiteners: np.ndarray
    constants: np.ndarray
    share: float
    temper: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        logs = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiteners, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) * self.temper, -700, 700)))


def fit(labelled: DataFrame, x: str = "x", label: str = "quality", pooling: float = 0.1, sphere: float = 0.02, temper: float = 0.5) -> Discriminant:
    """From sums over all of ``labelled``; ``pooling`` and ``sphere`` are the shares of the pooled covariance and of a sphere."""
    d = len(STATISTICS)
    at = [F.get(F.col(x), F.lit(i)) for i in range(d)]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("k")).agg(
        F.count("*"), *[F.sum(a) for a in at], *[F.sum(at[i] * at[j]) for i, j in upper]
    )
    found = {int(r[0]): r for r in sums.collect()}
    total = sum(r[1] for r in found.values())
    share = found[1][1] / total if 1 in found else (0.0 if total else 0.5)
    if len(found) < 2:
        return Discriminant(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), share, temper)
    means, covariances = [], []
    for k in (0, 1):
        n = found[k][1]
        mean = np.array(found[k][2 : 2 + d], float) / n
        second = np.zeros((d, d))
        for (i, j), v in zip(upper, found[k][2 + d :], strict=True):
            second[i, j] = second[j, i] = v / n
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    pooled = sum(found[k][1] * covariances[k] for k in (0, 1)) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    whiteners, constants = [], []
    for k in (0, 1):
        c = ((1 - pooling) * covariances[k] + pooling * pooled) / np.outer(scale, scale)
        c = (1 - sphere) * c + sphere * max(np.trace(c) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(c)
        whiteners.append(np.linalg.inv(factor) / scale)
        constants.append(math.log(found[k][1] / total) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiteners), np.array(constants), share, temper)


def score(rows: DataFrame, model: Discriminant, x: str = "x", out: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(vectors.to_numpy()))) if len(vectors) else pd.Series([], dtype=float)

    return rows.withColumn(out, run(F.col(x)))


def report(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on); labels of held-out documents are not learned from."""
    held = F.coalesce(id_as_text_crc(F.col("doc_id")) % folds == held_out, F.lit(False))
    rows = cut(with_statistics(docs.select("doc_id", "text")).select("doc_id", held.alias("held_out"), "x"))
    known = labels.select(F.col("doc_id").alias("_id"), "quality").where("quality IS NOT NULL")
    model = fit(rows.where("NOT held_out").join(known, F.col("doc_id") == F.col("_id")))
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
