"""Small networks over vectors, trained here on bounded samples: codes that a network learns, and similarity that it learns.

Training is full-batch gradient descent in numpy on the driver, over at most ``sample`` rows; applying is one matrix product per Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import kmeans, sampled


class _Adam:
    """Steps of gradient descent with running moments, for a list of arrays that are changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.first, self.second = ([np.zeros_like(a) for a in arrays] for _ in range(2))

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Autoencoder:
    """Codes of ``size`` numbers: tanh(W v + a), decoded by U c + b. Starts from the principal axes of the sample."""

    def __init__(self, size: int = 16, sample: int = 20_000, rounds: int = 200, rate: float = 0.003, seed: int = 42):
        self.size, self.sample, self.rounds, self.rate, self.seed = size, sample, rounds, rate, seed

    def fit(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> Autoencoder:
        x = sampled(vectors, self.sample, vec_id, embedding)
        centre = x.mean(axis=0)
        axes = np.linalg.svd(x - centre, full_matrices=False)[2][: self.size]
        spread = 3 * np.maximum(((x - centre) @ axes.T).std(axis=0), 1e-9)
        self.w, self.a = axes / spread[:, None], -(axes / spread[:, None]) @ centre
        self.u, self.b = axes.T * spread, centre.copy()
        adam = _Adam([self.w, self.a, self.u, self.b], self.rate)
        for _ in range(self.rounds):
            code = np.tanh(x @ self.w.T + self.a)
            used = self._used(code)
            off = (used @ self.u.T + self.b - x) / len(x)
            back = (off @ self.u + self._pull(code, used)) * (1 - code * code)
            adam.step([back.T @ x, back.sum(axis=0), off.T @ used, off.sum(axis=0)])
        return self

    def _used(self, code: np.ndarray) -> np.ndarray:
        """What the decoder is given of a code."""
        return code

    def _pull(self, code: np.ndarray, used: np.ndarray) -> np.ndarray | float:
        """What draws codes to what is used of them, as a gradient."""
        return 0.0

    def encode(self, v: Column) -> Column:
        w, a = self.w, self.a

        @F.pandas_udf("array<double>")
        def run(series: pd.Series) -> pd.Series:
            return pd.Series(list(np.tanh(np.stack(series.to_numpy()).astype(float) @ w.T + a)) if len(series) else [], dtype=object)

        return run(v)

    def decode(self, code: Column) -> Column:
        u, b = self.u, self.b

        @F.pandas_udf("array<double>")
        def run(series: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(series.to_numpy()).astype(float) @ u.T + b) if len(series) else [], dtype=object)

        return run(code)


class NeuralQuantizer(Autoencoder):
    """An autoencoder whose codes are drawn to codebooks while it learns: with one part a vector-quantised autoencoder, with more a
    neural product quantizer. A code is the number of the nearest entry in each part's book; gradients pass the choice unchanged."""

    def __init__(self, parts: int = 4, centroids: int = 64, commitment: float = 0.25, **options):
        super().__init__(**options)
        self.parts, self.centroids, self.commitment, self.books = parts, centroids, commitment, None

    def _used(self, code: np.ndarray) -> np.ndarray:
        subs = np.split(code, self.parts, axis=1)
        if self.books is None:
            rng = np.random.default_rng(self.seed)
            self.books = [kmeans(s, self.centroids, rng) for s in subs]
        out = []
        for p, s in enumerate(subs):
            near = _near(s, self.books[p])
            sums = np.zeros_like(self.books[p])
            np.add.at(sums, near, s)
            n = np.bincount(near, minlength=len(sums))[:, None]
            self.books[p] = np.where(n > 0, 0.9 * self.books[p] + 0.1 * sums / np.maximum(n, 1), self.books[p])
            out.append(self.books[p][near])
        return np.concatenate(out, axis=1)

    def _pull(self, code: np.ndarray, used: np.ndarray) -> np.ndarray:
        return self.commitment * (code - used) / len(code)

    def encode(self, v: Column) -> Column:
        books = self.books

        @F.pandas_udf("array<int>")
        def run(series: pd.Series) -> pd.Series:
            if not len(series):
                return pd.Series([], dtype=object)
            subs = np.split(np.stack(series.to_numpy()).astype(float), len(books), axis=1)
            return pd.Series(list(np.stack([_near(s, b) for s, b in zip(subs, books, strict=True)], axis=1).astype(np.int32)), dtype=object)

        return run(super().encode(v))

    def decode(self, code: Column) -> Column:
        books = self.books

        @F.pandas_udf("array<double>")
        def run(series: pd.Series) -> pd.Series:
            return pd.Series([np.concatenate([b[i] for b, i in zip(books, one, strict=True)]) for one in series], dtype=object)

        return super().decode(run(code))


def _near(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1)[None] - 2 * x @ book.T).argmin(axis=1)


class PairModel:
    """Similarity of two vectors, between 0 and 1, learned from labelled pairs by a network with one hidden layer.

    ``kind``: "mlp" sees how the two differ and agree (|a - b|, a * b) and is symmetric; "cross" sees both and their product, as a
    cross-encoder does.
    """

    def __init__(self, kind: str = "mlp", hidden: int = 32, sample: int = 20_000, rounds: int = 300, rate: float = 0.01, seed: int = 42):
        if kind not in ("mlp", "cross"):
            raise ValueError(f"unknown kind {kind!r}")
        self.kind, self.hidden, self.sample, self.rounds, self.rate, self.seed = kind, hidden, sample, rounds, rate, seed

    def _features(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.abs(a - b), a * b] if self.kind == "mlp" else [a, b, a * b], axis=1)

    def fit(self, pairs: DataFrame, a: str = "a", b: str = "b", label: str = "label") -> PairModel:
        rows = pairs.select(a, b, label).orderBy(F.xxhash64(a, b)).limit(self.sample).collect()
        x = self._features(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))
        y = np.array([r[2] for r in rows], float)
        rng = np.random.default_rng(self.seed)
        self.w, self.c = rng.normal(0, x.shape[1] ** -0.5, (self.hidden, x.shape[1])), np.zeros(self.hidden)
        self.v, self.d = rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)
        adam = _Adam([self.w, self.c, self.v, self.d], self.rate)
        for _ in range(self.rounds):
            h = np.tanh(x @ self.w.T + self.c)
            off = (1 / (1 + np.exp(-(h @ self.v + self.d))) - y) / len(y)
            back = np.outer(off, self.v) * (1 - h * h)
            adam.step([back.T @ x, back.sum(axis=0), h.T @ off, np.array([off.sum()])])
        return self

    def score(self, a: Column, b: Column) -> Column:
        w, c, v, d, features = self.w, self.c, self.v, self.d, self._features

        @F.pandas_udf("double")
        def run(left: pd.Series, right: pd.Series) -> pd.Series:
            if not len(left):
                return pd.Series([], dtype=float)
            x = features(np.stack(left.to_numpy()).astype(float), np.stack(right.to_numpy()).astype(float))
            return pd.Series(1 / (1 + np.exp(-(np.tanh(x @ w.T + c) @ v + d))))

        return run(a, b)
