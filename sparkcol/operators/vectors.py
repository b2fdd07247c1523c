"""Vector distances, search, quantisation and small neural layers over array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Below this product of squared norms, cosine distance is 1.
TINY = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    norms = squared_norm(a) * squared_norm(b)
    return F.when(norms < TINY, 1.0).otherwise(1 - dot(a, b) / F.sqrt(norms))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {"l2": l2_squared, "cosine": cosine_distance, "ip": negative_inner_product, "l1": manhattan}


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda it would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return _given(F.sqrt(squared_norm(v)), lambda n: F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x)))


def combine(a: Column, b: Column, op: str) -> Column:
    """Element-wise add, sub or mul."""
    return F.zip_with(doubles(a), doubles(b), {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}[op])


def scale(v: Column, factor: float) -> Column:
    return F.transform(doubles(v), lambda x: x * factor)


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": lambda x: F.tanh(x),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x))),
}


def activate(v: Column, kind: str) -> Column:
    if kind == "softmax":
        weights = _given(F.array_max(doubles(v)), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
        return _given(weights, lambda w: _given(total(w), lambda t: F.transform(w, lambda x: x / t)))
    return F.transform(doubles(v), ACTIVATIONS[kind])


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    centred = _given(mean(v), lambda m: F.transform(doubles(v), lambda x: x - m))
    return _given(centred, lambda c: _given(F.sqrt(squared_norm(c) / F.size(c) + epsilon), lambda r: F.transform(c, lambda x: x / r)))


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "l2", vec_id: str = "vec_id", embedding: str = "embedding", digits: int | None = None) -> DataFrame:
    """The min(k, n) rows nearest to one query, ties by id, null vectors last: each task keeps k. With ``digits`` distances are rounded
    before they are compared, so what rounds to one distance is a tie."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = METRICS[metric](F.col(embedding), q)
    ranked = vectors.withColumn("distance", distance if digits is None else F.round(distance, digits))
    return ranked.orderBy(F.col("distance").asc_nulls_last(), vec_id).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", vec_id: str = "vec_id", embedding: str = "embedding", block: int = 256, most_queries: int = 1 << 16, probes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank) for a stated set of queries (vec_id, embedding) against all vectors.

    The vectors are read once: a task holds the queries, and the k nearest of each that it has met; a batch of vectors is set against
    ``block`` queries at a time, by one matrix product or as few operations, so no pairs are made. The driver reads the queries partition
    by partition and broadcasts ``most_queries`` of them; while there are more, what is found for these is written before the next are taken.
    ``probes``: the lists that each query of a block looks into, of those in the column ``lists``.
    """
    left = iter(queries.select(vec_id, embedding).toLocalIterator())
    rows, out = list(islice(left, most_queries)), None
    while True:
        found = _nearest(vectors, rows, k, metric, vec_id, embedding, block, probes)
        rows = list(islice(left, most_queries))
        if not rows and out is None:
            return _ranked(found, k)
        found = written(_ranked(found, k))
        out = found if out is None else out.union(found)
        if not rows:
            return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        return np.stack([np.abs(x - one).sum(axis=1) for one in q])
    if metric == "l2":
        return np.stack([((x - one) ** 2).sum(axis=1) for one in q])
    if metric == "ip":
        return -(q @ x.T)
    norms = (q * q).sum(axis=1)[:, None] * (x * x).sum(axis=1)[None, :]
    return np.where(norms < TINY, 1.0, 1 - (q @ x.T) / np.sqrt(np.maximum(norms, TINY)))


def _nearest(vectors: DataFrame, rows: list, k: int, metric: str, vec_id: str, embedding: str, block: int, probes: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """(query_id, vec_id, distance): for each task, the k nearest that it has of each query."""
    asked = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    looked = probes(asked) if probes and len(rows) else None
    shipped = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), asked, looked))

    def nearest(frames):
        ids, q, looked = shipped.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for frame in frames:
            if not len(frame) or not len(ids):
                continue
            x, own = np.stack(frame[embedding].to_numpy()).astype(float), frame[vec_id].to_numpy()
            lists = np.stack(frame["lists"].to_numpy()) if looked is not None else None
            for i in range(0, len(ids), block):
                for j, row in enumerate(_distances(q[i : i + block], x, metric), i):
                    at = np.arange(len(own)) if lists is None else np.flatnonzero(np.isin(lists, looked[j]).any(axis=1))
                    if len(best[j][0]) == k:
                        at = at[row[at] <= best[j][0][-1]]
                    if len(at) > k:  # no more than those up to the k-th distance, ties included
                        at = at[row[at] <= np.partition(row[at], k - 1)[k - 1]]
                    if len(at):
                        d, who = np.concatenate([best[j][0], row[at]]), np.concatenate([best[j][1], own[at]])
                        order = np.lexsort((who, d))[:k]
                        best[j] = d[order], who[order]
        for i in range(0, len(ids), 4096):
            part = best[i : i + 4096]
            sizes = [len(d) for d, _ in part]
            if sum(sizes):
                yield pd.DataFrame({"query_id": np.repeat(ids[i : i + 4096], sizes), "vec_id": np.concatenate([w for _, w in part]), "distance": np.concatenate([d for d, _ in part])})

    return vectors.select(vec_id, embedding, *(["lists"] if probes else [])).mapInPandas(nearest, "query_id long, vec_id long, distance double")


def to_half(v: Column) -> Column:
    """The vector with elements rounded to half precision."""

    @F.pandas_udf("array<float>")
    def rounded(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, np.float16).astype(np.float32) for x in vectors], dtype=object)

    return rounded(v)


def sq8_bounds(vectors: DataFrame, embedding: str = "embedding") -> tuple[float, float]:
    low, high = vectors.agg(F.min(F.array_min(embedding).cast("double")), F.max(F.array_max(embedding).cast("double"))).first()
    return low or 0.0, high or 0.0


def sq8_encode(v: Column, low: float, high: float) -> Column:
    """Elements as integers 0..255 between the bounds."""
    step = (high - low) / 255 or 1.0
    return F.transform(doubles(v), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x - low) / step + 0.5))).cast("int"))


def sq8_decode(codes: Column, low: float, high: float) -> Column:
    step = (high - low) / 255 or 1.0
    return F.transform(codes, lambda c: c * F.lit(step) + low)


def sampled(vectors: DataFrame, most: int, vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """Up to ``most`` vectors, those whose ids have the least hashes: what models are fitted on."""
    rows = vectors.select(vec_id, embedding).where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(F.col(vec_id)), vec_id).limit(most).collect()
    return np.array([r[1] for r in rows], float)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of up to ``k`` groups; a group that runs empty keeps its centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


class ProductQuantizer:
    """Sub-vectors replaced by the number of their nearest centroid; centroids from a bounded sample by k-means."""

    def __init__(self, parts: int = 8, centroids: int = 16, sample: int = 20_000, seed: int = 42):
        self.parts, self.centroids, self.sample, self.seed = parts, centroids, sample, seed
        self.books: np.ndarray | None = None

    def fit(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> ProductQuantizer:
        self._learn(sampled(vectors, self.sample, vec_id, embedding))
        return self

    def _learn(self, x: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        self.books = np.stack([kmeans(sub, self.centroids, rng) for sub in np.split(x, self.parts, axis=1)])

    def encode(self, v: Column) -> Column:
        books = self.books

        @F.pandas_udf("array<int>")
        def codes(vectors: pd.Series) -> pd.Series:
            out = []
            for x in vectors:
                subs = np.split(np.asarray(x, float), len(books))
                out.append(np.array([((b - s) ** 2).sum(axis=1).argmin() for b, s in zip(books, subs, strict=True)], np.int32))
            return pd.Series(out, dtype=object)

        return codes(v)

    def decode(self, codes: Column) -> Column:
        books = self.books

        @F.pandas_udf("array<double>")
        def vectors(series: pd.Series) -> pd.Series:
            return pd.Series([np.concatenate([b[c] for b, c in zip(books, x, strict=True)]) for x in series], dtype=object)

        return vectors(codes)

    def asymmetric_distance(self, codes: Column, query: Sequence[float]) -> Column:
        """Squared distance of the query to what the codes stand for, from a table of distances to the centroids."""
        subs = np.split(np.asarray(query, float), self.parts)
        table = [[float(((c - s) ** 2).sum()) for c in b] for b, s in zip(self.books, subs, strict=True)]
        looked = [F.get(F.array(*[F.lit(x) for x in row]), F.get(codes, F.lit(i))) for i, row in enumerate(table)]
        return sum(looked[1:], looked[0])


class RotatedProductQuantizer(ProductQuantizer):
    """A product quantizer behind a rotation that is learned with it: codes and rotation in turn, the latter by an orthogonal fit."""

    rounds = 8

    def _learn(self, x: np.ndarray) -> None:
        self.rotation = np.eye(x.shape[1])
        for _ in range(self.rounds):
            turned = x @ self.rotation
            super()._learn(turned)
            subs = np.split(turned, self.parts, axis=1)
            back = np.concatenate([b[((s[:, None, :] - b[None]) ** 2).sum(axis=2).argmin(axis=1)] for b, s in zip(self.books, subs, strict=True)], axis=1)
            u, _, v = np.linalg.svd(x.T @ back)
            self.rotation = u @ v

    def encode(self, v: Column) -> Column:
        return super().encode(matvec(v, self.rotation.T))

    def decode(self, codes: Column) -> Column:
        return matvec(super().decode(codes), self.rotation)

    def asymmetric_distance(self, codes: Column, query: Sequence[float]) -> Column:
        return super().asymmetric_distance(codes, np.asarray(query, float) @ self.rotation)


def reconstruction_error(vectors: DataFrame, quantizer, embedding: str = "embedding") -> float:
    """The mean squared distance of vectors to what their codes decode to."""
    back = vectors.select(embedding, quantizer.decode(quantizer.encode(F.col(embedding))).alias("_back"))
    return back.agg(F.avg(l2_squared(F.col(embedding), F.col("_back")))).first()[0]


class QuantizedIndex:
    """Search by codes alone for the first ``first_k``, which are then measured by their vectors.

    The quantizer's codes leave a share of each distance open, and the more vectors there are, the more come so near that ``first_k`` of them
    crowd out the nearest. So what a vector's codes leave of it is kept too, at half a byte an element between three standard deviations.
    """

    def __init__(self, quantizer: ProductQuantizer, first_k: int = 300):
        self.quantizer, self.first_k, self.rows = quantizer, first_k, None

    def build(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", measured: int = 2000) -> QuantizedIndex:
        """``measured``: vectors from which the deviation of what is left is taken, those whose ids have the least hashes."""
        known = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
        self.quantizer.fit(known)
        left = combine(F.col("embedding"), self.quantizer.decode(self.quantizer.encode(F.col("embedding"))), "sub")
        some = known.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(measured).select(left.alias("left"))
        deviation = some.agg(F.sqrt(F.sum(squared_norm(F.col("left"))) / F.sum(F.size("left")))).first()[0] or 0.0
        self.bounds = -3 * deviation, 3 * deviation
        coded = known.withColumn("codes", self.quantizer.encode(F.col("embedding")))
        rest = combine(F.col("embedding"), self.quantizer.decode(F.col("codes")), "sub")
        self.rows = coded.withColumn("rest", sq4_encode(rest, *self.bounds).cast("array<tinyint>"))
        return self

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, vec_id, distance, rank) for each row of ``queries`` (vec_id, embedding)."""
        decoded = self.rows.select("vec_id", combine(self.quantizer.decode(F.col("codes")), sq4_decode(F.col("rest"), *self.bounds), "add").alias("embedding"))
        coarse = knn_batch(decoded, queries, max(k, self.first_k)).select("query_id", F.col("vec_id").alias("_id"))
        asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
        known = self.rows.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_e"))
        found = coarse.join(known, "_id").join(asked, "query_id").select("query_id", F.col("_id").alias("vec_id"), l2_squared(F.col("_e"), F.col("_q")).alias("distance"))
        return _ranked(found, k)


class InvertedIndex:
    """Approximate search: vectors are listed under their ``shared`` nearest centres, and a query looks into ``n_probe`` lists.

    Centres come from a bounded sample; every vector is listed. Near the border of two lists a neighbour is found from either
    side. It takes the place of a graph index, which is one mutable structure in memory and doesn't distribute. ``metric``: l2, l1, cosine
    (lists of unit vectors) or ip (lists of vectors with one element more, which makes all as long as the longest).
    """

    def __init__(self, lists: int = 16, sample: int = 20_000, seed: int = 42, shared: int = 3, metric: str = "l2"):
        self.lists, self.sample, self.seed, self.shared, self.metric = lists, sample, seed, shared, metric
        self.centres: np.ndarray | None = None
        self.rows: DataFrame | None = None

    def build(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> InvertedIndex:
        longest = (vectors.agg(F.max(squared_norm(F.col(embedding)))).first()[0] or 0.0) if self.metric == "ip" else 0.0
        metric, shared = self.metric, self.shared
        x = _listable(sampled(vectors, self.sample, vec_id, embedding), metric, longest)
        self.centres = centres = kmeans(x, self.lists, np.random.default_rng(self.seed))

        @F.pandas_udf("array<int>")
        def listed(series: pd.Series) -> pd.Series:
            if not len(series):
                return pd.Series([], dtype=object)
            x = _listable(np.stack(series.to_numpy()).astype(float), metric, longest)
            return pd.Series([((centres - one) ** 2).sum(axis=1).argsort(kind="stable")[:shared].astype(np.int32) for one in x], dtype=object)

        self.rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), listed(F.col(embedding)).alias("lists"))
        return self

    def _probes(self, q: np.ndarray, n_probe: int) -> np.ndarray:
        asked = _listable(q, self.metric, None)
        return ((self.centres[None] - asked[:, None]) ** 2).sum(axis=2).argsort(axis=1)[:, :n_probe]

    def search(self, query: Sequence[float], k: int = 10, n_probe: int = 6, where: Column | None = None) -> DataFrame:
        """The nearest k; ``where``: a condition on vec_id or embedding that they must meet."""
        near = self._probes(np.asarray(query, float)[None], n_probe)[0]
        looked = F.arrays_overlap("lists", F.array(*[F.lit(int(x)) for x in near]))
        return knn(self.rows.where(looked if where is None else looked & where), query, k, self.metric).select("vec_id", "distance")

    def search_batch(self, queries: DataFrame, k: int = 10, n_probe: int = 6) -> DataFrame:
        """(query_id, vec_id, distance, rank) as ``search`` finds them for each row of ``queries`` (vec_id, embedding)."""
        return knn_batch(self.rows, queries, k, self.metric, probes=lambda q: self._probes(q, n_probe))


def _listable(x: np.ndarray, metric: str, longest: float | None) -> np.ndarray:
    """Vectors so changed that the nearest by ``metric`` are near by squared distance; ``longest``: the greatest squared norm, None for queries."""
    if metric == "cosine":
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), TINY)
    if metric == "ip":
        rest = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)
    return x


def dense(v: Column, weights: np.ndarray, bias: np.ndarray, activation: str | None = None) -> Column:
    """activation(W v + b) in one matrix product per batch."""
    w, b = np.asarray(weights, float), np.asarray(bias, float)

    @F.pandas_udf("array<double>")
    def layer(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        out = np.stack(vectors.to_numpy()).astype(float) @ w.T + b
        return pd.Series(list(np.maximum(out, 0) if activation == "relu" else np.tanh(out) if activation == "tanh" else out), dtype=object)

    return layer(v)


def two_stage(vectors: DataFrame, query: Sequence[float], first_k: int = 100, final_k: int = 10, metric: str = "l2", rerank: str = "cosine", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A coarse top ``first_k``, scored anew by another metric; scores are brought to 0..1, the nearest having 1."""
    coarse = knn(vectors, query, first_k, metric, vec_id, embedding)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = coarse.select(vec_id, METRICS[rerank](F.col(embedding), q).alias("d"))
    everything = Window.partitionBy()
    low, high = F.min("d").over(everything), F.max("d").over(everything)
    return scored.withColumn("score", F.coalesce(F.try_divide(high - F.col("d"), high - low), F.lit(1.0))).orderBy("d", vec_id).limit(final_k)


def two_stage_batch(vectors: DataFrame, queries: DataFrame, first_k: int = 100, final_k: int = 10, metric: str = "l2", rerank: str = "cosine", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, d, score, rank) as ``two_stage`` finds them for each row of ``queries``."""
    coarse = knn_batch(vectors, queries, first_k, metric, vec_id, embedding).select("query_id", F.col("vec_id").alias("_id"))
    asked = queries.select(F.col(vec_id).alias("query_id"), F.col(embedding).alias("_q"))
    known = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).alias("_e"))
    scored = coarse.join(known, "_id").join(asked, "query_id").select("query_id", F.col("_id").alias("vec_id"), METRICS[rerank](F.col("_e"), F.col("_q")).alias("d"))
    own = Window.partitionBy("query_id")
    low, high = F.min("d").over(own), F.max("d").over(own)
    score = F.coalesce(F.try_divide(high - F.col("d"), high - low), F.lit(1.0))
    ranked = scored.withColumn("score", score).withColumn("rank", F.row_number().over(own.orderBy("d", "vec_id")))
    return ranked.where(F.col("rank") <= final_k)


def sq4_encode(v: Column, low: float, high: float) -> Column:
    """Elements as integers 0..15 between the bounds."""
    step = (high - low) / 15 or 1.0
    return F.transform(doubles(v), lambda x: F.least(F.lit(15), F.greatest(F.lit(0), F.floor((x - low) / step + 0.5))).cast("int"))


def sq4_decode(codes: Column, low: float, high: float) -> Column:
    step = (high - low) / 15 or 1.0
    return F.transform(codes, lambda c: c * F.lit(step) + low)


def matvec(v: Column, matrix: np.ndarray) -> Column:
    """matrix times v."""
    return dense(v, matrix, np.zeros(len(matrix)))


def adapter(v: Column, down: np.ndarray, up: np.ndarray, strength: float = 1.0) -> Column:
    """v + strength * up relu(down v): a low-rank correction of a vector, in one pass over the batch."""
    d, u = np.asarray(down, float), np.asarray(up, float)

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(float)
        return pd.Series(list(x + strength * np.maximum(x @ d.T, 0) @ u.T), dtype=object)

    return run(v)


def mlp(v: Column, layers: Sequence[tuple[np.ndarray, np.ndarray, str | None]]) -> Column:
    """Dense layers in turn, each (weights, bias, activation), in one pass over the batch."""
    plan = [(np.asarray(w, float), np.asarray(b, float), a) for w, b, a in layers]

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(float)
        for w, b, a in plan:
            x = x @ w.T + b
            x = np.maximum(x, 0) if a == "relu" else np.tanh(x) if a == "tanh" else 1 / (1 + np.exp(-x)) if a == "sigmoid" else x
        return pd.Series(list(x), dtype=object)

    return run(v)


def conv1d(v: Column, kernel: Sequence[float]) -> Column:
    """Valid one-dimensional correlation of the vector with the kernel."""
    n = len(kernel)
    heads = F.slice(doubles(v), F.lit(1), F.greatest(F.lit(0), F.size(v) - (n - 1)))
    terms = lambda i: sum((F.get(doubles(v), i + k) * float(w) for k, w in enumerate(kernel)), F.lit(0.0))
    return F.transform(heads, lambda x, i: terms(i))


def score_batches(rows: DataFrame, model: Callable, columns: Sequence[str], out: str = "score", loads: bool = False) -> DataFrame:
    """``rows`` with the model's score: the model is sent once per task and called with batches of the given columns.

    ``loads``: ``model`` is a function without arguments that opens a session and returns the model; it is called once in each task,
    on the worker, for models that can't be sent (as ``lambda: open_onnx(path)``).
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out] + [f"`{out}` double"])

    def run(frames):
        call = model() if loads else model
        for frame in frames:
            yield frame.assign(**{out: call(frame[list(columns)]).astype(float)})

    return rows.mapInPandas(run, schema)


def open_onnx(path: str) -> Callable[[pd.DataFrame], pd.Series]:
    """A session over an ONNX model that takes one matrix, made of the first column's vectors, and gives a number for each row."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name

    def call(frame: pd.DataFrame) -> pd.Series:
        x = np.stack(frame.iloc[:, 0].to_numpy()).astype(np.float32)
        return pd.Series(np.asarray(session.run(None, {name: x})[0]).reshape(len(frame)), index=frame.index)

    return call


class FlatIndex:
    """An exact index: vectors with their squared norms, which grows by adding frames and is stored as a table."""

    def __init__(self, metric: str = "l2"):
        self.metric, self.rows = metric, None

    def add(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> FlatIndex:
        e = F.col(embedding)
        new = vectors.select(F.col(vec_id).alias("vec_id"), e.alias("embedding"), squared_norm(e).alias("norm2"))
        self.rows = new if self.rows is None else self.rows.unionByName(new)
        return self

    def search(self, query: Sequence[float], k: int = 10) -> DataFrame:
        """The nearest k; of cosine and l2 only the inner products are computed, the stored norms give the rest."""
        q, e = F.array(*[F.lit(float(x)) for x in query]), F.col("embedding")
        own = float(np.square(np.asarray(query, float)).sum())
        if self.metric == "cosine":
            norms = F.col("norm2") * own
            distance = F.when(norms < TINY, 1.0).otherwise(1 - dot(e, q) / F.sqrt(norms))
        elif self.metric == "l2":
            distance = F.greatest(F.lit(0.0), F.col("norm2") + own - 2 * dot(e, q))
        else:
            distance = METRICS[self.metric](e, q)
        return self.rows.select("vec_id", distance.alias("distance")).orderBy("distance", "vec_id").limit(k)

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return knn_batch(self.rows, queries, k, self.metric)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> FlatIndex:
        self.rows = spark.read.parquet(path)
        return self
