"""Approximate search over navigable graphs.

Vectors are dealt by a hash of their id into shards of bounded size, and each shard becomes a graph, kept as one row: every vector is linked
to its nearest ones, they to it, and all in a ring of random order, so that the graph is connected. A search walks each shard best first
from a few entries, keeping a beam of candidates, and the k best over all shards are the result. A graph over all vectors would be
one mutable structure in one memory; shards are built, searched and lost independently.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written
from .vectors import _distances, _listable, _ranked, squared_norm

SHARD = "shard int, ids binary, vectors binary, starts binary, links binary"
#: Vectors of a shard whose distances to all others are held at a time.
CHUNK = 512


def _graph(x: np.ndarray, links: int, walk: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each vector, as where they start in a list, and the list."""
    n = len(x)
    pairs = []
    for i in range(0, n, CHUNK):
        d = _distances(x[i : i + CHUNK], x, walk)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, min(links, n - 1) - 1, axis=1)[:, :links] if n > 1 else np.zeros((len(d), 0), np.int64)
        pairs.append(np.stack([np.repeat(np.arange(i, i + len(d)), near.shape[1]), near.ravel()], axis=1))
    ring = np.random.default_rng(seed).permutation(n)
    pairs.append(np.stack([ring, np.roll(ring, 1)], axis=1))
    both = np.concatenate(pairs)
    both = np.unique(np.concatenate([both, both[:, ::-1]]), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return np.searchsorted(both[:, 0], np.arange(n + 1)).astype(np.int32), both[:, 1].astype(np.int32)


def _walk(q: np.ndarray, x: np.ndarray, starts: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int, walk: str) -> np.ndarray:
    """Places of the ``beam`` nearest vectors that a best-first walk meets."""
    seen = np.zeros(len(x), bool)
    seen[entries] = True
    front = [(float(d), int(i)) for d, i in zip(_distances(q[None], x[entries], walk)[0], entries, strict=True)]
    heapq.heapify(front)
    best = [(-d, i) for d, i in front]
    heapq.heapify(best)
    while len(best) > beam:
        heapq.heappop(best)
    while front:
        d, i = heapq.heappop(front)
        if len(best) >= beam and d > -best[0][0]:
            break
        near = links[starts[i] : starts[i + 1]]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        for d, j in zip(_distances(q[None], x[near], walk)[0].tolist(), near.tolist(), strict=True):
            if len(best) < beam or d < -best[0][0]:
                heapq.heappush(front, (d, j))
                heapq.heappush(best, (-d, j))
                if len(best) > beam:
                    heapq.heappop(best)
    return np.array([i for _, i in best])


class GraphIndex:
    """``links``: nearest vectors that each is linked to; ``beam``: candidates that a search keeps in each shard; ``metric``: l2, l1, cosine, ip."""

    def __init__(self, links: int = 16, beam: int = 96, shard_rows: int = 4096, metric: str = "l2", entries: int = 8, seed: int = 42):
        self.links, self.beam, self.shard_rows, self.metric, self.entries, self.seed = links, beam, shard_rows, metric, entries, seed
        self.shards: DataFrame | None = None

    def build(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", where: Column | None = None) -> GraphIndex:
        """Over the vectors that meet ``where``; null vectors are left out."""
        known = vectors.where(F.col(embedding).isNotNull() if where is None else F.col(embedding).isNotNull() & where)
        n, longest = known.agg(F.count("*"), F.max(squared_norm(F.col(embedding)))).first()
        n_shards = max(1, -(-n // self.shard_rows))
        links, metric, seed, longest = self.links, self.metric, self.seed, longest or 0.0

        def made(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("vec_id")
            x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
            starts, near = _graph(_listable(x, metric, longest), links, "l1" if metric == "l1" else "l2", seed)
            return pd.DataFrame([(frame["shard"].iloc[0], frame["vec_id"].to_numpy().astype("<i8").tobytes(), x.tobytes(), starts.tobytes(), near.tobytes())], columns=["shard", "ids", "vectors", "starts", "links"])

        dealt = known.select(F.pmod(F.xxhash64(vec_id), F.lit(n_shards)).cast("int").alias("shard"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
        self.longest = longest
        self.shards = written(dealt.groupBy("shard").applyInPandas(made, SHARD))
        return self

    def _searcher(self, asked: tuple[np.ndarray, np.ndarray], spark: SparkSession, k: int, beam: int) -> Callable:
        shipped, metric, longest, n_entries, seed = spark.sparkContext.broadcast(asked), self.metric, self.longest, self.entries, self.seed

        def run(frames):
            ids, q = shipped.value
            turned, walk = (_listable(q, metric, None) if len(q) else q), "l1" if metric == "l1" else "l2"
            for frame in frames:
                for row in frame.itertuples(index=False):
                    own, starts, links = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.starts, np.int32), np.frombuffer(row.links, np.int32)
                    x = np.frombuffer(row.vectors, np.float64).reshape(len(own), -1)
                    space = _listable(x, metric, longest)
                    entries = np.unique(np.random.default_rng(seed).integers(0, len(own), n_entries))
                    out = []
                    for i in range(len(ids)):
                        at = _walk(turned[i], space, starts, links, entries, max(beam, k), walk)
                        d = _distances(q[i : i + 1], x[at], metric)[0]
                        best = np.lexsort((own[at], d))[:k]
                        out.append((np.full(len(best), ids[i]), own[at][best], d[best]))
                    if out:
                        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
                        yield pd.DataFrame({"query_id": a, "vec_id": b, "distance": c})

        return run

    def search_batch(self, queries: DataFrame, k: int = 10, beam: int | None = None, most_queries: int = 1 << 14) -> DataFrame:
        """(query_id, vec_id, distance, rank) for each row of ``queries`` (vec_id, embedding), ``most_queries`` of them at a time."""
        out, rows = None, queries.select("vec_id", "embedding").toLocalIterator()
        while True:
            part = [r for _, r in zip(range(most_queries), rows, strict=False)]
            if not part and out is not None:
                return out
            asked = np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], float).reshape(len(part), -1)
            found = self.shards.mapInPandas(self._searcher(asked, self.shards.sparkSession, k, beam or self.beam), "query_id long, vec_id long, distance double")
            found = written(_ranked(found, k))
            out = found if out is None else out.union(found)

    def search(self, query: Sequence[float], k: int = 10, beam: int | None = None) -> DataFrame:
        asked = np.zeros(1, np.int64), np.array([query], float)
        found = self.shards.mapInPandas(self._searcher(asked, self.shards.sparkSession, k, beam or self.beam), "query_id long, vec_id long, distance double")
        return found.orderBy("distance", "vec_id").limit(k).select("vec_id", "distance")

    def save(self, path: str) -> None:
        self.shards.withColumn("longest", F.lit(float(self.longest))).withColumn("metric", F.lit(self.metric)).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> GraphIndex:
        """An index as it was saved, its metric included."""
        self.shards = spark.read.parquet(path)
        kept = self.shards.select("longest", "metric").first()
        if kept:
            self.longest, self.metric = kept
        return self
