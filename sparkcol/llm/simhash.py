"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into ``max_bits + 1`` consecutive segments on a ring. If two fingerprints differ in at most
``max_bits`` bits, then from some segment on every chain of the next l segments differs in at most
``l * max_bits / (max_bits + 1)`` bits: none in the first, one in the first two, and so on. Keys are made of the first
two: the whole first segment and all but one part of the second, since one difference spoils one part. Rows that share a
key are compared: chains first, the full distance last.

For distances so wide that two segments make a short key, the ring goes over two fingerprints and a key is its first segment
alone. The rows of a key are laid into buckets by the segments that follow, as many as leave some rows to a bucket, and only
buckets that the chains' budgets allow are compared, by the full distance. No link is lost, and comparisons grow with the square
of the number of rows, less what the longer chains save. Who can't pay that and may lose links asks for a recall: ``sampled_keys``
then draws keys of bits, as wide as the number of rows asks for, and as many as it takes to meet a link with that probability.

Only distinct fingerprints are compared, so copies cost nothing. Within a key the links come out as a spanning forest,
never as all pairs, unless the key has a few rows. A key with more rows than a task should hold is split into blocks, and each
pair of blocks is a task of its own; nothing is capped.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, whole_row
from .components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Keys with up to so many rows are compared pair by pair.
FEW = 12
#: Keys with up to so many rows are compared in one matrix.
MATRIX = 1 << 10
#: Of an exact key on two fingerprints: rows of a bucket at least, on average; rows on each side of a comparison; links held for each row.
BUCKET, TILE, HELD = 48, 512, 8
#: Rows, with their keys, that one task is meant to compare.
PER_TASK = 1 << 18
#: Of sampled keys: rows of unrelated fingerprints that one holds on average, the probability of meeting a link, and the share
#: of bits in which texts differ whose shingle sets have a similarity of 0.8 (of unit vectors at the angle arccos(2 * 0.8 / 1.8)).
PER_KEY, RECALL, ERROR = 64, 0.95, math.acos(1.6 / 1.8) / math.pi


def fingerprints(text: str | None, shingle: int, seeds: tuple[int, ...]) -> list[int]:
    """For each seed, the bits that are set in over half of the XXH64 of the word shingles; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * len(seeds)
    n = max(1, len(words) - shingle + 1)
    set_bits = np.zeros((len(seeds), BITS), np.int64)
    for i in range(0, n, CHUNK):
        part = words[i : i + CHUNK + shingle - 1]
        shingles = list(map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))) if len(part) >= shingle else [b" ".join(part)]
        for k, seed in enumerate(seeds):
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), "<u8", len(shingles))
            set_bits[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int(np.packbits(2 * x > n, bitorder="little").view("<u8")[0]) for x in set_bits]


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    return fingerprints(text, shingle, (seed,))[0]


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 4, seed: int = SEED) -> DataFrame:
    """``docs`` with the fingerprint as a long (its bits, two's complement)."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in series], np.uint64).view(np.int64))

    return docs.withColumn(out, prints(F.col(text)))


def with_two_fingerprints(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with ``prints``: fp and fp2, by two seeds, as longs."""

    @F.pandas_udf("fp long, fp2 long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = np.array([fingerprints(t, shingle, (SEED, SEED + 1)) for t in series], np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"fp": found[:, 0], "fp2": found[:, 1]})

    return docs.withColumn("prints", prints(F.col(text)))


def segments(n: int) -> list[int]:
    """Masks of ``n`` consecutive segments of a fingerprint, of near-equal width."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def patterns(max_bits: int, parts: int) -> list[tuple[int, list[int]]]:
    """(mask of the key's bits, masks of the growing chain from two segments on) for each start and part left out."""
    ring = segments(max_bits + 1)
    n, out = len(ring), []
    for i in range(n):
        chains = [0]
        for j in range(n):
            chains.append(chains[-1] | ring[(i + j) % n])
        second = [b for b in range(BITS) if ring[(i + 1) % n] >> b & 1]
        k = min(parts, len(second))
        for p in range(k):
            omitted = sum(1 << b for b in second[len(second) * p // k : len(second) * (p + 1) // k])
            out.append((chains[2] & ~omitted, chains[2:]))
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def sampled_keys(n: int, error: float = ERROR, recall: float = RECALL) -> list[tuple[int, int]]:
    """Masks of keys over two fingerprints, for ``n`` distinct rows.

    A key has as many bits as leave ``PER_KEY`` unrelated rows to it; two rows that differ in the share ``error`` of their bits
    agree in all of a key's with the probability of that many agreements, which gives the number of keys for the recall. So
    comparisons per row are ``PER_KEY`` times the number of keys, which grows as a quarter power of ``n``.
    """
    width = max(8, math.ceil(math.log2(max(1, n) / PER_KEY)))
    meet = (1 - error) ** width
    rng = random.Random(SEED)
    out = []
    for _ in range(max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))):
        drawn = rng.sample(range(2 * BITS), width)
        out.append((sum(1 << b for b in drawn if b < BITS), sum(1 << (b - BITS) for b in drawn if b >= BITS)))
    return out


class _Near:
    """Which of the pairs that share a sampled key are links: on the ring of both fingerprints' segments, some chain of one, two and
    three has at most none, one and two differing bits; then the full distance."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        half = (max_bits + 1) // 2
        self.rings = [[np.uint64(x) for x in segments(n)] for n in (half, max_bits + 1 - half)]

    def __call__(self, diff: np.ndarray, second: np.ndarray) -> np.ndarray:
        counts = [np.bitwise_count(d & x) for d, ring in zip((diff, second), self.rings, strict=True) for x in ring]
        ok, n = np.zeros(diff.shape, bool), len(counts)
        for i in range(n):
            two = counts[i] + counts[(i + 1) % n]
            ok |= (counts[i] == 0) & (two <= 1) & (two + counts[(i + 2) % n] <= 2)
        at = np.nonzero(ok)
        ok[at] = np.bitwise_count(diff[at]) + np.bitwise_count(second[at]) <= self.max_bits
        return ok


class _Filter:
    """Which of the pairs that share an exact key are links: budgets of the growing chains from the key on, then the full distance."""

    def __init__(self, chains: list[int], max_bits: int):
        self.chains, self.max_bits = [np.uint64(c) for c in chains], max_bits

    def __call__(self, diff: np.ndarray, second: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(diff & self.chains[0]) <= 1
        for length, mask in enumerate(self.chains[1:], 3):
            at = np.nonzero(ok)
            if not len(at[0]):
                return ok
            ok[at] = np.bitwise_count(diff[at] & mask) <= length - 1
        at = np.nonzero(ok)
        ok[at] = np.bitwise_count(diff[at]) <= self.max_bits
        return ok


def double_ring(max_bits: int) -> list[tuple[int, int]]:
    """Masks of ``max_bits + 1`` consecutive segments of two fingerprints: if these differ in at most ``max_bits`` bits, they agree in one at least."""
    n, whole = max_bits + 1, (1 << BITS) - 1
    edges = [2 * BITS * i // n for i in range(n + 1)]
    return [(x & whole, x >> BITS) for x in ((1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False))]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``n`` places that connect what the pairs (i, j) connect, fewer than n: each place with the least one of its component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return root[at], at


class _Chain:
    """Links among rows that share the segment ``start`` of the ring over two fingerprints.

    For each link there is a start from which on l segments differ in at most l - 1 bits, whatever l: rows of a large key are compared
    where the segments after the first allow it.
    """

    def __init__(self, ring: list[tuple[int, int]], start: int, max_bits: int):
        self.max_bits = max_bits
        self.after = [[b for b in range(2 * BITS) if (m | m2 << BITS) >> b & 1] for m, m2 in ring[start + 1 :] + ring[:start]]

    def __call__(self, diff: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.bitwise_count(diff) + np.bitwise_count(second) <= self.max_bits

    def buckets(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each row, made of the bits that follow the key, and the differences of numbers that links may have."""
        number, differ, width = np.zeros(len(v), np.int64), np.zeros(1, np.int64), 0
        for length, bits in enumerate(self.after, 1):
            if len(v) >> (width + len(bits)) < BUCKET:
                break
            for k, b in enumerate(bits, width):
                number |= ((v if b < BITS else w) >> np.uint64(b % BITS) & np.uint64(1)).astype(np.int64) << k
            differ = (differ[None, :] | np.arange(1 << len(bits))[:, None] << width).ravel()
            differ = differ[np.bitwise_count(differ) <= length]
            width += len(bits)
        return number, differ

    def links(self, v: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        number, differ = self.buckets(v, w)
        order = np.argsort(number, kind="stable")
        v, w, number = v[order], w[order], number[order]
        values, starts = np.unique(number, return_index=True)
        ends = np.append(starts[1:], len(v))
        place = {x: k for k, x in enumerate(values.tolist())}
        found, held, root = [(np.zeros(0, np.int64),) * 2], 0, None
        for x, at in place.items():
            for other in [place[y] for y in (x ^ differ).tolist() if y >= x and y in place]:
                for a in range(starts[at], ends[at], TILE):
                    for b in range(a if other == at else starts[other], ends[other], TILE):
                        a_end, b_end = min(a + TILE, ends[at]), min(b + TILE, ends[other])
                        if root is not None and (root[a:a_end] == root[a]).all() and (root[b:b_end] == root[a]).all():
                            continue  # connected already
                        near = self(v[a:a_end, None] ^ v[None, b:b_end], w[a:a_end, None] ^ w[None, b:b_end])
                        if a == b:
                            near = np.triu(near, 1)
                        if near.any():
                            i, j = np.nonzero(near)
                            found.append((a + i, b + j))
                            held += len(i)
                        if held > HELD * len(v):
                            found = [_forest(*map(np.concatenate, zip(*found, strict=True)), len(v))]
                            held, root = len(found[0][0]), np.arange(len(v))
                            root[found[0][1]] = found[0][0]
        i, j = _forest(*map(np.concatenate, zip(*found, strict=True)), len(v))
        yield order[i], order[j]


def _links(v: np.ndarray, w: np.ndarray, close: _Filter | _Near | _Chain) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, as places of rows, that span what is linked among the rows of a key."""
    if len(v) <= MATRIX:
        i, j = np.nonzero(np.triu(close(v[:, None] ^ v[None, :], w[:, None] ^ w[None, :]), 1))
        if len(i) <= 2 * len(v):
            yield i, j
            return
    elif isinstance(close, _Chain):
        yield from close.links(v, w)
        return
    rest = np.arange(len(v))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = close(v[rest] ^ v[at], w[rest] ^ w[at])
            if near.any():
                found = rest[near]
                yield np.full(len(found), at), found
                front.extend(found)
                rest = rest[~near]


def link(nodes: DataFrame, fp: str = "fp", max_bits: int = 4, parts: int = 4, most: int | None = None, second: str | None = None, recall: float | None = None) -> DataFrame:
    """Links (a, b) among the distinct values of ``fp`` (long) that connect exactly what distances of up to ``max_bits`` connect.

    ``second``: a further fingerprint. Nodes are then pairs (fp, fp2), a and b are structs of them, ``max_bits`` is the distance over the
    bits of both. With a ``recall``, keys are sampled and links may be lost: texts of similarity 0.8 meet with that probability, more
    like ones more surely.
    ``most``: rows of a key that one task compares, by default 2**20 of two fingerprints without a recall and else 2**14; the rows of
    a larger key are compared block by block.
    """
    exact = bool(second) and recall is None
    most = most or (1 << 20 if exact else 1 << 14)
    tasks = []
    if second:
        n = nodes.count()
        masks = double_ring(max_bits) if exact else sampled_keys(n, recall=recall)
        filters = [_Chain(masks, k, max_bits) for k in range(len(masks))] if exact else [_Near(max_bits)] * len(masks)
        if exact:
            tasks = [max(1, math.ceil(n * len(masks) / PER_TASK))]  # their work is more than their bytes tell
        bits = [F.xxhash64(F.col(fp).bitwiseAND(F.lit(_signed(m))), F.col(second).bitwiseAND(F.lit(_signed(m2)))) for m, m2 in masks]
    else:
        table = patterns(max_bits, parts)
        filters = [_Filter(chains, max_bits) for _, chains in table]
        bits = [F.col(fp).bitwiseAND(F.lit(_signed(mask))) for mask, _ in table]
    keys = F.array(*[F.struct(F.lit(p).alias("pattern"), b.alias("bits")) for p, b in enumerate(bits)])
    other = F.col(second) if second else F.lit(0).cast("long")
    rows = nodes.select(F.col(fp).alias("fp"), other.alias("fp2"), F.explode(keys).alias("k")).select("k.pattern", "k.bits", F.lit(0).alias("pair"), "fp", "fp2")
    key = ["pattern", "bits", "pair"]

    def compare(limit: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def put(p, k, v, w, i, j) -> pd.DataFrame:
                return pd.DataFrame({"pattern": np.int32(p), "bits": np.int64(k), "a": v[i].view(np.int64), "a2": w[i].view(np.int64), "b": v[j].view(np.int64), "b2": w[j].view(np.int64)})

            def settle(p, k, v, w, starts) -> Iterator[pd.DataFrame]:
                """Links of whole keys; the rows of a key beyond the limit are passed on with their pattern instead."""
                lengths = np.diff(np.append(starts, len(v)))
                run_of = np.repeat(np.arange(len(starts)), lengths)
                small = lengths[run_of] <= FEW
                for d in range(1, FEW):
                    i = np.flatnonzero(small[:-d] & (run_of[d:] == run_of[:-d]))
                    if not len(i):
                        break
                    for which in np.unique(p[i]):
                        j = i[p[i] == which]
                        j = j[filters[which](v[j] ^ v[j + d], w[j] ^ w[j + d])]
                        if len(j):
                            yield put(-1, 0, v, w, j, j + d)
                for s, n in zip(starts[lengths > FEW], lengths[lengths > FEW], strict=True):
                    if n > limit:
                        yield put(p[s], k[s], v, w, slice(s, s + n), slice(s, s + n))
                    else:
                        for i, j in _links(v[s : s + n], w[s : s + n], filters[p[s]]):
                            yield put(-1, 0, v, w, s + i, s + j)

            held = None  # the rows of the last key, which may go on
            passed = None  # a key beyond the limit, whose rows are passed on as they come
            for batch in batches:
                if not len(batch):
                    continue
                now = [batch[c].to_numpy() for c in key] + [batch[c].to_numpy().view(np.uint64) for c in ("fp", "fp2")]
                p, k, q, v, w = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
                held = None
                starts = np.concatenate([[0], np.flatnonzero((p[1:] != p[:-1]) | (k[1:] != k[:-1]) | (q[1:] != q[:-1])) + 1])
                if passed == (p[0], k[0], q[0]):
                    n = starts[1] if len(starts) > 1 else len(v)
                    yield put(p[0], k[0], v, w, slice(n), slice(n))
                    p, k, q, v, w = (x[n:] for x in (p, k, q, v, w))
                    starts = starts[1:] - n
                    if not len(v):
                        continue
                last = starts[-1]
                passed = (p[last], k[last], q[last]) if len(v) - last > limit else None
                if passed:
                    yield from settle(p, k, v, w, starts)
                else:
                    yield from settle(p[:last], k[:last], v[:last], w[:last], starts[:-1])
                    held = [x[last:] for x in (p, k, q, v, w)]
            if held:
                p, k, q, v, w = held
                yield from settle(p, k, v, w, np.array([0]))

        return run

    shape = "pattern int, bits long, a long, a2 long, b long, b2 long"
    ends = [F.struct(F.col(x).alias("fp"), F.col(f"{x}2").alias("fp2")).alias(x) if second else F.col(x) for x in ("a", "b")]
    out = cut(rows.repartition(*tasks, *key).sortWithinPartitions(*key).mapInPandas(compare(most), shape))
    links = out.where("pattern < 0").select(*ends)
    over = out.where("pattern >= 0").select("pattern", "bits", F.col("a").alias("fp"), F.col("a2").alias("fp2"))
    if over.isEmpty():
        return links
    blocks = over.groupBy("pattern", "bits").agg(F.ceil(F.count("*") * 2 / F.lit(most)).cast("int").alias("n"))
    placed = over.join(blocks, ["pattern", "bits"]).withColumn("b", F.pmod(F.xxhash64("fp", "fp2"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.least(c, F.col("b")) * F.col("n") + F.greatest(c, F.col("b")))
    rest = placed.select("pattern", "bits", F.explode(pairs).alias("pair"), "fp", "fp2")
    rest = rest.repartition(*key).sortWithinPartitions(*key).mapInPandas(compare(1 << 62), shape)
    return links.union(rest.select(*ends))


def _named(rows: DataFrame, first: Column, max_bits: int, recall: float | None = None) -> DataFrame:
    """(fp, and fp2 where ``rows`` have it, name) for each distinct one of ``rows``, name being the least ``first`` (an aggregate) of its component."""
    both = [c for c in ("fp", "fp2") if c in rows.columns]
    node = F.struct(*both) if len(both) > 1 else F.col("fp")
    nodes = cut(rows.groupBy(*both).agg(first.alias("first")))
    roots = components(link(nodes, "fp", max_bits, second="fp2" if len(both) > 1 else None, recall=recall))
    named = cut(nodes.join(roots, node == roots["node"], "left").select(*both, "first", F.coalesce("root", node).alias("root")))
    # written, so that the rows of a very large component can be split in the join
    least = cut(named.groupBy("root").agg(F.min("first").alias("name")))
    return named.join(least, "root").select(*both, "name")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """A row per row of ``docs``: doc_id, fp (long) and component_id, the least doc_id reachable over links of fingerprints.

    Texts without words (null too) have fingerprint 0 and are linked like any other. Rows with a null id get the
    component of their fingerprint; a component without any id has a null one. Repeated rows get equal results; an empty table gives an
    empty one. Ids may be of any type that has an order. One text is held in memory with its words, whatever its length.
    """
    rows = cut(with_fingerprints(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), "text", "fp", shingle).drop("text"))
    names = _named(rows, F.min("doc_id"), max_bits)
    return rows.join(names, "fp").select("doc_id", "fp", F.col("name").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 26, shingle: int = 5, recall: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component, that of the least doc_id, with all columns as they came.

    The similarity of texts is that of five-word shingles, of at least 0.8. Such texts differ in up to 26 of the 128 bits of two
    fingerprints as a rule (19 on average at 0.8); unrelated ones do so once in some 10**11 pairs. All pairs that do are linked, unless
    a ``recall`` is asked for: see ``link``.
    A null id comes after all others; ids may be of any type that has an order. Of rows that share the id, the text with the least
    hash stays; of rows that share the text too, any one does. Documents without words stay or go like any other: one of them stays.
    """
    i, t = F.col(quoted(doc_id)), F.col(quoted(text))
    key = ["_none", "_as_text", "_hash"]
    known = docs.select(
        whole_row(docs).alias("_row"), i.alias("_id"), i.isNull().alias("_none"), F.coalesce(i.cast("string"), F.lit("")).alias("_as_text"),
        F.xxhash64(F.coalesce(t, F.lit(""))).alias("_hash"), t.alias("_text"),
    )
    rows = with_two_fingerprints(known.drop("_row"), "_text", shingle).select("_none", "_id", "_as_text", "_hash", "prints.*")
    names = _named(cut(rows), F.min(F.struct("_none", "_id", "_as_text", "_hash")), max_bits, recall)
    stay = names.select(*[F.col(f"name.{k}").alias(k) for k in key]).distinct()
    return known.groupBy(*key).agg(F.first("_row").alias("_row")).join(stay, key, "left_semi").select("_row.*")
