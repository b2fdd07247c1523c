"""Benchmark decontamination with a broadcast hash set of the benchmark's n-grams.

Words are maximal runs of digits, letters a-z (A-Z lowered) and bytes beyond ASCII. A window is ``n`` consecutive words of
an item; an item of fewer words, but not none, is one window. Window hashes of a batch of texts are computed at once from
prefix sums of a polynomial, looked up in a bitmap and a sorted array, and hits are verified byte for byte.

The benchmark is read in blocks of bounded size, as many as it takes; each block is broadcast and all texts are
scanned against it. A usual benchmark is one block. Of several, only what is found is kept, by a hash of the text, and joined to the
documents at the end; texts are read again for each block, never written.

Null texts and texts without words have no hits. Items without text or words have no window; an item whose id is null
hits words but isn't counted. Repeated item ids count once; equal documents get equal results. An empty table of documents gives an
empty result, an empty benchmark no hits. Memory is some forty bytes for each byte of a batch of texts (2 MB, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, whole_row

#: How bytes count in words: lowered, or a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BITMAP = 22
#: Bytes of texts that are looked at together.
BATCH = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of several texts: their normal form, joined by single spaces, and where each begins and ends."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts).translate(NORMAL) + b" ", np.uint8)
        inside = raw != 32
        before = np.concatenate([[False], inside[:-1]])
        self.flat = raw[inside | before]
        self.end = np.flatnonzero(self.flat == 32)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.from_byte = np.flatnonzero(inside & ~before)
        self.to_byte = np.flatnonzero(before & ~inside)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.offsets = offsets[:-1]
        self.text_of = np.searchsorted(self.offsets, self.from_byte, "right") - 1
        self.sums = None

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of ``n`` words within one text, and the windows' hashes."""
        if len(self.start) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if self.sums is None:
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.flat.astype(np.uint64) * _powers(BASE, len(self.flat)))])
            self.undo = _powers(INVERSE, len(self.flat))
        first = np.flatnonzero(self.text_of[: len(self.text_of) - n + 1] == self.text_of[n - 1 :])
        s, e = self.start[first], self.end[first + n - 1]
        return first, (self.sums[e] - self.sums[s]) * self.undo[s]

    def window(self, first: int, n: int) -> bytes:
        return self.flat[self.start[first] : self.end[first + n - 1]].tobytes()


class Index:
    """Windows of a block of items, by hash."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids = [i for i, _ in items]
        self.words = Words([t.encode("utf-8", "surrogatepass") for _, t in items])
        counts = np.bincount(self.words.text_of, minlength=len(items))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(n, int(c)) for c in counts if c}):
            first, hashes = self.words.hashes(size)
            own = (np.minimum(counts, n) == size)[self.words.text_of[first]]
            first, hashes = first[own], hashes[own]
            order = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << BITMAP, bool)
            bitmap[hashes >> np.uint64(64 - BITMAP)] = True
            self.sizes[size] = first[order], hashes[order], bitmap

    def plain(self) -> tuple:
        """What a broadcast can carry to workers that don't have this package: without the sums, which only hashing needs."""
        return self.ids, vars(self.words) | {"sums": None, "undo": None}, self.sizes

    @classmethod
    def of(cls, plain: tuple) -> Index:
        index, words = cls.__new__(cls), Words.__new__(Words)
        index.ids, known, index.sizes = plain
        vars(words).update(known)
        index.words = words
        return index

    def hits(self, texts: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, number of words, item) for each window that occurs."""
        for size, (first, known, bitmap) in self.sizes.items():
            at, hashes = texts.hashes(size)
            maybe = np.flatnonzero(bitmap[hashes >> np.uint64(64 - BITMAP)])
            lo, hi = np.searchsorted(known, hashes[maybe], "left"), np.searchsorted(known, hashes[maybe], "right")
            for m, a, b in zip(maybe[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                seen = texts.window(at[m], size)
                for j in range(a, b):
                    if self.words.window(first[j], size) == seen:
                        yield int(at[m]), size, int(self.words.text_of[first[j]])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > BATCH:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


FOUND = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def _scan(index, rest: bool) -> Column:
    @F.pandas_udf(FOUND + ", rest string" * rest)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Index.of(index.value)
        for series in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in series]
            n_words = np.zeros(len(texts), np.int64)
            found: list[set[tuple[int, int]]] = [set() for _ in texts]
            named: list[set[str]] = [set() for _ in texts]
            for lo, hi in _batches(texts):
                words = Words(texts[lo:hi])
                n_words[lo:hi] = np.bincount(words.text_of, minlength=hi - lo)
                begin = np.searchsorted(words.text_of, np.arange(hi - lo))
                for first, size, item in known.hits(words):
                    t = int(words.text_of[first])
                    a = first - int(begin[t])
                    found[lo + t].add((a, a + size))
                    if known.ids[item] is not None:
                        named[lo + t].add(known.ids[item])
            spans = [_merge(list(s)) for s in found]
            out = pd.DataFrame({"n_words": n_words, "spans": [[{"a": a, "b": b} for a, b in s] for s in spans], "items": [sorted(x) for x in named]})
            if rest:
                out["rest"] = pd.Series([without_words(t, s) if s else None for t, s in zip(series, spans, strict=True)], dtype=object)
            yield out

    return scan.asNondeterministic()  # or a later filter on its result would run it again


def _merged(spans: Column) -> Column:
    @F.pandas_udf("array<struct<a:int,b:int>>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _merge([(int(x["a"]), int(x["b"])) for x in one])] for one in lists], dtype=object)

    return run(spans)


def _rest(text: Column, spans: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([without_words(t, [(int(x["a"]), int(x["b"])) for x in s]) if len(s) else None for t, s in zip(texts, lists, strict=True)], dtype=object)

    return run(text, spans)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, block_bytes: int = 8 << 20, out: str = "found", rest: bool = False) -> DataFrame:
    """``docs`` with ``out``: n_words, spans of hit words (by number, merged) and the sorted ids of the items found.

    ``rest``: and the text without these words (null if none is hit). One Python function finds and removes, since each further one
    in a task takes a worker of its own, with its memory.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("id"), F.col(quoted(item_text)).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    t = F.col(quoted(text))

    def scan(block: int, rest: bool = False) -> Column:
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).collect()
        return _scan(spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows], n).plain()), rest)(t)

    if n_blocks == 1:
        return docs.withColumn(out, scan(0, rest))
    key = [F.xxhash64(t).alias("_t1"), F.xxhash64(F.lit(n), t).alias("_t2")]
    parts = [docs.select(*key, F.lit(block).alias("_block"), scan(block).alias("f")) for block in range(n_blocks)]
    hits = reduce(DataFrame.union, [p.where((F.size("f.spans") > 0) | (F.col("_block") == 0)) for p in parts])
    each = hits.groupBy("_t1", "_t2", "_block").agg(F.first("f").alias("f"))  # copies of a text found the same
    found = each.groupBy("_t1", "_t2").agg(F.max("f.n_words").alias("n_words"), F.flatten(F.collect_list("f.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"))
    # written, so that the documents that share one text can be split in the join
    found = cut(found.select("_t1", "_t2", F.struct("n_words", _merged(F.col("spans")).alias("spans"), "items").alias("_found")))
    packed = docs.select(whole_row(docs).alias("_row"), *key).join(found, ["_t1", "_t2"], "left")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() != out.lower()]
    if rest:
        packed = packed.withColumn("_found", F.col("_found").withField("rest", _rest(F.col("_row")[text], F.col("_found.spans"))))
    return packed.select(*kept, F.col("_found").alias(out))


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (at least ``min_items`` items)."""
    df = find(docs.select("doc_id", "text"), benchmark, n=n, out="found", **options)
    items = F.col("found")["items"]
    size = F.size(items).cast("long")
    return df.select(
        "doc_id", F.col("found")["n_words"].alias("n_words"), n_hit(F.col("found")).alias("n_hit"), size.alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (size >= min_items).alias("contaminated"),
    )


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    words = Words([data])
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : words.from_byte[a]])
        at = int(words.to_byte[b - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "spans", text: str = "text", n: int = 8, min_items: int = 2, **options) -> DataFrame:
    """``docs`` without the words hit (``what="spans"``; a document of which no word is left goes) or without the documents
    that hold at least ``min_items`` items (``what="documents"``). All columns keep their names; others are untouched."""
    packed = docs.select(whole_row(docs).alias("_row"), F.col(quoted(text)).alias("_text"))
    df = find(packed, benchmark, "_text", n=n, out="_found", rest=what != "documents", **options)
    if what == "documents":
        return df.where(F.size(F.col("_found")["items"]) < min_items).select("_row.*")
    hit = n_hit(F.col("_found"))
    df = df.where((hit == 0) | (hit < F.col("_found")["n_words"]))
    df = df.withColumn("_text", F.when(hit > 0, F.col("_found")["rest"]).otherwise(F.col("_text")))
    return df.select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
