"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences: at ``. ! ?``, such marks of other scripts, and line ends. A sentence of more than ``LONG`` words is
cut further at its clause marks (``, ; :`` and their kin), and a clause that is still longer than twice that behind words that
their own hash picks, so that the cuts of a copied passage are the same wherever it stands. From each sentence on, the
span of the next ones is hashed: at least ``min_sentences`` of them, and as many as it takes to hold ``min_words`` words, so that
set phrases don't count; and up to each sentence, the span of such a size that ends with it. Where fewer sentences hold ``long_words`` words, these are hashed as a span too; a text that is too short for
any span is one span as a whole. In scripts without spaces each letter counts as a word.

Spans meet over all documents by 128 bits of hash: they are put in one order by (hash, doc_id, hash of the text, position), in which
equal spans are neighbours, however many tasks their row of neighbours crosses. The first of equal spans stays, and the
sentences that any other one covers are removed.

Sentences are compared without case and with white space made single. Null and empty texts, and those of white space, have no
spans; an empty table gives an empty result. Ids may be of any type that has an order; a null id comes last. Rows that share both id
and text count as one document and get the same result. One text with its spans is held in memory; nothing is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, whole_row

#: Marks that end sentences, and those that end clauses.
ENDS = ".!?…\n。！？｡؟۔।॥"
CLAUSE_ENDS = ",;:，；：、､،؛"
SENTENCE = re.compile(rf"[^{ENDS}]*[{ENDS}]+\s*|[^{ENDS}]+\Z")
CLAUSE = re.compile(rf"[^{CLAUSE_ENDS}]*[{CLAUSE_ENDS}]+\s*|[^{CLAUSE_ENDS}]+\Z")
SPACED_WORD = re.compile(r"\s*\S+\s*")
#: Letters of scripts that put no spaces between words.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")
#: Words of a sentence beyond which it is cut at clause marks; twice as many make a clause be cut at picked words, one in so many.
LONG, PICKED = 20, 8
#: Spans that are handed on at a time.
SPANS = 1 << 15
BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in BASES], np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _length(words: list[str], spaced: bool) -> int:
    return len(words) if spaced else sum(max(1, len(UNSPACED.findall(w))) for w in words)


def sentences(text: str | None) -> tuple[list[str], list[list[str]], list[int]]:
    """The sentences and parts of sentences of a text, which joined give the text; their words, lowered; their lengths."""
    pieces, words, lengths = [], [], []
    if not text:
        return pieces, words, lengths
    spaced = text.isascii() or not UNSPACED.search(text)

    def add(piece: str, own: list[str], length: int) -> None:
        pieces.append(piece)
        words.append(own)
        lengths.append(length)

    for sentence in SENTENCE.findall(text):
        own = sentence.lower().split()
        length = _length(own, spaced)
        if length <= LONG:
            add(sentence, own, length)
            continue
        for clause in CLAUSE.findall(sentence):
            own = clause.lower().split()
            length = _length(own, spaced)
            if length <= 2 * LONG:
                add(clause, own, length)
                continue
            part: list[str] = []
            for word in SPACED_WORD.findall(clause) or [clause]:
                part.append(word)
                if xxhash.xxh3_64_intdigest(word.strip().lower().encode("utf-8", "surrogatepass")) % PICKED == 0:
                    add("".join(part), (own := "".join(part).lower().split()), _length(own, spaced))
                    part = []
            if part:
                add("".join(part), (own := "".join(part).lower().split()), _length(own, spaced))
    return pieces, words, lengths


def spans(text: str | None, min_sentences: int = 2, min_words: int = 25, long_words: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, as two longs; first sentence; sentence after the last) of the spans of a text."""
    _, words, lengths = sentences(text)
    n = len(words)
    ends = np.cumsum([0, *lengths])
    if not n or not ends[-1]:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    digests = b"".join([xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words])
    hashes = np.frombuffer(digests, "<u8").reshape(n, 2)
    first = np.arange(n)
    until = np.maximum(first + min_sentences, np.searchsorted(ends, ends[:-1] + min_words))
    back = np.minimum(first + 1 - min_sentences, np.searchsorted(ends, ends[1:] - min_words, "right") - 1)
    few = np.searchsorted(ends, ends[:-1] + long_words)
    kinds = ((first, until, until <= n), (back, first + 1, back >= 0), (first, few, (few <= n) & (few - first < min_sentences)))
    both = np.unique(np.concatenate([a[ok] * (n + 1) + b[ok] for a, b, ok in kinds]))
    first, until = both // (n + 1), both % (n + 1)
    if not len(first):
        first, until = np.zeros(1, np.int64), np.full(1, n)
    found = np.empty((len(first), 2), np.uint64)
    for half in (0, 1):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, half] * _powers(BASES[half], n))])
        found[:, half] = (sums[until] - sums[first]) * _powers(INVERSES[half], n)[first]
    return found.view(np.int64), first.astype(np.int32), until.astype(np.int32)


def without_sentences(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the sentences of the given spans, the number of its sentences, and of those removed."""
    pieces = sentences(text)[0]
    gone = np.zeros(len(pieces) + 1, np.int64)
    for a, b in covered:
        gone[a] += 1
        gone[b] -= 1
    stay = np.cumsum(gone)[:-1] == 0
    return "".join([p for p, s in zip(pieces, stay, strict=True) if s]).rstrip(), len(pieces), int((~stay).sum())


def _spans_of(docs: DataFrame, options: dict[str, int]) -> DataFrame:
    """(h1, h2, _id, _key, a, b) of all spans."""

    def put(batch: pa.RecordBatch, parts: list[tuple], rows: list[int]) -> pa.RecordBatch:
        h, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = pa.array(np.repeat(rows, [len(p[1]) for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("_id").take(at), batch.column("_key").take(at), pa.array(a), pa.array(b)], ["h1", "h2", "_id", "_key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            parts, rows, n = [], [], 0
            for row in range(len(batch)):
                own = spans(texts[row].as_py(), **options)
                if len(own[1]):
                    parts.append(own)
                    rows.append(row)
                    n += len(own[1])
                if n >= SPANS:
                    yield put(batch, parts, rows)
                    parts, rows, n = [], [], 0
            if parts:
                yield put(batch, parts, rows)

    return docs.select("_id", "_key", "_text").mapInArrow(run, f"h1 long, h2 long, _id {docs.schema['_id'].dataType.simpleString()}, _key long, a int, b int")


#: What a row of ``_marked`` is: a span known not to be the first; a span of the first group of its task, which may go on from the
#: task before; the first span that a task has of its first or last group.
LATER, LEADING, EDGE = 0, 1, 2


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans in order, those that are not the first of their group, as far as one task can tell."""
    groups, last = 0, None  # last: the first row, as a batch, of the group that the rows have reached

    def put(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *rows.columns], ["kind", *rows.schema.names])

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        h1, h2, key, a = (batch.column(c).to_numpy() for c in ("h1", "h2", "_key", "a"))
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        known = [last.column(c)[0].as_py() for c in ("h1", "h2", "_key", "a")] if last else None
        if known:
            new[0] = known[0] != h1[0] or known[1] != h2[0]
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first_key, first_a = key[start], a[start]
        if known:
            first_key, first_a = np.where(start < 0, known[2], first_key), np.where(start < 0, known[3], first_a)
        leading = np.cumsum(new) + groups <= 1
        later = ~leading & ((key != first_key) | (a != first_a))
        for mask, kind in ((later, LATER), (leading, LEADING)):
            if mask.any():
                yield put(batch.filter(pa.array(mask)), kind)
        if not groups:
            yield put(batch.slice(0, 1), EDGE)
        groups += int(new.sum())
        if start[-1] >= 0:
            last = batch.slice(start[-1], 1)
    if last and groups > 1:
        yield put(last, EDGE)


def _not_first(firsts: dict[tuple[int, int], tuple[int, int]]):
    """Of marked spans, those that are not the first of their group over all tasks; ``firsts`` tells that of the groups at edges, as (_key, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, h1, h2, key, a = (batch.column(c).to_numpy() for c in ("kind", "h1", "h2", "_key", "a"))
            later = kind == LATER
            leading = kind == LEADING
            for one, two in set(zip(h1[leading].tolist(), h2[leading].tolist(), strict=True)):
                first_key, first_a = firsts[one, two]
                later |= leading & (h1 == one) & (h2 == two) & ((key != first_key) | (a != first_a))
            if later.any():
                yield batch.filter(pa.array(later)).select(["_id", "_key", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, **options: int) -> DataFrame:
    """(_id, _key) of documents, and ``covered``: their spans that repeat an earlier one, as (a, b)."""
    found = _spans_of(docs, options)
    order = ["h1", "h2", F.col("_id").asc_nulls_last(), "_key", "a"]
    # the order goes on within equal spans, so a span that very many documents hold is dealt over tasks like any others
    ordered = found.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut(ordered.mapInArrow(_marked, "kind int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)))
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "a")
    edges = marked.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min(place).alias("first"))
    # at most two groups for each task of the range exchange, so their number is bounded by a setting
    firsts = {(r.h1, r.h2): (r._key, r.a) for r in edges.select("h1", "h2", "first._key", "first.a").collect()}
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name not in ("h1", "h2"))
    later = marked.mapInArrow(_not_first(firsts), shape)
    return later.groupBy("_id", "_key").agg(F.collect_set(F.struct("a", "b")).alias("covered"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row``, ``_text``, and what tells documents apart: ``_id`` and ``_key``, a hash of id and text."""
    i, t = F.col(quoted(doc_id)), F.col(quoted(text))
    key: Column = F.xxhash64(i.isNull(), F.coalesce(i.cast("string"), F.lit("")), t.isNull(), F.coalesce(t, F.lit("")))
    return docs.select(whole_row(docs).alias("row"), t.alias("_text"), i.alias("_id"), key.alias("_key"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """All rows and columns of ``docs`` as a struct ``row``, with the cleaned ``text``, ``n_sentences`` and ``n_removed`` (long).

    ``options``: min_sentences, min_words and long_words of a span.
    """
    known = _keyed(docs, doc_id, text)

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def cleaned(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for series, covered in texts:
            rows = [
                (t, len(sentences(t)[0]), 0) if c is None else without_sentences(t, [(int(x["a"]), int(x["b"])) for x in c])
                for t, c in zip(series, covered, strict=True)
            ]
            yield pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])

    covered = repeated_spans(known, **options).select(F.col("_id").alias("_other"), F.col("_key").alias("_other_key"), "covered")
    joined = known.drop("_text").join(covered, F.col("_id").eqNullSafe(F.col("_other")) & (F.col("_key") == F.col("_other_key")), "left")
    once = cleaned.asNondeterministic()  # or a later filter on its result would run it again
    return joined.withColumn("_c", once(F.col("row")[text], "covered")).select("row", "_c.*")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` with the cleaned texts; documents of which nothing is left go. Other columns are untouched."""
    df = remove_repeats(docs, doc_id, text, **options)
    left = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    return df.where(left).select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
