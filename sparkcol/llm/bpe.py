"""Byte-level BPE: encoding and decoding by the ranks of a given vocabulary.

Each match of the pre-token pattern is encoded on its own, in two tiers. First, a minimal perfect hash maps the bytes of
whole pre-tokens to the only rank they could have; the stored bytes tell whether they are that token. Second, what is not in
the vocabulary is merged: its bytes form a linked list, a heap holds the neighbouring pairs that the vocabulary knows, and the
pair of least rank, leftmost first, is merged until none is left. The new pre-tokens of a batch of texts go through both tiers
together: numpy looks them up at once, and their heaps are trees in the rows of an array that are worked on in step. Long
pre-tokens, and few, have a heap of their own each.

Null texts count as empty and give no ids; equal texts give equal ids, an empty table an empty result. A task remembers the
pre-tokens it has met, up to a bound. A text is encoded piece by piece, so that a very long one needs its own size and no more; a
single pre-token needs some hundred times its size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in either half of a task's memory, and the longest that it remembers.
MEMORY, LONGEST = 150_000, 64
#: Characters of texts that are encoded at a time; a cut falls between two pre-tokens.
PIECE = 1 << 20
#: Rows whose heaps are worked on in step, at most and at least, bytes of a pre-token in a row (powers of two), and what stands for no pair.
ROWS, FEW, WIDTHS, NONE = 4096, 64, (16, 32, 64), 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash of fixed keys: a key's bucket has a seed under which all keys of the bucket get free slots."""

    LOAD = 4

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.seeds = np.zeros(max(1, -(-len(keys) // self.LOAD)), np.uint32)
        buckets: dict[int, list[int]] = {}
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets.setdefault(h % len(self.seeds), []).append(i)
        self.key_at = np.full(self.n, -1, np.int64)
        taken = bytearray(self.n)
        free: Iterator[int] | None = None
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # any free slot will do: the seed names it
                free = free or iter([i for i in range(self.n) if not taken[i]])
                slot = next(free)
                self.seeds[b] = (1 << 31) | slot
                slots = [slot]
            else:
                seed = 0
                while True:
                    slots = [self._mix(hashes[i], seed) % self.n for i in members]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    seed += 1
                self.seeds[b] = seed
            for i, s in zip(members, slots, strict=True):
                taken[s] = 1
                self.key_at[s] = i

    @staticmethod
    def _mix(h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 29)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        seed = int(self.seeds[h % len(self.seeds)])
        return seed & 0x7FFFFFFF if seed >> 31 else self._mix(h, seed) % self.n


    def slots_of(self, keys: list[bytes]) -> np.ndarray:
        """``slot`` of many keys."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        seed = self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)].astype(np.uint64)
        x = h ^ (seed * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) % np.uint64(self.n)
        return np.where(seed >> np.uint64(31), seed & np.uint64(0x7FFFFFFF), x).astype(np.int64)


def pairs_of(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each two tokens that make a third, as left rank << 32 | right rank in order, and the third's rank."""
    get = ranks.get
    found = sorted(
        (left << 32 | right, rank)
        for token, rank in ranks.items()
        for k in range(1, len(token))
        if (left := get(token[:k])) is not None and (right := get(token[k:])) is not None
    )
    return np.array([k for k, _ in found] + [NONE], np.int64), np.array([r for _, r in found] + [0], np.int64)


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None, pairs: tuple | None = None):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        tokens = list(ranks)
        self.table = table or PerfectHash(tokens)
        self.slots = [(tokens[i], ranks[tokens[i]]) for i in self.table.key_at]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.of_two = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self.pairs = pairs or pairs_of(ranks)
        self.of_byte = np.array([ranks.get(bytes((a,)), -1) for a in range(256)], np.int64)

    def plain(self) -> tuple:
        """What a broadcast can carry to workers that don't have this package."""
        return self.ranks, self.pattern.pattern, vars(self.table), self.pairs

    @classmethod
    def of(cls, plain: tuple) -> Tokenizer:
        ranks, pattern, known, pairs = plain
        table = PerfectHash.__new__(PerfectHash)
        vars(table).update(known)
        return cls(ranks, pattern, table, pairs)

    def whole(self, token: bytes) -> int | None:
        """First tier: the rank of a pre-token that is itself in the vocabulary."""
        known, rank = self.slots[self.table.slot(token)]
        return rank if known == token else None

    def merge(self, token: bytes) -> list[int]:
        """Second tier: a heap of pairs over linked parts; a part is known by its first byte, ``end`` is where it stops."""
        n, rank_of, of_two, push, pop = len(token), self.ranks.get, self.of_two, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := of_two[token[i] << 8 | token[i + 1]]) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = pop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:  # one of the two parts is no more what it was
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                last = end[stop]
                if (r := rank_of(token[i:last])) is not None:
                    push(heap, (r, i, last))
            if i:
                first = before[i]
                if (r := rank_of(token[first:stop])) is not None:
                    push(heap, (r, first, stop))
        out, i = [], 0
        while i < n:
            stop = end[i]
            out.append(rank_of(token[i:stop]))
            i = stop
        return out

    def _together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two parts make, or NONE >> 8."""
        keys, made = self.pairs
        wanted = left << 32 | right
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, made[at], NONE >> 8)

    def merge_rows(self, tokens: list[bytes], width: int) -> list[list[int]]:
        """``merge`` of many pre-tokens of at most ``width`` bytes. A row's heap is a tree of 2 * width numbers, each the less of the
        two below it; leaf i has the pair that part i makes with the next, its rank above i. So the root is the pair to merge, and
        a changed leaf changes the numbers on its way up."""
        rows, wide = len(tokens), width + 1
        n = np.fromiter(map(len, tokens), np.int64, rows)
        part = np.zeros((rows, wide), np.int64)
        part[:, :width] = self.of_byte[np.frombuffer(b"".join([t.ljust(width, b"\0") for t in tokens]), np.uint8).reshape(rows, width)]
        end = np.tile(np.arange(1, wide + 1), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        tree = np.full((rows, 2 * width), NONE, np.int64)
        places = np.arange(width)
        first = self._together(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(rows, width)
        tree[:, width:] = np.where(places + 1 < n[:, None], first << 8 | places, NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        ends, befores, parts, nodes = end.reshape(-1), before.reshape(-1), part.reshape(-1), tree.reshape(-1)
        live = np.arange(rows)
        while True:
            top = nodes[live * (2 * width) + 1]
            on = top < NONE
            live, top = live[on], top[on]
            if not len(live):
                break
            row, root, i = live * wide, live * (2 * width), top & 255
            middle = ends[row + i]
            stop = ends[row + middle]
            ends[row + i] = stop
            ends[row + middle] = 0
            merged = top >> 8
            parts[row + i] = merged
            more = stop < n[live]
            befores[(row + stop)[more]] = i[more]
            after = np.where(more, self._together(merged, parts[row + stop]) << 8 | i, NONE)
            start = befores[row + i]
            fore = start >= 0
            start = np.where(fore, start, i)
            ahead = np.where(fore, self._together(parts[row + start], merged) << 8 | start, after)
            for leaf, x in ((middle, NONE), (i, after), (start, ahead)):
                nodes[root + width + leaf] = x
            for leaf in (middle, i, start):
                node = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    below = root + 2 * node
                    nodes[root + node] = np.minimum(nodes[below], nodes[below + 1])
                    node >>= 1
        kept = (end[:, :width] > 0) & (places < n[:, None])
        ids, stops = part[:, :width][kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode_tokens(self, tokens: list[bytes]) -> list[list[int]]:
        """``encode_token`` of each."""
        out: list = [None] * len(tokens)
        slots, in_rows = self.slots, self.of_byte.min() >= 0
        by_width: dict[int, list[int]] = {w: [] for w in WIDTHS}
        for k, (token, slot) in enumerate(zip(tokens, self.table.slots_of(tokens).tolist(), strict=True)):
            known, rank = slots[slot]
            if known == token:
                out[k] = [rank]
            elif in_rows and len(token) <= WIDTHS[-1]:
                by_width[next(w for w in WIDTHS if len(token) <= w)].append(k)
            else:
                out[k] = self.merge(token)
        for width, places in by_width.items():
            for at in range(0, len(places), ROWS):
                some = places[at : at + ROWS]
                due = [tokens[k] for k in some]
                for k, ids in zip(some, self.merge_rows(due, width) if len(due) >= FEW else map(self.merge, due), strict=True):
                    out[k] = ids
        return out

    def encode_token(self, token: bytes) -> list[int]:
        rank = self.whole(token)
        return [rank] if rank is not None else self.merge(token)

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.encode_token(t.encode("utf-8", "surrogatepass")) for t in self.pattern.findall(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Memory(dict):
    """Pre-token -> (its ids as text, its number of ids, what these decode to). When it is full it becomes the older half and a new
    one begins; what is asked for again moves over, so frequent pre-tokens stay."""

    def __init__(self, tokenizer: Tokenizer, most: int = MEMORY):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def __missing__(self, token: str) -> tuple[str, int, bytes]:
        found = self.older.get(token)
        if found is None:
            found = self._entry(self.tokenizer.encode_token(token.encode("utf-8", "surrogatepass")))
        if len(token) <= LONGEST:
            self._keep(token, found)
        return found

    def _entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return " ".join(map(str, ids)), len(ids), self.tokenizer.decode(ids)

    def _keep(self, token: str, found: tuple[str, int, bytes]) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[token] = found

    def learn(self, lists: list[list[str]]) -> None:
        """What the lists have that isn't known yet, all at once."""
        older = self.older
        new = [t for t in set().union(*lists) if t not in self and len(t) <= LONGEST]
        for token in new:
            if token in older:
                self._keep(token, older[token])
        new = [t for t in new if t not in older]
        for token, ids in zip(new, self.tokenizer.encode_tokens([t.encode("utf-8", "surrogatepass") for t in new]), strict=True):
            self._keep(token, self._entry(ids))


def pieces(text: str, pattern: regex.Pattern, size: int = PIECE) -> Iterator[list[str]]:
    """The pre-tokens of ``text`` in lists; a list ends where a match does, so the cuts change no match."""
    if len(text) <= size:
        yield pattern.findall(text)
        return
    found: list[str] = []
    seen = 0
    for m in pattern.finditer(text):
        found.append(m[0])
        seen += len(m[0])
        if seen >= size:
            yield found
            found, seen = [], 0
    if found:
        yield found


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(lists: Iterable[list[str]], memory: Memory) -> tuple[int, str, str]:
    n, ids_hash, decoded_hash = 0, hashlib.sha256(), hashlib.sha256()
    for tokens in lists:
        if not tokens:
            continue
        ids, counts, decoded = zip(*map(memory.__getitem__, tokens), strict=True)
        ids_hash.update((" " * (n > 0) + " ".join(ids)).encode())
        decoded_hash.update(b"".join(decoded))
        n += sum(counts)
    return n, ids_hash.hexdigest(), decoded_hash.hexdigest()


def _learned_pieces(text: str, memory: Memory, size: int) -> Iterator[list[str]]:
    for tokens in pieces(text, memory.tokenizer.pattern, size):
        memory.learn([tokens])
        yield tokens


def learned(texts: Iterable[str], memory: Memory, size: int = PIECE) -> Iterator[Iterable[list[str]]]:
    """Each text as lists of its pre-tokens, which ``memory`` has met when they come: those of texts of ``size`` characters together,
    or of a piece of a longer one, at once. A text's lists are to be read before the next text is asked for."""
    held: list[list[str]] = []
    seen = 0
    for text in texts:
        if held and seen + len(text) > size:
            memory.learn(held)
            yield from ([tokens] for tokens in held)
            held, seen = [], 0
        if len(text) > size:
            yield _learned_pieces(text, memory, size)
        else:
            held.append(memory.tokenizer.pattern.findall(text))
            seen += len(text)
    memory.learn(held)
    yield from ([tokens] for tokens in held)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _shipped(docs: DataFrame, path: str | None, pattern: str | None):
    """The vocabulary, of a fixed size, its perfect hash and the pattern, for the workers."""
    return docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(path or default_path()), pattern or default_pattern()).plain())


def digests(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, out: str = "bpe") -> DataFrame:
    """``docs`` with ``out``: n_tokens, ids_sha256 (of the decimal ids, joined by one space) and decoded_sha256 (of what the ids decode to)."""
    shipped = _shipped(docs, path, pattern)

    @F.pandas_udf(DIGEST)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = Memory(Tokenizer.of(shipped.value))
        for series in texts:
            found = [_digest(lists, memory) for lists in learned((t or "" for t in series), memory)]
            yield pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(out, run(F.col(text)))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text."""
    shipped = _shipped(docs, path, pattern)

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory = Memory(Tokenizer.of(shipped.value))
        for series in texts:
            ids = [" ".join([memory[x][0] for tokens in lists for x in tokens]) for lists in learned((t or "" for t in series), memory)]
            yield pd.Series([np.array(x.split(), np.int32) for x in ids], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for (bytes that are no UTF-8 replaced); null ids give null."""
    shipped = _shipped(rows, path, None)

    @F.pandas_udf("string")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {rank: t for t, rank in shipped.value[0].items()}
        for series in lists:
            yield pd.Series([None if x is None else b"".join(token[i] for i in x).decode("utf-8", "replace") for x in series], dtype=object)

    return rows.withColumn(out, run(F.col(ids)))


def report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(docs.select("doc_id", "text"), path=path, pattern=pattern).select("doc_id", "bpe.*")
