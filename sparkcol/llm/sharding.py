"""Histogram sort into shards of near-equal bytes, in DataFrame functions only.

Rows are ordered by a key. A splitter is a key; shard ``s`` begins at the first row whose preceding bytes reach
``s / n`` of all bytes. Splitters are found by counting: each pass counts the exact rows and bytes between candidate
keys over all partitions, and places the next candidates inside the interval that holds each splitter, until every
splitter is within the tolerance (0 bytes: exact). Then rows are exchanged once, to buckets that the candidates found on
the way delimit, and numbered inside them. A bucket of more rows than a task should have is dealt further by equal steps of
the key, or of the position where it holds a single key; the exact counts of these steps number their rows.

The order is (key, position in the materialised input), so a key that a third of the rows share is split like any
other range. A null key sorts first. Rows that repeat keep their own places. The only data on the driver are the
counts between candidates, of a number that depends on the number of shards and buckets and not on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

#: Where a null key sorts.
NULL_KEY = -(2**63) + 1


@dataclass
class Probe:
    """A candidate boundary (key, position) and what lies strictly below it."""

    at: tuple[int, int]
    rows: int
    size: int


def _interval(key: str, place: str, cuts: list[tuple[int, int]]) -> Column:
    """The number of ``cuts`` (ascending) at or below the row, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        k, p = cuts[mid]
        below = f"{key} < {k}L" + (f" OR ({key} = {k}L AND {place} < {p}L)" if p else "")
        return f"CASE WHEN {below} THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return F.expr(tree(0, len(cuts)))


def _between(lo: tuple[int, int], hi: tuple[int, int], n: int, places: int) -> list[tuple[int, int]]:
    """Up to ``n`` keys strictly between two boundaries, evenly spread over keys, or over places where keys meet."""
    (a, p), (b, q) = lo, hi
    if b - a > 1:
        return sorted({(a + (b - a) * i // (n + 1), 0) for i in range(1, n + 1)} - {(a, 0)} | ({(b, 0)} if q else set()))
    if b - a == 1:
        if q:
            return [(b, 0)]
        b, q = a, places  # only rows of key a are left
    return sorted({(a, p + (q - p) * i // (n + 1)) for i in range(1, n + 1)} - {lo, hi})


def find_splitters(rows: DataFrame, key: str, place: str, size: str, targets: dict[int, int], probes: int = 8, max_passes: int = 200) -> tuple[dict[int, Probe], list[Probe]]:
    """``targets``: bytes to have below a splitter -> tolerance in bytes (0: the first row at or beyond it, exactly).

    Returns the splitter of each target, and all candidates met, ascending.
    """
    edge = rows.agg(F.min(key), F.max(key), F.max(place), F.sum(size), F.count("*")).first()
    if not edge[4]:
        return {}, []
    places = edge[2] + 1
    known = {(edge[0], 0): Probe((edge[0], 0), 0, 0), (edge[1] + 1, 0): Probe((edge[1] + 1, 0), edge[4], edge[3])}
    found: dict[int, Probe] = {}
    for _ in range(max_passes):
        order = sorted(known)
        sizes = [known[k].size for k in order]
        wanted: set[tuple[int, int]] = set()
        i = 0
        for target, slack in sorted(targets.items()):
            while i + 1 < len(order) and sizes[i + 1] < target:
                i += 1
            if target in found:
                continue
            if target <= 0:
                found[target] = known[order[0]]
                continue
            lo, hi = known[order[i]], known[order[i + 1]]
            if slack and min(abs(lo.size - target), abs(hi.size - target)) <= slack:
                found[target] = min(lo, hi, key=lambda x: abs(x.size - target))
            elif hi.size == target or hi.rows - lo.rows <= 1 or not (inner := _between(lo.at, hi.at, 2 if slack else probes, places)):
                # the row between lo and hi is below the target by less than its size; the first row at or beyond it is hi's
                found[target] = hi
            else:
                wanted.update(inner)
        wanted -= known.keys()
        if not wanted:
            break
        cuts = sorted(wanted)
        counted = {
            r[0]: (r[1], r[2])
            for r in rows.groupBy(_interval(key, place, cuts).alias("_i")).agg(F.count("*"), F.sum(size)).collect()
        }
        n = b = 0
        for j, at in enumerate(cuts):
            n += counted.get(j, (0, 0))[0]
            b += counted.get(j, (0, 0))[1]
            known[at] = Probe(at, n, b)
    else:
        raise RuntimeError("splitters did not meet the tolerance")
    return found, [known[k] for k in sorted(known)]


def histogram_sort(rows: DataFrame, key: str, size: str, n_shards: int = 16, tolerance: int = 0, buckets_per_shard: int = 8, task_rows: int = 1 << 20) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard, in the order of the key); these replace
    input columns of the same names.

    ``key`` must be integral and within 63 bits; ``size`` a long column of positive sizes. ``rows`` should be narrow
    (identifiers and sizes): it is written to the shared folder once, and each pass reads it. ``task_rows``: rows that one task
    should number. An empty input gives an empty result.
    """
    k, p, b, off, sub = "_hs_key", "_hs_place", "_hs_bucket", "_hs_offset", "_hs_step"
    base = cut(rows.withColumns({k: F.coalesce(F.col(quoted(key)).cast("long"), F.lit(NULL_KEY)), p: F.monotonically_increasing_id()}))
    total = base.agg(F.sum(size)).first()[0] or 0
    bounds = [-(-total * s // n_shards) for s in range(1, n_shards)]
    targets = {t: tolerance for t in bounds}
    fine = n_shards * buckets_per_shard
    loose = max(1, total // fine // 2)
    for s in range(1, fine):
        targets.setdefault(total * s // fine, loose)
    found, known = find_splitters(base, k, p, size, targets)
    if not known:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    starts = [found[t] for t in bounds]
    chosen = sorted({x.at: x for x in found.values() if known[0].at < x.at < known[-1].at}.values(), key=lambda x: x.at)
    lows = [known[0], *chosen]
    highs = [*chosen, known[-1]]
    shard_of = [sum(s.at <= x.at for s in starts) for x in lows]
    base_rows = [0, *(s.rows for s in starts)]
    at = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col(b))
    steps = [max(1, -(-(hi.rows - lo.rows) // task_rows)) for lo, hi in zip(lows, highs, strict=True)]
    out = base.withColumn(b, _interval(k, p, [x.at for x in chosen]))
    before = F.lit(0).cast("long")
    if max(steps) > 1:
        last_place = base.agg(F.max(p)).first()[0]
        by_key = [hi.at[0] - lo.at[0] > 1 for lo, hi in zip(lows, highs, strict=True)]
        key_step = [(hi.at[0] + 1 - lo.at[0]) / n for lo, hi, n in zip(lows, highs, steps, strict=True)]
        ends = [hi.at[1] if hi.at[0] == lo.at[0] else last_place + 1 for lo, hi in zip(lows, highs, strict=True)]
        place_step = [(end - lo.at[1]) / n for lo, end, n in zip(lows, ends, steps, strict=True)]
        # doubles round, but keep the order; keys are subtracted as doubles, for they may be far apart
        low_key = at([x.at[0] for x in lows], "double")
        of_key = F.floor((F.col(k).cast("double") - low_key) / at(key_step, "double"))
        # an interval without keys between its ends holds one key, or the end of one and the beginning of the next
        of_place = F.when(F.col(k) > at([x.at[0] for x in lows], "long"), at(steps, "long") + F.floor(F.col(p).cast("double") * at(steps, "long") / F.lit(last_place + 1.0))).otherwise(
            F.floor((F.col(p) - at([x.at[1] for x in lows], "long")) / at(place_step, "double"))
        )
        out = out.withColumn(sub, F.when(at(by_key, "boolean"), of_key).otherwise(of_place).cast("long"))
        ordered = Window.partitionBy(b).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
        counts = out.groupBy(b, sub).agg(F.count("*").alias("_n")).withColumn(off, F.coalesce(F.sum("_n").over(ordered), F.lit(0).cast("long"))).drop("_n")
        out = out.join(counts, [b, sub])
        before = F.col(off)
    else:
        out = out.withColumn(sub, F.lit(0)).repartition(b)
    window = Window.partitionBy(b, sub).orderBy(k, p)
    place = before + F.row_number().over(window).cast("long") - 1
    out = out.withColumn("slot", at([x.rows - base_rows[s] for x, s in zip(lows, shard_of, strict=True)], "long") + place)
    return out.withColumn("shard", at(shard_of, "int")).drop(k, p, b, off, sub).select(*[quoted(c) for c in [*[c for c in rows.columns if c not in ("shard", "slot")], "shard", "slot"]])


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; null text: 1) and text_crc32 (null: that of the empty text)."""
    filled = F.coalesce(F.col(quoted(text)), F.lit(""))
    return docs.select(
        F.col(quoted(doc_id)).alias("doc_id"), (F.octet_length(filled).cast("long") + 1).alias("size"), F.crc32(filled.cast("binary")).alias("text_crc32")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null: a new shard moves ranges of all)."""
    placed = histogram_sort(digest(docs), "doc_id", "size", n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
