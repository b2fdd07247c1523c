"""Joins. Catalyst and adaptive execution choose the physical strategy from sizes; hints are there for those who know better."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import total as total_of
from .shared import written

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
STRATEGY = {"hash": "shuffle_hash", "merge": "merge"}
#: Bytes up to which a side is broadcast.
MOST_BROADCAST = 64 << 20


def join(probe: DataFrame, build: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", strategy: str = "auto") -> DataFrame:
    """Equi-join on pairs (probe column, build column). Null keys never match. Semi and anti keep probe rows, once each;
    an anti join with an empty build side keeps them all.

    ``strategy``: hash, merge, or auto, which marks a build side for broadcast where that is estimated small and measured runs
    say that it is fastest (``plans.advisor``), and else leaves the choice to adaptive execution. A full join is never marked.
    """
    condition = [probe[a] == build[b] for a, b in on]
    if strategy == "auto":
        build = advised(build) if how not in ("right", "full") else build
    else:
        build = build.hint(STRATEGY[strategy])
    return probe.join(build, condition, HOW[how])


def pair_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], side: int = 4096) -> DataFrame:
    """Inner equi-join on pairs (left column, right column) of few keys that have many rows on both sides. Null keys never match.

    The result has the size it has: all pairs of a key. Of a key with more than ``side`` rows on either side, rows are dealt by a hash of the whole row into
    parts of some ``side`` rows, and each part meets each part of the other side in a cell of its own. So no task has more than a few
    cells of ``side`` * ``side`` pairs, and what is shuffled is 2 / ``side`` of the result. Such keys are counted first (both sides are read twice more) and broadcast:
    a 4096th of the rows at most. Rows that are equal in all columns stay in one part.
    """
    keys, sides = [f"_k{i}" for i in range(len(on))], []
    for i, (df, mine) in enumerate(((left, [a for a, _ in on]), (right, [b for _, b in on]))):
        columns = [F.col(f"`{c}`").alias(f"_{i}_{j}") for j, c in enumerate(df.columns)]
        sides.append(df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in mine)).select(*columns, *[F.col(c).alias(k) for c, k in zip(mine, keys, strict=True)]))
    counted = sides[0].select(*keys, F.lit(1).alias("_n"), F.lit(0).alias("_m")).union(sides[1].select(*keys, F.lit(0), F.lit(1))).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / side)).cast("int")
    large = counted.where((F.col("_n") > side) | (F.col("_m") > side)).select(*keys, parts("_n").alias("_p0"), parts("_m").alias("_p1"))
    cells = large.agg(F.sum(F.col("_p0").cast("long") * F.col("_p1"))).first()[0]
    if not cells:
        return join(left, right, on)
    n_tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, 1 << 15))
    dealt = []
    for i, rows in enumerate(sides):
        known = rows.join(F.broadcast(large), keys, "left")
        own = F.pmod(F.xxhash64(*rows.columns), F.coalesce(f"_p{i}", F.lit(1))).cast("int").alias(f"_c{i}")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(f"_p{1 - i}", F.lit(1)) - 1)).alias(f"_c{1 - i}")
        dealt.append(known.select(*rows.columns, own, other).repartition(n_tasks, *keys, "_c0", "_c1"))
    pairs = dealt[0].join(dealt[1].hint(STRATEGY["hash"]), [*keys, "_c0", "_c1"])
    return pairs.select(*[F.col(f"_{i}_{j}").alias(c) for i, df in enumerate((left, right)) for j, c in enumerate(df.columns)])


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; without statistics a large number."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def advised(build: DataFrame, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """``build``, marked for broadcast if measured runs say so for its estimated size, and that is within the bound."""
    from ..plans import advisor

    size = estimated_bytes(build)
    return F.broadcast(build) if size <= most_bytes and advisor.fastest("join", size / 2**20) == "broadcast_hash" else build


def bounded_broadcast(df: DataFrame, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if the optimizer's estimate of its size is within the bound, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= most_bytes else df


def not_in(probe: DataFrame, build: DataFrame, column: str, key: str) -> DataFrame:
    """``column NOT IN (SELECT key FROM build)`` with SQL's nulls: a null in ``build`` lets nothing through, and a null in ``column``
    passes only if ``build`` is empty.

    One aggregation counts rows and keys of ``build``; the rest is an anti-join on equal keys, each of which is brought once: few keys
    in many rows would all go to the tasks of these keys.
    """
    n_rows, n_keys = build.agg(F.count("*")).scalar(), build.agg(F.count(key)).scalar()
    anti = probe.join(build.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct(), F.col(column) == F.col("_k"), "left_anti")
    return anti.where((n_rows == 0) | ((n_rows == n_keys) & F.col(column).isNotNull()))


def bloom_join(probe: DataFrame, build: DataFrame, on: tuple[str, str], false_positives: float = 0.03, most_bits: int = 1 << 26) -> DataFrame:
    """Inner join behind a bloom filter of the build keys, which drops probe rows before they are shuffled.

    The filter is made by one aggregation of ``build`` (read twice, so it should be selective or stored) and has up to ``most_bits`` bits
    (8 MB); beyond that it lets more rows through, which the join then drops. Keys are longs, ints or strings. A null key never matches.
    """
    spark = probe.sparkSession
    keyed = build.where(F.col(on[1]).isNotNull())
    n = keyed.count()
    if not n:
        return probe.join(build, probe[on[0]] == build[on[1]])
    bits = min(most_bits, max(64, int(-n * math.log(false_positives) / math.log(2) ** 2)))
    jvm, keys = spark._jvm, keyed.select(F.xxhash64(on[1]).alias("h"))
    made = keys._jdf.stat().bloomFilter("h", max(1, int(bits * math.log(2) ** 2 / -math.log(false_positives))), bits)
    stream = jvm.java.io.ByteArrayOutputStream()
    made.writeTo(stream)
    expressions, utils = jvm.org.apache.spark.sql.catalyst.expressions, getattr(jvm.org.apache.spark.sql.classic, "ExpressionUtils")
    literal = expressions.Literal.create(stream.toByteArray(), jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    within = utils.column(expressions.BloomFilterMightContain(literal, utils.expression(F.xxhash64(probe[on[0]])._jc)))
    return probe.where(Column(within)).join(build, probe[on[0]] == build[on[1]])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at <= high, as an equi-join on buckets of ``width``: a range goes to each bucket that it touches.

    Choose ``width`` near the usual length of a range; longer ranges are exact too, only in more buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("_b", bucket(at)).join(spread, "_b").where(F.col(at).between(F.col(low), F.col(high))).drop("_b")


def inequality_join(left: DataFrame, right: DataFrame, a: str, op: str, b: str, buckets: int = 64) -> DataFrame:
    """Pairs with a op b, of numbers. A right side within the bound of a broadcast, such as a table of bands, meets each left row in a loop.

    A larger one is cut into ``buckets`` ranges of b: a left row goes to the ranges that can match, an equi-join, in which only
    its own range has rows to drop. The result has the size it has: up to all pairs.
    """
    from .filters import COMPARE

    condition = COMPARE[op](F.col(a), F.col(b))
    if estimated_bytes(right) <= MOST_BROADCAST:
        return left.join(F.broadcast(right), condition)
    cuts = sorted(set(right.approxQuantile(b, [i / buckets for i in range(1, buckets)], 0.001)))
    place = lambda c: sum((F.when(F.col(c) >= x, 1).otherwise(0) for x in cuts), F.lit(0))
    reach = F.sequence(place(a), F.lit(len(cuts))) if op in ("lt", "le") else F.sequence(F.lit(0), place(a))
    spread = left.where(F.col(a).isNotNull()).withColumn("_r", F.explode(reach))
    return spread.join(right.where(F.col(b).isNotNull()).withColumn("_r", place(b)), "_r").where(condition).drop("_r")


def inequality_counts(left: DataFrame, right: DataFrame, a: str, op: str, b: str, out: str = "n") -> DataFrame:
    """Each row of ``left`` with the number of rows of ``right`` with a op b, without making the pairs.

    Distinct values of both sides are dealt by ranges and written once; counts run inside each range, and the ranges' totals, of
    which there are as many as tasks, are added up and joined back.
    """
    values = right.groupBy(F.col(b).alias("v")).agg(F.count("*").alias("c")).where("v IS NOT NULL")
    asked = left.select(F.col(a).alias("v")).where("v IS NOT NULL").distinct().withColumn("c", F.lit(0).cast("long"))
    ranged = values.union(asked).groupBy("v").agg(F.sum("c").alias("c")).repartitionByRange("v")
    both = written(ranged.withColumn("_part", F.spark_partition_id()))
    inside = F.sum("c").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    totals = both.groupBy("_part").agg(F.sum("c").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = totals.select("_part", before.alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("_all"))  # a row per task
    placed = both.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    running, total = F.col("_before") + F.col("_inside"), F.col("_all")
    n = {"gt": running - F.col("c"), "ge": running, "lt": total - running, "le": total - running + F.col("c")}[op]
    counted = placed.select("v", n.alias(out))
    return left.join(counted, left[a] == counted["v"], "left").drop("v").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def join_group_sum(fact: DataFrame, dim: DataFrame, on: tuple[str, str], keys: Sequence[str], value: Column, out: str = "total", scale: int | None = None) -> DataFrame:
    return fact.join(dim, fact[on[0]] == dim[on[1]]).groupBy(*keys).agg(total_of(value, scale).alias(out))


def multi_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """``fact`` joined to each (dimension, fact column, dimension column) in turn."""
    for dim, a, b in dims:
        fact = fact.join(dim, F.col(a) == dim[b])
    return fact


def outer_join_aggregate(left: DataFrame, right: DataFrame, on: tuple[str, str], value: str | None = None, scale: int | None = None) -> DataFrame:
    """Each left row with the count (and sum of ``value``) of its right rows, 0 where there are none. The right side is
    aggregated before the join, so its rows never multiply."""
    aggregates = [F.count("*").alias("n")] + ([total_of(F.col(value), scale).alias("total")] if value else [])
    counted = right.groupBy(F.col(on[1]).alias("_k")).agg(*aggregates)
    out = left.join(counted, left[on[0]] == F.col("_k"), "left").drop("_k").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("total", F.coalesce("total", F.lit(0).cast(counted.schema["total"].dataType))) if value else out


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the latest right row of its keys at or before it: a union and one window, no pairs."""
    window = Window.partitionBy(*by).orderBy(F.col("_t"), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    payload = F.struct(*left.columns)
    a = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), payload.alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*by, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    both = a.union(b).withColumn("_v", F.last("_v", ignorenulls=True).over(window)).where("_side = 1")
    return both.select("_row.*", F.col("_v").alias(f"{value}_as_of"))


def hashes(df: DataFrame, column: str) -> DataFrame:
    """Hash values of a key: 32-bit Murmur3 and 64-bit XXH64."""
    return df.select(column, F.hash(column).alias("h32"), F.xxhash64(column).alias("h64"))
