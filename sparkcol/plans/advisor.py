"""Strategies learned from measured runs, and a catalogue of runs that is kept in tables.

A run of a strategy is (operation, strategy, mb, seconds): how long it took with so many MB on its decisive side. The runs of a
strategy make a straight line by least squares, and of several strategies the one whose line is lowest at the size in question is
advised; ``joins.join`` asks for a join's build side. Lines come from ``MEASURED``, or from runs of one's own by ``measure_joins``.

Of queries that are run again and again, in several versions, the mean time is taken with its 95 % interval: a version is settled
if that is narrow, and the best one is that whose interval ends lowest.
"""

from __future__ import annotations

import statistics
import time
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sketch

RUNS = "operation string, strategy string, mb double, seconds double"
#: Runs of ``measure_joins`` on eight threads of one machine: MB of the build side, seconds with two million probe rows.
MEASURED: list[tuple[str, str, float, float]] = [
    ("join", "broadcast_hash", 0.61, 0.1164), ("join", "shuffled_hash", 0.61, 0.2207), ("join", "sort_merge", 0.61, 0.2882),
    ("join", "broadcast_hash", 18.311, 0.3217), ("join", "shuffled_hash", 18.311, 0.3291), ("join", "sort_merge", 18.311, 0.2844),
    ("join", "broadcast_hash", 61.035, 0.697), ("join", "shuffled_hash", 61.035, 0.381), ("join", "sort_merge", 61.035, 0.3789),
    ("join", "broadcast_hash", 183.105, 1.7967), ("join", "shuffled_hash", 183.105, 0.5099), ("join", "sort_merge", 183.105, 0.5159),
]
SAMPLES = "query string, version string, ms double, n_rows long, at timestamp"
#: Half the width of a 95 % interval of a normal variable, in standard deviations.
Z95 = 1.96


def measured(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEASURED, RUNS)


def fit(runs: DataFrame) -> DataFrame:
    """(operation, strategy, n, fixed, per_mb): the line of each strategy. Runs at one size give their mean and no slope; a line never
    falls with the size."""
    lines = runs.groupBy("operation", "strategy").agg(
        F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.regr_intercept("seconds", "mb").alias("a"), F.regr_slope("seconds", "mb").alias("b")
    )
    rises = F.coalesce(F.col("b") > 0, F.lit(False))
    return lines.select("operation", "strategy", "n", F.when(rises, F.col("a")).otherwise(F.col("mean")).alias("fixed"), F.when(rises, F.col("b")).otherwise(0.0).alias("per_mb"))


def choose(lines: DataFrame, mb: float) -> DataFrame:
    """Per operation the strategy with the least expected seconds at the size; ties by name."""
    expected = F.greatest(F.lit(0.0), F.col("fixed") + F.col("per_mb") * F.lit(float(mb)))
    best = lines.groupBy("operation").agg(F.min(F.struct(expected.alias("seconds"), "strategy")).alias("s"))
    return best.select("operation", "s.strategy", "s.seconds")


@cache
def _lines(operation: str) -> dict[str, tuple[float, float]]:
    out = {}
    for strategy in {s for o, s, _, _ in MEASURED if o == operation}:
        at, took = zip(*[(mb, sec) for o, s, mb, sec in MEASURED if (o, s) == (operation, strategy)], strict=True)
        slope, fixed = statistics.linear_regression(at, took) if len(set(at)) > 1 else (0.0, 0.0)
        out[strategy] = (fixed, slope) if slope > 0 else (statistics.fmean(took), 0.0)
    return out


def fastest(operation: str, mb: float) -> str | None:
    """What ``choose`` says of the measured runs, without a Spark job; None for an operation that wasn't measured."""
    lines = _lines(operation)
    return min(lines, key=lambda s: (max(0.0, lines[s][0] + lines[s][1] * mb), s)) if lines else None


def measure_joins(spark: SparkSession, build_rows: tuple[int, ...] = (10_000, 300_000, 1_000_000, 3_000_000), probe_rows: int = 2_000_000, tries: int = 3) -> DataFrame:
    """Runs of broadcast, shuffled hash and sort-merge joins over generated keys, the best of ``tries`` each."""
    runs = []
    probe = spark.range(probe_rows).select(F.pmod(F.xxhash64("id"), F.lit(max(build_rows))).alias("k"), "id")
    for n in build_rows:
        build = spark.range(n).select(F.col("id").alias("k"), F.sha1(F.col("id").cast("string")).alias("v"))
        for strategy, hint in (("broadcast_hash", "broadcast"), ("shuffled_hash", "shuffle_hash"), ("sort_merge", "merge")):
            took = []
            for _ in range(tries):
                began = time.perf_counter()
                probe.join(build.hint(hint), "k").write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            runs.append(("join", strategy, round(n * 64 / 2**20, 3), round(min(took), 4)))
    return spark.createDataFrame(runs, RUNS)


def steadiness(samples: DataFrame) -> DataFrame:
    """Of samples (query, version, ms): n, mean, the half width of its 95 % interval, and whether that is within a tenth of the
    mean. A single sample has no interval and is never settled."""
    found = samples.groupBy("query", "version").agg(F.count("ms").alias("n"), F.avg("ms").alias("mean_ms"), F.stddev_samp("ms").alias("sd"))
    half = F.lit(Z95) * F.col("sd") / F.sqrt("n")
    return found.select("query", "version", "n", "mean_ms", half.alias("half_ms"), F.coalesce(half <= 0.1 * F.col("mean_ms"), F.lit(False)).alias("settled"))


def best_versions(samples: DataFrame) -> DataFrame:
    """Per query the version whose interval ends lowest, among those with an interval; ties by name."""
    known = steadiness(samples).where("half_ms IS NOT NULL").withColumn("worst_ms", F.col("mean_ms") + F.col("half_ms"))
    best = known.groupBy("query").agg(F.min(F.struct("worst_ms", "version", "mean_ms")).alias("s"))
    return best.select("query", "s.version", "s.mean_ms", "s.worst_ms")


class Catalog:
    """Operators, samples of queries, their statistics and their time buckets, kept as four tables under a folder.

    ``operators`` (operation, strategy, fixed, per_mb), ``metrics`` (the samples), ``query_stats`` (n, mean, least, greatest and deviation
    by query and version) and ``sketch_buckets`` (levels 1 to 3 by query and version; level 0 lives as long as the samples).
    """

    TABLES = ("operators", "metrics", "query_stats", "sketch_buckets")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, samples: DataFrame) -> None:
        """Append samples (query, version, ms, n_rows, at)."""
        samples.select("query", "version", "ms", "n_rows", "at").write.mode("append").parquet(f"{self.path}/metrics")

    def save(self, runs: DataFrame) -> None:
        """Make the other tables anew, from runs of strategies and from all samples."""
        samples = self.table("metrics")
        fit(runs).select("operation", "strategy", "fixed", "per_mb").write.mode("overwrite").parquet(f"{self.path}/operators")
        stats = samples.groupBy("query", "version").agg(
            F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("least_ms"), F.max("ms").alias("greatest_ms"), F.stddev_pop("ms").alias("deviation_ms")
        )
        stats.write.mode("overwrite").parquet(f"{self.path}/query_stats")
        keys = ("query", "version")
        level = sketch.buckets(samples, 1, "at", "ms", keys)
        for number in (1, 2, 3):
            level = level if number == 1 else sketch.merge(level, number, keys)
            level.withColumn("level", F.lit(number)).write.mode("overwrite" if number == 1 else "append").parquet(f"{self.path}/sketch_buckets")

    def table(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise ValueError(f"no table {name!r}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def restore(self) -> dict[str, DataFrame]:
        """All four tables, as temporary views catalog_<name> too."""
        found = {name: self.table(name) for name in self.TABLES}
        for name, df in found.items():
            df.createOrReplaceTempView(f"catalog_{name}")
        return found
