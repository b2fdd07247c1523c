"""Readers and writers of files and in-memory data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | T.StructType | None = None, columns: Sequence[str] | None = None, **options: Any) -> DataFrame:
    """A file source with an explicit schema where the format has none of its own; ``columns`` prunes the scan."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema: inference would read all data twice")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: Any) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def from_rows(spark: SparkSession, rows: Iterable[Sequence[Any]], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def from_arrays(spark: SparkSession, **columns: Sequence[Any]) -> DataFrame:
    """Columns held in memory (lists or numpy arrays of one length) as a DataFrame, through Arrow."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


def append(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same columns, matched by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report table as CSV with a header, or as a Markdown table (a report is small: its rows are gathered in one file)."""
    if fmt == "csv":
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "markdown":
        from pyspark.sql import functions as F

        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
        head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
        spark = rows.sparkSession
        spark.createDataFrame([(head,)], "value string").union(rows.select(line)).coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
