"""What the corpus operators share: reading tables, the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local master gets one of its own; a cluster raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sparkcol-checkpoint-"))
    return (configured or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later jobs neither recompute it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove what was written under ``path``, wherever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def quoted(name: str) -> str:
    """A column name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_as_text_crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words_on_white_space(text: Column) -> Column:
    r"""The matches of ``[^\x20\x09-\x0D]+`` in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
