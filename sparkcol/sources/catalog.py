"""Tables of a data folder, as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TABLES = (*TPCH, "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The data has no partsupp; this is what both engines derive it with.
PARTSUPP = (
    "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS ps_availqty, "
    "ROUND(MIN(l_extendedprice) / 100, 4) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey"
)


#: Schemas of tables that were read before, by path and state, so that footers aren't read again for each query.
_SCHEMAS: dict[tuple[str, int, int], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with the schema known from an earlier reading if its file or folder hasn't changed since."""
    path = f"{sf_dir}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    state = path, status.getModificationTime(), status.getLen()
    if state not in _SCHEMAS:
        _SCHEMAS[state] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[state]).parquet(path)


def load_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TPCH, views: bool = True) -> dict[str, DataFrame]:
    """The named tables; with ``views`` also as temporary views of the same names. Nothing is read before it is used."""
    found = {name: table(spark, sf_dir, name) for name in names}
    if views:
        for name, df in found.items():
            df.createOrReplaceTempView(name)
    return found


def sql(spark: SparkSession, sf_dir: str, text: str, names: tuple[str, ...] = TPCH) -> DataFrame:
    """``text`` over views of the tables of ``sf_dir``."""
    load_tables(spark, sf_dir, names)
    return spark.sql(text)
