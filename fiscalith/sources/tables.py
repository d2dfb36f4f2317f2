"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Table ``name`` of ``folder``; with ``schema`` the columns are taken by name and typed as given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, in whatever storage it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
