"""Tables and small hand-kept files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def read_parquet_many(
    spark: SparkSession, *paths: str, schema: T.StructType | None = None, base_path: str | None = None
) -> DataFrame:
    """One path, several, or globs.  Give ``schema`` for directories partitioned by an id: inference would
    read ``050760`` as a number."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if base_path is not None:
        reader = reader.option("basePath", base_path)
    return reader.parquet(*paths)


def read_crosswalk(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header, read with the given schema (identifiers as strings, zeros kept)."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)


def require_one(df: DataFrame, condition: Column, what: str):
    """The only row that meets the condition; raises when there is none or more than one."""
    rows = df.filter(condition).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"expected exactly one row for {what}, found {'none' if not rows else 'several'}")
    return rows[0]
