"""Writers and batch bookkeeping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, below the shared folder the cluster names in
    ``spark.checkpoint.dir``; a temporary one only where none is set (local runs, tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="ratebook-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a work folder and read it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("facility_id",), mode: str = "overwrite") -> None:
    """Directory per key.  The rebalance hint brings a key's rows together but lets adaptive execution split
    a key that is too large for one task.

    Tasks move their files into place as they end (Hadoop's committer 2): with committer 1 the driver moves the files of
    all keys one by one behind the last task.  Readers must wait for the end of the job."""
    writer = df.hint("rebalance", *by).write.mode(mode).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(*by).parquet(path)


#: Column of the part a row goes to.
_PART = "_export_part"
#: Where this is set, a union of tables of one partition each has one partition.
_UNION = "spark.sql.unionOutputPartitioning"


def export_single(df: DataFrame, path: str, parts: int = 1, mode: str = "overwrite") -> int:
    """Write exactly ``parts`` part files for hand-off (one by default); returns their number.

    Only the last step runs in so few tasks, as a file is written by one task.  The rows are first written by all tasks, each
    dealing its rows to the parts, so that the task of a part reads compressed columns and not shuffled rows.  A large table
    needs as many parts as the receiver can take.
    """
    dealt, spark = work_dir(df.sparkSession, "export-parts"), df.sparkSession
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))  # 0, 1, ... in each task
    number = F.pmod(F.spark_partition_id() + in_task, F.lit(parts)).cast("int")
    df.withColumn(_PART, number).write.option("compression", "zstd").partitionBy(_PART).parquet(dealt)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_PART, T.IntegerType())])).parquet(dealt)
    each = [rows.filter(F.col(_PART) == i).drop(_PART).coalesce(1) for i in range(parts)]
    before = spark.conf.get(_UNION, None)
    spark.conf.set(_UNION, "false")
    try:
        reduce(DataFrame.unionAll, each).write.mode(mode).parquet(path)
    finally:
        spark.conf.unset(_UNION) if before is None else spark.conf.set(_UNION, before)
    return parts


def write_table(
    df: DataFrame,
    name: str,
    *,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
    path: str | None = None,
) -> tuple[int, int]:
    """Replace a table; returns its (rows, columns).

    ``cluster_by`` range-partitions and sorts on the keys, so that readers skip row groups; a hash of the whole
    row is the last range key, which lets one very frequent key combination spread over several files.
    """
    out = df
    if cluster_by:
        out = out.repartitionByRange(*cluster_by, F.xxhash64(*df.columns)).sortWithinPartitions(*cluster_by)
    elif partition_by:
        out = out.hint("rebalance", *partition_by)
    writer = out.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name).count(), len(df.columns)


def load_dimension(df: DataFrame, name: str, schema: T.StructType, path: str | None = None) -> tuple[int, int]:
    """Replace a small table, cast to ``schema`` (identifiers stay strings)."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return write_table(typed, name, path=path)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def write_review_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def pending_work(manifest: DataFrame, loaded: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Manifest rows whose key is not loaded yet; all of them with ``force``."""
    return manifest if force else manifest.join(loaded.select(*keys), list(keys), "left_anti")


def batch_status(
    manifest: DataFrame, rows: DataFrame, keys: Sequence[str], error: Column | None = None
) -> DataFrame:
    """Manifest keys with ``status`` success/failed, ``rows`` and ``error``.

    ``error`` is an expression on ``rows`` that is NULL for good rows.  A location without rows has failed.
    """
    error = F.lit(None).cast("string") if error is None else error
    seen = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(error).alias("bad_rows"), F.min(error).alias("error")
    )
    status = F.when((F.col("rows") > 0) & (F.col("bad_rows") == 0), "success").otherwise("failed")
    return (
        manifest.select(*keys)
        .join(seen, list(keys), "left")
        .withColumns({"rows": F.coalesce("rows", F.lit(0)), "bad_rows": F.coalesce("bad_rows", F.lit(0))})
        .withColumn("status", status)
        .withColumn("error", F.when(F.col("rows") == 0, "no rows").otherwise(F.col("error")))
        .select(*keys, "status", "rows", "bad_rows", "error")
    )
