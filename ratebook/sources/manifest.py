"""Manifests published as text: ``key: value`` lines, one block of keys per location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import MANIFEST_KEYS
from ..functions.text import BLANKS


def read_manifest_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``source_file, line_number, line`` of manifest files (small text files)."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_number", "line"),
    )


def segment_records(
    df: DataFrame, keys: Sequence[str], order: str, is_start: Column, into: str = "record_number", chunk: int = 100_000
) -> DataFrame:
    """Number consecutive rows by how many start rows precede or are them, per ``keys`` in ``order``.

    ``order`` is a whole number.  The count runs inside chunks of ``chunk`` order values and is carried over
    the chunks, so a key with very many rows is not one task's work.
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_start", is_start.cast("long"))
    per_chunk = df.groupBy(*keys, "_chunk").agg(F.sum("_start").alias("_n"))
    carried = F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk")) - F.col("_n")
    per_chunk = per_chunk.withColumn("_before", carried).drop("_n")
    here = F.sum("_start").over(W.partitionBy(*keys, "_chunk").orderBy(order))
    return (
        df.join(per_chunk, [*keys, "_chunk"])
        .withColumn(into, F.col("_before") + here)
        .drop("_chunk", "_start", "_before")
    )


def parse_kv_manifest(
    lines: DataFrame,
    keys: Sequence[str] = MANIFEST_KEYS,
    *,
    file: str = "source_file",
    order: str = "line_number",
    line: str = "line",
) -> DataFrame:
    """One row per entry: ``file, record_number`` and one column per key (dashes become underscores).

    The first key opens an entry.  Lines without a colon and unknown keys are ignored; the value is all
    behind the first colon; of a repeated key in one entry the last line counts.
    """
    text = F.btrim(F.col(line), F.lit(BLANKS))
    pairs = (
        lines.withColumn("_text", text)
        .filter(F.contains("_text", F.lit(":")))
        .withColumn("_key", F.btrim(F.substring_index("_text", ":", 1), F.lit(BLANKS)))
        .filter(F.col("_key").isin(*keys))
        .withColumn(
            "_value", F.btrim(F.substr("_text", F.locate(":", F.col("_text")) + F.lit(1)), F.lit(BLANKS))
        )
    )
    starts = F.col("_key") == keys[0]
    entries = segment_records(pairs, [file], order, starts)
    return entries.groupBy(file, "record_number").agg(
        *[
            F.max_by(F.when(F.col("_key") == k, F.col("_value")), F.when(F.col("_key") == k, F.col(order))).alias(
                k.replace("-", "_")
            )
            for k in keys
        ]
    )
