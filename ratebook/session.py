"""Session settings the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # adaptive execution picks broadcast sides from measured sizes and splits hot partitions of joins
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, memory: str = "16g", partitions: int | None = None) -> SparkSession:
    """Session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ratebook")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
