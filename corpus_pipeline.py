"""From raw documents to piece ids: quality, near duplicates, repeated passages, benchmark passages, encoding.

Each stage gets the documents that the one before it kept, as a written table.  All but the last return the columns of
``documents``; texts that lose passages are returned without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratebook.llm.decontaminate import drop_contaminated
from ratebook.llm.near_dedup import drop_near_duplicates
from ratebook.llm.pieces import segment
from ratebook.llm.quality_model import keep_quality
from ratebook.llm.queries import PIECES
from ratebook.llm.substring_dedup import remove_substrings
from ratebook.llm.work import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; it learns from the rated documents among them."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return drop_near_duplicates(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; documents of which nothing is left are dropped."""
    return remove_substrings(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the texts, with the next best segmentations."""
    return segment(docs, PIECES)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: A trained classifier and a similarity join over minwise tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return staged(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
