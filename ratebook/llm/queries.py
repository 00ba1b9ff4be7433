"""Queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .hard_negatives import hard_negatives
from .language_id import language_id
from .merkle import merkle_manifest, proof
from .near_dedup import near_duplicates
from .oracles import ORACLES
from .pieces import segment
from .quality_model import quality
from .quality_rules import quality_rules
from .substring_dedup import substring_duplicates
from .token_index import ids_folder, read_ids, write_ids
from .token_rollup import Rollup, deltas, token_counts
from .topk import top_k
from .warc import pages_from, read_archives, write_archives
from .work import staged, work_dir

#: Vocabulary files of public tokenizers (a parameter of the operators; never copied).
TOKENIZERS = os.environ.get("TOKENIZERS_DIR") or os.path.dirname(public_tokenizers.__file__)
BYTE_BPE = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
PIECES = os.path.join(TOKENIZERS, "piece_bpe_32k.model")
END_ID = 2

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir))


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _documents(spark, sf_dir), ids_folder(spark)
    write_ids(docs, folder, BYTE_BPE, END_ID)
    return read_ids(docs, folder, with_ids=False)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two tokenizer versions: without and with the end id.

    Every kind of change takes part: all documents are inserted; exact copies are deleted (the smallest id stays), which is
    committed twice and changes nothing the second time, and inserted again; all documents are inserted under the second
    version with the counts of the first, which are then revised.  All batches are folded at the end."""
    docs = _documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = staged(token_counts(docs, BYTE_BPE, "byte_bpe_50k"), "token-counts")
    first = docs.groupBy(F.xxhash64(text).alias("h1"), F.md5(text).alias("h2")).agg(F.min("doc_id").alias("id"))
    first = staged(first.select("id"), "first-copies")
    copies = counts.join(first, "id", "left_anti")
    draft = counts.withColumn("tokenizer", F.lit("byte_bpe_50k+end"))
    revised = draft.withColumn("tokens", F.col("tokens") + 1)
    rollup = Rollup(spark, work_dir(spark, "token-rollup"))
    rollup.commit("1-insert", deltas(None, counts))
    for _ in range(2):
        rollup.commit("2-delete-copies", deltas(copies, None))
    rollup.commit("3-insert-copies", deltas(None, copies))
    rollup.commit("4-insert-end", deltas(None, draft))
    rollup.commit("5-end-id", deltas(draft, revised))
    rollup.compact()
    return rollup.totals()


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return pages_from(read_archives(archives, folder, with_data=False))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir)).drop("failed_rules")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(_documents(spark, sf_dir), PIECES)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_embeddings(spark, sf_dir).withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle_manifest(_documents(spark, sf_dir), tampered).select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("witness")).alias("proof_sha256"), "folded_root", "verified"
    )


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_token_index": op2_token_index,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_pieces": op10_pieces,
    "op11_topk": op11_topk,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}
