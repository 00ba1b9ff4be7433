"""Connected components of links, as a loop of joins: nothing of the graph is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import staged

MAX_ROUNDS = 60
#: So many links (16 bytes each) fit one task easily, which finds their components without rounds of joins.
FEW = 200_000


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of all links of a partition: every id to the smallest one it is linked with."""
    table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    ids, place = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    a, b = place[: len(table)], place[len(table) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root[a] == root[b]).all():
            break
    other = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[other], pa.int64()), pa.array(ids[root[other]], pa.int64())], names=["a", "b"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether each larger id of (a, b) has one smaller id, which itself has none."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    met = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _stars_of(edges: DataFrame) -> DataFrame:
    for _ in range(MAX_ROUNDS):
        if _stars(edges):
            break
        both = _both(edges)
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    return edges


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(id, comp) for each id in ``edges`` (a, b): comp is the smallest id that can be reached.

    Each round links every id's larger neighbours, then its smaller ones, to its smallest neighbour, until all
    components are stars around their smallest id; at most FEW links are settled by one task instead.
    Empty edges give an empty table; links of an id to itself and repeated links don't matter.
    """
    edges = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    if edges.count() <= few:
        edges = staged(edges.coalesce(1).mapInArrow(_at_once, "a long, b long"), "links")
    else:
        edges = _stars_of(edges)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    )
