"""Exact top-k search by distributed histogram selection.

Every vector is scored against every query, tile by tile.  The k-th score of each query lies in a known range that is cut
into 2**BITS buckets; a histogram of all scores says in which bucket it lies, which is the next range, until a bucket is
one value.  Then the scores above that value, and as many equal ones as are wanted, are the result.

A tile reports its histogram from the top down to the bucket that holds the k-th of its own scores: the k-th of all
scores is never below that.  Scores are not kept between rounds, which would cost more than to multiply again.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import Tile, integer_vectors, meet, packed, records, same_width, tiles_of
from .work import by_batch, staged

K, SCALE, BITS = 5, 256, 10
#: Queries of a tile, and of those the ones whose scores are in memory at once.
QUERIES, AT_ONCE = 1024, 64
COUNTS = "tile long, at int, bucket int, n long"
FOUND = "tile long, at int, query_id long, vec_id long, score long"


def scores(queries: np.ndarray, vectors: np.ndarray, bound: int) -> np.ndarray:
    """Exact integer inner products; in doubles, which are faster, where every partial sum is below 2**53."""
    a, b = same_width(queries, vectors)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def histograms(queries: Tile, tile: Tile, low: np.ndarray, need: np.ndarray, shift: int, bits: int, bound: int) -> list[np.ndarray]:
    """(at, bucket, n) of the scores in the range of each query, from the top until ``need`` of them are counted."""
    width = 1 << bits
    out: list[list[np.ndarray]] = [[], [], []]
    for first in range(0, len(queries.ids), AT_ONCE):
        own = slice(first, first + AT_ONCE)
        bucket = (scores(queries.matrix[own], tile.matrix, bound) - low[own, None]) >> shift
        bucket[(bucket < 0) | (bucket >= width) | tile.own(queries.ids[own])] = width
        rows = len(bucket)
        flat = (bucket + np.arange(rows)[:, None] * (width + 1)).ravel()
        count = np.bincount(flat, minlength=rows * (width + 1)).reshape(rows, width + 1)[:, :width]
        above = np.cumsum(count[:, ::-1], 1)[:, ::-1] - count
        at, hit = np.nonzero((count > 0) & (above < need[own, None]))
        for part, x in zip(out, (at + first, hit, count[at, hit]), strict=True):
            part.append(x)
    return [np.concatenate(x) for x in out]


def selected(queries: Tile, tile: Tile, kth: np.ndarray, need: np.ndarray, bound: int) -> list[np.ndarray]:
    """(at, query_id, vec_id, score) of scores above the k-th, and of equal ones the ``need`` of smallest id."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for first in range(0, len(queries.ids), AT_ONCE):
        own = slice(first, first + AT_ONCE)
        score = scores(queries.matrix[own], tile.matrix, bound)
        other = ~tile.own(queries.ids[own])
        equal = (score == kth[own, None]) & other
        equal &= np.cumsum(equal, 1) <= need[own, None]  # ids are in order
        at, hit = np.nonzero(((score > kth[own, None]) & other) | equal)
        for part, x in zip(out, (at + first, queries.ids[own][at], tile.ids[hit], score[at, hit]), strict=True):
            part.append(x)
    return [np.concatenate(x) for x in out]


def _state(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, need) of the queries of a row."""
    state = batch.column("l_state")[k].values
    return state.field("low").to_numpy(), state.field("need").to_numpy()


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = K,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
    bits: int = BITS,
    rows: tuple[int, int] | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each row for which ``queries`` holds
    with all rows but those of its own id; ties go to the smaller id.  With fewer rows there are fewer results.

    Null ids and vectors that are null, hold a null or non-finite component or are longer than the tiles allow take no
    part.  Missing components of a shorter vector count as 0, so an empty vector scores 0 with all.  Repeated rows are
    rows of their own, as results and as queries.  Other columns are not looked at.
    """
    tile_rows, query_rows = rows or (None, None)
    whole = integer_vectors(vectors.withColumn("_query", queries), id_column, vector_column, scale, "_query")
    tiles = packed(whole, "candidates", rows=tile_rows) if tile_rows else packed(whole, "candidates")
    blocks = packed(whole.filter("_query"), "queries", rows=query_rows or QUERIES)
    sizes = blocks.count(), tiles.count()
    longest = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c))
    most = whole.agg(longest.alias("all"), F.max(F.when(F.col("_query"), F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c))).alias("of")).first()
    bound = isqrt((most["all"] or 0) * (most["of"] or 0)) + 1
    rounds = -(-(2 * bound).bit_length() // bits)

    # each query's range starts at ``low``; ``need`` more scores are wanted from it
    count = F.floor(F.length("ids") / 8).cast("int")
    at = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))
    state = blocks.select("tile", at.alias("at")).withColumns(
        {"low": F.lit(-bound).cast("long"), "need": F.lit(k).cast("long"), "short": F.lit(False)}
    )

    def pairs() -> DataFrame:
        listed = state.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", "low", "need"))).alias("state"))
        return meet(blocks.join(listed, "tile"), tiles, sizes)

    for step in range(rounds):
        shift = bits * (rounds - 1 - step)

        def count_scores(batch: pa.RecordBatch, shift: int = shift) -> Iterator[pa.RecordBatch]:
            for i, (q, t) in enumerate(zip(tiles_of(batch, "l_"), tiles_of(batch, "r_"), strict=True)):
                found = histograms(q, t, *_state(batch, i), shift, bits, bound)
                yield records(COUNTS, [np.full(len(found[0]), batch.column("l_tile")[i].as_py()), *found])

        counted = by_batch(pairs(), count_scores, COUNTS).groupBy("tile", "at", "bucket").agg(F.sum("n").alias("n"))
        over = F.sum("n").over(Window.partitionBy("tile", "at").orderBy(F.desc("bucket"))) - F.col("n")
        reached = counted.withColumn("over", over).join(state, ["tile", "at"]).filter("over < need and over + n >= need")
        found = reached.select("tile", "at", "bucket", "over")
        # a query with fewer rows than it wants takes them all
        short = F.col("short") | F.col("bucket").isNull()
        next_low = F.when(short, F.lit(-bound).cast("long")).otherwise(F.col("low") + F.shiftleft(F.col("bucket").cast("long"), shift))
        state = staged(
            state.join(found, ["tile", "at"], "left").select(
                "tile", "at", next_low.alias("low"), F.when(short, F.lit(k).cast("long")).otherwise(F.col("need") - F.col("over")).alias("need"), short.alias("short")
            ),
            "ranges",
        )

    def select(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, (q, t) in enumerate(zip(tiles_of(batch, "l_"), tiles_of(batch, "r_"), strict=True)):
            found = selected(q, t, *_state(batch, i), bound)
            yield records(FOUND, [np.full(len(found[0]), batch.column("l_tile")[i].as_py()), *found])

    best = Window.partitionBy("tile", "at").orderBy(F.desc("score"), "vec_id")
    ranked = by_batch(pairs(), select, FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
