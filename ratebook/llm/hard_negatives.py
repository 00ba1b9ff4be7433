"""Hard negatives: exact scores by Strassen's multiplication, positives and windows of scores kept in small heaps.

Anchors and candidates are int64 tiles.  A product of two tiles is split into halves of rows, components and columns and
takes seven products instead of eight, down to LEAF; odd sizes are padded with zeros.  All sums are of 64-bit integers;
where one of Strassen's own sums overflows, it does so modulo 2**64, and the inner products themselves fit.

One round keeps each anchor's best rows of its label, a second one the best rows of other labels in the window of each
positive.  A tile keeps as many as are wanted, and those of several tiles merge into as many again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import Tile, integer_vectors, meet, packed, records, same_width, tiles_of
from .work import by_batch, staged

SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 3, (50, 95)
#: Anchors of a tile, and of those the ones whose scores are in memory at once.
ANCHORS, AT_ONCE = 1024, 256
#: Matrices with a side of this or less are multiplied directly.
LEAF = 16
POSITIVE = "tile long, at int, anchor_id long, positive_id long, positive_score long"
NEGATIVE = "tile long, at int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices of any size."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _blocks(anchors: Tile, tile: Tile) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of some anchors at a time."""
    a, b = same_width(anchors.matrix, tile.matrix)
    for first in range(0, len(anchors.ids), AT_ONCE):
        own = slice(first, first + AT_ONCE)
        yield own, strassen(a[own], np.ascontiguousarray(b.T))


def heap(score: np.ndarray, may: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``n`` highest scores of each row where ``may`` holds; of equal ones those of the first columns.
    ``score`` is below 2**62."""
    rest = np.where(may, score, np.iinfo(np.int64).min)
    line = np.arange(len(rest))
    rows, columns = [], []
    for _ in range(min(n, rest.shape[1])):
        best = rest.argmax(1)
        there = rest[line, best] > np.iinfo(np.int64).min
        if not there.any():
            break
        rows.append(line[there])
        columns.append(best[there])
        rest[line, best] = np.iinfo(np.int64).min
    if not rows:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(rows), np.concatenate(columns)


def _joined(parts: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    return [np.concatenate([x[k] for x in parts]) if parts else np.empty(0, np.int64) for k in range(width)]


def positives(anchors: Tile, tile: Tile, n: int) -> list[np.ndarray]:
    """(at, anchor_id, positive_id, positive_score): each anchor's best rows of its label in the tile."""
    parts = []
    for own, score in _blocks(anchors, tile):
        may = (tile.other[None, :] == anchors.other[own, None]) & ~tile.own(anchors.ids[own])
        at, hit = heap(score, may, n)
        parts.append([at + own.start, anchors.ids[own][at], tile.ids[hit], score[at, hit]])
    return _joined(parts, 4)


def negatives(anchors: Tile, tile: Tile, wanted: list[np.ndarray], n: int, window: tuple[int, int]) -> list[np.ndarray]:
    """Columns of NEGATIVE but the tile: for each positive (at, place, positive_id, positive_score) the anchor's best rows
    of other labels whose score is in the positive's window."""
    at, place, positive_id, positive_score = wanted
    parts = []
    for own, score in _blocks(anchors, tile):
        differs = tile.other[None, :] != anchors.other[own, None]
        mine = np.flatnonzero((at >= own.start) & (at < own.stop))
        for p in np.unique(place[mine]):
            some = mine[place[mine] == p]
            row, s = at[some] - own.start, positive_score[some, None]
            low, high = -((-window[0] * s) // 100), (window[1] * s) // 100
            near = score[row]
            k, hit = heap(near, differs[row] & (near >= low) & (near <= high), n)
            one = some[k]
            parts.append([at[one], place[one], anchors.ids[at[one]], positive_id[one], positive_score[one], tile.ids[hit], near[k, hit]])
    return _joined(parts, 7)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    positives_wanted: int = POSITIVES,
    negatives_wanted: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: int = SCALE,
    rows: tuple[int, int] | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row for which ``anchors``
    holds: its best other rows of the same (whole-number) label are its positives; for each of them the best rows of other
    labels whose score is between ``window`` per cent of the positive's, both ends included, ranked from 1.  Higher
    scores come first, ties by smaller id.  A positive without such rows, one of a negative score among them, has none.

    Rows with a null id, label or vector, a null or non-finite component or a vector longer than the tiles allow take no
    part.  Missing components of a shorter vector count as 0.  Rows of the anchor's own id are not its positives, but may
    be negatives if their label differs; other repeated rows are rows of their own.  Other columns are not looked at.
    """
    tile_rows, anchor_rows = rows or (None, None)
    plain = vectors.select(
        id_column, vector_column, F.col(label_column).cast("long").alias("_label"), anchors.alias("_anchor")
    ).filter("_label is not null")
    whole = integer_vectors(plain, id_column, vector_column, scale, "_label", "_anchor")
    tiles = packed(whole, "candidates", "_label", tile_rows) if tile_rows else packed(whole, "candidates", "_label")
    blocks = packed(whole.filter("_anchor"), "anchors", "_label", anchor_rows or ANCHORS)
    sizes = blocks.count(), tiles.count()

    def first(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, (a, t) in enumerate(zip(tiles_of(batch, "l_"), tiles_of(batch, "r_"), strict=True)):
            found = positives(a, t, positives_wanted)
            yield records(POSITIVE, [np.full(len(found[0]), batch.column("l_tile")[i].as_py()), *found])

    best = Window.partitionBy("tile", "at").orderBy(F.desc("positive_score"), "positive_id")
    near = by_batch(meet(blocks, tiles, sizes), first, POSITIVE).withColumn("place", F.row_number().over(best))
    near = staged(near.filter(F.col("place") <= positives_wanted), "positives")

    def second(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, (a, t) in enumerate(zip(tiles_of(batch, "l_"), tiles_of(batch, "r_"), strict=True)):
            state = batch.column("l_wanted")[i].values
            wanted = [state.field(c).to_numpy() for c in ("at", "place", "positive_id", "positive_score")]
            found = negatives(a, t, wanted, negatives_wanted, window)
            yield records(NEGATIVE, [np.full(len(found[0]), batch.column("l_tile")[i].as_py()), *found])

    wanted = F.collect_list(F.struct("at", "place", "positive_id", "positive_score"))
    known = blocks.join(near.groupBy("tile").agg(wanted.alias("wanted")), "tile")
    hard = Window.partitionBy("tile", "at", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = by_batch(meet(known, tiles, sizes), second, NEGATIVE).withColumn("rank", F.row_number().over(hard))
    return ranked.filter(F.col("rank") <= negatives_wanted).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
