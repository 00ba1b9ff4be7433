"""Integer vectors packed into tiles, and every tile of one table against every tile of another in an equi-join.

A tile is one row with the ids and the components of up to ``rows`` vectors.  Tiles of both tables meet on (salt, group):
each tile is sent to all groups of the other table, so the rows of a task are bounded whatever the vectors and ids are,
and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import bounded_batches
from .work import staged

#: Vectors and bytes of a tile.
ROWS, BYTES = 4096, 2 << 20
#: Vectors of this squared length or more take no part: 95 times an inner product of two others fits a long.
TOO_LONG = 2.0**55


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, scale: int, *others: str) -> DataFrame:
    """(id, v, others) of the rows that take part, with floor(scale * x) for each component x as double.

    Null ids, null vectors, vectors with a null or non-finite component and those of a squared length of TOO_LONG or
    more are left out."""
    whole = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"), *others
    ).filter(
        "id is not null and x is not null and not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))"
    )
    length = F.aggregate("x", F.lit(0.0), lambda a, c: a + F.pow(F.floor(c * scale).cast("double"), F.lit(2.0)))
    small = F.forall("x", lambda c: F.abs(c * scale) < TOO_LONG) & (length < TOO_LONG)
    return whole.filter(small).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), *others)


def _tile(ids: list[np.ndarray], rows: list[np.ndarray], sizes: list[np.ndarray], others: list[np.ndarray]) -> dict:
    """A tile in the order of ids; vectors with fewer components than the longest have zeros for the rest."""
    key, size = np.concatenate(ids), np.concatenate(sizes)
    width = int(size.max(initial=0))
    matrix = np.zeros((len(key), width), np.int64)
    matrix[np.arange(width) < size[:, None]] = np.concatenate(rows)
    other = np.concatenate(others)
    order = np.lexsort((other, key))
    return {"ids": key[order].tobytes(), "other": other[order].tobytes(), "v": matrix[order].tobytes(), "width": width}


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.binary()), ("other", pa.binary()), ("v", pa.binary()), ("width", pa.int32())])
    kept: tuple[list, list, list, list] = ([], [], [], [])
    held = components = widest = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if kept[0]:
            yield pa.RecordBatch.from_pylist([_tile(kept[0], kept[1], kept[2], kept[3])], schema)
        for part in kept:
            part.clear()

    for batch in batches:
        size = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids, other = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):
            widest = max(widest, int(size[at:].max(initial=1)), 1)
            room = min(limit, max(1, BYTES // 8 // widest)) - held
            if room <= 0:
                yield from flush()
                held, widest = 0, 0
                continue
            to = min(len(ids), at + room)
            for part, x in zip(kept, (ids[at:to], flat[ends[at] : ends[to]], size[at:to], other[at:to]), strict=True):
                part.append(x)
            held, at = held + to - at, to
    yield from flush()


def packed(vectors: DataFrame, name: str, other: str | None = None, rows: int = ROWS) -> DataFrame:
    """Written tiles (tile, ids, other, v, width) of (id, v) with a long column ``other``; rows are dealt out evenly,
    whatever their ids."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    plain = vectors.select("id", "v", (F.col(other).cast("long") if other else F.lit(0).cast("long")).alias("other"))
    plain = staged(plain, f"{name}-vectors")
    parts = max(1, -(-plain.count() // rows))
    tiles = plain.repartition(parts).mapInArrow(
        lambda batches: _pack(batches, rows), "ids binary, other binary, v binary, width int"
    )
    return staged(tiles.withColumn("tile", F.monotonically_increasing_id()), f"{name}-tiles")


def meet(left: DataFrame, right: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Each row of ``left`` with each of ``right`` (tables with a column ``tile``; ``sizes`` are their numbers of rows),
    by a join on keys that hold about one pair each.  Columns get the prefixes l_ and r_."""
    m, n = (max(1, x) for x in sizes)

    def keyed(df: DataFrame, prefix: str, own: str, mine: int, other: str, theirs: int) -> DataFrame:
        named = df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
        return named.withColumn(own, F.pmod(F.xxhash64(prefix + "tile"), F.lit(mine))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(theirs - 1).cast("long")))
        )

    one, two = keyed(left, "l_", "row", m, "col", n), keyed(right, "r_", "col", n, "row", m)
    return one.join(two.hint("merge"), ["row", "col"]).drop("row", "col")


class Tile:
    """Ids (ascending), the other column and the matrix of a tile."""

    def __init__(self, ids: bytes, other: bytes, v: bytes, width: int):
        self.ids, self.other = np.frombuffer(ids, np.int64), np.frombuffer(other, np.int64)
        self.matrix = np.frombuffer(v, np.int64).reshape(len(self.ids), width)

    def own(self, ids: np.ndarray) -> np.ndarray:
        """For each of ``ids`` whether a vector of the tile has it, as a matrix (ids, vectors)."""
        return self.ids[None, :] == ids[:, None]


def tiles_of(batch: pa.RecordBatch, prefix: str) -> list[Tile]:
    columns = [batch.column(prefix + c).to_pylist() for c in ("ids", "other", "v", "width")]
    return [Tile(*x) for x in zip(*columns, strict=True)]


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with as many columns, those of the narrower one followed by zeros."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))  # type: ignore


def records(schema: str, columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    arrays = [pa.array(x, kinds[c.split()[1]]) for x, c in zip(columns, schema.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)
