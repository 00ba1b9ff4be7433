"""Written intermediate tables, and joins that stay balanced whatever the keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.sources.sinks import staged, work_dir

__all__ = ["by_batch", "fresh", "keep_ids", "numbered", "one_text_an_id", "staged", "work_dir"]

#: Ids up to this number (about 1 MB of them) may be broadcast; more are shuffled.
BROADCAST_IDS = 100_000


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def keep_ids(docs: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` that join ``ids`` (a written table with one row per id).  A table of nothing but few ids is
    broadcast, so that texts don't move; beyond BROADCAST_IDS, and with other columns, both sides are shuffled."""
    few = ids.columns == [on] and ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), on, how)


def numbered(df: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``at``, the place of each row in its ``tree`` (a string, not null) by ``order``, nulls first, and ``size``,
    the rows of the tree; rows that are equal in the order are in any.  A tree may be as large as it likes: its rows are in
    order over several tasks."""
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order], F.col("_row")]
    whole = df.withColumn("_row", F.monotonically_increasing_id())
    spread = whole.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    placed = staged(spread.withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(tree).orderBy("_part")) - F.col("_rows")
    size = F.sum("_rows").over(Window.partitionBy(tree))
    parts = parts.select(tree, "_part", (before - F.col("_from")).alias("_shift"), size.alias("size"))
    return placed.join(parts, [tree, "_part"]).withColumn("at", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_text_an_id(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str] | None:
    """None where every id has one text.  Otherwise ``docs`` with a number of its own for each text of an id, in the order
    of ids and, within one, of the texts' digests, and the name of that column; it is null where the id is.

    The rule knows no order of rows, so a task that runs again finds the same."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    known = docs.filter(F.col(id_column).isNotNull())
    ends = known.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h")).groupBy("id").agg(
        F.min("h").alias("low"), F.max("h").alias("high")
    )
    if ends.filter("low <> high").isEmpty():
        return None
    of, digest, place = fresh(docs, "_of"), fresh(docs, "_digest"), fresh(docs, "_place")
    own = {of: F.col(id_column), digest: F.sha2(text, 256)}
    each = known.select(*[c.alias(n) for n, c in own.items()]).distinct().withColumn("_all", F.lit("all"))
    places = numbered(each, "_all", [of, digest], "places").select(of, digest, F.col("at").alias(place))
    return docs.withColumns(own).join(staged(places, "places"), [of, digest], "left").drop(of, digest), place
