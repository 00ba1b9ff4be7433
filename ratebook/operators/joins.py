"""Joins with a stated contract.

No join here forces a broadcast: the planner broadcasts a side whose size it knows to be small, adaptive
execution does so for sides it measured, and a hot key of a shuffled join is split by the adaptive skew join.
``few_or_merged`` is for written tables whose rows, not the bytes of their files, say whether they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import check_unique, enforce


#: Rows up to which a table that was counted is broadcast.
FEW_ROWS = 100_000


def few_or_merged(df: DataFrame) -> DataFrame:
    """A written table as a side of a join: broadcast if it has few rows, else joined by a merge.

    The planner goes by the bytes of the files, and these can be few for very many rows that repeat."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df.hint("merge")


def _shared(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in right.columns if c in left.columns and c not in keys]


def inner_equi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys))


def left_equi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def left_n_to_1(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Left join to a table with one row per key, so that every left row comes out once.

    ``check`` verifies the uniqueness (one aggregation of ``right``), which is what keeps the row count.
    """
    clash = _shared(left, right, keys)
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    if check:
        enforce(check_unique(right, keys))
    return left.join(right, list(keys), "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join after verifying that the key is unique on both sides."""
    enforce(check_unique(left, keys, "left"))
    enforce(check_unique(right, keys, "right"))
    return left.join(right, list(keys), how)


def join_with_flag(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Left join plus a boolean that says whether the right side had the key."""
    return left.join(right.withColumn(flag, F.lit(True)), list(keys), "left").withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def join_grouped(left: DataFrame, detail: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Left join to a detail table reduced to one row per key before the join (smallest non-NULL value)."""
    reduced = detail.groupBy(*keys).agg(*[F.min(a).alias(a) for a in attributes])
    return left.join(reduced, list(keys), "left")


def _on(keys: Sequence[str], prefix: str, null_safe: bool = True) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k).eqNullSafe(F.col(prefix + k)) if null_safe else (F.col(k) == F.col(prefix + k)))
    return on


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    return left.join(renamed, _on(keys, "_r_"), how).drop(*[f"_r_{k}" for k in keys])


def join_back(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Rows with aggregates of their group (one partial aggregation, then a join on one row per group)."""
    groups = df.groupBy(*keys).agg(*aggregates)
    return null_safe_join(df, groups, keys, how) if null_safe else df.join(groups, list(keys), how)


def semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def unique_lookup(right: DataFrame, keys: Sequence[str], value: str, into: str | None = None) -> DataFrame:
    """Keys of ``right`` that identify exactly one row, with its ``value``."""
    into = into or value
    return (
        right.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(into))
        .filter("_n = 1")
        .drop("_n")
    )


def unique_lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    value: str,
    into: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Add ``into`` = ``value`` of the only right row with the key; ambiguous keys give NULL.

    A NULL key matches nothing unless ``null_safe``, which lets it match the only right row with NULLs in the
    same places.
    """
    into = into or value
    lookup = unique_lookup(right, keys, value, into)
    if not null_safe:
        return left.join(lookup, list(keys), "left")
    return null_safe_join(left, lookup, keys, "left")


def priority_fill(
    df: DataFrame,
    target: str,
    steps: Sequence[tuple[str, str, float | str | None]],
    method: str = "match_method",
    score: str = "match_score",
) -> DataFrame:
    """Fill ``target`` from the first step that has a value and record which one it was.

    A step is (column with the proposal, method label, score: a number, the name of a score column, or None).
    """
    first = F.coalesce(*[F.col(c) for c, _, _ in steps])
    which, points = None, None
    for column, label, s in steps:
        value = F.col(s) if isinstance(s, str) else F.lit(s)
        value = value.cast("double")
        hit = F.col(column).isNotNull()
        which = F.when(hit, label) if which is None else which.when(hit, label)
        points = F.when(hit, value) if points is None else points.when(hit, value)
    return df.withColumns({method: which, score: points, target: first})


def compare_assignments(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where two assignments differ; one missing counts as different, both missing as equal."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def add_constants(rows: DataFrame, manifest: DataFrame, key: str = "source_file") -> DataFrame:
    """Attach per-file constants (facility, location, provenance) to each of its rows.

    The manifest has one row per file (checked); rows of a file it does not list fail the job.
    """
    out = left_n_to_1(rows, manifest.withColumn("_listed", F.lit(True)), [key])
    unlisted = F.raise_error(F.concat(F.lit("not in the manifest: "), F.col(key))).cast("boolean")
    return out.filter(F.when(F.col("_listed"), F.lit(True)).otherwise(unlisted)).drop("_listed")
