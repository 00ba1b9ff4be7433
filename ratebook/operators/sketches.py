"""Quantiles that are exact at any group size, and summaries that are stored and merged.

Two forms stand side by side.  :func:`agg_with_quantiles` gives exact quantiles beside other aggregates of a group, whatever
its size.  :func:`summaries` keeps a KLL sketch of values and theta sketches of distinct keys as columns, so that batches
and levels of a hierarchy are merged without reading the rows again; what it tells is approximate within known bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import ACCURACY, quantiles
from ..sources.sinks import staged
from .joins import null_safe_join

#: A summary of this accuracy errs by less than one rank in groups of fewer rows.
EXACT_ROWS = ACCURACY // 2
#: Cuts of a bracket per round, and distinct values that are few enough to be ordered at once.
CUTS, ORDERED = 32, 20_000
#: Size of the stored sketches: k of KLL, and the logarithm of the entries of theta.
KLL_SIZE, THETA_SIZE = 1000, 12
#: Bounds of their errors that hold all but once in a thousand: of the rank of a quantile, and relative of a distinct count.
RANK_ERROR, COUNT_ERROR = 0.01, 0.06


def narrowed_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, ps: Mapping[str, float], cuts: int = CUTS, ordered: int = ORDERED
) -> DataFrame:
    """Exact quantiles (element at rank ``ceil(p * n)``) of a double column by group, NULLs left out.

    Equal values are counted first.  Each wanted rank has a bracket of values, at first all of its group; a sketch cuts its
    distinct values into ``cuts`` parts, their totals tell which part holds the rank, and that part is the next bracket.
    Brackets of at most ``ordered`` distinct values are ordered.  The driver reads one number per round, and a group of
    any size takes a logarithmic number of rounds."""
    keys, names = list(keys), list(ps)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = staged(counted, "value-counts")
    ranks = F.array(*[
        F.struct(F.lit(i).alias("_i"), F.greatest(F.ceil(F.lit(float(p)) * F.col("_all")), F.lit(1)).alias("_rank"))
        for i, p in enumerate(ps.values())
    ])
    ends = counted.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_values")
    )
    brackets = staged(ends.select(*keys, F.inline(ranks), "_low", "_high", "_values"), "brackets")
    at = [*keys, "_i"]
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    steps = F.array(*[F.lit(k / cuts) for k in range(1, cuts)])
    while (brackets.agg(F.max("_values").alias("most")).first().most or 0) > ordered:
        done, wide = brackets.filter(F.col("_values") <= ordered), brackets.filter(F.col("_values") > ordered)
        members = null_safe_join(counted, wide, keys).filter(inside)
        sketch = members.groupBy(*at).agg(F.kll_sketch_agg_double(F.col("_v").cast("double")).alias("_sketch"))
        edges = sketch.select(*at, F.kll_sketch_get_quantile_double("_sketch", steps).alias("_edges"))
        parts = null_safe_join(members, staged(edges, "edges"), at).withColumn(
            "_part", F.size(F.filter("_edges", lambda c: c < F.col("_v")))
        )
        parts = parts.groupBy(*at, "_rank", "_part").agg(
            F.sum("_n").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_values")
        )
        upto = F.sum("_rows").over(W.partitionBy(*at).orderBy("_part"))  # at most ``cuts`` rows
        parts = parts.withColumn("_before", upto - F.col("_rows"))
        held = parts.filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_rows")))
        held = held.withColumn("_rank", F.col("_rank") - F.col("_before")).select(*brackets.columns)
        brackets = staged(done.unionByName(held), "brackets")
    members = null_safe_join(counted, brackets, keys).filter(inside)
    upto = F.sum("_n").over(W.partitionBy(*at).orderBy("_v"))
    found = members.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_rank")).groupBy(*at).agg(F.min("_v").alias("_v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)])


def agg_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    wanted: Mapping[str, tuple[Column | str, float]],
    exact_rows: int = EXACT_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``df`` grouped by ``keys`` with ``aggregates`` and exact quantiles: {name: (value, p)}.

    One pass gives the groups, with quantiles that are exact below ``exact_rows`` rows.  It is written, and only where there
    are larger groups are their rows, and no others, read again for :func:`narrowed_quantiles`.  The columns are in the
    order of ``keys``, ``aggregates`` and ``wanted``."""
    keys = list(keys)
    by_value: dict[str, tuple[Column, list[tuple[str, float]]]] = {}
    for name, (value, p) in wanted.items():
        column = F.col(value) if isinstance(value, str) else value
        by_value.setdefault(str(column), (column, []))[1].append((name, p))
    values = list(by_value.values())
    grouped = df.groupBy(*keys).agg(
        *aggregates,
        *[quantiles(column, [p for _, p in names], accuracy).alias(f"_q{k}") for k, (column, names) in enumerate(values)],
        *[F.count(column).alias(f"_c{k}") for k, (column, _) in enumerate(values)],
    )
    grouped = staged(grouped, "groups")
    plain = grouped.columns[: len(grouped.columns) - 2 * len(values)]
    picks = {name: F.get(f"_q{k}", F.lit(i)) for k, (_, names) in enumerate(values) for i, (name, _) in enumerate(names)}
    most = grouped.agg(*[F.max(f"_c{k}") for k in range(len(values))]).first()
    out = grouped
    for k, (column, names) in enumerate(values):
        if (most[k] or 0) < exact_rows:
            continue
        few = grouped.filter(F.col(f"_c{k}") >= exact_rows).select(*keys)
        rows = null_safe_join(df.select(*keys, column.alias("_value")), few, keys)
        out = null_safe_join(out, narrowed_quantiles(rows, keys, "_value", {f"_x{name}": p for name, p in names}), keys, "left")
        for name, _ in names:
            picks[name] = F.coalesce(f"_x{name}", picks[name])
    return out.select(*plain, *[picks[name].alias(name) for name in wanted])


def summaries(df: DataFrame, keys: Sequence[str], value: str, distinct: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Per group: ``rows``, ``low``, ``high`` and a KLL sketch ``values`` of ``value``, and a theta sketch ``of_{name}`` for
    each of ``distinct``.  All of it merges (:func:`merge_summaries`)."""
    double = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(double).alias("low"),
        F.max(double).alias("high"),
        F.kll_sketch_agg_double(double, KLL_SIZE).alias("values"),
        *[F.theta_sketch_agg(c, THETA_SIZE).alias(f"of_{name}") for name, c in (distinct or {}).items()],
    )


def merge_summaries(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of coarser groups, or of several batches, from summaries alone."""
    return parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("values", KLL_SIZE).alias("values"),
        *[F.theta_union_agg(c, THETA_SIZE).alias(c) for c in parts.columns if c.startswith("of_")],
    )


def levels(parts: DataFrame, hierarchy: Sequence[str]) -> DataFrame:
    """Summaries of each level of a hierarchy, from all of its columns down to none (the grand total); columns that a level
    does not have are NULL, and ``level`` tells how many it has."""
    every, below = [], parts
    for depth in range(len(hierarchy), -1, -1):
        below = staged(merge_summaries(below, hierarchy[:depth]), "level")  # read for the level above again
        missing = {c: F.lit(None).cast(parts.schema[c].dataType) for c in hierarchy[depth:]}
        every.append(below.withColumns({**missing, "level": F.lit(depth)}))
    return reduce(DataFrame.unionByName, every)


def told(merged: DataFrame, ps: Mapping[str, float]) -> DataFrame:
    """What summaries tell: quantiles by name (rank within ``RANK_ERROR``) and ``{name}`` for each ``of_{name}``, the
    estimated distinct count (within ``COUNT_ERROR``); the sketches themselves are left out."""
    sketches = [c for c in merged.columns if c.startswith("of_")]
    some = F.kll_sketch_get_n_double("values") > 0  # a group of NULLs has no quantile
    return merged.withColumns({
        **{name: F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(float(p)))) for name, p in ps.items()},
        **{c.removeprefix("of_"): F.theta_sketch_estimate(c) for c in sketches},
    }).drop("values", *sketches)


class SummaryMart:
    """Summaries of batches in a folder.  A batch has a name and is written whole or not at all, so loading it again replaces
    it; bringing the mart up to date reads the new rows only."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def load(self, batch: str, rows: DataFrame, value: str, distinct: Mapping[str, Column | str] | None = None) -> None:
        """Replace the batch ``batch`` (letters, digits, - and _) by summaries of ``rows``."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a name of a batch: {batch!r}")
        summaries(rows, self.keys, value, distinct).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def current(self) -> DataFrame:
        """Summaries over all batches."""
        return merge_summaries(self.spark.read.parquet(self.path).drop("batch"), self.keys)
