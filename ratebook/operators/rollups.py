"""Aggregations over groups of price rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import ACCURACY, quantile
from ..sources.sinks import staged
from .joins import null_safe_join
from .sketches import EXACT_ROWS, agg_with_quantiles


def value_counts(df: DataFrame, keys: Sequence[str], into: str = "row_count") -> DataFrame:
    """Rows per key combination (NULL is one), most frequent first."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(into))
    return counts.orderBy(F.col(into).desc(), *[F.col(k).asc_nulls_first() for k in keys])


def share_of_total(df: DataFrame, keys: Sequence[str], count="row_count", pct="percent_of_total") -> DataFrame:
    """Rows per key combination and their percentage of all rows."""
    counts = staged(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)), "counts")  # read for the total again
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(pct, 100.0 * F.col(count) / total)


def group_size_histogram(df: DataFrame, keys: Sequence[str], size="group_size", groups="groups") -> DataFrame:
    """How many groups have how many rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    return sizes.groupBy(size).agg(F.count(F.lit(1)).alias(groups))


def members_of_large_groups(df: DataFrame, keys: Sequence[str], more_than: int = 1) -> DataFrame:
    """Rows whose key occurs more than ``more_than`` times."""
    large = df.groupBy(*keys).count().filter(F.col("count") > more_than).drop("count")
    return df.join(large, list(keys), "left_semi")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``column, missing`` - one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])
    return counted.select(F.inline(rows))


def coverage(
    df: DataFrame, keys: Sequence[str], system: str, member: Column, all_systems: int | None = None
) -> DataFrame:
    """Per comparable key: distinct systems and members (NULL members do not count) and what that allows."""
    out = df.groupBy(*keys).agg(
        F.count_distinct(F.col(system)).alias("system_count"), F.count_distinct(member).alias("location_count")
    )
    out = out.withColumn("is_cross_system_comparable", F.col("system_count") >= 2)
    if all_systems is not None:
        out = out.withColumn("is_all_systems", F.col("system_count") == all_systems)
    return out


def with_coverage(
    df: DataFrame, keys: Sequence[str], system: str, member: Column, all_systems: int | None = None
) -> DataFrame:
    """The columns of :func:`coverage` on the rows themselves, for a table already reduced to one row per member.

    Distinct counts are the highest dense rank in the key's window, so the table is read once and shuffled once;
    a window holds no more rows than there are members.
    """
    group = W.partitionBy(*keys)

    def distinct(value: str) -> Column:
        return F.max(F.when(F.col(value).isNotNull(), F.col(f"{value}_rank"))).over(group)

    out = df.withColumns({"_system": F.col(system), "_member": member})
    out = out.withColumns({
        f"{c}_rank": F.dense_rank().over(group.orderBy(F.col(c).asc_nulls_last())) for c in ("_system", "_member")
    })
    out = out.withColumns({
        "system_count": F.coalesce(distinct("_system"), F.lit(0)).cast("long"),
        "location_count": F.coalesce(distinct("_member"), F.lit(0)).cast("long"),
    }).drop("_system", "_member", "_system_rank", "_member_rank")
    out = out.withColumn("is_cross_system_comparable", F.col("system_count") >= 2)
    if all_systems is not None:
        out = out.withColumn("is_all_systems", F.col("system_count") == all_systems)
    return out


def equal_weight_rollup(
    df: DataFrame,
    value: str,
    levels: Sequence[tuple[str, Sequence[str]]],
    carry: Sequence[str] = ("description",),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Median of medians up a hierarchy, so that members with more rows do not weigh more.

    ``levels`` is [(name, keys), …], finest first.  Each level turns the rows below into one with
    ``median_{name}_price``; ``source_row_count`` and the ``{name}_count`` of every level below are carried up,
    and mean, min, max and sample standard deviation of the level just below are added.  Medians are exact at any size:
    a level is checked for large groups until one has so few rows that none above it can be large.
    """
    counts: list[str] = []
    price, below, few = value, None, False
    for name, keys in levels:
        aggregates = [F.min(c).alias(c) for c in carry]
        if below is None:
            aggregates.append(F.count(F.lit(1)).alias("source_row_count"))
        else:
            aggregates += [
                F.count(F.lit(1)).alias(f"{below}_count"),
                *[F.sum(c).alias(c) for c in counts],
                F.avg(price).alias(f"mean_{below}_price"),
                F.min(price).alias(f"min_{below}_price"),
                F.max(price).alias(f"max_{below}_price"),
                F.stddev_samp(price).alias(f"sd_{below}_price"),
            ]
        counts.append("source_row_count" if below is None else f"{below}_count")
        median = f"median_{name}_price"
        if few:
            df = df.groupBy(*keys).agg(*aggregates, quantile(price, 0.5, accuracy).alias(median))
        else:
            df = agg_with_quantiles(df, keys, aggregates, {median: (price, 0.5)}, accuracy=accuracy)
            few = df.count() < EXACT_ROWS
        price, below = median, name
    return df


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, ps: Mapping[str, float], buckets: int = 200
) -> DataFrame:
    """Exact quantiles (element at rank ``ceil(p * n)``) of groups of any size.

    Equal values are counted first; each group's distinct values are cut into buckets by approximate
    quantiles, bucket totals tell which bucket holds the wanted rank, and only that bucket is ordered.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    counted = staged(counted, "value-counts")  # read for the cuts, the totals and the picks
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts")
    )
    bucketed = null_safe_join(counted, cuts, keys).withColumn(
        "bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))
    ).drop("cuts")
    totals = bucketed.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys)
    before = F.sum("n").over(whole.orderBy("bucket")) - F.col("n")
    ranks = [F.greatest(F.ceil(F.lit(p) * F.col("total")), F.lit(1)) for p in ps.values()]
    wanted = (
        totals.withColumns({"before": before, "total": F.sum("n").over(whole)})
        .withColumn("ranks", F.array(*ranks))
        .filter(F.exists("ranks", lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n"))))
        .drop("n")
    )
    ordered = null_safe_join(bucketed, wanted, [*keys, "bucket"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(W.partitionBy(*keys, "bucket").orderBy(value))
    )
    picks = [
        F.max(
            F.when(
                (F.get("ranks", F.lit(i)) > F.col("upto") - F.col("n")) & (F.get("ranks", F.lit(i)) <= F.col("upto")),
                F.col(value),
            )
        ).alias(name)
        for i, name in enumerate(ps)
    ]
    return ordered.groupBy(*keys).agg(*picks)
