"""Ridge regression on categories from additive moments: all folds and segments in one pass.

Least squares needs a table only through sums over its rows: how often two categories meet, the target's sum in each, the
sum of its square.  Sums of a fold's rows, taken from those of all, are the sums of the rows the fold's model learns from.
So one aggregate over the table serves every fold of every segment, and each model is a small system of equations, solved
in a task of its own.  The design is that of ``models.OneHot``: categories in alphabetical order, the first one a model
has seen is dropped, one it has not seen is all zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import FOLDS, RIDGE_ALPHA
from ..sources.sinks import staged
from .models import regression_metrics

#: What stands for the intercept and for the target where a feature's number is expected.
_ONE, _TARGET = -1, -2


def segment_folds(df: DataFrame, segment: Sequence[str], group: str, k: int = FOLDS, into: str = "fold") -> DataFrame:
    """Whole groups of each segment in ``k`` folds of similar size (as many as there are groups, if fewer), dealt out in
    order of size, back and forth.  Segments with fewer than two groups are left out, as are rows without a group.

    A segment's groups are numbered within ranges of that order, after those of the ranges before."""
    segment = list(segment)
    order = [F.col("_n").desc(), F.col(group)]
    sizes = df.filter(F.col(group).isNotNull()).groupBy(*segment, group).agg(F.count(F.lit(1)).alias("_n"))
    ranged = staged(sizes.repartitionByRange(*segment, *order).withColumn("_range", F.spark_partition_id()), "group-sizes")
    ranges = ranged.groupBy(*segment, "_range").agg(F.count(F.lit(1)).alias("_groups"))
    before = F.sum("_groups").over(W.partitionBy(*segment).orderBy("_range")) - F.col("_groups")
    ranges = ranges.select(*segment, "_range", before.alias("_before"), F.sum("_groups").over(W.partitionBy(*segment)).alias("groups"))
    within = F.row_number().over(W.partitionBy(*segment, "_range").orderBy(*order)) - 1
    keys = [*segment, "_range"]
    dealt = ranged.withColumn("_i", within)
    dealt = dealt.join(ranges, reduce(lambda a, b: a & b, [dealt[c].eqNullSafe(ranges[c]) for c in keys])).select(
        *[dealt[c] for c in segment], group, "groups", (F.col("_before") + F.col("_i")).alias("_place")
    )
    folds = F.least(F.lit(k), F.col("groups"))
    lap, place = F.floor(F.col("_place") / folds), F.col("_place") % folds
    fold = F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int")
    dealt = dealt.filter("groups > 1").withColumn(into, fold).drop("_place")
    return _join_null_safe(df, dealt, [*segment, group])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    met = left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]))
    return met.drop(*[f"_r_{c}" for c in keys])


def moments(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Cells of the moment matrix per ``keys``: ``a, b`` (structs of a feature's number and a value) and ``v``.

    ``v`` is the number of rows in which both categories meet, or the sum of the target or its square.  Rows are reduced
    to distinct combinations first.  Moments of disjoint tables add up."""
    combos = df.groupBy(*keys, *features).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(target).alias("_y"), F.sum(F.col(target) * F.col(target)).alias("_yy")
    )

    def name(feature: int, value: Column | None = None) -> Column:
        return F.struct(F.lit(feature).alias("feature"), (F.lit("") if value is None else value.cast("string")).alias("value"))

    categories = [name(_ONE), *[name(i, F.col(c)) for i, c in enumerate(features)]]
    cells = [F.struct(a.alias("a"), b.alias("b"), F.col("_n").alias("v")) for i, a in enumerate(categories) for b in categories[i:]]
    cells += [F.struct(a.alias("a"), name(_TARGET).alias("b"), F.col("_y").alias("v")) for a in categories]
    cells.append(F.struct(name(_TARGET).alias("a"), name(_TARGET).alias("b"), F.col("_yy").alias("v")))
    return combos.select(*keys, F.inline(F.array(*cells))).groupBy(*keys, "a", "b").agg(F.sum("v").alias("v"))


def without_fold(parts: DataFrame, segment: Sequence[str], fold: str = "fold") -> DataFrame:
    """Moments of the rows outside each fold: those of the segment less the fold's own."""
    total = parts.groupBy(*segment, "a", "b").agg(F.sum("v").alias("_all"))
    folds = parts.select(*segment, fold).distinct()
    every = _join_null_safe(total, folds, segment) if segment else total.crossJoin(F.broadcast(folds))  # at most k folds
    met = _join_null_safe_left(every, parts.select(*segment, fold, "a", "b", "v"), [*segment, fold, "a", "b"])
    return met.select(*segment, fold, "a", "b", (F.col("_all") - F.coalesce("v", F.lit(0.0))).alias("v"))


def _join_null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    met = left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]), "left")
    return met.drop(*[f"_r_{c}" for c in keys])


def solve(cells: pd.DataFrame, alpha: float) -> list[tuple[int, str, float]]:
    """(feature, value, coefficient) of one model from the cells of its moments (columns af, av, bf, bv, v), the
    intercept as feature -1; the categories that are dropped, or were not seen, are not there."""
    at = {(r.af, r.av, r.bf, r.bv): r.v for r in cells.itertuples(index=False)}
    one = (_ONE, "")
    n = at.get((*one, *one), 0.0)
    if n < 0.5:
        return []
    seen = sorted({(r.af, r.av) for r in cells.itertuples(index=False) if (r.af, r.av) == (r.bf, r.bv) and r.af >= 0 and r.v > 0.5})
    used = [c for k, c in enumerate(seen) if k and seen[k - 1][0] == c[0]]
    mean_y = at[(*one, _TARGET, "")] / n
    if not used:
        return [(*one, mean_y)]
    count = np.array([at[(*one, *c)] for c in used])
    sum_y = np.array([at.get((*c, _TARGET, ""), 0.0) for c in used])
    meet = np.array([[at.get((*min(a, b), *max(a, b)), 0.0) for b in used] for a in used])
    centred = meet - np.outer(count, count) / n + alpha * np.eye(len(used))
    right = sum_y - count * mean_y
    weights = np.linalg.solve(centred, right) if alpha > 0 else np.linalg.lstsq(centred, right, rcond=None)[0]
    return [(*one, float(mean_y - count @ weights / n)), *[(*c, float(w)) for c, w in zip(used, weights, strict=True)]]


def ridge_models(sums: DataFrame, keys: Sequence[str], alpha: float = RIDGE_ALPHA) -> DataFrame:
    """``keys, feature, value, coefficient`` of the model of each of ``keys`` from its moments; a task holds the moments
    of one model, whose size is that of the square of its categories."""
    keys = list(keys)
    flat = sums.select(*keys, F.col("a.feature").alias("af"), F.col("a.value").alias("av"), F.col("b.feature").alias("bf"), F.col("b.value").alias("bv"), "v")
    schema = T.StructType([*[f for f in flat.schema.fields if f.name in keys], *T.StructType.fromDDL("feature int, value string, coefficient double").fields])

    def one(cells: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(solve(cells, alpha), columns=["feature", "value", "coefficient"])
        for k in keys:
            found[k] = cells[k].iloc[0]
        return found[[f.name for f in schema.fields]]

    if not keys:
        flat = flat.withColumn("_model", F.lit(0))
    return flat.groupBy(*(keys or ["_model"])).applyInPandas(one, schema)


def out_of_fold(
    df: DataFrame, features: Sequence[str], target: str, *, segment: Sequence[str] = (), fold: str = "fold",
    alpha: float = RIDGE_ALPHA, into: str = "prediction",
) -> DataFrame:
    """Every row with the prediction of the model of its segment that learned without its fold.

    A prediction depends on a row's categories alone, so it is made once per combination and joined."""
    keys, features = [*segment, fold], list(features)
    models = staged(ridge_models(without_fold(staged(moments(df, features, target, keys), "moments"), segment, fold), keys, alpha), "ridge-models")
    combos = df.select(*keys, *features).distinct()
    parts = [F.struct(F.lit(_ONE).alias("feature"), F.lit("").alias("value"))]
    parts += [F.struct(F.lit(i).alias("feature"), F.col(c).cast("string").alias("value")) for i, c in enumerate(features)]
    spread = combos.select(*keys, *features, F.inline(F.array(*parts)))
    known = _join_null_safe_left(spread, models, [*keys, "feature", "value"])
    made = known.groupBy(*keys, *features).agg(F.sum(F.coalesce("coefficient", F.lit(0.0))).alias(into))
    return _join_null_safe(df, made, [*keys, *features])


def cross_validated_ridge(
    df: DataFrame, *, features: Sequence[str], target: str, group: str, segment: Sequence[str] = (), folds: int = FOLDS,
    alpha: float = RIDGE_ALPHA,
) -> DataFrame:
    """Out-of-fold metrics per segment (one row without one): ``segment, rows, groups, r2, mae``."""
    split = staged(segment_folds(df, segment, group, folds), "folds")
    predicted = out_of_fold(split, features, target, segment=segment, alpha=alpha)
    counts = split.groupBy(*segment).agg(F.max("groups").alias("groups"))
    metrics = regression_metrics(predicted, target, keys=segment)
    if not segment:
        return metrics.crossJoin(counts).select("rows", "groups", "r2", "mae")  # a row each
    return _join_null_safe(metrics, counts, segment).select(*segment, "rows", "groups", "r2", "mae")


def ridge_coefficients(df: DataFrame, features: Sequence[str], target: str, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """``feature, coefficient, multiplicative_effect, pct_effect`` of the model of a log ratio on all rows, ascending; no
    row for the intercept."""
    models = ridge_models(moments(df, features, target, []), [], alpha).filter(F.col("feature") >= 0)
    names = F.array(*[F.lit(c) for c in features])
    effect = F.exp("coefficient")
    return models.select(
        F.concat(F.get(names, F.col("feature")), F.lit("_"), "value").alias("feature"), "coefficient",
        effect.alias("multiplicative_effect"), (100.0 * (effect - 1.0)).alias("pct_effect"),
    ).orderBy("coefficient")
