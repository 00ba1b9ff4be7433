"""Regression on a modelling frame with folds that keep groups together (MLlib)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import FOLDS, FOREST, RIDGE_ALPHA
from ..sources.sinks import staged
from .quality import is_finite

MAX_CATEGORIES = 5_000  # the only thing fetched from the data; beyond it one-hot columns make no sense


def load_model_frame(
    df: DataFrame, *, target: str, features: Sequence[str], group: str, numeric: Sequence[str] = ()
) -> DataFrame:
    """Columns for modelling: numbers coerced (junk becomes NULL), rows without target, group or feature left
    out."""
    numbers = [*dict.fromkeys([*numeric, target])]
    others = [c for c in dict.fromkeys([group, *features]) if c not in numbers]
    return df.select(
        *others, *[F.col(c).cast("string").try_cast("double").alias(c) for c in numbers]
    ).dropna(subset=[group, *features, target])


def interaction_feature(df: DataFrame, columns: Sequence[str], into: str, separator: str = "__") -> DataFrame:
    return df.withColumn(into, F.concat_ws(separator, *columns))


def grouped_folds(df: DataFrame, group: str, k: int = FOLDS, into: str = "fold") -> DataFrame:
    """Assign whole groups to ``k`` folds of similar size: dealt out in order of size, back and forth.

    Groups are numbered within ranges of that order, after the groups of the ranges before; NULL is no group.
    """
    order = [F.col("_n").desc(), F.col(group)]
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    # written, so that a group keeps its range between the count and the numbering
    ranged = staged(sizes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "group-sizes")
    ranges = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_groups"))
    before = F.sum("_groups").over(W.orderBy("_range")) - F.col("_groups")  # one row per range
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    dealt = ranged.withColumn("_i", within).join(ranges.select("_range", before.alias("_before")), "_range")
    i = F.col("_before") + F.col("_i")
    lap, place = F.floor(i / k), i % k
    fold = F.when(lap % 2 == 0, place).otherwise(k - 1 - place).cast("int")
    return df.join(dealt.select(group, fold.alias(into)), group)


class OneHot:
    """Categories as 0/1 columns in alphabetical order; a value not seen when fitting is all zeros."""

    def __init__(self, train: DataFrame, features: Sequence[str], drop_first: bool):
        seen = train.select(*features).distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(seen) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} combinations of {', '.join(features)}")
        self.columns: list[tuple[str, str]] = []
        for f in features:
            values = sorted({row[f] for row in seen})
            self.columns += [(f, v) for v in (values[1:] if drop_first else values)]

    @property
    def names(self) -> list[str]:
        return [f"{f}_{v}" for f, v in self.columns]

    def transform(self, df: DataFrame) -> DataFrame:
        dummies = [f"_x{i}" for i in range(len(self.columns))]
        wide = df.withColumns({
            d: F.when(F.col(f) == v, 1.0).otherwise(0.0) for d, (f, v) in zip(dummies, self.columns)
        })
        return VectorAssembler(inputCols=dummies, outputCol="features").transform(wide).drop(*dummies)


class Ridge:
    """Penalized least squares, the intercept not penalized."""

    drop_first = True

    def __init__(self, alpha: float = RIDGE_ALPHA):
        self.alpha = alpha

    def fit(self, train: DataFrame, features: Sequence[str], target: str) -> Ridge:
        self.encoder = OneHot(train, features, self.drop_first)
        n, spread, mean = train.agg(F.count(target), F.stddev_pop(target), F.avg(target)).first()
        self.constant = mean if not self.encoder.columns or not spread else None
        if self.constant is None:
            # the solver minimizes the mean squared error of the target in units of its deviation, hence the
            # penalty per row and deviation
            solver = LinearRegression(
                featuresCol="features", labelCol=target, solver="normal", elasticNetParam=0.0,
                standardization=False, regParam=self.alpha * spread / n,
            )
            self.model = solver.fit(self.encoder.transform(train))
        return self

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        if self.constant is not None:
            return df.withColumn(into, F.lit(self.constant))
        return self.model.setPredictionCol(into).transform(self.encoder.transform(df)).drop("features")

    @property
    def weights(self) -> list[tuple[str, float]]:
        if self.constant is not None:
            return [(n, 0.0) for n in self.encoder.names]
        return list(zip(self.encoder.names, map(float, self.model.coefficients)))


class Forest:
    """Averaged regression trees on all categories."""

    drop_first = False

    def __init__(self, **params):
        self.params = {**FOREST, **params}

    def fit(self, train: DataFrame, features: Sequence[str], target: str) -> Forest:
        self.encoder = OneHot(train, features, self.drop_first)
        trees = RandomForestRegressor(
            featuresCol="features", labelCol=target, featureSubsetStrategy="all", **self.params
        )
        self.model = trees.fit(self.encoder.transform(train))
        return self

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        return self.model.setPredictionCol(into).transform(self.encoder.transform(df)).drop("features")

    @property
    def weights(self) -> list[tuple[str, float]]:
        return list(zip(self.encoder.names, map(float, self.model.featureImportances.toArray())))


def out_of_fold(
    df: DataFrame, make: Callable[[], Ridge | Forest], features: Sequence[str], target: str, fold: str = "fold"
) -> DataFrame:
    """Every row predicted by the model that was fitted without its fold."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = [
        make().fit(df.filter(F.col(fold) != f), features, target).predict(df.filter(F.col(fold) == f))
        for f in folds
    ]
    return reduce(DataFrame.unionByName, parts)


def regression_metrics(df: DataFrame, target: str, prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Rows, pooled R-squared and mean absolute error; the query fails on predictions that are not finite."""
    error = F.col(target) - F.col(prediction)
    total = F.var_pop(target) * F.count(target)
    invalid = F.count_if(~is_finite(prediction))
    message = F.concat(invalid.cast("string"), F.lit(" predictions are not finite"))
    return df.groupBy(*keys).agg(
        F.when(invalid == 0, F.count(target)).otherwise(F.raise_error(message).cast("long")).alias("rows"),
        (1 - F.try_divide(F.sum(error * error), total)).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
    )


def _small(df: DataFrame, rows: list, schema: T.StructType) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def coefficient_table(df: DataFrame, model: Ridge) -> DataFrame:
    """``feature, coefficient, multiplicative_effect, pct_effect`` of a model of a log ratio, ascending."""
    rows = [(n, c, math.exp(c), 100.0 * (math.exp(c) - 1.0)) for n, c in sorted(model.weights, key=lambda w: w[1])]
    fields = ["coefficient", "multiplicative_effect", "pct_effect"]
    schema = T.StructType(
        [T.StructField("feature", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in fields]
    )
    return _small(df, rows, schema)


def importance_table(df: DataFrame, model: Forest) -> DataFrame:
    """``feature, importance``, most important first."""
    rows = sorted(model.weights, key=lambda w: -w[1])
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return _small(df, rows, schema)


def cross_validate(
    df: DataFrame,
    make: Callable[[], Ridge | Forest],
    *,
    features: Sequence[str],
    target: str,
    group: str,
    folds: int = FOLDS,
) -> DataFrame:
    """Out-of-fold metrics of one model: one row."""
    groups = df.select(group).distinct().limit(folds).count()
    # every fit reads the split again, so it is written once
    split = staged(grouped_folds(df, group, min(folds, groups)), "folds")
    return regression_metrics(out_of_fold(split, make, features, target), target)


def segment_evaluate(
    df: DataFrame,
    segment: str,
    values: Sequence[str],
    models: Mapping[str, Callable[[], Ridge | Forest]],
    *,
    features: Sequence[str],
    target: str,
    group: str,
    folds: int = FOLDS,
) -> DataFrame:
    """Cross-validated metrics per segment and model; segments with fewer than two groups are left out."""
    parts = []
    for value in values:
        part = df.filter(F.col(segment) == value)
        if part.select(group).distinct().limit(2).count() < 2:
            continue
        n_groups = part.agg(F.count_distinct(group)).first()[0]
        for name, make in models.items():
            metrics = cross_validate(part, make, features=features, target=target, group=group, folds=folds)
            parts.append(
                metrics.select(
                    F.lit(value).alias(segment), F.lit(name).alias("model"), "rows",
                    F.lit(n_groups).cast("long").alias("groups"), "r2", "mae",
                )
            )
    if not parts:
        columns = "model string, rows long, groups long, r2 double, mae double"
        return df.sparkSession.createDataFrame([], f"`{segment}` string, {columns}")
    return reduce(DataFrame.unionByName, parts)
