"""Wide to long, nested to flat, long to pivoted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import PAYER_METRICS
from ..functions.text import optional


def wide_to_long(
    df: DataFrame,
    groups: Mapping[tuple, Mapping[str, str]],
    metrics: Mapping[str, tuple[str, str]] = PAYER_METRICS,
    keys: Sequence[str] = ("payer", "plan"),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per input row and group: ``keep`` columns, the group's ``keys`` and its metrics.

    ``metrics`` maps metric to (output column, kind); a metric a group lacks is NULL.  One narrow pass: the
    groups become an array of structs that is exploded.
    """
    used = {c for fields in groups.values() for c in fields.values()}
    keep = [c for c in df.columns if c not in used] if keep is None else list(keep)
    structs = [
        F.struct(
            *[F.lit(part).alias(key) for key, part in zip(keys, group)],
            *[optional(df, fields.get(m, ""), kind).alias(out) for m, (out, kind) in metrics.items()],
        )
        for group, fields in sorted(groups.items())
    ]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    return df.select(*quoted, F.inline(F.array(*structs)))


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with at least one of the columns present."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))


def flatten_nested(df: DataFrame, levels: Sequence[tuple[str | Column, str, str]]) -> DataFrame:
    """Explode nested arrays level by level.

    Each level is (array, element name, number name); the array may refer to the element of an earlier level.
    Numbers start at 1.  Rows whose array is NULL or empty vanish.
    """
    for array, element, number in levels:
        array = F.col(array) if isinstance(array, str) else array
        df = df.select("*", F.posexplode(array).alias(number, element)).withColumn(
            number, F.col(number).cast("long") + 1
        )
    return df


def conditional_pivot(
    df: DataFrame,
    keys: Sequence[str],
    on: str,
    values: Mapping[str, str],
    measures: Mapping[str, str | Column],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per ``keys`` with a column ``{label}_{measure}`` per known value of ``on``, in one aggregation.

    ``values`` maps value of ``on`` to label, ``measures`` maps measure name to the column carried over.
    """
    cells = [
        F.max(F.when(F.col(on) == value, F.col(m) if isinstance(m, str) else m)).alias(f"{label}_{name}")
        for name, m in measures.items()
        for value, label in values.items()
    ]
    return df.groupBy(*keys).agg(*extra, *cells)


def complete_pairs(df: DataFrame, columns: Sequence[str], positive: bool = True) -> DataFrame:
    """Rows where every side of the pivot is present (and above zero)."""
    return df.filter(
        reduce(lambda a, b: a & b, [(F.col(c) > 0) if positive else F.col(c).isNotNull() for c in columns])
    )


def conform(
    df: DataFrame,
    schema: T.StructType,
    literals: Mapping[str, object] | None = None,
    sources: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Project to ``schema``: a literal, a renamed or computed source, the same name, or a typed NULL.

    A column that already has its type is passed through without a cast, so filters on it still reach the scan.
    """
    literals, sources = literals or {}, sources or {}
    types = {f.name: f.dataType for f in df.schema.fields}

    def column(field: T.StructField) -> Column:
        if field.name in literals:
            return F.lit(literals[field.name]).cast(field.dataType)
        source = sources.get(field.name, field.name)
        if isinstance(source, Column):
            return source.cast(field.dataType)
        if source not in types:
            return F.lit(None).cast(field.dataType)
        c = F.col(f"`{source}`")
        return c if types[source] == field.dataType else c.try_cast(field.dataType)

    return df.select(*[column(f).alias(f.name) for f in schema.fields])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
