from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def rules_sql(rules: Sequence[tuple[str, str]], text: str, default: str = "NULL") -> str:
    """The first rule whose pattern is found in ``text``, as SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{label}'" for p, label in rules) + f" ELSE {default} END"


def to_digits(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns whose last bits depend on the order of summation or on the math library."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
