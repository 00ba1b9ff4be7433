"""Expressions about price rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BAND_LATITUDE, INPATIENT_CODE_TYPE, KNOWN_SETTINGS
from .text import _col, clean_string

KINDS = ("dollar", "percentage", "algorithm")


def presence_flags(df: DataFrame) -> DataFrame:
    """Add ``has_negotiated_{dollar,percentage,algorithm,price}``."""
    present = {k: F.col(f"negotiated_{k}").isNotNull() for k in KINDS}
    flags = {f"has_negotiated_{k}": c for k, c in present.items()}
    flags["has_negotiated_price"] = present["dollar"] | present["percentage"] | present["algorithm"]
    return df.withColumns(flags)


def price_representation(
    dollar: Column | str,
    percentage: Column | str,
    algorithm: Column | str,
    mode: str = "precedence",
    empty: str | None = None,
) -> Column:
    """Which forms of price a row carries, from three boolean columns.

    ``precedence``: a dollar amount wins, then percentage with algorithm, percentage, algorithm.
    ``concat``: all forms present, joined by underscores.  ``empty`` is used when there is none.
    """
    d, p, a = _col(dollar), _col(percentage), _col(algorithm)
    if mode == "precedence":
        return (
            F.when(d, "dollar")
            .when(p & a, "percentage_algorithm")
            .when(p, "percentage")
            .when(a, "algorithm")
            .otherwise(F.lit(empty))
        )
    if mode == "concat":
        parts = F.concat_ws("_", *[F.when(flag, kind) for flag, kind in zip((d, p, a), KINDS)])
        return F.coalesce(F.nullif(parts, F.lit("")), F.lit(empty))
    raise ValueError(f"unknown representation mode {mode!r}")


def comparison_setting(code_type: Column | str, setting: Column | str) -> Column:
    """Inpatient for stay-based codes, else the cleaned setting, else ``unknown``."""
    text = F.lower(F.trim(_col(setting)))
    return (
        F.when(F.upper(F.trim(_col(code_type))) == INPATIENT_CODE_TYPE, "inpatient")
        .when(text.isin(*KNOWN_SETTINGS), text)
        .otherwise("unknown")
    )


def latitude_band(latitude: Column | str, cut: float = BAND_LATITUDE, above="North", below="South") -> Column:
    """Band of a location; an unknown latitude falls into ``below``."""
    return F.when(_col(latitude) >= cut, above).otherwise(below)


def collect_codes(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """(code, type) slots as array<struct<code, type>> without the blank codes, in slot order."""
    slots = F.array(
        *[F.struct(clean_string(c).alias("code"), clean_string(t).alias("type")) for c, t in pairs]
    )
    return F.filter(slots, lambda s: s["code"].isNotNull())


def all_codes_json(codes: Column | str) -> Column:
    """Code list as JSON text; a NULL type is kept as ``null``."""
    return F.to_json(_col(codes), {"ignoreNullFields": "false"})


def source_record_id(*parts: Column | str, separator: str = ":") -> Column:
    return F.concat_ws(separator, *[_col(p).cast("string") for p in parts])


def drug_unit_text(c: Column | str) -> Column:
    """Unit of measurement as text; whole numbers lose the trailing ``.0``."""
    return F.regexp_replace(_col(c).cast("string"), r"\.0$", "")
