"""Cleaning and normalizing text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import STREET_ABBREVIATIONS

BLANKS = " \t\n\r\f\x0b"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_string(c: Column | str) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(F.btrim(_col(c), F.lit(BLANKS)), F.lit(""))


def clean_double(c: Column | str) -> Column:
    """Price-like text (``$1,000.50``, ``12%``) as double; anything else becomes NULL.

    The pattern is checked before the cast because the JVM number parser also takes forms such as ``12d``.
    """
    text = F.regexp_replace(clean_string(c), r"[$,%]", "")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """Column ``name`` of ``df`` cleaned as ``kind``; a typed NULL when the column is absent."""
    if name not in df.columns:
        return F.lit(None).cast(kind)
    source = F.col("`" + name.replace("`", "``") + "`").cast("string")
    return clean_double(source) if kind == "double" else clean_string(source).try_cast(kind)


def pad_id(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer values are kept whole (``lpad`` alone would cut them)."""
    c = _col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def zip5(c: Column | str, mode: str = "digits") -> Column:
    """Five-digit zip.

    ``digits``: first five digits found anywhere (NULL if fewer); ``pattern``: first run of five digits;
    ``prefix``: first five characters, zero-padded.
    """
    c = _col(c)
    if mode == "digits":
        digits = F.regexp_replace(c, "[^0-9]", "")
        return F.when(F.length(digits) >= 5, F.substring(digits, 1, 5))
    if mode == "pattern":
        return F.nullif(F.regexp_extract(c, r"(\d{5})", 1), F.lit(""))
    if mode == "prefix":
        return pad_id(F.substring(c, 1, 5), 5)
    raise ValueError(f"unknown zip mode {mode!r}")


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), ""
    )


def slugify(c: Column | str) -> Column:
    """Lower-case; every run of other characters becomes one underscore; none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_text(c: Column | str, *, ampersand: bool = True, null_as_empty: bool = False) -> Column:
    """Upper-case words separated by single blanks, without punctuation; ``&`` reads AND."""
    text = F.upper(_col(c))
    if ampersand:
        text = F.replace(text, F.lit("&"), F.lit(" AND "))
    text = F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))
    return F.coalesce(text, F.lit("")) if null_as_empty else text


def normalize_street(c: Column | str, mapping: Mapping[str, str] = STREET_ABBREVIATIONS) -> Column:
    """Normalized text with street words abbreviated token by token; NULL becomes ''."""
    words = F.split(normalize_text(c, ampersand=False, null_as_empty=True), " ")
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def drop_phrases(c: Column | str, phrases: Sequence[str]) -> Column:
    """Remove phrases wherever they occur in the normalized text, in the given order."""
    text = normalize_text(c, ampersand=False, null_as_empty=True)
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return F.trim(F.regexp_replace(text, " +", " "))


def drop_words(c: Column | str, words: Sequence[str]) -> Column:
    """Remove whole words from the normalized text."""
    tokens = F.split(normalize_text(c, null_as_empty=True), " ")
    return F.array_join(F.filter(tokens, lambda w: ~w.isin(*words)), " ")


def parse_address(c: Column | str) -> Column:
    """``street, …, city, state zip`` as struct<street, city, zip>; missing parts are ''."""
    text = F.btrim(F.btrim(_col(c), F.lit(BLANKS)), F.lit('"'))
    parts = F.transform(F.split(text, ","), lambda p: F.btrim(p, F.lit(BLANKS)))
    empty = F.lit("")
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), empty).alias("street"),
        F.coalesce(F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-2))), empty).alias("city"),
        F.coalesce(F.regexp_extract(text, r"\b(\d{5})(?:-\d{4})?\b", 1), empty).alias("zip"),
    )


def null_outside(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """NULL for values below ``low`` or above ``high`` (sentinels, impossible rates)."""
    c = _col(c)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (c >= low)
    if high is not None:
        keep = keep & (c <= high)
    return F.when(keep, c)
