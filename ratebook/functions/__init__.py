"""Column -> column expressions.  All JVM built-ins, no Python UDF."""

from .aggregates import exact_mean, geomean, pct_of_rows, quantile, quantiles
from .prices import (
    all_codes_json,
    collect_codes,
    comparison_setting,
    drug_unit_text,
    latitude_band,
    presence_flags,
    price_representation,
    source_record_id,
)
from .rules import payer_category, payer_family, rule_case
from .similarity import dice, similarity, trigrams
from .text import (
    clean_double,
    clean_string,
    drop_phrases,
    drop_words,
    normalize_street,
    normalize_text,
    null_outside,
    optional,
    pad_id,
    parse_address,
    slugify,
    title_case,
    zip5,
)

__all__ = [name for name in dir() if not name.startswith("_")]
