"""Ordered pattern rules: the first one that matches decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    COMMERCIAL,
    PAYER_CATEGORY_RULES_CLEANED,
    PAYER_CATEGORY_RULES_RAW,
    PAYER_FAMILY_RULES,
    UNCLASSIFIED,
)
from .text import _col

Rules = Sequence[tuple[str, str]]


def rule_case(text: Column | str, rules: Rules, default: Column | str | None = None) -> Column:
    """Label of the first pattern found in ``text``, else ``default``."""
    text = _col(text)
    if not isinstance(default, Column):
        default = F.lit(default)
    branches = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        branches = F.when(hit, label) if branches is None else branches.when(hit, label)
    return default if branches is None else branches.otherwise(default)


def payer_family(payer: Column | str, rules: Rules = PAYER_FAMILY_RULES) -> Column:
    """Insurer family recognized in the payer name, NULL when none is."""
    return rule_case(F.upper(F.coalesce(_col(payer), F.lit(""))), rules)


def _payer_plan_text(payer: Column | str, plan: Column | str) -> Column:
    empty = F.lit("")
    return F.upper(F.concat(F.coalesce(_col(payer), empty), F.lit(" "), F.coalesce(_col(plan), empty)))


def payer_category(
    payer: Column | str,
    plan: Column | str,
    *,
    family: Column | None = None,
    rules: Rules | None = None,
    default: str = UNCLASSIFIED,
) -> Column:
    """Line of business from payer and plan names.

    Without ``family`` the text is matched with punctuation turned into blanks and commercial products are
    recognized by keyword.  With ``family`` the raw text is matched, and a known family that no public
    program rule claimed is commercial.
    """
    text = _payer_plan_text(payer, plan)
    if family is None:
        return rule_case(
            F.regexp_replace(text, "[^A-Z0-9]+", " "), rules or PAYER_CATEGORY_RULES_CLEANED, default
        )
    return rule_case(
        text,
        rules or PAYER_CATEGORY_RULES_RAW,
        F.when(family.isNotNull(), COMMERCIAL).otherwise(default),
    )
