"""Summaries that describe a table: per location, per column, per nesting level, per pipeline stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import price_representation
from ..functions.text import clean_string

LOCATION = ["facility_id", "mrf_location_name"]


def location_summary(fact: DataFrame, keys: Sequence[str] = ("system_name", *LOCATION)) -> DataFrame:
    """Rows, forms of price and distinct codes, payers, plans, payer-plan pairs per location.

    Rows are counted by payer, plan and code first, so that the distinct counts do not multiply the fact's rows."""
    counts = {
        "negotiated_rows": F.count(F.lit(1)),
        **{f"rows_with_{k}": F.count_if(f"has_negotiated_{k}") for k in ("dollar", "percentage", "algorithm")},
        "percentage_algorithm_rows": F.count_if(F.col("price_representation") == "percentage_algorithm"),
    }
    reduced = fact.groupBy(*keys, "payer", "plan", "code_1").agg(*[c.alias(n) for n, c in counts.items()])
    return reduced.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in counts],
        F.count_distinct("payer").alias("unique_payers"),
        F.count_distinct("plan").alias("unique_plans"),
        F.count_distinct(F.struct("payer", "plan")).alias("unique_payer_plan_pairs"),
        F.count_distinct("code_1").alias("unique_primary_codes"),
    )


def stage_metrics(normalized: DataFrame, fact: DataFrame, keys: Sequence[str] = tuple(LOCATION)) -> DataFrame:
    """Rows through the stages per location: one aggregation per stage, not one job per location."""
    keys = list(keys)
    before = normalized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("normalized_rows"), F.max("source_row_number").alias("source_rows")
    )
    after = fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("negotiated_price_rows"),
        F.count_if(F.col("price_representation") == "dollar").alias("negotiated_dollar_rows"),
        F.count_if(F.col("price_representation") == "percentage_algorithm").alias("percentage_algorithm_rows"),
    )
    return before.join(after, keys, "left").withColumn(
        "pipeline_complete", F.col("negotiated_price_rows").isNotNull()
    )


def frequencies(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Value counts of several columns in one pass: ``column, value, row_count``; blank values do not count."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("column"), clean_string(c).alias("value"))
            for n, c in columns.items()
        ]
    )
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def profile_table(
    df: DataFrame,
    *,
    prices: Sequence[Column | str],
    payer: str = "payer",
    plan: str = "plan",
    codes: Sequence[Column | str] = (),
) -> DataFrame:
    """One row: rows, coverage per form of price, distinct payers / plans / pairs, most codes on a row."""
    d, p, a = [clean_string(c).isNotNull() for c in prices]
    who, what = clean_string(payer), clean_string(plan)
    pair = F.when(who.isNotNull() | what.isNotNull(), F.struct(who.alias("payer"), what.alias("plan")))
    n_codes = reduce(
        lambda x, y: x + y, [clean_string(c).isNotNull().cast("int") for c in codes], F.lit(0)
    )
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(d | p | a).alias("with_any_price"),
        F.count_if(~(d | p | a)).alias("without_price"),
        F.count_if(d).alias("with_dollar"),
        F.count_if(p).alias("with_percentage"),
        F.count_if(a).alias("with_algorithm"),
        F.count_distinct(who).alias("unique_payers"),
        F.count_distinct(what).alias("unique_plans"),
        F.count_distinct(pair).alias("unique_payer_plan_pairs"),
        F.max(n_codes).alias("max_codes"),
    )


def representation_counts(df: DataFrame, prices: Sequence[Column | str]) -> DataFrame:
    d, p, a = [clean_string(c).isNotNull() for c in prices]
    return df.groupBy(price_representation(d, p, a, "concat", "none").alias("representation")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def key_presence(df: DataFrame, levels: Mapping[str, Column | str], containing: str | None = None) -> DataFrame:
    """How often each key occurs per nesting level: ``level, key, occurrences``.

    A level is a JSON text column with one object per row; ``containing`` keeps keys with that word.
    """
    parts = [
        df.select(F.lit(level).alias("level"), F.explode(F.json_object_keys(c)).alias("key"))
        for level, c in levels.items()
    ]
    keys = reduce(DataFrame.unionByName, parts)
    if containing:
        keys = keys.filter(F.contains(F.lower("key"), F.lit(containing.lower())))
    return keys.groupBy("level", "key").agg(F.count(F.lit(1)).alias("occurrences"))


def child_counts(df: DataFrame, children: Mapping[str, Column | str]) -> DataFrame:
    """Histogram of list sizes: ``relation, children, parents``; a missing list has none."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("relation"),
                F.coalesce(F.array_size(F.col(c) if isinstance(c, str) else c), F.lit(0)).alias("children"),
            )
            for n, c in children.items()
        ]
    )
    return df.select(F.inline(pairs)).groupBy("relation", "children").agg(F.count(F.lit(1)).alias("parents"))


def profile_services(services: DataFrame) -> dict[str, DataFrame]:
    """Profile of nested services (``service`` column): list sizes per level, payer values, frequencies."""
    charges = services.select(F.explode("service.standard_charges").alias("charge"))
    payers = charges.select(F.explode("charge.payers_information").alias("payer"))
    codes = services.select(F.explode("service.code_information").alias("code"))
    return {
        "service_children": child_counts(
            services, {"charges": "service.standard_charges", "codes": "service.code_information"}
        ),
        "charge_children": child_counts(charges, {"payers": "charge.payers_information"}),
        "values": profile_table(
            payers,
            prices=[f"payer.standard_charge_{k}" for k in ("dollar", "percentage", "algorithm")],
            payer="payer.payer_name",
            plan="payer.plan_name",
        ),
        "code_types": frequencies(codes, {"code_type": "code.type"}),
        "settings": frequencies(charges, {"setting": "charge.setting"}),
        "methodologies": frequencies(payers, {"methodology": "payer.methodology"}),
    }
