"""Reports on one system's price fact.

``digits`` rounds the money columns (ratios get one more decimal where the report has it); None leaves all
values as computed.  ``scale`` sums prices as decimals of that scale, see ``functions.exact_mean``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BAND_LATITUDE
from ..functions.aggregates import exact_mean
from ..functions.prices import latitude_band
from ..operators.joins import null_safe_join
from ..operators.ranking import top_k
from ..operators.reshape import complete_pairs, conditional_pivot
from ..operators.rollups import exact_quantiles, share_of_total
from ..operators.sketches import agg_with_quantiles

PROCEDURE = ["code_1_type", "code_1", "description"]
LOCATION = ["facility_id", "mrf_location_name"]
PLANS = {"COMMERCIAL": "commercial", "MEDICARE": "medicare", "MEDICAID": "medicaid"}
_BANDS = {"North": "north", "South": "south"}


def rounded(c: Column | str, digits: int | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if digits is None else F.round(c, digits)


def _more(digits: int | None, extra: int = 1) -> int | None:
    return None if digits is None else digits + extra


def dollar_rows(fact: DataFrame, coded: bool = True) -> DataFrame:
    """Rows with a dollar price (and a procedure code)."""
    rows = fact.filter((F.col("price_representation") == "dollar") & F.col("negotiated_dollar").isNotNull())
    return rows.filter(F.col("code_1").isNotNull()) if coded else rows


def representation_breakdown(fact: DataFrame, digits: int | None = 2) -> DataFrame:
    """Rows and percentage of rows per form of price, most frequent first."""
    shares = share_of_total(fact, ["price_representation"])
    return shares.withColumn("percent_of_total", rounded("percent_of_total", digits)).orderBy(
        F.col("row_count").desc(), "price_representation"
    )


def payer_price_summary(fact: DataFrame, digits: int | None = 2, scale: int | None = None) -> DataFrame:
    """Dollar prices per plan: count, mean, median (exact at any group size), range."""
    price = F.col("negotiated_dollar")
    rows = dollar_rows(fact, coded=False)
    summary = rows.groupBy("plan").agg(
        F.count(F.lit(1)).alias("row_count"),
        rounded(exact_mean(price, scale), digits).alias("avg_negotiated_price"),
        rounded(F.min(price), digits).alias("min_negotiated_price"),
        rounded(F.max(price), digits).alias("max_negotiated_price"),
    )
    medians = exact_quantiles(rows.select("plan", "negotiated_dollar"), ["plan"], "negotiated_dollar", {"median": 0.5})
    return (
        null_safe_join(summary, medians, ["plan"])
        .select(
            "plan", "row_count", "avg_negotiated_price", rounded("median", digits).alias("median_negotiated_price"),
            "min_negotiated_price", "max_negotiated_price",
        )
        .orderBy(F.col("avg_negotiated_price").desc(), "plan")
    )


def plan_comparison(
    fact: DataFrame,
    plans: Mapping[str, str] = PLANS,
    limit: int = 50,
    digits: int | None = 2,
    scale: int | None = None,
) -> DataFrame:
    """Procedures priced under all plans: mean price per plan and the first plan's ratio to each other one."""
    labels = list(plans.values())
    prices = (
        dollar_rows(fact)
        .filter(F.col("plan").isin(*plans))
        .groupBy(*PROCEDURE, "plan")
        .agg(exact_mean("negotiated_dollar", scale).alias("avg_price"))
    )
    sides = complete_pairs(
        conditional_pivot(prices, PROCEDURE, "plan", plans, {"price": "avg_price"}),
        [f"{p}_price" for p in labels[1:]],
    ).filter(F.col(f"{labels[0]}_price").isNotNull())
    first, others = labels[0], labels[1:]
    out = sides.select(
        *PROCEDURE,
        *[rounded(f"{p}_price", digits).alias(f"{p}_price") for p in labels],
        *[
            rounded(F.col(f"{first}_price") / F.col(f"{p}_price"), digits).alias(f"{first}_to_{p}_ratio")
            for p in others
        ],
    )
    return top_k(out, [F.col(f"{first}_to_{others[0]}_ratio").desc(), *[F.col(c) for c in PROCEDURE]], limit)


def price_variation(
    fact: DataFrame,
    min_locations: int = 20,
    min_price: float = 100.0,
    limit: int = 50,
    digits: int | None = 2,
    scale: int | None = None,
) -> DataFrame:
    """Spread of location means per procedure and plan, widest range first."""
    keys = [*PROCEDURE, "payer_plan"]
    locations = (
        dollar_rows(fact)
        .withColumnRenamed("plan", "payer_plan")
        .groupBy(*keys, *LOCATION)
        .agg(exact_mean("negotiated_dollar", scale).alias("price"))
        .filter(F.col("price") > 0)
    )
    groups = (
        locations.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("hospital_count"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            F.avg("price").alias("avg_price"),
            F.stddev_samp("price").alias("price_stddev"),
        )
        .filter((F.col("hospital_count") >= min_locations) & (F.col("avg_price") >= min_price))
    )
    out = groups.select(
        *keys,
        "hospital_count",
        rounded("min_price", digits).alias("min_price"),
        rounded("max_price", digits).alias("max_price"),
        rounded("avg_price", digits).alias("avg_price"),
        rounded(F.col("max_price") - F.col("min_price"), digits).alias("price_range"),
        rounded("price_stddev", digits).alias("price_stddev"),
        rounded(F.try_divide("price_stddev", "avg_price"), _more(digits)).alias("coefficient_of_variation"),
        rounded(F.try_divide("max_price", "min_price"), digits).alias("max_to_min_ratio"),
    )
    return top_k(out, [F.col("price_range").desc(), *[F.col(k) for k in keys]], limit)


def campus_pattern(
    fact: DataFrame,
    locations: DataFrame,
    *,
    code_type: str,
    code: str,
    plan: str,
    attributes: Sequence[str] = ("hcai_city", "latitude"),
    digits: int | None = 2,
    scale: int | None = None,
) -> DataFrame:
    """Mean price of one procedure under one plan by campus, north to south."""
    prices = (
        fact.filter(
            (F.col("price_representation") == "dollar")
            & (F.col("code_1_type") == code_type)
            & (F.col("code_1") == code)
            & (F.col("plan") == plan)
        )
        .groupBy(*LOCATION)
        .agg(rounded(exact_mean("negotiated_dollar", scale), digits).alias("avg_price"))
    )
    return (
        prices.join(locations.select(*LOCATION, *attributes), LOCATION)
        .select(*LOCATION, *attributes, "avg_price")
        .orderBy(F.col("latitude").desc(), *LOCATION)
    )


def _banded(locations: DataFrame, cut: float) -> DataFrame:
    return locations.select(*LOCATION, latitude_band("latitude", cut).alias("band"))


def regional_structure(
    fact: DataFrame, locations: DataFrame, cut: float = BAND_LATITUDE, digits: int | None = 2, scale: int | None = None
) -> DataFrame:
    """Among procedure-plan groups priced at every location: how many have one price per band."""
    keys = ["code_1_type", "code_1", "payer_plan"]
    bands = _banded(locations, cut)
    # pre-aggregated to one row per location before the join
    campus = (
        dollar_rows(fact)
        .withColumnRenamed("plan", "payer_plan")
        .groupBy(*keys, *LOCATION)
        .agg(exact_mean("negotiated_dollar", scale).alias("price"))
        .join(bands, LOCATION)
    )
    per_band = campus.groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("campuses"), F.count_distinct(F.round("price", 2)).alias("prices")
    )
    sides = conditional_pivot(
        per_band, keys, "band", _BANDS, {"campuses": "campuses", "prices": "prices"}
    )
    for band, label in _BANDS.items():
        everywhere = bands.agg(F.count_if(F.col("band") == band)).scalar()
        sides = sides.filter(F.col(f"{label}_campuses") == everywhere)
    fixed = (F.col("north_prices") == 1) & (F.col("south_prices") == 1)
    return sides.agg(
        F.count(F.lit(1)).alias("procedure_plan_groups"),
        F.count_if(fixed).alias("fixed_regional_price_groups"),
        rounded(100 * F.try_divide(F.count_if(fixed), F.count(F.lit(1))), digits).alias("pct_fixed_regional_pattern"),
        F.count_if((F.col("north_prices") > 1) | (F.col("south_prices") > 1)).alias(
            "groups_with_within_region_variation"
        ),
    )


def regional_pairs(fact: DataFrame, locations: DataFrame, cut: float, scale: int | None) -> DataFrame:
    """Procedures and plans with a mean price in both bands."""
    keys = [*PROCEDURE, "payer_plan"]
    price = F.col("negotiated_dollar")
    exact = price if scale is None else price.cast(f"decimal(28,{scale})")
    # sums per location first: the join then touches one row per location, not one per price
    campus = (
        dollar_rows(fact)
        .withColumnRenamed("plan", "payer_plan")
        .groupBy(*keys, *LOCATION)
        .agg(F.sum(exact).alias("total"), F.count(price).alias("n"))
        .join(_banded(locations, cut), LOCATION)
    )
    banded = campus.groupBy(*keys, "band").agg(
        F.try_divide(F.sum("total").cast("double"), F.sum("n")).alias("price")
    )
    sides = conditional_pivot(banded, keys, "band", _BANDS, {"price": "price"})
    return sides.filter(
        F.col("north_price").isNotNull() & F.col("south_price").isNotNull() & (F.col("south_price") > 0)
    )


def regional_difference(
    fact: DataFrame, locations: DataFrame, cut: float = BAND_LATITUDE, digits: int | None = 2, scale: int | None = None
) -> DataFrame:
    """North against south by plan: mean prices, difference, ratio."""
    n, s = F.col("north_price"), F.col("south_price")
    return (
        regional_pairs(fact, locations, cut, scale)
        .groupBy("payer_plan")
        .agg(
            F.count(F.lit(1)).alias("procedure_count"),
            rounded(F.avg(n), digits).alias("avg_north_price"),
            rounded(F.avg(s), digits).alias("avg_south_price"),
            rounded(F.avg(n - s), digits).alias("avg_absolute_difference"),
            rounded(F.avg(F.try_divide(n, s)), _more(digits)).alias("avg_north_to_south_ratio"),
            rounded(100 * F.avg(F.try_divide(n - s, s)), digits).alias("avg_pct_difference"),
        )
        .orderBy(F.col("avg_north_to_south_ratio").desc(), "payer_plan")
    )


def ratio_distribution(
    fact: DataFrame, locations: DataFrame, cut: float = BAND_LATITUDE, digits: int | None = 3, scale: int | None = None
) -> DataFrame:
    """Quartiles and mean of the north/south ratio by plan."""
    ratio = F.try_divide("north_price", "south_price")
    quartiles = {"p25_ratio": 0.25, "median_ratio": 0.5, "p75_ratio": 0.75}
    grouped = agg_with_quantiles(
        regional_pairs(fact, locations, cut, scale),
        ["payer_plan"],
        [F.count(F.lit(1)).alias("procedure_count"), rounded(F.avg(ratio), digits).alias("mean_ratio")],
        {name: (ratio, p) for name, p in quartiles.items()},
    )
    return grouped.select(
        "payer_plan", "procedure_count", *[rounded(c, digits).alias(c) for c in quartiles], "mean_ratio"
    ).orderBy(F.col("median_ratio").desc(), "payer_plan")
