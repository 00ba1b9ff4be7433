"""Comparable-price marts and dashboard tables over all systems.

Systems are given as {value of system_name: label}; labels become column names (``{label}_price``), the first
label is the one compared with the second.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed_values import COMPARABLE_CODE_TYPES, INPATIENT_CODE_TYPE, PAYER_FAMILY_RULES
from ..functions.aggregates import exact_mean, pct_of_rows, quantile
from ..functions.prices import comparison_setting
from ..functions.rules import payer_category, payer_family
from ..operators.reshape import complete_pairs, conditional_pivot
from ..operators.rollups import equal_weight_rollup, with_coverage
from ..operators.sketches import agg_with_quantiles
from .reports import rounded

LOCATION = ["facility_id", "mrf_location_name"]
COMPARABLE = ["procedure_code_type", "procedure_code", "comparison_setting", "payer_category"]
LOCATION_ATTRIBUTES = [
    "facility_name", "city", "county", "latitude", "longitude", "hospital_type", "hospital_ownership",
    "overall_rating", "licensed_beds", "census_zcta", "zcta_population", "zcta_median_household_income",
    "zcta_poverty_rate", "zcta_uninsured_rate", "zcta_unemployment_rate", "zcta_bachelors_or_higher_rate",
]
_QUARTILES = {"_p25": 0.25, "_p50": 0.5, "_p75": 0.75}


def _priced(fact: DataFrame) -> DataFrame:
    price = F.col("negotiated_dollar")
    return fact.filter(
        F.col("has_negotiated_dollar") & price.isNotNull() & (price > 0) & F.col("code_1").isNotNull()
    )


def _code_type() -> Column:
    return F.upper(F.trim("code_1_type"))


def comparable_prices(
    fact: DataFrame,
    locations: DataFrame,
    *,
    code_types: Sequence[str] = COMPARABLE_CODE_TYPES,
    all_systems: int = 3,
    scale: int | None = None,
) -> DataFrame:
    """One row per location, procedure, setting and line of business, with how widely the procedure is priced.

    Prices are reduced to these groups first; location attributes join to the reduced rows.
    """
    price = F.col("negotiated_dollar")
    keys = ["system_name", *LOCATION, *COMPARABLE]
    rows = (
        _priced(fact)
        .filter(_code_type().isin(*code_types))
        .select(
            "system_name",
            *LOCATION,
            _code_type().alias("procedure_code_type"),
            F.col("code_1").alias("procedure_code"),
            comparison_setting("code_1_type", "setting").alias("comparison_setting"),
            payer_category("payer", "plan").alias("payer_category"),
            "description", "payer", "plan", "negotiated_dollar",
        )
    )
    grouped = agg_with_quantiles(
        rows,
        keys,
        [
            F.min("description").alias("description"),
            F.count(F.lit(1)).alias("source_row_count"),
            F.count_distinct("payer").alias("raw_payer_count"),
            F.count_distinct("plan").alias("raw_plan_count"),
            exact_mean(price, scale).alias("mean_negotiated_price"),
            F.min(price).alias("min_negotiated_price"),
            F.max(price).alias("max_negotiated_price"),
            F.stddev_samp(price).alias("sd_negotiated_price"),
        ],
        {"median_negotiated_price": (price, 0.5)},
    )
    attributes = locations.groupBy(*LOCATION).agg(*[F.min(a).alias(a) for a in LOCATION_ATTRIBUTES])
    member = F.concat("facility_id", F.lit("|"), "mrf_location_name")
    measures = [c for c in grouped.columns if c not in keys]
    return (
        with_coverage(grouped, COMPARABLE, "system_name", member, all_systems)
        .join(attributes, LOCATION, "left")
        .select(
            *keys, *measures, *LOCATION_ATTRIBUTES, "system_count", "location_count",
            "is_cross_system_comparable", F.col("is_all_systems").alias("is_all_three_systems"),
        )
    )


def msdrg_comparison(
    comparable: DataFrame,
    *,
    code_type: str = INPATIENT_CODE_TYPE,
    categories: Sequence[str] = ("Commercial", "Medicare"),
    all_systems: int = 3,
    scale: int | None = None,
) -> DataFrame:
    """System-level prices of stays that all systems price, against the median over systems.  ``scale`` takes
    means over decimals."""
    keys = ["msdrg_code", "payer_category"]
    price = F.col("median_negotiated_price")
    stays = comparable.filter(
        (F.col("procedure_code_type") == code_type)
        & F.col("is_all_three_systems")
        & F.col("payer_category").isin(*categories)
    ).withColumnRenamed("procedure_code", "msdrg_code")
    systems = agg_with_quantiles(
        stays,
        ["system_name", *keys],
        [
            F.min("description").alias("description"),
            F.count(F.lit(1)).alias("location_observations"),
            F.count_distinct(F.concat("facility_id", F.lit("|"), "mrf_location_name")).alias("location_count"),
            exact_mean(price, scale).alias("mean_location_price"),
            F.min(price).alias("min_location_price"),
            F.max(price).alias("max_location_price"),
            F.stddev_samp(price).alias("sd_location_price"),
        ],
        {"median_system_price": (price, 0.5)},
    )
    # at most one row per system in a window
    group = W.partitionBy(*keys)
    median = F.col("median_system_price")
    total = F.sum(median if scale is None else median.cast(f"decimal(28,{scale})")).over(group).cast("double")
    return (
        systems.withColumns({
            "_systems": F.count("system_name").over(group),
            "matched_group_median_price": quantile("median_system_price", 0.5).over(group),
            "matched_group_mean_price": F.try_divide(total, F.count(median).over(group)),
        })
        .filter(F.col("_systems") == all_systems)
        .drop("_systems")
        .withColumns({
            "price_index": F.try_divide("median_system_price", "matched_group_median_price"),
            "log_price": F.ln("median_system_price"),
        })
        .select("system_name", *[c for c in systems.columns if c != "system_name"],
                "matched_group_median_price", "matched_group_mean_price", "price_index", "log_price")
    )


def msdrg_differences(comparison: DataFrame, systems: Mapping[str, str], digits: int | None = 3) -> DataFrame:
    """Median pairwise ratios of the systems' prices by line of business; later systems against earlier ones."""
    labels = list(systems.values())
    sides = complete_pairs(
        conditional_pivot(
            comparison, ["msdrg_code", "payer_category"], "system_name", systems, {"price": "median_system_price"}
        ),
        [f"{x}_price" for x in labels],
    )
    pairs = [(b, a) for a in labels for b in labels if labels.index(b) > labels.index(a)]
    grouped = agg_with_quantiles(
        sides,
        ["payer_category"],
        [F.count(F.lit(1)).alias("matched_msdrgs")],
        {f"{b}_{a}": (F.try_divide(f"{b}_price", f"{a}_price"), 0.5) for b, a in pairs},
    )
    pct_digits = None if digits is None else 1
    return grouped.select(
        "payer_category",
        "matched_msdrgs",
        *[rounded(f"{b}_{a}", digits).alias(f"median_{b}_vs_{a}_ratio") for b, a in pairs],
        *[rounded(100 * (F.col(f"{b}_{a}") - 1), pct_digits).alias(f"median_{b}_vs_{a}_pct") for b, a in pairs],
    ).orderBy("payer_category")


def insurer_msdrg(
    fact: DataFrame,
    systems: Sequence[str],
    *,
    code_type: str = INPATIENT_CODE_TYPE,
    family_rules: Sequence[tuple[str, str]] = PAYER_FAMILY_RULES,
    category_rules: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Prices of stays by insurer family, as medians plan -> location -> system, where all systems have one.

    The comparison with the other systems of the same stay, family and category is a window over the
    system-level rows: at most one row per system is in a window.
    """
    match = ["msdrg_code", "payer_family", "payer_category"]
    family = payer_family("payer", family_rules)
    rows = (
        _priced(fact)
        .filter(F.col("system_name").isin(*systems) & (_code_type() == code_type))
        .withColumn("payer_family", family)
        .filter(F.col("payer_family").isNotNull())
        .select(
            "system_name", *LOCATION, F.col("code_1").alias("msdrg_code"), "description", "payer", "plan",
            "negotiated_dollar", "payer_family",
            payer_category("payer", "plan", family=F.col("payer_family"), rules=category_rules).alias(
                "payer_category"
            ),
        )
    )
    location_keys = ["system_name", *LOCATION, *match]
    rolled = equal_weight_rollup(
        rows,
        "negotiated_dollar",
        [
            ("plan", [*location_keys, "payer", "plan"]),
            ("location", location_keys),
            ("system", ["system_name", *match]),
        ],
    )
    group = W.partitionBy(*match)
    price = F.col("median_system_price")
    return (
        rolled.filter(price > 0)
        .withColumns({
            "_systems": F.count(F.lit(1)).over(group),
            "pair_mean_price": F.avg(price).over(group),
            "pair_geometric_mean_price": F.exp(F.avg(F.ln(price)).over(group)),
        })
        .filter(F.col("_systems") == len(systems))
        .select(
            "system_name", *match, "description", "location_count", "plan_count", "source_row_count",
            "mean_location_price", "median_system_price", "min_location_price", "max_location_price",
            "sd_location_price", "pair_mean_price", "pair_geometric_mean_price",
            F.try_divide(price, F.col("pair_geometric_mean_price")).alias("price_index"),
            F.ln(price).alias("log_price"),
        )
    )


def insurer_differences(insurer: DataFrame, systems: Mapping[str, str], digits: int | None = 2) -> DataFrame:
    """First system against second by insurer family and line of business."""
    a, b = systems.values()
    pairs = complete_pairs(
        conditional_pivot(
            insurer, ["msdrg_code", "payer_family", "payer_category"], "system_name", systems,
            {"price": "median_system_price"},
        ),
        [f"{a}_price", f"{b}_price"],
    )
    pa, pb = F.col(f"{a}_price"), F.col(f"{b}_price")
    ratio_digits, pct_digits = (None, None) if digits is None else (3, 1)
    grouped = agg_with_quantiles(
        pairs,
        ["payer_family", "payer_category"],
        [
            F.count(F.lit(1)).alias("matched_msdrgs"),
            rounded(pct_of_rows(pa > pb), pct_digits).alias(f"pct_msdrgs_{a}_higher"),
        ],
        {
            f"median_{a}_price": (pa, 0.5),
            f"median_{b}_price": (pb, 0.5),
            **{name: (F.try_divide(pa, pb), p) for name, p in _QUARTILES.items()},
        },
    )
    q = [F.col(name) for name in _QUARTILES]
    return grouped.select(
        "payer_family", "payer_category", "matched_msdrgs",
        *[rounded(f"median_{label}_price", digits).alias(f"median_{label}_price") for label in (a, b)],
        rounded(q[0], ratio_digits).alias("p25_ratio"),
        rounded(q[1], ratio_digits).alias(f"median_{a}_vs_{b}_ratio"),
        rounded(q[2], ratio_digits).alias("p75_ratio"),
        rounded(100 * (q[1] - 1), pct_digits).alias(f"median_{a}_vs_{b}_pct"),
        f"pct_msdrgs_{a}_higher",
    ).orderBy("payer_category", F.col(f"median_{a}_vs_{b}_ratio").desc(), "payer_family")


def paired_differences(insurer: DataFrame, systems: Mapping[str, str]) -> DataFrame:
    """One row per stay, insurer family and line of business: both prices, counts behind them, differences."""
    a, b = systems.values()
    pairs = conditional_pivot(
        insurer,
        ["msdrg_code", "payer_family", "payer_category"],
        "system_name",
        systems,
        {"price": "median_system_price", "plan_count": "plan_count", "location_count": "location_count"},
        extra=[F.min("description").alias("description")],
    )
    pa, pb = F.col(f"{a}_price"), F.col(f"{b}_price")
    ratio = F.try_divide(pa, pb)
    return complete_pairs(pairs, [f"{a}_price", f"{b}_price"]).withColumns({
        f"{a}_vs_{b}_ratio": ratio,
        f"{a}_vs_{b}_pct_difference": 100 * (ratio - 1),
        "log_price_ratio": F.ln(ratio),
        "absolute_price_difference": pa - pb,
        f"{a}_higher": pa > pb,
    })


def _dashboard(paired: DataFrame, keys: Sequence[str], first: Sequence[Column], labels: Sequence[str], digits):
    a, b = labels
    ratio_digits, pct_digits = (None, None) if digits is None else (3, 1)
    log_ratio = F.avg("log_price_ratio")
    ratios = dict(zip(["p25_ratio", "median_ratio", "p75_ratio"], _QUARTILES.values()))
    prices = [f"median_{a}_price", f"median_{b}_price"]
    grouped = agg_with_quantiles(
        paired,
        keys,
        [
            *first,
            rounded(F.exp(log_ratio), ratio_digits).alias("geometric_mean_ratio"),
            rounded(100 * (F.exp(log_ratio) - 1), pct_digits).alias("geometric_mean_pct_difference"),
            rounded(100 * F.avg(F.col(f"{a}_higher").cast("int")), pct_digits).alias(f"pct_{a}_higher"),
        ],
        {
            **dict(zip(prices, [(f"{a}_price", 0.5), (f"{b}_price", 0.5)])),
            **{name: (f"{a}_vs_{b}_ratio", p) for name, p in ratios.items()},
        },
    )
    return grouped.withColumns({
        **{c: rounded(c, digits) for c in prices}, **{c: rounded(c, ratio_digits) for c in ratios}
    })


def dashboard_insurer_summary(paired: DataFrame, labels: Sequence[str], digits: int | None = 2) -> DataFrame:
    """Paired differences by line of business and insurer family."""
    out = _dashboard(
        paired, ["payer_category", "payer_family"], [F.count(F.lit(1)).alias("matched_msdrgs")], labels, digits
    )
    a, b = labels
    return out.select(
        "payer_category", "payer_family", "matched_msdrgs", f"median_{a}_price", f"median_{b}_price",
        "p25_ratio", "median_ratio", "p75_ratio", "geometric_mean_ratio", "geometric_mean_pct_difference",
        f"pct_{a}_higher",
    )


def dashboard_category_summary(paired: DataFrame, labels: Sequence[str], digits: int | None = 2) -> DataFrame:
    """Paired differences by line of business."""
    first = [
        F.count(F.lit(1)).alias("matched_pairs"),
        F.count_distinct("msdrg_code").alias("unique_msdrgs"),
        F.count_distinct("payer_family").alias("insurer_families"),
    ]
    a, b = labels
    return _dashboard(paired, ["payer_category"], first, labels, digits).select(
        "payer_category", "matched_pairs", "unique_msdrgs", "insurer_families",
        "p25_ratio", "median_ratio", "p75_ratio", "geometric_mean_ratio", "geometric_mean_pct_difference",
        f"pct_{a}_higher", f"median_{a}_price", f"median_{b}_price",
    )


def dashboard_detail(paired: DataFrame, labels: Sequence[str], digits: int | None = 2) -> DataFrame:
    """The paired differences as shown: rounded, without the log ratio."""
    a, b = labels
    ratio_digits, pct_digits = (None, None) if digits is None else (3, 1)
    return paired.select(
        "msdrg_code", "description", "payer_category", "payer_family",
        rounded(f"{a}_price", digits).alias(f"{a}_price"),
        rounded(f"{b}_price", digits).alias(f"{b}_price"),
        rounded("absolute_price_difference", digits).alias("absolute_price_difference"),
        rounded(f"{a}_vs_{b}_ratio", ratio_digits).alias(f"{a}_vs_{b}_ratio"),
        rounded(f"{a}_vs_{b}_pct_difference", pct_digits).alias(f"{a}_vs_{b}_pct_difference"),
        f"{a}_higher", f"{a}_plan_count", f"{b}_plan_count", f"{a}_location_count", f"{b}_location_count",
    )
