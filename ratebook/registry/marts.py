"""Multi-system tables, marts and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import (
    COMMERCIAL,
    COMPARABLE_CODE_TYPES,
    INPATIENT_CODE_TYPE,
    KNOWN_SETTINGS,
    PAYER_CATEGORY_RULES_CLEANED,
    PAYER_CATEGORY_RULES_RAW,
    PAYER_FAMILY_RULES,
    UNCLASSIFIED,
)
from ..plans import marts as M
from ..plans.warehouse import SystemTable, location_dimension, multisystem_fact
from ..schema import LOCATION_DIMENSION, PRICE_FACT
from . import adapters as A
from .core import register, rules_sql, to_digits
from .reports import MEAN

# --- price fact and dimension over all systems ----------------------------------------------------

# EUROPE publishes wide files, ASIA and AFRICA nested ones, AMERICA and MIDDLE EAST tall ones
_KINDS = {"EUROPE": "wide", "ASIA": "nested", "AMERICA": "tall", "AFRICA": "nested", "MIDDLE EAST": "tall"}


def _n09_sql() -> str:
    def branch(system: str) -> str:
        kind = _KINDS[system]
        own = {
            "source_format": "'JSON'" if kind == "nested" else "'CSV'",
            "mrf_last_updated_on": "mrf_last_updated_on" if kind != "wide" else "NULL",
            "source_service_number": "source_service_number" if kind == "nested" else "NULL",
            "source_charge_number": "source_charge_number" if kind == "nested" else "NULL",
            "source_row_number": "source_service_number" if kind != "nested" else "NULL",
            "source_record_id": {
                "wide": "NULL",
                "nested": "source_service_number || ':' || source_charge_number",
                "tall": "facility_id || '|' || source_service_number",
            }[kind],
            "drug_unit": "regexp_replace(drug_unit::VARCHAR, '\\.0$', '')",
        }
        passed = {
            "system_name", "facility_id", "mrf_location_name", "description", "code_1", "code_1_type", "setting",
            "payer", "plan", "negotiated_dollar", "negotiated_percentage", "negotiated_algorithm",
            "has_negotiated_dollar", "has_negotiated_percentage", "has_negotiated_algorithm",
            "has_negotiated_price", "price_representation",
        }
        kinds = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "boolean": "BOOLEAN"}
        items = []
        for f in PRICE_FACT.fields:
            expr = own.get(f.name) or (f.name if f.name in passed else "NULL")
            items.append(f"CAST({expr} AS {kinds[f.dataType.simpleString()]}) AS {f.name}")
        return f"SELECT {', '.join(items)} FROM fact WHERE system_name = '{system}'"

    return f"WITH {A.FACT_SQL} " + " UNION ALL ".join(branch(s) for s in A.SYSTEMS)


def _systems(spark, sf) -> list[SystemTable]:
    """The systems as they would arrive: each a table with its own format, keys and gaps."""
    ids = ["source_service_number", "source_charge_number"]

    def system(kind: str, table) -> SystemTable:
        if kind == "nested":
            return SystemTable(table.withColumn("source_record_id", F.concat_ws(":", *ids)), {"source_format": "JSON"})
        table = table.withColumnRenamed("source_service_number", "source_row_number").drop("source_charge_number")
        if kind == "wide":
            return SystemTable(table.drop("mrf_last_updated_on"), {"source_format": "CSV"})
        record = F.concat_ws("|", "facility_id", "source_row_number")
        return SystemTable(table.withColumn("source_record_id", record), {"source_format": "CSV"})

    return [system(_KINDS[name], table) for name, table in A.system_facts(spark, sf).items()]


@register("n09_multisystem_fact", _n09_sql())
def n09(spark, sf):
    return multisystem_fact(_systems(spark, sf))


_DIM_SOURCES = {
    "hcai_facility_name": "facility_name",
    "census_zcta_name": "city",
    "hcai_zip_code": "census_zcta",
}
_DIM_FROM_FACT = ("mrf_last_updated_on",)


def _n10_sql() -> str:
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    plain = {
        "system_name", "facility_id", "mrf_location_name", "facility_name", "city", "hcai_city", "county", "hospital_type",
        "hospital_ownership", "overall_rating", "longitude", "latitude", "licensed_beds", "census_zcta",
        "zcta_population", "zcta_median_household_income", "zcta_poverty_rate", "zcta_uninsured_rate",
        "zcta_unemployment_rate", "zcta_bachelors_or_higher_rate",
    }

    def branch(system: str) -> str:
        own = {**_DIM_SOURCES, "state": "'CA'", "analysis_eligible": "TRUE", "census_acs_matched": "census_zcta IS NOT NULL"}
        if _KINDS[system] != "wide":
            own["mrf_last_updated_on"] = "updated"
        items = [
            f"CAST({own.get(f.name) or (f.name if f.name in plain else 'NULL')} AS "
            f"{kinds[f.dataType.simpleString()]}) AS {f.name}"
            for f in LOCATION_DIMENSION.fields
        ]
        return f"SELECT {', '.join(items)} FROM locations LEFT JOIN per_facility USING (facility_id) WHERE system_name = '{system}'"

    return (
        f"WITH {A.FACT_SQL}, per_facility AS (SELECT facility_id, MIN(mrf_last_updated_on) AS updated FROM fact "
        "GROUP BY 1) " + " UNION ALL ".join(branch(s) for s in A.SYSTEMS)
    )


@register("n10_location_dimension", _n10_sql())
def n10(spark, sf):
    literals = {"state": "CA", "analysis_eligible": True}
    places, facts = A.locations(spark, sf), A.system_facts(spark, sf)

    def system(name: str) -> SystemTable:
        wide = _KINDS[name] == "wide"
        return SystemTable(
            places.filter(F.col("system_name") == name),
            literals=literals,
            sources={**_DIM_SOURCES, "census_acs_matched": F.col("census_zcta").isNotNull()},
            fact=None if wide else facts[name],
            fact_attributes=() if wide else _DIM_FROM_FACT,
        )

    return location_dimension([system(s) for s in A.SYSTEMS])


# --- comparable prices ------------------------------------------------------------------------------

_PAYER_TEXT = "upper(concat(payer, ' ', plan))"
_LINE = rules_sql(PAYER_CATEGORY_RULES_CLEANED, f"regexp_replace({_PAYER_TEXT}, '[^A-Z0-9]+', ' ', 'g')", f"'{UNCLASSIFIED}'")
_PRICED = "code_1 IS NOT NULL AND negotiated_dollar > 0"
_MEDIAN = "quantile_disc({}, 0.5)"
# what a location asks for a procedure, and over how many systems and locations the procedure is priced
_OFFER_KEYS = "system_name, facility_id, mrf_location_name, procedure_code_type, procedure_code, comparison_setting, payer_category"

COMPARABLE_SQL = f"""
{A.FACT_SQL},
offers AS (
  SELECT system_name, facility_id, mrf_location_name, kind AS procedure_code_type, code_1 AS procedure_code,
    CASE kind WHEN '{INPATIENT_CODE_TYPE}' THEN 'inpatient'
      ELSE coalesce(list_filter({list(KNOWN_SETTINGS)}, lambda s: s = lower(trim(setting)))[1], 'unknown') END AS comparison_setting,
    {_LINE} AS payer_category, description, payer, plan, negotiated_dollar
  FROM (SELECT *, upper(trim(code_1_type)) AS kind FROM fact) WHERE kind IN {COMPARABLE_CODE_TYPES} AND {_PRICED}
),
comparable AS (
  SELECT m.*, {', '.join(M.LOCATION_ATTRIBUTES)},
    system_count >= 2 AS is_cross_system_comparable, system_count = {len(A.SYSTEMS)} AS is_all_three_systems
  FROM (
    SELECT *, len(list_distinct(list(system_name) OVER everywhere)) AS system_count,
      len(list_distinct(list(facility_id || '|' || mrf_location_name) OVER everywhere)) AS location_count
    FROM (
      SELECT {_OFFER_KEYS}, MIN(description) AS description, COUNT(*) AS source_row_count,
        COUNT(DISTINCT payer) AS raw_payer_count, COUNT(DISTINCT plan) AS raw_plan_count,
        {MEAN} AS mean_negotiated_price, {_MEDIAN.format('negotiated_dollar')} AS median_negotiated_price,
        MIN(negotiated_dollar) AS min_negotiated_price, MAX(negotiated_dollar) AS max_negotiated_price,
        stddev_samp(negotiated_dollar) AS sd_negotiated_price
      FROM offers GROUP BY {_OFFER_KEYS})
    WINDOW everywhere AS (PARTITION BY procedure_code_type, procedure_code, comparison_setting, payer_category)
  ) m LEFT JOIN (SELECT * EXCLUDE (system_name) FROM locations) USING (facility_id, mrf_location_name)
)"""

def _exact_mean(c: str, over: str = "") -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(28,2))) {over} AS DOUBLE) / COUNT({c}) {over}"


_AMONG = "OVER (PARTITION BY msdrg_code, payer_category)"
COMPARISON_SQL = f"""
{COMPARABLE_SQL},
comparison AS (
  SELECT *, median_system_price / matched_group_median_price AS price_index, ln(median_system_price) AS log_price
  FROM (
    SELECT *, {_MEDIAN.format('median_system_price')} {_AMONG} AS matched_group_median_price,
      {_exact_mean('median_system_price', _AMONG)} AS matched_group_mean_price
    FROM (
      SELECT system_name, procedure_code AS msdrg_code, payer_category, MIN(description) AS description,
        COUNT(*) AS location_observations, COUNT(DISTINCT (facility_id, mrf_location_name)) AS location_count,
        {_exact_mean('median_negotiated_price')} AS mean_location_price,
        {_MEDIAN.format('median_negotiated_price')} AS median_system_price,
        MIN(median_negotiated_price) AS min_location_price, MAX(median_negotiated_price) AS max_location_price,
        stddev_samp(median_negotiated_price) AS sd_location_price
      FROM comparable WHERE is_all_three_systems AND procedure_code_type = '{INPATIENT_CODE_TYPE}'
        AND payer_category IN ('Commercial', 'Medicare')
      GROUP BY 1, 2, 3)
    QUALIFY COUNT(*) {_AMONG} = {len(A.SYSTEMS)})
)"""


def comparable(spark, sf):
    return M.comparable_prices(A.price_fact(spark, sf), A.locations(spark, sf), scale=2, all_systems=len(A.SYSTEMS))


def comparison(spark, sf):
    return M.msdrg_comparison(comparable(spark, sf), scale=2, all_systems=len(A.SYSTEMS))


@register(
    "n11_comparable_price_mart",
    f"""WITH {COMPARABLE_SQL}
    SELECT * REPLACE (round(sd_negotiated_price, 6) AS sd_negotiated_price) FROM comparable""",
)
def n11(spark, sf):
    return to_digits(comparable(spark, sf), 6, "sd_negotiated_price")


@register(
    "n12_msdrg_comparison_mart",
    f"""WITH {COMPARISON_SQL}
    SELECT * REPLACE (round(sd_location_price, 6) AS sd_location_price, round(log_price, 9) AS log_price)
    FROM comparison""",
)
def n12(spark, sf):
    out = to_digits(comparison(spark, sf), 6, "sd_location_price")
    return to_digits(out, 9, "log_price")


_LATER = [(b, a) for i, a in enumerate(A.SYSTEMS.values()) for b in list(A.SYSTEMS.values())[i + 1 :]]


@register(
    "n13_msdrg_differences",
    f"""WITH {COMPARISON_SQL},
    prices AS (SELECT msdrg_code, payer_category,
        map_from_entries(list((system_name, median_system_price))) AS price FROM comparison GROUP BY ALL
      HAVING COUNT(*) FILTER (median_system_price > 0) = {len(A.SYSTEMS)}),
    ratios AS (SELECT payer_category, COUNT(*) AS matched_msdrgs,
      {', '.join(f"{_MEDIAN.format(f'price[{chr(39)}{sb}{chr(39)}] / price[{chr(39)}{sa}{chr(39)}]')} AS {b}_{a}"
                 for b, a in _LATER for sb in A.SYSTEMS if A.SYSTEMS[sb] == b for sa in A.SYSTEMS if A.SYSTEMS[sa] == a)}
      FROM prices GROUP BY 1)
    SELECT payer_category, matched_msdrgs, {', '.join(f'{b}_{a} AS median_{b}_vs_{a}_ratio' for b, a in _LATER)},
      {', '.join(f'100 * ({b}_{a} - 1) AS median_{b}_vs_{a}_pct' for b, a in _LATER)} FROM ratios""",
)
def n13(spark, sf):
    return M.msdrg_differences(comparison(spark, sf), A.SYSTEMS, digits=None)


# --- insurer comparison -------------------------------------------------------------------------------

_STAY = "msdrg_code, payer_family, payer_category"
_PLACE = f"system_name, facility_id, mrf_location_name, {_STAY}"
_OF_STAY = f"OVER (PARTITION BY {_STAY})"


def _level(below: str, keys: str, price: str, *more: str) -> str:
    """One level of the rollup: the median of the prices below, so that each member weighs the same."""
    items = [keys, "MIN(description) AS description", f"{_MEDIAN.format(price)} AS price", *more]
    return f"(SELECT {', '.join(items)} FROM {below} GROUP BY {keys})"


_OWN_ROWS = f"""(SELECT system_name, facility_id, mrf_location_name, code_1 AS msdrg_code, description, payer, plan, negotiated_dollar,
    {rules_sql(PAYER_FAMILY_RULES, "upper(payer)")} AS payer_family,
    {rules_sql(PAYER_CATEGORY_RULES_RAW, _PAYER_TEXT, f"'{COMMERCIAL}'")} AS payer_category
  FROM fact WHERE system_name IN {tuple(A.PAIR)} AND upper(trim(code_1_type)) = '{INPATIENT_CODE_TYPE}' AND {_PRICED}
    AND regexp_matches(upper(payer), '{'|'.join(pattern for pattern, _ in PAYER_FAMILY_RULES)}'))"""
_BY_PLAN = _level(_OWN_ROWS, f"{_PLACE}, payer, plan", "negotiated_dollar", "COUNT(*) AS n")
_BY_PLACE = _level(_BY_PLAN, _PLACE, "price", "COUNT(*) AS plans", "SUM(n) AS n")
_BY_SYSTEM = _level(
    _BY_PLACE, f"system_name, {_STAY}", "price", "COUNT(*) AS location_count", "SUM(plans)::BIGINT AS plan_count",
    "SUM(n)::BIGINT AS source_row_count", "AVG(price) AS mean_location_price", "MIN(price) AS min_location_price",
    "MAX(price) AS max_location_price", "stddev_samp(price) AS sd_location_price",
)

INSURER_SQL = f"""
{A.FACT_SQL},
insurer AS (
  SELECT * RENAME (price AS median_system_price), AVG(price) {_OF_STAY} AS pair_mean_price,
    exp(AVG(ln(price)) {_OF_STAY}) AS pair_geometric_mean_price,
    price / exp(AVG(ln(price)) {_OF_STAY}) AS price_index, ln(price) AS log_price
  FROM {_BY_SYSTEM} WHERE price > 0 QUALIFY COUNT(*) {_OF_STAY} = {len(A.PAIR)}
)"""

PAIRED_SQL = f"""
{INSURER_SQL},
paired AS (
  SELECT msdrg_code, payer_family, payer_category, least(e.description, a.description) AS description,
    e.median_system_price AS europe_price, a.median_system_price AS asia_price,
    e.plan_count AS europe_plan_count, a.plan_count AS asia_plan_count,
    e.location_count AS europe_location_count, a.location_count AS asia_location_count,
    europe_price / asia_price AS europe_vs_asia_ratio, 100 * (europe_price / asia_price - 1) AS europe_vs_asia_pct_difference,
    ln(europe_price / asia_price) AS log_price_ratio, europe_price - asia_price AS absolute_price_difference,
    europe_price > asia_price AS europe_higher
  FROM (FROM insurer WHERE system_name = 'EUROPE') e JOIN (FROM insurer WHERE system_name = 'ASIA') a USING ({_STAY})
)"""

_LABELS = tuple(A.PAIR.values())
_DASH = """quantile_disc(europe_vs_asia_ratio, 0.25) AS p25_ratio,
      quantile_disc(europe_vs_asia_ratio, 0.5) AS median_ratio,
      quantile_disc(europe_vs_asia_ratio, 0.75) AS p75_ratio,
      quantile_disc(europe_price, 0.5) AS median_europe_price, quantile_disc(asia_price, 0.5) AS median_asia_price,
      round(exp(AVG(log_price_ratio)), 9) AS geometric_mean_ratio,
      round(100 * (exp(AVG(log_price_ratio)) - 1), 7) AS geometric_mean_pct_difference,
      round(100 * AVG(CAST(europe_higher AS INT)), 9) AS pct_europe_higher"""


def insurer(spark, sf):
    return M.insurer_msdrg(A.price_fact(spark, sf), list(A.PAIR))


def paired(spark, sf):
    return M.paired_differences(insurer(spark, sf), A.PAIR)


def _dash_digits(df):
    df = to_digits(df, 9, "geometric_mean_ratio", "pct_europe_higher")
    return to_digits(df, 7, "geometric_mean_pct_difference")


@register(
    "n14_insurer_msdrg_mart",
    f"""WITH {INSURER_SQL}
    SELECT * REPLACE (round(mean_location_price, 6) AS mean_location_price,
      round(sd_location_price, 6) AS sd_location_price, round(pair_mean_price, 6) AS pair_mean_price,
      round(pair_geometric_mean_price, 6) AS pair_geometric_mean_price, round(price_index, 9) AS price_index,
      round(log_price, 9) AS log_price)
    FROM insurer""",
)
def n14(spark, sf):
    out = to_digits(
        insurer(spark, sf), 6,
        "mean_location_price", "sd_location_price", "pair_mean_price", "pair_geometric_mean_price",
    )
    return to_digits(out, 9, "price_index", "log_price")


@register(
    "n15_insurer_differences",
    f"""WITH {PAIRED_SQL}
    SELECT payer_family, payer_category, COUNT(*) AS matched_msdrgs,
      quantile_disc(europe_price, 0.5) AS median_europe_price, quantile_disc(asia_price, 0.5) AS median_asia_price,
      quantile_disc(europe_vs_asia_ratio, 0.25) AS p25_ratio,
      quantile_disc(europe_vs_asia_ratio, 0.5) AS median_europe_vs_asia_ratio,
      quantile_disc(europe_vs_asia_ratio, 0.75) AS p75_ratio,
      100 * (quantile_disc(europe_vs_asia_ratio, 0.5) - 1) AS median_europe_vs_asia_pct,
      100.0::DOUBLE * COUNT(*) FILTER (europe_price > asia_price) / COUNT(*) AS pct_msdrgs_europe_higher
    FROM paired GROUP BY ALL""",
)
def n15(spark, sf):
    return M.insurer_differences(insurer(spark, sf), A.PAIR, digits=None)


@register(
    "n16_paired_differences",
    f"WITH {PAIRED_SQL} SELECT * REPLACE (round(log_price_ratio, 9) AS log_price_ratio) FROM paired",
)
def n16(spark, sf):
    return to_digits(paired(spark, sf), 9, "log_price_ratio")


@register(
    "n17_dashboard_insurer_summary",
    f"WITH {PAIRED_SQL} SELECT payer_category, payer_family, COUNT(*) AS matched_msdrgs, {_DASH} FROM paired GROUP BY ALL",
)
def n17(spark, sf):
    return _dash_digits(M.dashboard_insurer_summary(paired(spark, sf), _LABELS, digits=None))


@register(
    "n18_dashboard_category_summary",
    f"""WITH {PAIRED_SQL} SELECT payer_category, COUNT(*) AS matched_pairs,
      COUNT(DISTINCT msdrg_code) AS unique_msdrgs, COUNT(DISTINCT payer_family) AS insurer_families, {_DASH}
    FROM paired GROUP BY ALL""",
)
def n18(spark, sf):
    return _dash_digits(M.dashboard_category_summary(paired(spark, sf), _LABELS, digits=None))


@register(
    "n19_dashboard_detail",
    f"""WITH {PAIRED_SQL} SELECT msdrg_code, description, payer_category, payer_family, europe_price, asia_price,
      absolute_price_difference, europe_vs_asia_ratio, europe_vs_asia_pct_difference, europe_higher,
      europe_plan_count, asia_plan_count, europe_location_count, asia_location_count FROM paired""",
)
def n19(spark, sf):
    return M.dashboard_detail(paired(spark, sf), _LABELS, digits=None)
