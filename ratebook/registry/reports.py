"""Reports on the price fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import reports as R
from . import adapters as A
from .core import register, to_digits

MEAN = "CAST(SUM(CAST(negotiated_dollar AS DECIMAL(28,2))) AS DOUBLE) / COUNT(negotiated_dollar)"
_DOLLAR = "price_representation = 'dollar' AND negotiated_dollar IS NOT NULL"
_BAND = "CASE WHEN latitude >= 35 THEN 'North' ELSE 'South' END"

_REGIONAL_SQL = f"""
WITH {A.FACT_SQL},
paired AS (
  SELECT code_1_type, code_1, description, plan AS payer_plan,
    CAST(SUM(CASE WHEN latitude >= 35 THEN CAST(negotiated_dollar AS DECIMAL(28,2)) END) AS DOUBLE)
      / NULLIF(COUNT(*) FILTER (latitude >= 35), 0) AS north_price,
    CAST(SUM(CASE WHEN NOT latitude >= 35 THEN CAST(negotiated_dollar AS DECIMAL(28,2)) END) AS DOUBLE)
      / NULLIF(COUNT(*) FILTER (NOT latitude >= 35), 0) AS south_price
  FROM fact JOIN locations USING (facility_id, mrf_location_name)
  WHERE {_DOLLAR} AND code_1 IS NOT NULL
  GROUP BY ALL
),
sides AS (SELECT * FROM paired WHERE north_price IS NOT NULL AND south_price > 0)
"""


@register(
    "n01_representation_breakdown",
    f"""WITH {A.FACT_SQL}
    SELECT price_representation, COUNT(*) AS row_count,
      100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM fact) AS percent_of_total
    FROM fact GROUP BY 1""",
)
def n01(spark, sf):
    return R.representation_breakdown(A.price_fact(spark, sf), digits=None)


@register(
    "n02_payer_price_summary",
    f"""WITH {A.FACT_SQL}
    SELECT plan, COUNT(*) AS row_count, {MEAN} AS avg_negotiated_price,
      quantile_disc(negotiated_dollar, 0.5) AS median_negotiated_price,
      MIN(negotiated_dollar) AS min_negotiated_price, MAX(negotiated_dollar) AS max_negotiated_price
    FROM fact WHERE {_DOLLAR} GROUP BY plan""",
)
def n02(spark, sf):
    return R.payer_price_summary(A.price_fact(spark, sf), digits=None, scale=2)


@register(
    "n03_plan_comparison",
    f"""WITH {A.FACT_SQL},
    prices AS (SELECT code_1_type, code_1, description, plan, {MEAN} AS price
      FROM fact WHERE {_DOLLAR} AND code_1 IS NOT NULL GROUP BY ALL),
    sides AS (SELECT code_1_type, code_1, description,
        MAX(price) FILTER (plan = 'COMMERCIAL') AS commercial_price,
        MAX(price) FILTER (plan = 'MEDICARE') AS medicare_price,
        MAX(price) FILTER (plan = 'MEDICAID') AS medicaid_price
      FROM prices GROUP BY ALL)
    SELECT *, commercial_price / medicare_price AS commercial_to_medicare_ratio,
      commercial_price / medicaid_price AS commercial_to_medicaid_ratio
    FROM sides WHERE commercial_price IS NOT NULL AND medicare_price > 0 AND medicaid_price > 0
    ORDER BY commercial_to_medicare_ratio DESC, code_1_type, code_1, description LIMIT 50""",
)
def n03(spark, sf):
    return R.plan_comparison(A.price_fact(spark, sf), digits=None, scale=2)


@register(
    "n04_price_variation",
    f"""WITH {A.FACT_SQL},
    places AS (SELECT code_1_type, code_1, description, plan AS payer_plan, facility_id, mrf_location_name,
        {MEAN} AS price
      FROM fact WHERE {_DOLLAR} AND code_1 IS NOT NULL GROUP BY ALL),
    spread AS (SELECT code_1_type, code_1, description, payer_plan, COUNT(*) AS hospital_count,
        MIN(price) AS min_price, MAX(price) AS max_price, AVG(price) AS avg_price,
        STDDEV_SAMP(price) AS price_stddev
      FROM places WHERE price > 0 GROUP BY ALL HAVING COUNT(*) >= 2 AND AVG(price) >= 100)
    SELECT code_1_type, code_1, description, payer_plan, hospital_count, min_price, max_price,
      round(avg_price, 6) AS avg_price, max_price - min_price AS price_range,
      round(price_stddev, 6) AS price_stddev,
      round(price_stddev / avg_price, 6) AS coefficient_of_variation,
      max_price / min_price AS max_to_min_ratio
    FROM spread
    ORDER BY max_price - min_price DESC, code_1_type, code_1, description, payer_plan LIMIT 50""",
)
def n04(spark, sf):
    out = R.price_variation(A.price_fact(spark, sf), min_locations=2, digits=None, scale=2)
    return to_digits(out, 6, "avg_price", "price_stddev", "coefficient_of_variation")


@register(
    "n05_campus_pattern",
    f"""WITH {A.FACT_SQL}
    SELECT facility_id, mrf_location_name, hcai_city, latitude, {MEAN} AS avg_price
    FROM fact JOIN locations USING (facility_id, mrf_location_name)
    WHERE price_representation = 'dollar' AND code_1_type = 'MS-DRG' AND code_1 = 'Brand#18'
      AND plan = 'COMMERCIAL'
    GROUP BY ALL""",
)
def n05(spark, sf):
    return R.campus_pattern(
        A.price_fact(spark, sf), A.locations(spark, sf),
        code_type="MS-DRG", code="Brand#18", plan="COMMERCIAL", digits=None, scale=2,
    )


@register(
    "n06_regional_structure",
    f"""WITH {A.FACT_SQL},
    campus AS (SELECT code_1_type, code_1, plan AS payer_plan, {_BAND} AS band, city, {MEAN} AS price
      FROM fact JOIN locations USING (facility_id, mrf_location_name)
      WHERE {_DOLLAR} AND code_1 IS NOT NULL GROUP BY ALL),
    per_band AS (SELECT code_1_type, code_1, payer_plan, band, COUNT(*) AS campuses,
        COUNT(DISTINCT round(price, 2)) AS prices FROM campus GROUP BY ALL),
    sides AS (SELECT code_1_type, code_1, payer_plan,
        MAX(campuses) FILTER (band = 'North') AS nc, MAX(campuses) FILTER (band = 'South') AS sc,
        MAX(prices) FILTER (band = 'North') AS np, MAX(prices) FILTER (band = 'South') AS sp
      FROM per_band GROUP BY ALL)
    SELECT COUNT(*) AS procedure_plan_groups,
      COUNT(*) FILTER (np = 1 AND sp = 1) AS fixed_regional_price_groups,
      100 * (COUNT(*) FILTER (np = 1 AND sp = 1))::DOUBLE / NULLIF(COUNT(*), 0) AS pct_fixed_regional_pattern,
      COUNT(*) FILTER (np > 1 OR sp > 1) AS groups_with_within_region_variation
    FROM sides
    WHERE nc = (SELECT COUNT(DISTINCT city) FROM locations WHERE latitude >= 35)
      AND sc = (SELECT COUNT(DISTINCT city) FROM locations WHERE NOT latitude >= 35)""",
)
def n06(spark, sf):
    # cities are the campuses here: no procedure is priced by every single supplier
    places = A.locations(spark, sf)
    city = places.select("facility_id", F.col("city").alias("campus"))
    fact = A.price_fact(spark, sf).join(city, "facility_id").withColumns(
        {"facility_id": F.col("campus"), "mrf_location_name": F.col("campus")}
    )
    campuses = places.select(
        F.col("city").alias("facility_id"), F.col("city").alias("mrf_location_name"), "latitude"
    ).distinct()
    return R.regional_structure(fact, campuses, digits=None, scale=2)


@register(
    "n07_regional_difference",
    f"""{_REGIONAL_SQL}
    SELECT payer_plan, COUNT(*) AS procedure_count,
      round(AVG(north_price), 6) AS avg_north_price, round(AVG(south_price), 6) AS avg_south_price,
      round(AVG(north_price - south_price), 6) AS avg_absolute_difference,
      round(AVG(north_price / south_price), 6) AS avg_north_to_south_ratio,
      round(100 * AVG((north_price - south_price) / south_price), 6) AS avg_pct_difference
    FROM sides GROUP BY payer_plan""",
)
def n07(spark, sf):
    out = R.regional_difference(A.price_fact(spark, sf), A.locations(spark, sf), digits=None, scale=2)
    return to_digits(out, 6, *out.columns[2:])


@register(
    "n08_ratio_distribution",
    f"""{_REGIONAL_SQL}
    SELECT payer_plan, COUNT(*) AS procedure_count,
      quantile_disc(north_price / south_price, 0.25) AS p25_ratio,
      quantile_disc(north_price / south_price, 0.5) AS median_ratio,
      quantile_disc(north_price / south_price, 0.75) AS p75_ratio,
      round(AVG(north_price / south_price), 6) AS mean_ratio
    FROM sides GROUP BY payer_plan""",
)
def n08(spark, sf):
    out = R.ratio_distribution(A.price_fact(spark, sf), A.locations(spark, sf), digits=None, scale=2)
    return to_digits(out, 6, "mean_ratio")
