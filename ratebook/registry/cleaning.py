"""Column expressions and register cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import COMMERCIAL, PAYER_CATEGORY_RULES_RAW, PAYER_FAMILY_RULES, UNCLASSIFIED
from ..functions import (
    all_codes_json,
    clean_double,
    clean_string,
    collect_codes,
    comparison_setting,
    drop_phrases,
    drop_words,
    latitude_band,
    normalize_street,
    normalize_text,
    null_outside,
    optional,
    pad_id,
    parse_address,
    payer_category,
    payer_family,
    presence_flags,
    price_representation,
    slugify,
    source_record_id,
    title_case,
    zip5,
)
from ..plans import facilities
from . import adapters as A
from .core import register, rules_sql
from .marts import _LINE, _PAYER_TEXT

# --- text and numbers ---------------------------------------------------------------------------------

_MESSY_SQL = """
messy AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN ' $' || c_acctbal WHEN 1 THEN c_acctbal || '% '
  WHEN 2 THEN '   ' WHEN 3 THEN 'N/A' WHEN 4 THEN '1,0' || c_custkey || '.50' WHEN 5 THEN c_acctbal || 'd'
  ELSE c_mktsegment END AS txt FROM customer)"""


def _messy(spark, sf):
    key, bal = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    text = (
        F.when(key % 7 == 0, F.concat(F.lit(" $"), bal))
        .when(key % 7 == 1, F.concat(bal, F.lit("% ")))
        .when(key % 7 == 2, "   ")
        .when(key % 7 == 3, "N/A")
        .when(key % 7 == 4, F.concat(F.lit("1,0"), key, F.lit(".50")))
        .when(key % 7 == 5, F.concat(bal, F.lit("d")))
        .otherwise(F.col("c_mktsegment"))
    )
    return A.table(spark, sf, "customer").select("c_custkey", text.alias("txt"))


@register(
    "clean_strings_numbers",
    f"""WITH {_MESSY_SQL}
    SELECT c_custkey, nullif(trim(txt), '') AS text_value,
      CASE WHEN regexp_full_match(regexp_replace(trim(txt), '[$,%]', '', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')
        THEN CAST(regexp_replace(trim(txt), '[$,%]', '', 'g') AS DOUBLE) END AS number_value,
      CAST(NULL AS DOUBLE) AS absent_value
    FROM messy""",
)
def clean_strings_numbers(spark, sf):
    df = _messy(spark, sf)
    return df.select(
        "c_custkey",
        clean_string("txt").alias("text_value"),
        clean_double("txt").alias("number_value"),
        optional(df, "standard_charge|gross", "double").alias("absent_value"),
    )


@register(
    "pad_zip_title_slug",
    """SELECT page_id,
      CASE WHEN length(page_id::VARCHAR) < 3 THEN lpad(page_id::VARCHAR, 3, '0') ELSE page_id::VARCHAR END AS padded,
      CASE WHEN length(regexp_replace(z, '[^0-9]', '', 'g')) >= 5
        THEN substr(regexp_replace(z, '[^0-9]', '', 'g'), 1, 5) END AS zip_digits,
      nullif(regexp_extract(z, '([0-9]{5})', 1), '') AS zip_pattern,
      CASE WHEN length(substr(z, 1, 5)) < 5 THEN lpad(substr(z, 1, 5), 5, '0') ELSE substr(z, 1, 5) END AS zip_prefix,
      list_aggregate(list_transform(regexp_extract_all(lower(url), '([a-z]+|[^a-z]+)', 1),
        lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS titled,
      trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug
    FROM (SELECT page_id, url, (page_id * 379) || '-' || (page_id * 7919 % 100000) AS z FROM pages)""",
)
def pad_zip_title_slug(spark, sf):
    key = F.col("page_id")
    z = F.concat((key * 379).cast("string"), F.lit("-"), (key * 7919 % 100000).cast("string"))
    return (
        A.table(spark, sf, "pages")
        .select("page_id", "url", z.alias("z"))
        .select(
            "page_id",
            pad_id(key.cast("string"), 3).alias("padded"),
            zip5("z", "digits").alias("zip_digits"),
            zip5("z", "pattern").alias("zip_pattern"),
            zip5("z", "prefix").alias("zip_prefix"),
            title_case("url").alias("titled"),
            slugify("url").alias("slug"),
        )
    )


_ADDRESS_SQL = """
addressed AS (SELECT p_partkey, 'Kaiser Foundation Hospital - ' || p_name || ' & ' || p_brand AS hospital,
  CASE p_partkey % 4 WHEN 0 THEN NULL
    WHEN 1 THEN '"' || p_partkey || ' North ' || p_name || ' Street, ' || p_type || ', CA ' || (90000 + p_size) || '"'
    WHEN 2 THEN p_partkey || ' ' || p_name || ' Blvd., Suite ' || p_size || ', ' || p_type || ', CA ' || (90000 + p_size) || '-1234'
    ELSE p_size || ' ' || p_name || ' parkway' END AS address
  FROM part)"""


def _norm_sql(c: str, ampersand: bool) -> str:
    c = f"upper({c})"
    if ampersand:
        c = f"replace({c}, '&', ' AND ')"
    return f"trim(regexp_replace({c}, '[^A-Z0-9]+', ' ', 'g'))"


_TOKENS_SQL = " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in facilities.V.STREET_ABBREVIATIONS.items()
)


def _street_sql(c: str) -> str:
    words = f"string_split(coalesce({_norm_sql(c, False)}, ''), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: CASE w {_TOKENS_SQL} ELSE w END), ' ')"


def _phrases_sql(c: str) -> str:
    c = f"coalesce({_norm_sql(c, False)}, '')"
    for p in facilities.V.GENERIC_PHRASES:
        c = f"replace({c}, '{p}', ' ')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"


def _words_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in facilities.V.GENERIC_WORDS)
    words = f"string_split(coalesce({_norm_sql(c, True)}, ''), ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ({stop})), ' ')"


def _addressed(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    zone = (90000 + F.col("p_size")).cast("string")
    address = (
        F.when(F.col("p_partkey") % 4 == 0, F.lit(None).cast("string"))
        .when(
            F.col("p_partkey") % 4 == 1,
            F.concat(F.lit('"'), key, F.lit(" North "), "p_name", F.lit(" Street, "), "p_type", F.lit(", CA "), zone, F.lit('"')),
        )
        .when(
            F.col("p_partkey") % 4 == 2,
            F.concat(key, F.lit(" "), "p_name", F.lit(" Blvd., Suite "), size, F.lit(", "), "p_type", F.lit(", CA "), zone, F.lit("-1234")),
        )
        .otherwise(F.concat(size, F.lit(" "), "p_name", F.lit(" parkway")))
    )
    hospital = F.concat(F.lit("Kaiser Foundation Hospital - "), "p_name", F.lit(" & "), "p_brand")
    return A.table(spark, sf, "part").select("p_partkey", hospital.alias("hospital"), address.alias("address"))


@register(
    "normalize_names_addresses",
    f"""WITH {_ADDRESS_SQL}
    SELECT p_partkey, {_norm_sql('hospital', True)} AS name_text, {_norm_sql('address', True)} AS address_text,
      {_street_sql('address')} AS street_text, {_phrases_sql('hospital')} AS without_phrases,
      {_words_sql('hospital')} AS without_words
    FROM addressed""",
)
def normalize_names_addresses(spark, sf):
    return _addressed(spark, sf).select(
        "p_partkey",
        normalize_text("hospital").alias("name_text"),
        normalize_text("address").alias("address_text"),
        normalize_street("address").alias("street_text"),
        drop_phrases("hospital", facilities.V.GENERIC_PHRASES).alias("without_phrases"),
        drop_words("hospital", facilities.V.GENERIC_WORDS).alias("without_words"),
    )


@register(
    "parse_addresses",
    f"""WITH {_ADDRESS_SQL},
    split AS (SELECT p_partkey, trim(trim(coalesce(address, '')), '"') AS txt,
      list_transform(string_split(trim(trim(coalesce(address, '')), '"'), ','), lambda p: trim(p)) AS parts FROM addressed)
    SELECT p_partkey, parts[1] AS street, CASE WHEN len(parts) >= 3 THEN parts[-2] ELSE '' END AS city,
      regexp_extract(txt, '\\b([0-9]{{5}})(?:-[0-9]{{4}})?\\b', 1) AS zip
    FROM split""",
)
def parse_addresses(spark, sf):
    parsed = _addressed(spark, sf).select("p_partkey", parse_address(F.coalesce("address", F.lit(""))).alias("a"))
    return parsed.select("p_partkey", "a.street", "a.city", "a.zip")


@register(
    "null_sentinels",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS amount,
      CASE WHEN c_acctbal / 50 BETWEEN 0 AND 100 THEN c_acctbal / 50 END AS rate FROM customer""",
)
def null_sentinels(spark, sf):
    return A.table(spark, sf, "customer").select(
        "c_custkey",
        null_outside("c_acctbal", 0.0).alias("amount"),
        null_outside(F.col("c_acctbal") / 50, 0.0, 100.0).alias("rate"),
    )


# --- prices -------------------------------------------------------------------------------------------


@register(
    "representation_modes",
    f"""WITH {A.RAW_PRICES_SQL}
    SELECT negotiated_dollar IS NOT NULL AS has_negotiated_dollar,
      negotiated_percentage IS NOT NULL AS has_negotiated_percentage,
      negotiated_algorithm IS NOT NULL AS has_negotiated_algorithm,
      negotiated_dollar IS NOT NULL OR negotiated_percentage IS NOT NULL OR negotiated_algorithm IS NOT NULL
        AS has_negotiated_price,
      CASE WHEN negotiated_dollar IS NOT NULL THEN 'dollar'
        WHEN negotiated_percentage IS NOT NULL AND negotiated_algorithm IS NOT NULL THEN 'percentage_algorithm'
        WHEN negotiated_percentage IS NOT NULL THEN 'percentage'
        WHEN negotiated_algorithm IS NOT NULL THEN 'algorithm' ELSE 'unknown' END AS by_precedence,
      coalesce(nullif(concat_ws('_', CASE WHEN negotiated_dollar IS NOT NULL THEN 'dollar' END,
        CASE WHEN negotiated_percentage IS NOT NULL THEN 'percentage' END,
        CASE WHEN negotiated_algorithm IS NOT NULL THEN 'algorithm' END), ''), 'none') AS joined,
      COUNT(*) AS row_count
    FROM raw_prices GROUP BY ALL""",
)
def representation_modes(spark, sf):
    flags = [f"has_negotiated_{k}" for k in ("dollar", "percentage", "algorithm")]
    return (
        presence_flags(A.raw_prices(spark, sf))
        .groupBy(*flags, "has_negotiated_price")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumns({
            "by_precedence": price_representation(*flags, mode="precedence", empty="unknown"),
            "joined": price_representation(*flags, mode="concat", empty="none"),
        })
    )


@register(
    "payer_rules",
    f"""WITH {A.RAW_PRICES_SQL},
    t AS (SELECT *, {rules_sql(PAYER_FAMILY_RULES, 'upper(payer)')} AS payer_family
      FROM raw_prices JOIN (SELECT facility_id, latitude FROM locations) USING (facility_id))
    SELECT payer, plan, payer_family, {_LINE} AS category_cleaned,
      {rules_sql(PAYER_CATEGORY_RULES_RAW, _PAYER_TEXT,
                 f"CASE WHEN payer_family IS NULL THEN '{UNCLASSIFIED}' ELSE '{COMMERCIAL}' END")} AS category_raw,
      CASE WHEN upper(trim(code_1_type)) = 'MS-DRG' THEN 'inpatient'
        WHEN lower(setting) IN ('inpatient', 'outpatient', 'both') THEN lower(setting) ELSE 'unknown' END
        AS comparison_setting,
      CASE WHEN latitude >= 35 THEN 'North' ELSE 'South' END AS band, COUNT(*) AS row_count
    FROM t GROUP BY ALL""",
)
def payer_rules(spark, sf):
    rows = A.raw_prices(spark, sf).join(A.locations(spark, sf).select("facility_id", "latitude"), "facility_id")
    family = payer_family("payer")
    # few distinct names: classified after counting
    return (
        rows.groupBy(
            "payer", "plan", comparison_setting("code_1_type", "setting").alias("comparison_setting"),
            latitude_band("latitude").alias("band"),
        )
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumns({
            "payer_family": family,
            "category_cleaned": payer_category("payer", "plan"),
            "category_raw": payer_category("payer", "plan", family=family),
        })
    )


@register(
    "collect_codes",
    """WITH slots AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END AS c1, p_type AS t1,
        CASE WHEN p_size % 2 = 0 THEN p_name END AS c2, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'NAME' END AS t2,
        CASE WHEN p_size % 5 = 0 THEN '' ELSE p_size::VARCHAR END AS c3, 'SIZE' AS t3 FROM part),
    listed AS (SELECT p_partkey, list_filter([{'code': nullif(trim(c1), ''), 'type': nullif(trim(t1), '')},
        {'code': nullif(trim(c2), ''), 'type': nullif(trim(t2), '')},
        {'code': nullif(trim(c3), ''), 'type': nullif(trim(t3), '')}], lambda s: s.code IS NOT NULL) AS codes FROM slots)
    SELECT p_partkey, codes[1].code AS code_1, codes[1].type AS code_1_type, codes[2].code AS code_2,
      codes[2].type AS code_2_type, CAST(to_json(codes) AS VARCHAR) AS all_codes_json,
      p_partkey || ':' || len(codes) || ':1' AS source_record_id
    FROM listed""",
)
def collect_codes_query(spark, sf):
    size = F.col("p_size")
    pairs = [
        (F.when(size % 3 == 0, " ").otherwise(F.col("p_brand")), F.col("p_type")),
        (F.when(size % 2 == 0, F.col("p_name")), F.when(size % 4 == 0, "").otherwise("NAME")),
        (F.when(size % 5 == 0, "").otherwise(size.cast("string")), F.lit("SIZE")),
    ]
    listed = A.table(spark, sf, "part").select("p_partkey", collect_codes(pairs).alias("codes"))
    first, second = F.get("codes", F.lit(0)), F.get("codes", F.lit(1))
    return listed.select(
        "p_partkey",
        first["code"].alias("code_1"), first["type"].alias("code_1_type"),
        second["code"].alias("code_2"), second["type"].alias("code_2_type"),
        all_codes_json("codes").alias("all_codes_json"),
        source_record_id("p_partkey", F.size("codes"), F.lit(1)).alias("source_record_id"),
    )


# --- registers ----------------------------------------------------------------------------------------

_TYPES = ["Acute Care Hospitals", "Critical Access Hospitals", "Psychiatric", "Childrens",
          "Acute Care - Veterans Administration"]


def _cycle(c, values):
    out = None
    for i, v in enumerate(values):
        out = F.when(c % len(values) == i, v) if out is None else out.when(c % len(values) == i, v)
    return out


def _cycle_sql(c, values):
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {c} % {len(values)} {whens} END"


def hospital_register(spark, sf):
    """Customers as a raw hospital register; every 10th appears twice."""
    key = F.col("c_custkey")
    raw = A.table(spark, sf, "customer").select(
        (key - F.when(key % 10 == 9, 1).otherwise(0)).cast("string").alias("facility_id"),
        F.concat(F.lit(" o'"), F.lower("c_name"), F.lit(" ")).alias("facility_name"),
        F.concat(key.cast("string"), F.lit(" main st")).alias("address"),
        F.lower("c_mktsegment").alias("citytown"),
        F.lit("CA").alias("state"),
        (F.col("c_nationkey") * 1000 + 7).cast("string").alias("zip_code"),
        F.lower("c_mktsegment").alias("countyparish"),
        F.lit(None).cast("string").alias("telephone_number"),
        _cycle(key, _TYPES).alias("hospital_type"),
        F.lit("Proprietary").alias("hospital_ownership"),
        F.lit("Yes").alias("emergency_services"),
        F.when(key % 3 == 0, "Not Available").otherwise((key % 5 + 1).cast("string")).alias(
            "hospital_overall_rating"
        ),
    )
    return raw


@register(
    "clean_hospital_register",
    f"""WITH raw AS (SELECT c_custkey, (c_custkey - CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END)::VARCHAR AS id,
        {_cycle_sql('c_custkey', _TYPES)} AS hospital_type, * FROM customer),
    typed AS (SELECT CASE WHEN length(id) < 6 THEN lpad(id, 6, '0') ELSE id END AS facility_id,
        list_aggregate(list_transform(regexp_extract_all('o''' || lower(c_name), '([a-z]+|[^a-z]+)', 1),
          lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS facility_name,
        c_custkey || ' main st' AS address,
        upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS city, 'CA' AS state,
        lpad((c_nationkey * 1000 + 7)::VARCHAR, 5, '0') AS zip_code,
        upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS county, CAST(NULL AS VARCHAR) AS telephone_number,
        hospital_type, 'Proprietary' AS hospital_ownership, 'Yes' AS emergency_services,
        CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 5 + 1)::DOUBLE END AS overall_rating,
        hospital_type IN ('Acute Care Hospitals', 'Critical Access Hospitals') AS analysis_eligible,
        CASE hospital_type WHEN 'Psychiatric' THEN 'Psychiatric hospital' WHEN 'Childrens' THEN 'Children''s hospital'
          WHEN 'Acute Care - Veterans Administration' THEN 'Veterans Administration hospital' END AS exclusion_reason
      FROM raw)
    SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY facility_name) = 1""",
)
def clean_hospital_register(spark, sf):
    return facilities.clean_hospitals(hospital_register(spark, sf))


_LEVELS = ["Parent Facility", "Distinct Part Unit", "Consolidated Facility"]


def registry_raw(spark, sf):
    """Suppliers as a raw facility registry."""
    key = F.col("s_suppkey")
    return A.table(spark, sf, "supplier").select(
        key.cast("string").alias("oshpd_id"),
        F.upper("s_name").alias("facility_desc"),
        F.concat((key * 3).cast("string"), F.lit(" Oak Avenue ")).alias("site_address1"),
        F.concat(F.lit("City "), F.col("s_nationkey")).alias("site_city"),
        F.concat((F.col("s_nationkey") * 1000).cast("string"), F.lit("-1234")).alias("site_zip"),
        F.when(key % 5 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("site_x_coordinate"),
        F.col("s_acctbal").cast("string").alias("site_y_coordinate"),
        F.when(key % 11 == 0, "Clinic").otherwise("Hospital").alias("license_type_desc"),
        F.when(key % 6 == 0, "Acute Psychiatric Hospital").otherwise("General Acute Care Hospital").alias(
            "license_category_desc"
        ),
        _cycle(key, _LEVELS).alias("facility_level_desc"),
        F.lit("Basic").alias("er_service_level_desc"),
        (key % 300).cast("string").alias("licensed_beds"),
        F.when(key % 13 == 0, "Closed").otherwise("Open").alias("facility_status_desc"),
    )


@register(
    "clean_facility_registry",
    f"""WITH t AS (SELECT CASE WHEN length(s_suppkey::VARCHAR) < 9 THEN lpad(s_suppkey::VARCHAR, 9, '0')
        ELSE s_suppkey::VARCHAR END AS hcai_id, upper(s_name) AS facility_name, (s_suppkey * 3) || ' Oak Avenue' AS address,
        'City ' || s_nationkey AS city,
        CASE WHEN length(substr((s_nationkey * 1000) || '-1234', 1, 5)) < 5
          THEN lpad(substr((s_nationkey * 1000) || '-1234', 1, 5), 5, '0')
          ELSE substr((s_nationkey * 1000) || '-1234', 1, 5) END AS zip_code,
        CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS longitude, s_acctbal AS latitude,
        CASE WHEN s_suppkey % 11 = 0 THEN 'Clinic' ELSE 'Hospital' END AS license_type,
        CASE WHEN s_suppkey % 6 = 0 THEN 'Acute Psychiatric Hospital' ELSE 'General Acute Care Hospital' END
          AS license_category,
        {_cycle_sql('s_suppkey', _LEVELS)} AS facility_level, 'Basic' AS er_service_level,
        (s_suppkey % 300)::DOUBLE AS licensed_beds,
        CASE WHEN s_suppkey % 13 = 0 THEN 'Closed' ELSE 'Open' END AS facility_status FROM supplier)
    SELECT *, license_category = 'General Acute Care Hospital' AND facility_status = 'Open'
      AND facility_level IN ('Parent Facility', 'Consolidated Facility') AS match_candidate
    FROM t WHERE license_type = 'Hospital'""",
)
def clean_facility_registry(spark, sf):
    return facilities.clean_registry(registry_raw(spark, sf))


@register(
    "clean_zone_features",
    """SELECT CASE WHEN length(c_custkey::VARCHAR) < 5 THEN lpad(c_custkey::VARCHAR, 5, '0') ELSE c_custkey::VARCHAR END AS zcta,
      c_name AS zcta_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS population,
      CASE WHEN c_custkey % 9 <> 0 THEN 50000.0::DOUBLE + c_custkey END AS median_household_income,
      CASE WHEN c_acctbal / 50 BETWEEN 0 AND 100 THEN c_acctbal / 50 END AS poverty_rate,
      CAST(NULL AS DOUBLE) AS uninsured_rate, (c_custkey % 100)::DOUBLE AS unemployment_rate,
      CASE WHEN c_custkey % 203 <= 100 THEN (c_custkey % 203)::DOUBLE END AS bachelors_or_higher_rate
    FROM customer""",
)
def clean_zone_features(spark, sf):
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    raw = A.table(spark, sf, "customer").select(
        key.cast("string").alias("zcta"),
        F.col("c_name").alias("zcta_name"),
        bal.cast("string").alias("population"),
        F.when(key % 9 == 0, "-666666666").otherwise((50000.0 + key).cast("string")).alias("median_household_income"),
        (bal / 50).cast("string").alias("poverty_rate"),
        F.lit("-").alias("uninsured_rate"),
        (key % 100).cast("string").alias("unemployment_rate"),
        (key % 203).cast("string").alias("bachelors_or_higher_rate"),
    )
    return facilities.clean_zones(raw)
