"""Typed schemas of the inputs and of the two warehouse tables."""

from __future__ import annotations

from pyspark.sql import types as T

from .fixed_values import HOSPITAL_COLUMNS, REGISTRY_RENAMES


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "boolean": T.BooleanType()}


def schema_of(spec: str) -> T.StructType:
    """Schema from ``"a b c:double d:long"`` (string unless a type is given)."""
    pairs = [item.partition(":") for item in spec.split()]
    return T.StructType([T.StructField(name, _TYPES[kind or "string"]) for name, _, kind in pairs])


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PRICE_FACT = schema_of(
    """
    system_name facility_id mrf_location_name description billing_class
    code_1 code_1_type code_2 code_2_type all_codes_json modifier modifiers drug_unit drug_type setting
    gross_charge:double discounted_cash_charge:double minimum_charge:double maximum_charge:double
    additional_generic_notes payer plan
    negotiated_dollar:double negotiated_percentage:double negotiated_algorithm
    median_amount:double p10_amount:double p90_amount:double
    negotiated_count methodology additional_payer_notes
    has_negotiated_dollar:boolean has_negotiated_percentage:boolean has_negotiated_algorithm:boolean
    has_negotiated_price:boolean price_representation source_format
    source_row_number:long source_service_number:long source_charge_number:long source_payer_number:long
    source_record_id mrf_url source_page_url
    mrf_hospital_name mrf_address mrf_license_number mrf_type_2_npi mrf_last_updated_on mrf_as_of_date
    mrf_version
    """
)

LOCATION_DIMENSION = schema_of(
    """
    system_name facility_id mrf_location_name mrf_hospital_name mrf_address mrf_license_number
    mrf_type_2_npi mrf_last_updated_on mrf_as_of_date mrf_version
    facility_name address city state zip_code county telephone_number
    hospital_type hospital_ownership emergency_services overall_rating:double analysis_eligible:boolean
    hcai_id hcai_facility_name hcai_address hcai_city hcai_zip_code longitude:double latitude:double
    license_type license_category facility_level er_service_level licensed_beds:double facility_status
    match_method match_score:double census_zcta census_zcta_name
    zcta_population:double zcta_median_household_income:double zcta_poverty_rate:double
    zcta_uninsured_rate:double zcta_unemployment_rate:double zcta_bachelors_or_higher_rate:double
    zcta_match_method census_acs_matched:boolean
    """
)

HOSPITALS_RAW = strings(*HOSPITAL_COLUMNS)
REGISTRY_RAW = strings(*REGISTRY_RENAMES)

LOCATION_CROSSWALK = strings("location_name", "facility_id", "status")
SOURCE_CROSSWALK = strings(
    "mrf_location_name", "facility_id", "source_file", "include_in_analysis", "match_method"
)
MANUAL_MATCHES = strings("cms_id", "hcai_id", "reason")


def _array(fields: T.StructType) -> T.ArrayType:
    return T.ArrayType(fields)


# One service of a nested price file.  Leaves are strings: numbers arrive both bare and quoted, and the
# cleaning expressions decide what is a number.
_PAYER = strings(
    "payer_name", "plan_name", "standard_charge_dollar", "standard_charge_percentage",
    "standard_charge_algorithm", "median_amount", "10th_percentile", "90th_percentile", "count",
    "methodology", "additional_payer_notes",
)
_CHARGE = strings(
    "setting", "gross_charge", "discounted_cash", "minimum", "maximum", "additional_generic_notes"
).add("payers_information", _array(_PAYER))
NESTED_SERVICE = (
    strings("description")
    .add("code_information", _array(strings("code", "type")))
    .add("drug_information", strings("unit", "type"))
    .add("standard_charges", _array(_CHARGE))
)
NESTED_PRICE_FILE = strings("hospital_name")
for _name in ("location_name", "hospital_address", "type_2_npi"):
    NESTED_PRICE_FILE.add(_name, T.ArrayType(T.StringType()))
NESTED_PRICE_FILE.add("license_information", strings("license_number"))
for _name in ("last_updated_on", "as_of_date", "version"):
    NESTED_PRICE_FILE.add(_name, T.StringType())
NESTED_PRICE_FILE.add("standard_charge_information", _array(NESTED_SERVICE))
