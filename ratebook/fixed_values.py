"""Fixed values.

Everything below has to equal published formats or the agreed business rules for results to be
right: column names of the price-file formats, ordered classification patterns, word lists,
score weights and thresholds.  All of them are defaults of parameters elsewhere.
"""

# --- price-file columns ---------------------------------------------------------------------

# Payer-specific columns of a wide file: metric|[payer]|[plan] with an optional sub-metric.
PAYER_COLUMN_PATTERN = (
    r"^(standard_charge|median_amount|10th_percentile|90th_percentile|count|additional_payer_notes)"
    r"\|\[(.*?)\]\|\[(.*?)\]"
    r"(?:\|(negotiated_dollar|negotiated_percentage|negotiated_algorithm|methodology))?$"
)

# metric in the header -> (column of the price fact, kind of value)
PAYER_METRICS = {
    "negotiated_dollar": ("negotiated_dollar", "double"),
    "negotiated_percentage": ("negotiated_percentage", "double"),
    "negotiated_algorithm": ("negotiated_algorithm", "string"),
    "median_amount": ("median_amount", "double"),
    "10th_percentile": ("p10_amount", "double"),
    "90th_percentile": ("p90_amount", "double"),
    "count": ("negotiated_count", "string"),
    "methodology": ("methodology", "string"),
    "additional_payer_notes": ("additional_payer_notes", "string"),
}

# service-level columns shared by wide and tall files -> (column of the price fact, kind of value)
SERVICE_COLUMNS = {
    "description": ("description", "string"),
    "setting": ("setting", "string"),
    "modifiers": ("modifiers", "string"),
    "drug_unit_of_measurement": ("drug_unit", "string"),
    "drug_type_of_measurement": ("drug_type", "string"),
    "standard_charge|gross": ("gross_charge", "double"),
    "standard_charge|discounted_cash": ("discounted_cash_charge", "double"),
    "standard_charge|min": ("minimum_charge", "double"),
    "standard_charge|max": ("maximum_charge", "double"),
    "additional_generic_notes": ("additional_generic_notes", "string"),
}

# only in wide files: codes keep their position
WIDE_COLUMNS = {
    "code|1": ("code_1", "string"),
    "code|1|type": ("code_1_type", "string"),
    "code|2": ("code_2", "string"),
    "code|2|type": ("code_2_type", "string"),
    "modifier": ("modifier", "string"),
}

# only in tall files: one payer per row
TALL_COLUMNS = {
    "billing_class": ("billing_class", "string"),
    "payer_name": ("payer", "string"),
    "plan_name": ("plan", "string"),
    "standard_charge|negotiated_dollar": ("negotiated_dollar", "double"),
    "standard_charge|negotiated_percentage": ("negotiated_percentage", "double"),
    "standard_charge|negotiated_algorithm": ("negotiated_algorithm", "string"),
    "standard_charge|methodology": ("methodology", "string"),
    "median_amount": ("median_amount", "double"),
    "10th_percentile": ("p10_amount", "double"),
    "90th_percentile": ("p90_amount", "double"),
    "count": ("negotiated_count", "string"),
}
TALL_CODE_SLOTS = 4

# preamble record of a price file -> provenance column
PREAMBLE_COLUMNS = {
    "hospital_name": "mrf_hospital_name",
    "location_name": "mrf_location_name",
    "hospital_address": "mrf_address",
    "type_2_npi": "mrf_type_2_npi",
    "license_number|CA": "mrf_license_number",
    "last_updated_on": "mrf_last_updated_on",
    "version": "mrf_version",
}

# key: value lines of a published price-file manifest; the first one opens a new entry
MANIFEST_KEYS = ("location-name", "source-page-url", "mrf-url", "contact-name", "contact-email")

# --- classification (first matching rule wins, so the order is part of the value) --------------

PAYER_FAMILY_RULES = (
    ("ANTHEM", "Anthem"),
    ("BLUE SHIELD", "Blue Shield"),
    ("AETNA", "Aetna"),
    ("CIGNA", "Cigna"),
    ("UNITEDHEALTHCARE|UHC|UNITED", "UnitedHealthcare"),
    ("HEALTH NET", "Health Net"),
)

# on payer and plan text whose punctuation became blanks
PAYER_CATEGORY_RULES_CLEANED = (
    ("WORKERS COMP|WORKER COMP", "Workers Compensation"),
    ("MEDICAID|MEDI CAL|MEDICAL HMO", "Medicaid"),
    ("MEDICARE", "Medicare"),
    ("TRIWEST|TRICARE|OTHER GOVERNMENT", "Other Government"),
    ("COMMERCIAL|PPO|HMO|EPO|INDIVIDUAL|INDEMNITY|SELECT", "Commercial"),
)

# on the raw upper-case payer and plan text; a known family that is not public is Commercial
PAYER_CATEGORY_RULES_RAW = (
    ("WORKERS COMP|WORKER COMP", "Workers Compensation"),
    ("MEDICAID|MEDI-CAL|MEDI CAL|MEDICAL HMO", "Medicaid"),
    ("MEDICARE", "Medicare"),
    ("TRIWEST|TRICARE|OTHER GOVERNMENT", "Other Government"),
)
COMMERCIAL = "Commercial"
UNCLASSIFIED = "Other / Unclassified"

COMPARABLE_CODE_TYPES = ("HCPCS", "MS-DRG")
INPATIENT_CODE_TYPE = "MS-DRG"
KNOWN_SETTINGS = ("inpatient", "outpatient", "both")
BAND_LATITUDE = 35.0

# --- facilities ---------------------------------------------------------------------------------

HOSPITAL_RENAMES = {"citytown": "city", "countyparish": "county", "hospital_overall_rating": "overall_rating"}
HOSPITAL_COLUMNS = (
    "facility_id", "facility_name", "address", "citytown", "state", "zip_code", "countyparish",
    "telephone_number", "hospital_type", "hospital_ownership", "emergency_services",
    "hospital_overall_rating",
)
ELIGIBLE_HOSPITAL_TYPES = ("Acute Care Hospitals", "Critical Access Hospitals")
EXCLUSION_REASONS = {
    "Psychiatric": "Psychiatric hospital",
    "Childrens": "Children's hospital",
    "Acute Care - Veterans Administration": "Veterans Administration hospital",
    "Acute Care - Department of Defense": "Department of Defense hospital",
}

REGISTRY_RENAMES = {
    "oshpd_id": "hcai_id",
    "facility_desc": "facility_name",
    "site_address1": "address",
    "site_city": "city",
    "site_zip": "zip_code",
    "site_x_coordinate": "longitude",
    "site_y_coordinate": "latitude",
    "license_type_desc": "license_type",
    "license_category_desc": "license_category",
    "facility_level_desc": "facility_level",
    "er_service_level_desc": "er_service_level",
    "licensed_beds": "licensed_beds",
    "facility_status_desc": "facility_status",
}
REGISTRY_LICENSE_TYPE = "Hospital"
REGISTRY_CATEGORY = "General Acute Care Hospital"
REGISTRY_STATUS = "Open"
REGISTRY_LEVELS = ("Parent Facility", "Consolidated Facility")

ZONE_GEOGRAPHY = "zip code tabulation area"
ZONE_VARIABLES = {
    "population": "DP05_0001E",
    "median_household_income": "DP03_0062E",
    "poverty_rate": "DP03_0128PE",
    "uninsured_rate": "DP03_0099PE",
    "unemployment_rate": "DP03_0009PE",
    "bachelors_or_higher_rate": "DP02_0068PE",
}
ZONE_RATES = ("poverty_rate", "uninsured_rate", "unemployment_rate", "bachelors_or_higher_rate")

# --- name and address matching ------------------------------------------------------------------

STREET_ABBREVIATIONS = {
    "STREET": "ST", "ST": "ST",
    "AVENUE": "AVE", "AVE": "AVE",
    "BOULEVARD": "BLVD", "BLVD": "BLVD",
    "ROAD": "RD", "RD": "RD",
    "DRIVE": "DR", "DR": "DR",
    "PARKWAY": "PKWY", "PKWY": "PKWY",
    "HIGHWAY": "HWY", "HWY": "HWY",
    "LANE": "LN", "LN": "LN",
    "COURT": "CT", "CT": "CT",
    "PLACE": "PL", "PL": "PL",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
GENERIC_PHRASES = (
    "KAISER FOUNDATION HOSPITAL", "KAISER PERMANENTE", "MEDICAL CENTER", "MED CENTER", "HOSPITAL", "CAMPUS",
)
GENERIC_WORDS = ("KAISER", "FOUNDATION", "HOSPITAL", "MEDICAL", "CENTER")

# facility matching: name counts more than address
FACILITY_WEIGHTS = {"name": 0.70, "address": 0.30}
FACILITY_ACCEPT = {"combined": 85.0, "name": 80.0, "address": 80.0, "gap": 10.0}
# campus matching: address counts more than name
CAMPUS_WEIGHTS = {"address": 0.75, "name": 0.25}
CAMPUS_ACCEPT = {"combined": 85.0, "address": 80.0, "name": 55.0, "gap": 8.0}
CANDIDATES_KEPT = 3
# the edit score of texts with their words in order counts so much of that of texts as they are
WORD_ORDER_DISCOUNT = 0.95

# --- models ---------------------------------------------------------------------------------------

RIDGE_ALPHA = 1.0
FOLDS = 5
FOREST = {"numTrees": 300, "maxDepth": 6, "minInstancesPerNode": 10, "seed": 42}
