"""Facilities: cleaning the registers, matching them, enriching them with zone features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import (
    drop_phrases,
    drop_words,
    normalize_street,
    normalize_text,
    null_outside,
    pad_id,
    parse_address,
    title_case,
    zip5,
)
from ..operators.candidates import top_candidates
from ..operators.joins import join_with_flag, left_n_to_1, one_to_one
from ..operators.matching import (
    accept,
    address_first_match,
    build_crosswalk,
    exact_match_cascade,
    fuzzy_candidates,
    summarize_candidates,
)
from ..operators.quality import check_complete, check_unique, enforce
from ..operators.ranking import dedup_first

MATCH_BLOCKS = [("same_zip", "zip_code", "zip_code"), ("same_city", "city_key", "city_key")]
CAMPUS_BLOCKS = [("zip", "mrf_zip", "zip_code"), ("city", "mrf_city", "city_norm")]


def clean_hospitals(raw: DataFrame) -> DataFrame:
    """Hospital register: trimmed, padded ids, title-cased names, one row per facility, cohort flags."""
    numbers = "hospital_overall_rating"
    named = raw.select(
        *[
            (F.col(c) if c == numbers else F.btrim(c)).alias(V.HOSPITAL_RENAMES.get(c, c))
            for c in V.HOSPITAL_COLUMNS
        ]
    )
    kind = F.col("hospital_type")
    reason = F.lit(None).cast("string")
    for value, text in V.EXCLUSION_REASONS.items():
        reason = F.when(kind == value, text).otherwise(reason)
    cleaned = named.withColumns({
        "facility_id": pad_id("facility_id", 6),
        "zip_code": pad_id("zip_code", 5),
        "overall_rating": F.btrim("overall_rating").try_cast("double"),
        **{c: title_case(c) for c in ("facility_name", "city", "county")},
        "analysis_eligible": F.coalesce(kind.isin(*V.ELIGIBLE_HOSPITAL_TYPES), F.lit(False)),
        "exclusion_reason": reason,
    })
    order = [F.col(c).asc_nulls_last() for c in cleaned.columns if c != "facility_id"]
    return dedup_first(cleaned, ["facility_id"], order)


def clean_registry(raw: DataFrame) -> DataFrame:
    """Facility registry: hospitals only, padded ids, numbers coerced, candidates for matching flagged."""
    numeric = ("longitude", "latitude", "licensed_beds")
    named = raw.filter(F.col("license_type_desc") == V.REGISTRY_LICENSE_TYPE).select(
        *[
            (F.btrim(c).try_cast("double") if n in numeric else F.btrim(c)).alias(n)
            for c, n in V.REGISTRY_RENAMES.items()
        ]
    )
    candidate = (
        (F.col("license_category") == V.REGISTRY_CATEGORY)
        & (F.col("facility_status") == V.REGISTRY_STATUS)
        & F.col("facility_level").isin(*V.REGISTRY_LEVELS)
    )
    cleaned = named.withColumns({
        "hcai_id": pad_id("hcai_id", 9),
        "zip_code": zip5("zip_code", "prefix"),
        "match_candidate": F.coalesce(candidate, F.lit(False)),
    })
    enforce(check_unique(cleaned, ["hcai_id"], "registry"))
    return cleaned


def clean_zones(raw: DataFrame, variables: Mapping[str, str] = V.ZONE_VARIABLES) -> DataFrame:
    """Zone features (columns already named): padded ids, negative sentinels and impossible rates to NULL."""
    cleaned = raw.select(
        pad_id("zcta", 5).alias("zcta"),
        "zcta_name",
        *[
            null_outside(F.col(v).try_cast("double"), 0.0, 100.0 if v in V.ZONE_RATES else None).alias(v)
            for v in variables
        ],
    )
    enforce(check_unique(cleaned, ["zcta"], "zones"))
    return cleaned


def zone_columns() -> dict[str, str]:
    """Source name to column of the zone file."""
    return {
        V.ZONE_GEOGRAPHY: "zcta", "NAME": "zcta_name", **{code: name for name, code in V.ZONE_VARIABLES.items()}
    }


def with_match_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "name_normalized": normalize_text("facility_name"),
        "address_normalized": normalize_text("address"),
        "city_key": F.upper("city"),
    })


def facility_crosswalk(
    hospitals: DataFrame, registry: DataFrame, manual: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Hospital to registry: exact name and zip, exact address and zip, clear fuzzy winners, manual list.

    Returns (crosswalk, review); review holds the best candidate of each hospital no rule accepted.
    """
    left = with_match_keys(hospitals)
    right = with_match_keys(registry.filter("match_candidate"))
    exact = exact_match_cascade(
        left,
        right,
        [
            ("exact_name_zip", ["name_normalized", "zip_code"]),
            ("exact_address_zip", ["address_normalized", "zip_code"]),
        ],
        "hcai_id",
    )
    unmatched = exact.filter(F.col("hcai_id").isNull() & F.col("analysis_eligible")).drop(
        "hcai_id", "match_method", "match_score"
    )
    candidates = fuzzy_candidates(
        unmatched, right, left_id="facility_id", right_id="hcai_id", blocks=MATCH_BLOCKS, digits=1, **options
    )
    best = accept(summarize_candidates(candidates, "facility_id", "hcai_id"))
    crosswalk = build_crosswalk(exact, best, manual).drop("name_normalized", "address_normalized", "city_key")
    return crosswalk, best.filter("not auto_accept")


def hospital_master(crosswalk: DataFrame, registry: DataFrame) -> DataFrame:
    """Crosswalk with the registry's attributes; a matched id need not have a current profile."""
    attributes = registry.select(
        "hcai_id",
        F.col("facility_name").alias("hcai_facility_name"),
        F.col("address").alias("hcai_address"),
        F.col("city").alias("hcai_city"),
        F.col("zip_code").alias("hcai_zip_code"),
        "longitude", "latitude", "license_category", "facility_level", "er_service_level", "licensed_beds",
        "facility_status",
    )
    master = left_n_to_1(crosswalk, attributes, ["hcai_id"])
    enforce(check_unique(master, ["facility_id"], "hospital master"))
    return master.withColumn("hcai_profile_available", F.col("hcai_facility_name").isNotNull())


def add_zone_features(hospitals: DataFrame, zone_of: DataFrame, zones: DataFrame) -> DataFrame:
    """Attach each hospital's zone and the zone's features; ``census_acs_matched`` says whether it had any."""
    placed = one_to_one(hospitals, zone_of.select("facility_id", "census_zcta", "zcta_match_method"), ["facility_id"])
    features = zones.select(
        F.col("zcta").alias("census_zcta"),
        F.col("zcta_name").alias("census_zcta_name"),
        *[F.col(v).alias(f"zcta_{v}") for v in V.ZONE_VARIABLES],
    )
    enforce(check_unique(features, ["census_zcta"], "zone features"))
    return join_with_flag(placed, features, ["census_zcta"], "census_acs_matched")


def campus_crosswalk(
    campuses: DataFrame,
    registry: DataFrame,
    phrases: Sequence[str] = V.GENERIC_PHRASES,
    scope: Column | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Published campuses to registry facilities, address first.  Returns (crosswalk, candidates).

    ``campuses`` has ``campus_id, mrf_hospital_name, mrf_location_name, mrf_address``; ``scope`` narrows the
    registry (e.g. to one system's facilities).
    """
    right = registry.filter("match_candidate")
    right = right if scope is None else right.filter(scope)
    right = right.withColumns({
        "zip_code": zip5("zip_code", "pattern"),
        "address_norm": normalize_street("address"),
        "city_norm": normalize_text("city", ampersand=False, null_as_empty=True),
        "name_norm": drop_phrases("facility_name", phrases),
    })
    parsed = campuses.withColumn("_address", parse_address(F.coalesce("mrf_address", F.lit(""))))
    left = parsed.withColumns({
        "mrf_zip": F.nullif(F.col("_address.zip"), F.lit("")),
        "mrf_city": normalize_text("_address.city", ampersand=False, null_as_empty=True),
        "street_norm": normalize_street("_address.street"),
        "hospital_name_norm": drop_phrases("mrf_hospital_name", phrases),
        "location_name_norm": drop_phrases("mrf_location_name", phrases),
    }).drop("_address")
    crosswalk, candidates = address_first_match(
        left, right, left_id="campus_id", right_id="hcai_id", blocks=CAMPUS_BLOCKS,
        address=("street_norm", "address_norm"),
        names=(["hospital_name_norm", "location_name_norm"], ["name_norm"]),
        digits=2, **options,
    )
    return left.drop("street_norm", "hospital_name_norm", "location_name_norm").join(crosswalk, "campus_id"), candidates


def manifest_candidates(
    manifest: DataFrame, hospitals: DataFrame, words: Sequence[str] = V.GENERIC_WORDS, **options
) -> DataFrame:
    """Top hospitals for each manifest location by name; the better of two hospital names counts."""
    left = manifest.withColumn("location_match_name", drop_words("location_name", words))
    right = hospitals.withColumns({
        "cms_match_name": drop_words("facility_name", words),
        "hcai_match_name": drop_words("hcai_facility_name", words),
    })
    options.setdefault("digits", 1)
    return top_candidates(
        left, right, left_id="location_name", right_id="facility_id",
        fields={"name": (["location_match_name"], ["cms_match_name", "hcai_match_name"])},
        weights={"name": 1.0}, **options,
    )


def system_manifest(entries: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Manifest entries with their facility and status; every entry must be classified exactly once."""
    enforce(check_complete(entries, crosswalk, ["location_name"], "manifest classified"))
    return one_to_one(entries, crosswalk, ["location_name"]).withColumn("facility_id", pad_id("facility_id", 6))


def facility_subset(hospitals: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of the expected facilities."""
    return hospitals.withColumn("facility_id", pad_id("facility_id", 6)).join(
        expected.select("facility_id").distinct(), "facility_id", "left_semi"
    )


def campus_dimension(crosswalk: DataFrame, registry: DataFrame, zones: DataFrame) -> DataFrame:
    """Campuses with registry attributes and the features of the zone their zip names."""
    attributes = registry.select(
        "hcai_id",
        F.col("facility_name").alias("hcai_facility_name"),
        F.col("address").alias("hcai_address"),
        F.col("city").alias("hcai_city"),
        zip5("zip_code", "digits").alias("hcai_zip"),
        "longitude", "latitude", "license_type", "license_category", "facility_level", "er_service_level",
        "licensed_beds", "facility_status",
    )
    located = left_n_to_1(crosswalk, attributes, ["hcai_id"]).withColumn("zcta", zip5("hcai_zip", "digits"))
    features = zones.withColumn("zcta", zip5("zcta", "digits")).drop("zcta_name")
    out = left_n_to_1(located, features, ["zcta"])
    enforce(check_unique(out, ["campus_id"], "campuses"))
    return out
