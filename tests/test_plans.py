import pytest
from pyspark.sql import functions as F

from ratebook.operators.quality import CheckFailed
from ratebook.operators.zones import assign_zone, with_bounds
from ratebook.plans import facilities as P
from ratebook.plans import marts, profiles, reports
from ratebook.schema import HOSPITALS_RAW, REGISTRY_RAW


@pytest.fixture(scope="module")
def hospitals(spark):
    def row(i, name, address, city, zip_code, kind="Acute Care Hospitals", rating="4"):
        return (i, name, address, city, "CA", zip_code, "alameda", None, kind, "Gov", "Yes", rating)

    data = [
        row("50001", "ST. ROSE & CO HOSPITAL", "1 Oak St", "HAYWARD", "94545"),
        row("50001", "ST. ROSE & CO HOSPITAL", "1 Oak St", "HAYWARD", "94545"),
        row("50002", "other name", "22 PINE AVE.", "fremont", "94538", rating="Not Available"),
        row("50003", "valley general hospital", "300 North Main Street", "o'connor", "1234"),
        row("50004", "lonely hospital", "9 Far Rd", "nowhere", "99999"),
        row("50005", "mind clinic", "1 Oak St", "HAYWARD", "94545", kind="Psychiatric"),
    ]
    return P.clean_hospitals(spark.createDataFrame(data, HOSPITALS_RAW)).persist()


@pytest.fixture(scope="module")
def registry(spark):
    def row(i, name, address, city, zip_code, x, y, status="Open", kind="Hospital"):
        return (i, name, address, city, zip_code, x, y, kind, "General Acute Care Hospital", "Parent Facility", "Basic", "10", status)

    data = [
        row("106010001", "St Rose and Co. Hospital", "1 OAK STREET", "Hayward", "94545-1111", "1", "1"),
        row("10602", "Second", "22 Pine Ave", "Fremont", "94538", "2", "x"),
        row("106010003", "VALLEY GENERAL HOSPITAL CTR", "300 N. MAIN STREET", "O'Connor", "01234", "3", "3"),
        row("106010009", "Closed", "1 Oak St", "Hayward", "94545", "1", "1", status="Closed"),
        row("1", "Clinic", "1 Oak St", "Hayward", "94545", "1", "1", kind="Clinic"),
    ]
    return P.clean_registry(spark.createDataFrame(data, REGISTRY_RAW)).persist()


def test_register_cleaning(hospitals, registry, rows):
    assert rows(hospitals, "facility_id", "facility_name", "city", "zip_code", "overall_rating", "analysis_eligible",
                "exclusion_reason") == [
        ("050001", "St. Rose & Co Hospital", "Hayward", "94545", 4.0, True, None),
        ("050002", "Other Name", "Fremont", "94538", None, True, None),
        ("050003", "Valley General Hospital", "O'Connor", "01234", 4.0, True, None),
        ("050004", "Lonely Hospital", "Nowhere", "99999", 4.0, True, None),
        ("050005", "Mind Clinic", "Hayward", "94545", 4.0, False, "Psychiatric hospital"),
    ]
    assert rows(registry, "hcai_id", "zip_code", "latitude", "match_candidate") == [
        ("000010602", "94538", None, True), ("106010001", "94545", 1.0, True), ("106010003", "01234", 3.0, True),
        ("106010009", "94545", 1.0, False),
    ]


def test_facility_chain(spark, hospitals, registry, rows):
    manual = spark.createDataFrame([("050004", "106099999", "checked by phone")], "cms_id string, hcai_id string, reason string")
    crosswalk, review = P.facility_crosswalk(hospitals, registry, manual)
    crosswalk = crosswalk.persist()
    found = {r["facility_id"]: (r["hcai_id"], r["match_method"], r["match_score"]) for r in crosswalk.collect()}
    assert found["050001"] == ("106010001", "exact_name_zip", 100.0)
    assert found["050002"] == ("000010602", "exact_address_zip", 100.0)
    assert found["050004"] == ("106099999", "manual_verified", None)
    assert found["050003"][:2] == ("106010003", "high_confidence_fuzzy") and found["050003"][2] >= 85
    assert found["050005"][0] is None and review.count() == 0

    master = P.hospital_master(crosswalk, registry)
    assert rows(master, "facility_id", "hcai_profile_available")[3] == ("050004", False)

    zones = P.clean_zones(spark.createDataFrame(
        [("94545", "z", "100", "-666666666", "101", "5", "5", "5"), ("777", "y", "7", "1", "1", None, "1", "1")],
        "zcta string, zcta_name string, population string, median_household_income string, poverty_rate string, "
        "uninsured_rate string, unemployment_rate string, bachelors_or_higher_rate string"))
    square = "array(struct(2D as x, 2D as y), struct(4D as x, 2D as y), struct(4D as x, 4D as y), struct(2D as x, 4D as y))"
    polygons = with_bounds(spark.createDataFrame([("00777",)], "zone string").withColumn("ring", F.expr(square)))
    eligible = master.filter("analysis_eligible")
    placed = assign_zone(eligible, zones, polygons)
    out = P.add_zone_features(eligible, placed, zones)
    assert rows(out, "facility_id", "census_zcta", "zcta_match_method", "zcta_population",
                "zcta_median_household_income", "zcta_poverty_rate", "census_acs_matched") == [
        ("050001", "94545", "zip_exact", 100.0, None, None, True),
        ("050002", None, "unresolved", None, None, None, False),
        ("050003", "00777", "coordinate_point", 7.0, 1.0, 1.0, True),
        ("050004", None, "unresolved", None, None, None, False),
    ]


def test_campuses(spark, registry, rows):
    campuses = spark.createDataFrame(
        [("c1", "Kaiser Foundation Hospital", "St Rose", "1 Oak Street, Hayward, CA 94545"),
         ("c2", "Valley General", "Other", "301 North Main Street, O'CONNOR, CA"),
         ("c3", "Zzz", "Qqq", None)],
        "campus_id string, mrf_hospital_name string, mrf_location_name string, mrf_address string")
    crosswalk, candidates = P.campus_crosswalk(campuses, registry)
    got = {r["campus_id"]: (r["hcai_id"], r["match_method"], r["match_status"]) for r in crosswalk.collect()}
    assert got["c1"] == ("106010001", "exact_address_zip", "matched")
    assert got["c2"][0] == "106010003" and got["c2"][1].endswith("_city")
    assert got["c3"][1:] == ("review_all", "review")
    assert candidates.filter("campus_id = 'c3'").count() == 3


def test_manifest_must_be_classified(spark):
    entries = spark.createDataFrame([("A", "u1"), ("B", "u2")], "location_name string, mrf_url string")
    cross = spark.createDataFrame([("A", "7", "include"), ("B", "8", "skip")], "location_name string, facility_id string, status string")
    assert P.system_manifest(entries, cross).filter("facility_id = '000007'").count() == 1
    with pytest.raises(CheckFailed):
        P.system_manifest(entries, cross.filter("location_name = 'A'"))


def test_report_rounding_and_order(spark):
    data = [("dollar", "COMMERCIAL", 10.005), ("dollar", "COMMERCIAL", 20.0), ("dollar", "MEDICARE", 30.0), ("algorithm", "X", None)]
    fact = spark.createDataFrame(data, "price_representation string, plan string, negotiated_dollar double")
    out = [tuple(r) for r in reports.payer_price_summary(fact).collect()]
    assert out == [("MEDICARE", 1, 30.0, 30.0, 30.0, 30.0), ("COMMERCIAL", 2, 15.0, 10.01, 10.01, 20.0)]
    shares = [tuple(r) for r in reports.representation_breakdown(fact).collect()]
    assert shares == [("dollar", 3, 75.0), ("algorithm", 1, 25.0)]


def test_hospitals_with_more_plans_do_not_weigh_more(spark):
    rows_ = []
    for system, location, plan, price in [("A", "l1", "p1", 10.0), ("A", "l1", "p1", 10.0), ("A", "l1", "p2", 30.0),
                                          ("A", "l2", "p1", 100.0), ("B", "l3", "p1", 50.0)]:
        rows_.append((system, location, location, "470", "MS-DRG", "d", "Aetna", plan, price, True))
    fact = spark.createDataFrame(rows_, "system_name string, facility_id string, mrf_location_name string, code_1 string, "
                                 "code_1_type string, description string, payer string, plan string, negotiated_dollar double, "
                                 "has_negotiated_dollar boolean")
    insurer = marts.insurer_msdrg(fact, ["A", "B"])
    a = insurer.filter("system_name = 'A'").first()
    assert (a.median_system_price, a.location_count, a.plan_count, a.source_row_count) == (10.0, 2, 3, 4)
    assert abs(a.pair_geometric_mean_price - 500 ** 0.5) < 1e-9
    pair = marts.paired_differences(insurer, {"A": "a", "B": "b"}).first()
    assert (pair.a_price, pair.b_price, pair.a_vs_b_ratio, pair.a_higher) == (10.0, 50.0, 0.2, False)
    assert abs(pair.a_vs_b_pct_difference + 80) < 1e-9


def test_nested_profile(spark, rows):
    from ratebook.schema import NESTED_SERVICE

    text = '{"standard_charges": [{"setting": "both", "payers_information": [{"payer_name": "p", "standard_charge_dollar": 1}]}]}'
    services = spark.createDataFrame([(text,), ('{"code_information": [{"code": "1", "type": "T"}]}',)], "j string").select(
        F.from_json("j", NESTED_SERVICE).alias("service"))
    out = profiles.profile_services(services)
    assert rows(out["service_children"], "relation", "children", "parents") == [
        ("charges", 0, 1), ("charges", 1, 1), ("codes", 0, 1), ("codes", 1, 1)]
    assert out["values"].first()["with_dollar"] == 1
    assert rows(out["code_types"], "value", "row_count") == [("T", 1)]
