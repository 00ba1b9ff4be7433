from pyspark.sql import functions as F

from ratebook import functions as X
from ratebook.fixed_values import GENERIC_PHRASES, GENERIC_WORDS


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expr("c").alias("x")).first()["x"]


def test_clean_string_and_double(spark):
    assert one(spark, " \t a\n", X.clean_string) == "a"
    assert one(spark, " \n ", X.clean_string) is None
    for text, number in {
        "$1,000.50": 1000.5, " 12% ": 12.0, "": None, "N/A": None, "1d": None, "1e3": 1000.0, "-5": -5.0,
        ".5": 0.5, "1 through 10": None, "nan": None,
    }.items():
        assert one(spark, text, X.clean_double) == number, text


def test_optional_column_is_typed_null(spark):
    df = spark.createDataFrame([("1",)], "`code|1` string")
    out = df.select(X.optional(df, "code|1", "double").alias("a"), X.optional(df, "code|9", "double").alias("b"))
    assert out.first() == (1.0, None)
    assert dict(out.dtypes) == {"a": "double", "b": "double"}


def test_pad_id_never_truncates(spark):
    assert one(spark, "50760", lambda c: X.pad_id(c, 6)) == "050760"
    assert one(spark, "1234567", lambda c: X.pad_id(c, 6)) == "1234567"


def test_zip5_modes(spark):
    assert one(spark, "9-45 31", lambda c: X.zip5(c, "digits")) == "94531"
    assert one(spark, "945", lambda c: X.zip5(c, "digits")) is None
    assert one(spark, "CA 94531-1234", lambda c: X.zip5(c, "pattern")) == "94531"
    assert one(spark, "none", lambda c: X.zip5(c, "pattern")) is None
    assert one(spark, "945", lambda c: X.zip5(c, "prefix")) == "00945"


def test_title_case_matches_python(spark):
    for text in ("O'CONNOR hospital", "st. mary's 3rd-street", "café été", "  x ", ""):
        assert one(spark, text, X.title_case) == text.title()


def test_slug_and_normalized_text(spark):
    assert one(spark, "--Antioch (Med. Ctr)  #2!", X.slugify) == "antioch_med_ctr_2"
    assert one(spark, "St. Rose & Co,  Hosp.", X.normalize_text) == "ST ROSE AND CO HOSP"
    assert one(spark, None, X.normalize_text) is None
    assert one(spark, None, lambda c: X.normalize_text(c, null_as_empty=True)) == ""


def test_street_phrases_words(spark):
    assert one(spark, "4501 North Sand Creek Road.", X.normalize_street) == "4501 N SAND CREEK RD"
    assert one(spark, None, X.normalize_street) == ""
    assert one(spark, "Kaiser Foundation Hospital - Antioch Med Center", lambda c: X.drop_phrases(c, GENERIC_PHRASES)) == "ANTIOCH"
    assert one(spark, "Medical Center & Hospitals", lambda c: X.drop_words(c, GENERIC_WORDS)) == "AND HOSPITALS"


def test_parse_address(spark):
    assert tuple(one(spark, '"4501 SAND CREEK ROAD, ANTIOCH, CA 94531-0001"', X.parse_address)) == (
        "4501 SAND CREEK ROAD", "ANTIOCH", "94531",
    )
    assert tuple(one(spark, "1 MAIN ST, 123456", X.parse_address)) == ("1 MAIN ST", "", "")


def test_null_outside(spark):
    df = spark.createDataFrame([(-666666666.0,), (0.0,), (100.0,), (101.0,), (None,)], "c double")
    assert [r[0] for r in df.select(X.null_outside("c", 0, 100)).collect()] == [None, 0.0, 100.0, None, None]


def test_price_representation_modes(spark):
    cases = {
        (True, True, True): ("dollar", "dollar_percentage_algorithm"),
        (False, True, True): ("percentage_algorithm", "percentage_algorithm"),
        (False, False, True): ("algorithm", "algorithm"),
        (True, False, True): ("dollar", "dollar_algorithm"),
        (False, False, False): ("unknown", None),
    }
    df = spark.createDataFrame(list(cases), "d boolean, p boolean, a boolean")
    out = df.select(
        "d", "p", "a", X.price_representation("d", "p", "a", "precedence", "unknown").alias("x"),
        X.price_representation("d", "p", "a", "concat").alias("y"),
    )
    assert {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()} == cases


def test_payer_rules_order_and_variants(spark):
    df = spark.createDataFrame(
        [("Anthem", "Workers' Comp HMO"), ("Aetna", "Medi-Cal HMO"), ("UHC", "Medicare PPO"), (None, "Indemnity"),
         ("TriWest", None), ("Acme", "Plan")],
        "payer string, plan string",
    )
    family = X.payer_family("payer")
    out = [
        tuple(r) for r in df.select(
            family, X.payer_category("payer", "plan"), X.payer_category("payer", "plan", family=family)
        ).collect()
    ]
    assert out == [
        # only the cleaned text, where the apostrophe is gone, reads WORKERS COMP
        ("Anthem", "Workers Compensation", "Commercial"),
        ("Aetna", "Medicaid", "Medicaid"),
        ("UnitedHealthcare", "Medicare", "Medicare"),
        (None, "Commercial", "Other / Unclassified"),
        (None, "Other Government", "Other Government"),
        (None, "Other / Unclassified", "Other / Unclassified"),
    ]


def test_codes_are_compacted_and_keep_null_type(spark):
    df = spark.createDataFrame([(" ", "CPT", "99213", None)], "a string, at string, b string, bt string")
    codes = X.collect_codes([(F.col("a"), F.col("at")), (F.col("b"), F.col("bt"))])
    r = df.select(F.get(codes, F.lit(0))["code"].alias("c"), X.all_codes_json(codes).alias("j")).first()
    assert tuple(r) == ("99213", '[{"code":"99213","type":null}]')


def test_setting_band_unit(spark):
    df = spark.createDataFrame([("ms-drg ", "Outpatient", None, 1.0), ("CPT", " BOTH", 35.0, 2.5)],
                               "t string, s string, lat double, u double")
    out = df.select(X.comparison_setting("t", "s"), X.latitude_band("lat"), X.drug_unit_text("u")).collect()
    assert [tuple(r) for r in out] == [("inpatient", "South", "1"), ("both", "North", "2.5")]


def test_similarity(spark):
    df = spark.createDataFrame(
        [("Mercy Hospital", "HOSPITAL, mercy"), ("Mercy", "Mercy General"), ("abc", "xyz"), (None, "x")], "a string, b string"
    )
    scores = [r[0] for r in df.select(X.similarity("a", "b")).collect()]
    assert scores[0] == 100.0 and scores[2] == 0.0 and scores[3] == 0.0
    assert 50 < scores[1] < 100


def test_quantile_is_the_lower_element(spark):
    df = spark.range(1, 5).select(F.col("id").cast("double").alias("x"))
    assert df.select(X.quantile("x", 0.5)).first()[0] == 2.0
    assert df.select(X.quantiles("x", [0.25, 0.5, 0.75])).first()[0] == [1.0, 2.0, 3.0]
    assert abs(df.select(X.geomean("x")).first()[0] - 24 ** 0.25) < 1e-12
    assert df.select(X.exact_mean("x", 2)).first()[0] == 2.5
