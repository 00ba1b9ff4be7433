"""The supplied tables read as price data.

A line of an order is a price row: its part is the procedure, its supplier the location, the supplier's region
the health system, the customer's segment the payer and the order's priority the plan.  Each adapter has its
SQL twin, a WITH item used by the SQL of the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prices import presence_flags, price_representation
from ..functions.text import pad_id
from ..sources.sinks import work_dir

PAYERS = {
    "AUTOMOBILE": "Anthem Blue Cross",
    "BUILDING": "Blue Shield of California",
    "FURNITURE": "Aetna Health",
    "HOUSEHOLD": "UHC West",
    "MACHINERY": "Regional Cooperative",
}
PLANS = {
    "1-URGENT": "MEDICARE",
    "2-HIGH": "COMMERCIAL",
    "3-MEDIUM": "MEDICAID",
    "4-NOT SPECIFIED": "SELECT PPO",
    "5-LOW": "WORKERS' COMP",
}
CODE_TYPES = {"PROMO": "MS-DRG", "ECONOMY": "HCPCS"}

# every region is a system; labels become column names
SYSTEMS = {"EUROPE": "europe", "ASIA": "asia", "AMERICA": "america", "AFRICA": "africa", "MIDDLE EAST": "middle_east"}
PAIR = {"EUROPE": "europe", "ASIA": "asia"}


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; its schema is looked up once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _mapped(c: str, mapping: dict[str, str], keep: bool = False) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    return out.otherwise(F.col(c)) if keep else out


def _mapped_sql(c: str, mapping: dict[str, str], keep: bool = False) -> str:
    quoted = {k: v.replace("'", "''") for k, v in mapping.items()}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items())
    return f"CASE {c} {cases} {'ELSE ' + c if keep else ''} END"


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier as location, its nation as city, its region as system."""
    return _suppliers(spark, sf_dir).drop("s_suppkey")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "s_suppkey",
            F.col("r_name").alias("system_name"),
            pad_id(key.cast("string"), 6).alias("facility_id"),
            F.col("s_name").alias("mrf_location_name"),
            F.concat(F.lit("Hospital "), F.col("s_name")).alias("facility_name"),
            F.col("n_name").alias("city"),
            F.col("n_name").alias("hcai_city"),
            F.concat(F.lit("County "), F.col("n_nationkey") % 7).alias("county"),
            (30.0 + 0.5 * F.col("n_nationkey")).alias("latitude"),
            (-125.0 + 0.25 * F.col("n_nationkey")).alias("longitude"),
            F.when(key % 4 == 0, "Critical Access Hospitals").otherwise("Acute Care Hospitals").alias("hospital_type"),
            F.when(key % 3 == 0, "Proprietary").otherwise("Voluntary non-profit").alias("hospital_ownership"),
            (1.0 + key % 5).alias("overall_rating"),
            (25.0 * (1 + key % 20)).alias("licensed_beds"),
            pad_id((90000 + F.col("n_nationkey")).cast("string"), 5).alias("census_zcta"),
            (1000.0 * (1 + F.col("n_nationkey"))).alias("zcta_population"),
            (50000.0 + 100 * F.col("n_nationkey")).alias("zcta_median_household_income"),
            (5.0 + F.col("n_nationkey")).alias("zcta_poverty_rate"),
            (4.0 + F.col("n_nationkey")).alias("zcta_uninsured_rate"),
            (3.0 + F.col("n_nationkey")).alias("zcta_unemployment_rate"),
            (20.0 + F.col("n_nationkey")).alias("zcta_bachelors_or_higher_rate"),
        )
    )


LOCATIONS_SQL = """
locations AS (
  SELECT r_name AS system_name,
    CASE WHEN length(s_suppkey::VARCHAR) < 6 THEN lpad(s_suppkey::VARCHAR, 6, '0')
         ELSE s_suppkey::VARCHAR END AS facility_id,
    s_name AS mrf_location_name, 'Hospital ' || s_name AS facility_name,
    n_name AS city, n_name AS hcai_city, 'County ' || (n_nationkey % 7) AS county,
    30.0::DOUBLE + 0.5::DOUBLE * n_nationkey AS latitude,
    -125.0::DOUBLE + 0.25::DOUBLE * n_nationkey AS longitude,
    CASE WHEN s_suppkey % 4 = 0 THEN 'Critical Access Hospitals' ELSE 'Acute Care Hospitals' END AS hospital_type,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Proprietary' ELSE 'Voluntary non-profit' END AS hospital_ownership,
    (1 + s_suppkey % 5)::DOUBLE AS overall_rating,
    (25 * (1 + s_suppkey % 20))::DOUBLE AS licensed_beds,
    (90000 + n_nationkey)::VARCHAR AS census_zcta,
    (1000 * (1 + n_nationkey))::DOUBLE AS zcta_population,
    (50000 + 100 * n_nationkey)::DOUBLE AS zcta_median_household_income,
    (5 + n_nationkey)::DOUBLE AS zcta_poverty_rate,
    (4 + n_nationkey)::DOUBLE AS zcta_uninsured_rate,
    (3 + n_nationkey)::DOUBLE AS zcta_unemployment_rate,
    (20 + n_nationkey)::DOUBLE AS zcta_bachelors_or_higher_rate
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows without flags: one per order line."""
    where = _suppliers(spark, sf_dir).select("s_suppkey", "system_name", "facility_id", "mrf_location_name")
    who = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            _mapped("c_mktsegment", PAYERS).alias("payer"),
            _mapped("o_orderpriority", PLANS).alias("plan"),
        )
    )
    what = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("description"),
        F.col("p_brand").alias("code_1"),
        _mapped("p_type", CODE_TYPES, keep=True).alias("code_1_type"),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(where, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(what, F.col("l_partkey") == F.col("p_partkey"))
        .join(who, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "system_name", "facility_id", "mrf_location_name", "description", "code_1", "code_1_type",
            "payer", "plan",
            F.when(F.col("l_linestatus") == "F", "Inpatient").otherwise("Outpatient").alias("setting"),
            F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("negotiated_dollar"),
            F.nullif(F.col("l_discount"), F.lit(0.0)).alias("negotiated_percentage"),
            F.when(F.col("l_tax") != 0, F.concat(F.lit("tax "), F.col("l_tax").cast("string"))).alias(
                "negotiated_algorithm"
            ),
            F.col("l_quantity").alias("drug_unit"),
            F.col("l_orderkey").alias("source_service_number"),
            F.col("l_linenumber").cast("long").alias("source_charge_number"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("mrf_last_updated_on"),
        )
    )


RAW_PRICES_SQL = f"""
{LOCATIONS_SQL},
raw_prices AS (
  SELECT w.system_name, w.facility_id, w.mrf_location_name,
    p_name AS description, p_brand AS code_1, {_mapped_sql('p_type', CODE_TYPES, True)} AS code_1_type,
    {_mapped_sql('c_mktsegment', PAYERS)} AS payer, {_mapped_sql('o_orderpriority', PLANS)} AS plan,
    CASE WHEN l_linestatus = 'F' THEN 'Inpatient' ELSE 'Outpatient' END AS setting,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS negotiated_dollar,
    nullif(l_discount, 0) AS negotiated_percentage,
    CASE WHEN l_tax <> 0 THEN 'tax ' || l_tax END AS negotiated_algorithm,
    l_quantity AS drug_unit,
    l_orderkey AS source_service_number, l_linenumber::BIGINT AS source_charge_number,
    strftime(l_shipdate, '%Y-%m-%d') AS mrf_last_updated_on
  FROM lineitem
  JOIN locations w ON w.facility_id = CASE WHEN length(l_suppkey::VARCHAR) < 6
    THEN lpad(l_suppkey::VARCHAR, 6, '0') ELSE l_suppkey::VARCHAR END
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""


def price_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows with presence flags, their form by precedence; rows without any price left out."""
    flagged = presence_flags(raw_prices(spark, sf_dir)).filter("has_negotiated_price")
    return flagged.withColumn(
        "price_representation",
        price_representation("has_negotiated_dollar", "has_negotiated_percentage", "has_negotiated_algorithm"),
    )


FACT_SQL = f"""
{RAW_PRICES_SQL},
fact AS (
  SELECT *,
    negotiated_dollar IS NOT NULL AS has_negotiated_dollar,
    negotiated_percentage IS NOT NULL AS has_negotiated_percentage,
    negotiated_algorithm IS NOT NULL AS has_negotiated_algorithm,
    TRUE AS has_negotiated_price,
    CASE WHEN negotiated_dollar IS NOT NULL THEN 'dollar'
         WHEN negotiated_percentage IS NOT NULL AND negotiated_algorithm IS NOT NULL THEN 'percentage_algorithm'
         WHEN negotiated_percentage IS NOT NULL THEN 'percentage'
         ELSE 'algorithm' END AS price_representation
  FROM raw_prices
  WHERE negotiated_dollar IS NOT NULL OR negotiated_percentage IS NOT NULL OR negotiated_algorithm IS NOT NULL
)"""


def system_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each system's price rows as a table of its own, as systems publish them: the joined fact is written once."""
    path = work_dir(spark, "system-facts")
    fact = price_fact(spark, sf_dir)
    fact.write.partitionBy("system_name").parquet(path)
    schema = T.StructType([f for f in fact.schema.fields if f.name != "system_name"])
    return {
        name: spark.read.schema(schema).parquet(f"{path}/system_name={name}").withColumn("system_name", F.lit(name))
        for name in SYSTEMS
    }
