"""Tables that are loaded and checked by reading back, and small files of records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pad_id
from ..sources import sinks as K
from ..sources.nested_json import scan_json_records
from ..sources.tables import read_crosswalk, read_parquet_many
from . import adapters as A
from .core import register

_PARTS = 3
#: Rows of a file of JSON records, by range of key, so that no file and no cell outgrows a few MB.
_RECORDS = 20_000


@register(
    "load_price_fact",
    f"""WITH {A.FACT_SQL}
    SELECT system_name, code_1_type, COUNT(*) AS row_count, COUNT(DISTINCT code_1) AS codes,
      SUM(negotiated_dollar::DECIMAL(28,2))::DOUBLE AS total_price, MIN(negotiated_dollar) AS lowest
    FROM fact GROUP BY ALL""",
)
def load_price_fact(spark, sf):
    fact, path = A.price_fact(spark, sf), K.work_dir(spark, "price-fact")
    K.write_parquet(fact, path)
    return read_parquet_many(spark, path, schema=fact.schema).groupBy("system_name", "code_1_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("code_1").alias("codes"),
        F.sum(F.col("negotiated_dollar").cast("decimal(28,2)")).cast("double").alias("total_price"),
        F.min("negotiated_dollar").alias("lowest"),
    )


@register(
    "export_parts",
    f"""WITH {A.FACT_SQL}
    SELECT {_PARTS} AS parts, COUNT(*) AS row_count, COUNT(DISTINCT facility_id) AS facilities,
      COUNT(negotiated_percentage) AS percentages FROM fact""",
)
def export_parts(spark, sf):
    fact, path = A.price_fact(spark, sf), K.work_dir(spark, "export")
    K.export_single(fact, path, _PARTS)
    back = read_parquet_many(spark, path, schema=fact.schema).withColumn("_file", F.col("_metadata.file_name"))
    return back.agg(
        F.count_distinct("_file").alias("parts"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("facility_id").alias("facilities"),
        F.count("negotiated_percentage").alias("percentages"),
    )


@register(
    "clustered_load",
    f"""WITH {A.FACT_SQL},
    size AS (SELECT COUNT(*) AS loaded_rows FROM fact)
    SELECT facility_id, payer, COUNT(*) AS row_count, MAX(negotiated_dollar) AS highest, MAX(loaded_rows) AS loaded_rows
    FROM fact, size WHERE code_1_type = 'MS-DRG' GROUP BY 1, 2""",
)
def clustered_load(spark, sf):
    """Load the fact clustered by facility and kind of code, read it back from the catalog by both."""
    fact, name = A.price_fact(spark, sf), f"price_fact_{uuid.uuid4().hex}"
    loaded, _ = K.write_table(
        fact, name, cluster_by=["code_1_type", "facility_id"], path=K.work_dir(spark, "clustered-fact")
    )
    stays = spark.table(name).filter("code_1_type = 'MS-DRG'")
    return stays.groupBy("facility_id", "payer").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("negotiated_dollar").alias("highest")
    ).withColumn("loaded_rows", F.lit(loaded).cast("long"))


_PLACE = T.StructType([
    T.StructField("facility_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("balance", T.DoubleType()),
])
_PLACE_SQL = """SELECT lpad(s_suppkey::VARCHAR, 9, '0') AS facility_id, s_name AS name,
    's, "' || s_name || '"' AS address, s_acctbal::DOUBLE AS balance FROM supplier"""


def _places(spark, sf):
    """Suppliers with ids that begin with zeros and addresses with commas and quotes."""
    return A.table(spark, sf, "supplier").select(
        pad_id(F.col("s_suppkey").cast("string"), 9).alias("facility_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit('s, "'), "s_name", F.lit('"')).alias("address"),
        F.col("s_acctbal").cast("string").alias("balance"),
    )


@register("load_dimension", _PLACE_SQL)
def load_dimension(spark, sf):
    name = f"places_{uuid.uuid4().hex}"
    K.load_dimension(_places(spark, sf), name, _PLACE, path=K.work_dir(spark, "dimension"))
    return spark.table(name)


@register("review_file", _PLACE_SQL)
def review_file(spark, sf):
    """Written for review as CSV with a header, and read again as a crosswalk: identifiers stay strings."""
    path = K.work_dir(spark, "review")
    K.write_review_csv(_places(spark, sf), path)
    return read_crosswalk(spark, path, _PLACE)


@register(
    "json_records",
    """SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment, c_acctbal::DOUBLE AS balance,
      NULL::VARCHAR AS missing FROM customer""",
)
def json_records(spark, sf):
    """Files that hold an array of flat records each, read with a schema: a key that no record has is NULL."""
    path = K.work_dir(spark, "records")
    record = F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance"),
        F.lit("not asked for").alias("other"),
    )
    rows = A.table(spark, sf, "customer").withColumn("slice", F.floor(F.col("c_custkey") / _RECORDS))
    arrays = rows.groupBy("slice").agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("slice").text(path)
    schema = "id string, name string, segment string, balance double, missing string"
    return scan_json_records(spark, f"{path}/slice=*", T.StructType.fromDDL(schema))
