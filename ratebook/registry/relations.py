"""Reshaping, joining, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact_mean, geomean
from ..operators import joins as J
from ..operators import ranking as K
from ..operators import reshape as S
from ..operators import rollups as U
from ..operators.quality import set_difference
from ..plans.normalize import column_groups
from ..sources.manifest import parse_kv_manifest
from ..sources.nested_json import header_array_rows
from ..sources.sinks import pending_work
from . import adapters as A
from .core import register, to_digits
from .reports import MEAN

# --- reshape ------------------------------------------------------------------------------------------

_PAIRS = [(A.PAYERS[p], A.PLANS[q]) for p in A.PAYERS for q in A.PLANS]
_METRICS = {
    "negotiated_dollar": "max(negotiated_dollar)",
    "negotiated_percentage": "min(negotiated_percentage)",
    "count": "cast(nullif(count(negotiated_algorithm), 0) as string)",
}


def wide_prices(spark, sf):
    """One row per location and code, payer and plan in the column names, as published wide files have it."""
    keys = ["facility_id", "code_1_type", "code_1"]
    # aggregated as narrow rows, whose sort by key can spill, and spread over the columns one key at a time
    cells = (
        A.raw_prices(spark, sf)
        .repartition(*keys)
        .groupBy(*keys, "payer", "plan")
        .agg(
            F.max("negotiated_dollar").alias("negotiated_dollar"),
            F.min("negotiated_percentage").alias("negotiated_percentage"),
            F.nullif(F.count("negotiated_algorithm"), F.lit(0)).cast("string").alias("count"),
        )
    )
    cell = F.struct("payer", "plan", "negotiated_dollar", "negotiated_percentage", "count")
    rows = cells.groupBy(*keys).agg(F.collect_list(cell).alias("cells"))
    columns = []
    for payer, plan in _PAIRS:
        here = F.get(F.filter("cells", lambda c: (c["payer"] == payer) & (c["plan"] == plan)), F.lit(0))
        name = f"[{payer}]|[{plan}]"
        columns += [
            here["negotiated_dollar"].alias(f"standard_charge|{name}|negotiated_dollar"),
            here["negotiated_percentage"].alias(f"standard_charge|{name}|negotiated_percentage"),
            here["count"].alias(f"count|{name}"),
        ]
    return rows.select(*keys, *columns)


@register(
    "wide_to_long",
    f"""WITH {A.RAW_PRICES_SQL},
    t AS (SELECT facility_id, code_1_type, code_1, payer, plan, MAX(negotiated_dollar) AS negotiated_dollar,
        MIN(negotiated_percentage) AS negotiated_percentage, CAST(NULL AS VARCHAR) AS negotiated_algorithm,
        CAST(NULL AS DOUBLE) AS median_amount, CAST(NULL AS DOUBLE) AS p10_amount, CAST(NULL AS DOUBLE) AS p90_amount,
        nullif(COUNT(negotiated_algorithm), 0)::VARCHAR AS negotiated_count, CAST(NULL AS VARCHAR) AS methodology,
        CAST(NULL AS VARCHAR) AS additional_payer_notes
      FROM raw_prices GROUP BY ALL)
    SELECT * FROM t WHERE negotiated_dollar IS NOT NULL OR negotiated_percentage IS NOT NULL
      OR negotiated_count IS NOT NULL""",
)
def wide_to_long(spark, sf):
    wide = wide_prices(spark, sf)
    long = S.wide_to_long(wide, column_groups(wide))
    return S.drop_empty(long, [c for c in long.columns if c not in ("facility_id", "code_1_type", "code_1", "payer", "plan")])


@register(
    "flatten_nested",
    """SELECT l_orderkey, l_linenumber, service_number, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS payer_number, l_partkey, l_extendedprice
    FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS service_number FROM lineitem)""",
)
def flatten_nested(spark, sf):
    # an order holds a handful of lines
    payer = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    charges = (
        A.table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.array_sort(F.collect_list(payer)).alias("payers"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "payers"))).alias("charges"))
    )
    flat = S.flatten_nested(
        charges, [("charges", "charge", "service_number"), ("charge.payers", "payer", "payer_number")]
    )
    return flat.select(
        "l_orderkey", "charge.l_linenumber", "service_number", "payer_number", "payer.l_partkey", "payer.l_extendedprice"
    )


@register(
    "conditional_pivot",
    f"""WITH {A.FACT_SQL},
    t AS (SELECT code_1_type, code_1, system_name, {MEAN} AS price, COUNT(*) AS n FROM fact
      WHERE negotiated_dollar > 0 GROUP BY ALL)
    SELECT code_1_type, code_1,
      {', '.join(f"MAX({c}) FILTER (system_name = '{s}') AS {x}_{n}" for s, x in A.SYSTEMS.items() for c, n in (('price', 'price'), ('n', 'rows')))}
    FROM t GROUP BY ALL HAVING COUNT(*) FILTER (price > 0) = {len(A.SYSTEMS)}""",
)
def conditional_pivot(spark, sf):
    keys = ["code_1_type", "code_1"]
    prices = (
        A.price_fact(spark, sf)
        .filter(F.col("negotiated_dollar") > 0)
        .groupBy(*keys, "system_name")
        .agg(exact_mean("negotiated_dollar", 2).alias("price"), F.count(F.lit(1)).alias("n"))
    )
    sides = S.conditional_pivot(prices, keys, "system_name", A.SYSTEMS, {"price": "price", "rows": "n"})
    return S.complete_pairs(sides, [f"{x}_price" for x in A.SYSTEMS.values()])


@register(
    "header_array_json",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, CAST(NULL AS VARCHAR) AS absent
    FROM events""",
)
def header_array_json(spark, sf):
    events = A.table(spark, sf, "events").select(
        "event_id",
        F.to_json(
            F.array(
                F.array(F.lit("kind"), F.lit("k")),
                F.array("event_type", F.get_json_object("props", "$.k")),
            )
        ).alias("document"),
    )
    return header_array_rows(events, "document", {"k": "k", "kind": "kind", "zone": "absent"}, keep=["event_id"])


@register(
    "kv_manifest",
    """SELECT n_name AS source_file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS record_number,
      s_name AS location_name, CAST(NULL AS VARCHAR) AS source_page_url,
      'https://example.org/' || s_suppkey || ':8080/file' AS mrf_url,
      CASE WHEN s_suppkey % 2 = 0 THEN 'second ' || s_suppkey END AS contact_name,
      CAST(NULL AS VARCHAR) AS contact_email
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def kv_manifest(spark, sf):
    key = F.col("s_suppkey")
    texts = [
        F.concat(F.lit("location-name: "), "s_name"),
        F.lit(""),
        F.concat(F.lit("  mrf-url :https://example.org/"), key, F.lit(":8080/file ")),
        F.when(key % 2 == 0, F.concat(F.lit("contact-name: first "), key)).otherwise("no colon here"),
        F.when(key % 2 == 0, F.concat(F.lit("contact-name: second "), key)).otherwise("unknown-key: x"),
    ]
    lines = (
        A.table(spark, sf, "supplier")
        .join(A.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("source_file"), "s_suppkey", F.posexplode(F.array(*texts)).alias("i", "line"))
        .withColumn("line_number", key * len(texts) + F.col("i"))
    )
    return parse_kv_manifest(lines)


# --- filters and joins --------------------------------------------------------------------------------


@register(
    "row_filters",
    f"""WITH {A.FACT_SQL}
    SELECT facility_id, code_1, payer, plan, negotiated_dollar, source_service_number, source_charge_number FROM fact
    WHERE has_negotiated_dollar AND negotiated_dollar > 50000 AND code_1 IS NOT NULL
      AND upper(trim(code_1_type)) IN ('HCPCS', 'MS-DRG') AND regexp_matches(plan, 'PPO|COMP')
      AND payer ILIKE '%blue%'""",
)
def row_filters(spark, sf):
    return (
        A.price_fact(spark, sf)
        .filter("has_negotiated_dollar")
        .filter((F.col("negotiated_dollar") > 50000) & F.col("code_1").isNotNull())
        .filter(F.upper(F.trim("code_1_type")).isin("HCPCS", "MS-DRG"))
        .filter(F.col("plan").rlike("PPO|COMP") & F.col("payer").ilike("%blue%"))
        .select("facility_id", "code_1", "payer", "plan", "negotiated_dollar", "source_service_number", "source_charge_number")
    )


def _some_customers(spark, sf):
    return A.table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"
    )


@register(
    "left_n_to_1",
    """SELECT o_custkey, o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def left_n_to_1(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return J.left_n_to_1(orders, _some_customers(spark, sf), ["o_custkey"])


@register(
    "one_to_one",
    """SELECT s_suppkey AS key, s_name, c_name FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey""",
)
def one_to_one(spark, sf):
    left = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    right = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return J.one_to_one(left, right, ["key"])


@register(
    "join_indicator",
    """SELECT o_custkey, o_orderkey, c_name, c_mktsegment, c_custkey IS NOT NULL AS has_credit FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def join_indicator(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return J.join_with_flag(orders, _some_customers(spark, sf), ["o_custkey"], "has_credit")


@register(
    "inner_left_equi",
    f"""WITH {A.FACT_SQL}
    SELECT w.city, w.facility_name, COUNT(*) AS row_count, COUNT(f.code_1) AS priced
    FROM locations w LEFT JOIN (SELECT * FROM fact WHERE negotiated_dollar > 90000) f
      USING (facility_id, mrf_location_name) GROUP BY ALL""",
)
def inner_left_equi(spark, sf):
    keys = ["facility_id", "mrf_location_name"]
    priced = A.price_fact(spark, sf).filter("negotiated_dollar > 90000").select(*keys, "code_1")
    return J.left_equi(A.locations(spark, sf).select(*keys, "city", "facility_name"), priced, keys).groupBy(
        "city", "facility_name"
    ).agg(F.count(F.lit(1)).alias("row_count"), F.count("code_1").alias("priced"))


@register(
    "join_grouped",
    """SELECT c_custkey, c_name, first_status, first_priority FROM customer LEFT JOIN
      (SELECT o_custkey, MIN(o_orderstatus) AS first_status, MIN(o_orderpriority) AS first_priority
       FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def join_grouped(spark, sf):
    orders = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("first_status"),
        F.col("o_orderpriority").alias("first_priority"),
    )
    customers = A.table(spark, sf, "customer").select("c_custkey", "c_name")
    return J.join_grouped(customers, orders, ["c_custkey"], ["first_status", "first_priority"])


@register(
    "join_back",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, n, largest FROM orders JOIN
      (SELECT o_custkey, o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM orders GROUP BY ALL)
      USING (o_custkey, o_orderstatus) WHERE n >= 3""",
)
def join_back(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    stats = [F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest")]
    return J.join_back(orders, ["o_custkey", "o_orderstatus"], stats).filter("n >= 3")


@register(
    "semi_anti",
    """SELECT 'with orders' AS side, COUNT(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'without orders', COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'forced', COUNT(*) FROM customer""",
)
def semi_anti(spark, sf):
    customers = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    loaded = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    parts = {
        "with orders": J.semi(customers, loaded, ["key"]),
        "without orders": pending_work(customers, loaded, ["key"]),
        "forced": pending_work(customers, loaded, ["key"], force=True),
    }
    return S.union_all(
        [df.agg(F.count(F.lit(1)).alias("customers")).withColumn("side", F.lit(n)) for n, df in parts.items()]
    )


@register(
    "set_difference",
    """SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def set_difference_query(spark, sf):
    expected = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    found = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return set_difference(expected, found, ["key"])


@register("distinct_keys", "SELECT COUNT(*) AS distinct_keys FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def distinct_keys(spark, sf):
    keys = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return keys.agg(F.count(F.lit(1)).alias("distinct_keys"))


# --- ranking ------------------------------------------------------------------------------------------


@register(
    "share_of_total",
    """SELECT event_type, COUNT(*) AS row_count, 100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM events) AS percent_of_total
    FROM events GROUP BY 1""",
)
def share_of_total(spark, sf):
    return U.share_of_total(A.table(spark, sf, "events"), ["event_type"])


@register("value_counts", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS row_count FROM orders GROUP BY ALL")
def value_counts(spark, sf):
    return U.value_counts(A.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@register(
    "top_n_per_group",
    """SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
    FROM events QUALIFY rank <= 3""",
)
def top_n_per_group(spark, sf):
    events = A.table(spark, sf, "events").select("event_type", "event_id", "value")
    return K.top_n(events, ["event_type"], [F.col("value").desc(), F.col("event_id")], 3)


@register(
    "best_and_gap",
    """SELECT user_id, event_id, value, second_score, value - second_score AS score_gap FROM (
      SELECT user_id, event_id, value, lead(value) OVER w AS second_score, row_number() OVER w AS r FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE r = 1""",
)
def best_and_gap(spark, sf):
    events = A.table(spark, sf, "events").select("user_id", "event_id", "value")
    return K.best_and_gap(events, ["user_id"], "value", [F.col("event_id")])


@register(
    "dedup_first",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def dedup_first(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return K.dedup_first(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@register(
    "topk",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def topk(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return K.top_k(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50)


# --- aggregation --------------------------------------------------------------------------------------


@register(
    "exact_quantiles",
    f"""WITH {A.FACT_SQL}
    SELECT code_1_type, plan, quantile_disc(negotiated_dollar, 0.25) AS p25, quantile_disc(negotiated_dollar, 0.5) AS p50,
      quantile_disc(negotiated_dollar, 0.75) AS p75, quantile_disc(negotiated_dollar, 1.0) AS p100
    FROM fact WHERE negotiated_dollar IS NOT NULL GROUP BY ALL""",
)
def exact_quantiles(spark, sf):
    ps = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    return U.exact_quantiles(A.price_fact(spark, sf), ["code_1_type", "plan"], "negotiated_dollar", ps)


@register(
    "dispersion",
    f"""WITH {A.FACT_SQL}
    SELECT code_1_type, plan, MAX(negotiated_dollar) - MIN(negotiated_dollar) AS price_range,
      round(STDDEV_SAMP(negotiated_dollar) / AVG(negotiated_dollar), 9) AS coefficient_of_variation,
      MAX(negotiated_dollar) / MIN(negotiated_dollar) AS max_to_min_ratio,
      round(exp(AVG(ln(negotiated_dollar))), 6) AS geometric_mean,
      round(MAX(negotiated_dollar) / exp(AVG(ln(negotiated_dollar))), 9) AS top_price_index
    FROM fact WHERE negotiated_dollar > 0 GROUP BY ALL""",
)
def dispersion(spark, sf):
    p = F.col("negotiated_dollar")
    out = (
        A.price_fact(spark, sf)
        .filter(p > 0)
        .groupBy("code_1_type", "plan")
        .agg(
            (F.max(p) - F.min(p)).alias("price_range"),
            F.try_divide(F.stddev_samp(p), F.avg(p)).alias("coefficient_of_variation"),
            F.try_divide(F.max(p), F.min(p)).alias("max_to_min_ratio"),
            geomean(p).alias("geometric_mean"),
            F.try_divide(F.max(p), geomean(p)).alias("top_price_index"),
        )
    )
    return to_digits(to_digits(out, 9, "coefficient_of_variation", "top_price_index"), 6, "geometric_mean")
