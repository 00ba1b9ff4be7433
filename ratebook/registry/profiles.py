"""Profiles, summaries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import rollups as U
from ..operators import sketches as S
from ..operators.joins import null_safe_join
from ..plans import profiles as P
from ..schema import PRICE_FACT
from ..sources.sinks import staged, work_dir
from . import adapters as A
from .core import register

_KINDS = ("dollar", "percentage", "algorithm")


@register(
    "location_summary",
    f"""WITH {A.FACT_SQL}
    SELECT system_name, facility_id, mrf_location_name, COUNT(*) AS negotiated_rows,
      COUNT(DISTINCT payer) AS unique_payers, COUNT(DISTINCT plan) AS unique_plans,
      COUNT(DISTINCT (payer, plan)) AS unique_payer_plan_pairs, COUNT(DISTINCT code_1) AS unique_primary_codes,
      COUNT(negotiated_dollar) AS rows_with_dollar, COUNT(negotiated_percentage) AS rows_with_percentage,
      COUNT(negotiated_algorithm) AS rows_with_algorithm,
      COUNT(*) FILTER (price_representation = 'percentage_algorithm') AS percentage_algorithm_rows
    FROM fact GROUP BY ALL""",
)
def location_summary(spark, sf):
    return P.location_summary(A.price_fact(spark, sf))


@register(
    "stage_metrics",
    f"""WITH {A.FACT_SQL},
    a AS (SELECT facility_id, mrf_location_name, COUNT(*) AS normalized_rows, MAX(source_service_number) AS source_rows
      FROM raw_prices GROUP BY ALL),
    b AS (SELECT facility_id, mrf_location_name, COUNT(*) AS negotiated_price_rows,
        COUNT(*) FILTER (price_representation = 'dollar') AS negotiated_dollar_rows,
        COUNT(*) FILTER (price_representation = 'percentage_algorithm') AS percentage_algorithm_rows
      FROM fact GROUP BY ALL)
    SELECT *, negotiated_price_rows IS NOT NULL AS pipeline_complete FROM a
      LEFT JOIN b USING (facility_id, mrf_location_name)""",
)
def stage_metrics(spark, sf):
    normalized = A.raw_prices(spark, sf).withColumnRenamed("source_service_number", "source_row_number")
    return P.stage_metrics(normalized, A.price_fact(spark, sf))


@register(
    "profile_table",
    f"""WITH {A.RAW_PRICES_SQL}
    SELECT COUNT(*) AS total_rows,
      COUNT(*) FILTER (negotiated_dollar IS NOT NULL OR negotiated_percentage IS NOT NULL OR negotiated_algorithm IS NOT NULL) AS with_any_price,
      COUNT(*) FILTER (negotiated_dollar IS NULL AND negotiated_percentage IS NULL AND negotiated_algorithm IS NULL) AS without_price,
      COUNT(negotiated_dollar) AS with_dollar, COUNT(negotiated_percentage) AS with_percentage,
      COUNT(negotiated_algorithm) AS with_algorithm, COUNT(DISTINCT payer) AS unique_payers,
      COUNT(DISTINCT plan) AS unique_plans, COUNT(DISTINCT (payer, plan)) AS unique_payer_plan_pairs,
      MAX((code_1 IS NOT NULL)::INT + (code_1_type = 'HCPCS')::INT) AS max_codes
    FROM raw_prices""",
)
def profile_table(spark, sf):
    return P.profile_table(
        A.raw_prices(spark, sf),
        prices=[F.col(f"negotiated_{k}").cast("string") for k in _KINDS],
        codes=["code_1", F.when(F.col("code_1_type") == "HCPCS", F.col("code_1_type"))],
    )


@register(
    "profile_frequencies",
    f"""WITH {A.RAW_PRICES_SQL},
    t AS (UNPIVOT (SELECT code_1_type, setting, plan FROM raw_prices) ON code_1_type, setting, plan
      INTO NAME "column" VALUE value)
    SELECT "column", value, COUNT(*) AS row_count FROM t GROUP BY ALL""",
)
def profile_frequencies(spark, sf):
    columns = ["code_1_type", "setting", "plan"]
    return P.frequencies(A.raw_prices(spark, sf), {c: c for c in columns})


@register(
    "profile_representations",
    f"""WITH {A.RAW_PRICES_SQL}
    SELECT coalesce(nullif(concat_ws('_', CASE WHEN negotiated_dollar IS NOT NULL THEN 'dollar' END,
        CASE WHEN negotiated_percentage IS NOT NULL THEN 'percentage' END,
        CASE WHEN negotiated_algorithm IS NOT NULL THEN 'algorithm' END), ''), 'none') AS representation,
      COUNT(*) AS row_count FROM raw_prices GROUP BY ALL""",
)
def profile_representations(spark, sf):
    return P.representation_counts(
        A.raw_prices(spark, sf), [F.col(f"negotiated_{k}").cast("string") for k in _KINDS]
    )


@register(
    "nested_key_presence",
    """SELECT level, key, COUNT(*) AS occurrences FROM (
      SELECT 'event' AS level, unnest(json_keys(props)) AS key FROM events
      UNION ALL SELECT 'line', unnest(['price', 'algorithm_note']) FROM lineitem)
    GROUP BY ALL""",
)
def nested_key_presence(spark, sf):
    events = A.table(spark, sf, "events").select(F.col("props").alias("event"), F.lit(None).cast("string").alias("line"))
    line = F.to_json(
        F.struct(F.col("l_extendedprice").alias("price"), F.lit("x").alias("algorithm_note"))
    )
    lines = A.table(spark, sf, "lineitem").select(
        F.lit(None).cast("string").alias("event"), line.alias("line")
    )
    return P.key_presence(events.unionByName(lines), {"event": "event", "line": "line"})


@register(
    "nested_child_counts",
    """SELECT 'lines' AS relation, n AS children, COUNT(*) AS parents FROM (
      SELECT o_orderkey, COUNT(l_orderkey)::INT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    GROUP BY ALL""",
)
def nested_child_counts(spark, sf):
    lines = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list("l_partkey").alias("lines")  # an order holds a handful of lines
    )
    orders = A.table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return P.child_counts(orders, {"lines": "lines"})


@register(
    "group_size_histogram",
    "SELECT n AS group_size, COUNT(*) AS groups FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1",
)
def group_size_histogram(spark, sf):
    return U.group_size_histogram(A.table(spark, sf, "orders"), ["o_custkey"])


@register(
    "multi_campus_ids",
    """SELECT s_nationkey, s_suppkey, s_name FROM supplier
    WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING COUNT(*) > 4)""",
)
def multi_campus_ids(spark, sf):
    suppliers = A.table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    return U.members_of_large_groups(suppliers, ["s_nationkey"], 4)


@register(
    "missing_counts",
    f"""WITH {A.RAW_PRICES_SQL},
    t AS (SELECT COUNT(*) - COUNT(payer) AS payer, COUNT(*) - COUNT(negotiated_dollar) AS negotiated_dollar,
      COUNT(*) - COUNT(negotiated_percentage) AS negotiated_percentage,
      COUNT(*) - COUNT(negotiated_algorithm) AS negotiated_algorithm FROM raw_prices)
    UNPIVOT t ON payer, negotiated_dollar, negotiated_percentage, negotiated_algorithm
      INTO NAME "column" VALUE missing""",
)
def missing_counts(spark, sf):
    return U.missing_counts(A.raw_prices(spark, sf), ["payer", *[f"negotiated_{k}" for k in _KINDS]])


@register(
    "coverage",
    f"""WITH {A.FACT_SQL}
    SELECT code_1_type, code_1, plan, COUNT(DISTINCT system_name) AS system_count,
      COUNT(DISTINCT facility_id || '|' || mrf_location_name) AS location_count,
      COUNT(DISTINCT system_name) >= 2 AS is_cross_system_comparable,
      COUNT(DISTINCT system_name) = 5 AS is_all_systems
    FROM fact GROUP BY ALL""",
)
def coverage(spark, sf):
    member = F.concat("facility_id", F.lit("|"), "mrf_location_name")
    return U.coverage(A.price_fact(spark, sf), ["code_1_type", "code_1", "plan"], "system_name", member, 5)


@register(
    "validation_report",
    f"""WITH {A.FACT_SQL},
    checks AS (
      SELECT 'unique (source_service_number, source_charge_number)' AS name,
        (SELECT COUNT(*) FROM (SELECT 1 FROM fact GROUP BY source_service_number, source_charge_number HAVING COUNT(*) > 1)) AS observed,
        0 AS expected
      UNION ALL SELECT 'rows', (SELECT COUNT(*) FROM fact), (SELECT COUNT(*) FROM lineitem)
      UNION ALL SELECT 'no nulls in payer', (SELECT COUNT(*) FROM fact WHERE payer IS NULL), 0
      UNION ALL SELECT 'no nulls in negotiated_dollar', (SELECT COUNT(*) FROM fact WHERE negotiated_dollar IS NULL), 0
      UNION ALL SELECT 'some price', 0, 0
      UNION ALL SELECT 'finite negotiated_dollar', (SELECT COUNT(*) FROM fact WHERE negotiated_dollar IS NULL), 0
      UNION ALL SELECT 'columns present (missing billing_class, code_2)', 5, 7
      UNION ALL SELECT 'every location priced', (SELECT COUNT(*) FROM locations WHERE facility_id NOT IN (SELECT facility_id FROM fact)), 0
      UNION ALL SELECT 'systems as expected', (SELECT COUNT(*) FROM region WHERE r_name NOT IN (SELECT system_name FROM fact)), 0
      UNION ALL SELECT 'rows of ' || r_name, (SELECT COUNT(*) FROM fact WHERE system_name = r_name), 1000 FROM region
      UNION ALL SELECT 'rows kept by location join', (SELECT COUNT(*) FROM fact), (SELECT COUNT(*) FROM fact)
    )
    SELECT name, observed::BIGINT AS observed, expected::BIGINT AS expected, observed = expected AS passed FROM checks""",
)
def validation_report(spark, sf):
    fact = A.price_fact(spark, sf)
    places = A.locations(spark, sf)
    regions = A.table(spark, sf, "region").select(F.col("r_name").alias("system_name"))
    joined = fact.join(places.select("facility_id", "city"), "facility_id", "left")
    return Q.validation_report([
        Q.check_unique(fact, ["source_service_number", "source_charge_number"]),
        Q.check_row_count(fact, A.table(spark, sf, "lineitem").count()),
        Q.check_all(
            fact,
            {
                "no nulls in payer": F.col("payer").isNotNull(),
                "no nulls in negotiated_dollar": F.col("negotiated_dollar").isNotNull(),
                "some price": F.col("has_negotiated_price"),
                "finite negotiated_dollar": Q.is_finite("negotiated_dollar"),
            },
        ),
        Q.check_columns(fact, [f.name for f in PRICE_FACT.fields][:5] + ["code_1", "code_2"]),
        Q.check_complete(places, fact, ["facility_id"], "every location priced"),
        Q.check_set(regions, fact, ["system_name"], "systems as expected"),
        Q.check_counts(fact, "system_name", regions.withColumn("expected", F.lit(1000).cast("long"))),
        Q.check_same_count(fact, joined, "rows kept by location join"),
    ])


_HIERARCHY = ["system_name", "facility_id"]


@register(
    "incremental_summaries",
    f"""WITH {A.FACT_SQL},
    priced AS (SELECT system_name, facility_id, negotiated_dollar, code_1 FROM fact WHERE negotiated_dollar IS NOT NULL)
    SELECT grouping_id(system_name, facility_id) AS above, system_name, facility_id, COUNT(*) AS rows,
      MIN(negotiated_dollar) AS low, MAX(negotiated_dollar) AS high, COUNT(DISTINCT code_1) AS codes,
      TRUE AS quartiles_within_bound, TRUE AS codes_within_bound
    FROM priced GROUP BY ROLLUP (system_name, facility_id)""",
)
def incremental_summaries(spark, sf):
    """A mart of stored sketches per location, loaded in batches (one of them twice), merged over batches and up to systems and
    the total; what it tells is held against the rows themselves: the ranks of its quartiles and its distinct codes."""
    rows = A.price_fact(spark, sf).filter("negotiated_dollar is not null")
    rows = staged(rows.select(*_HIERARCHY, "negotiated_dollar", "code_1", "code_1_type"), "priced-rows")
    mart = S.SummaryMart(spark, work_dir(spark, "summary-mart"), _HIERARCHY)
    of = {"codes": "code_1"}
    staying = F.coalesce(F.col("code_1_type") == "MS-DRG", F.lit(False))
    for batch, part in [("other", ~staying), ("stays", staying), ("other", ~staying)]:
        mart.load(batch, rows.filter(part), "negotiated_dollar", of)
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    depth = len(_HIERARCHY)
    merged = S.told(S.levels(mart.current(), _HIERARCHY), quartiles)
    merged = staged(merged.withColumn("above", (F.pow(F.lit(2), depth - F.col("level")) - 1).cast("long")).drop("level"), "told")
    # each row stands below one group of each level
    sides = [F.struct(F.lit((1 << k) - 1).cast("long").alias("above"),
                      *[(F.col(c) if i < depth - k else F.lit(None).cast("string")).alias(c) for i, c in enumerate(_HIERARCHY)])
             for k in range(depth + 1)]
    at = ["above", *_HIERARCHY]
    values = rows.groupBy(*_HIERARCHY, "code_1", F.col("negotiated_dollar").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = values.select(F.inline(F.array(*sides)), "code_1", "v", "n")
    held = null_safe_join(values, merged.select(*at, *quartiles), at).groupBy(*at).agg(
        F.count_distinct("code_1").alias("exact_codes"),
        F.sum("n").alias("all"),
        *[F.sum(F.when(F.col("v") < F.col(q), F.col("n")).otherwise(0)).alias(f"{q}_below") for q in quartiles],
        *[F.sum(F.when(F.col("v") <= F.col(q), F.col("n")).otherwise(0)).alias(f"{q}_upto") for q in quartiles],
    )
    # the ranks of a value are from the rows below it to those up to it; one row is allowed for groups of few
    allowed = S.RANK_ERROR * F.col("all") + 1
    ranked = [(F.col(f"{q}_below") <= p * F.col("all") + allowed) & (F.col(f"{q}_upto") >= p * F.col("all") - allowed)
              for q, p in quartiles.items()]
    counted = F.abs(F.col("codes") - F.col("exact_codes")) <= S.COUNT_ERROR * F.col("exact_codes")
    return null_safe_join(merged, held, at).select(
        "above", *_HIERARCHY, "rows", "low", "high", F.col("exact_codes").alias("codes"),
        (ranked[0] & ranked[1] & ranked[2]).alias("quartiles_within_bound"), counted.alias("codes_within_bound"),
    )
