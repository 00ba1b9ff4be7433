"""Exact quantiles at any group size, and stored sketches that merge."""

import random

import pytest
from pyspark.sql import functions as F

from ratebook.operators import sketches as S
from ratebook.operators.rollups import equal_weight_rollup


def _disc(values, p):
    values = sorted(values)
    return values[max(-(-int(p * 10000) * len(values) // 10000), 1) - 1]


PS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def _data():
    rng = random.Random(7)
    hot = [("hot", rng.choice([1.0, 2.5, -rng.random() * 100, rng.random() * 1e6])) for _ in range(6000)]
    two = [("two", float(1 + i % 2)) for i in range(2000)]  # the median's rank ends at the first of two values
    return hot + two + [(None, float(i)) for i in range(7)] + [("one", 4.0), ("none", None), (None, None)]


def test_narrowed_quantiles_against_brute_force(spark):
    data = _data()
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in S.narrowed_quantiles(df, ["k"], "v", PS, cuts=5, ordered=20).collect()}
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: tuple(_disc(values, p) for p in PS.values()) for k, values in groups.items()}
    assert S.narrowed_quantiles(df.limit(0), ["k"], "v", PS).collect() == []


def test_large_groups_turn_exact_beside_other_aggregates(spark):
    data = _data()
    df = spark.createDataFrame(data, "k string, v double").withColumn("w", -F.col("v"))
    wanted = {"low": ("v", 0.25), "mid": ("v", 0.5), "neg": ("w", 0.75), "double": (F.col("v") * 2, 0.5)}
    # summaries this coarse are wrong for the hot group; all groups of 100 rows or more are done again
    out = S.agg_with_quantiles(df, ["k"], [F.count("*").alias("n"), F.max("v").alias("_qmax")], wanted, exact_rows=100, accuracy=10)
    assert out.columns == ["k", "n", "_qmax", *wanted]
    for r in out.collect():
        values = [v for k, v in data if k == r.k and v is not None]
        if len(values) >= 100:
            assert (r.low, r.mid, r.double) == (_disc(values, 0.25), _disc(values, 0.5), 2 * _disc(values, 0.5))
            assert r.neg == _disc([-v for v in values], 0.75)
        elif not values:
            assert (r.low, r.mid, r.neg, r.double) == (None, None, None, None)
    assert {r.k: r.n for r in out.collect()}["hot"] == 6000


def test_median_of_a_million_rows_in_one_group(spark):
    """A third of the rows are one value, the others differ; the order of the ids is mixed by a multiplication modulo a prime."""
    n, prime = 1_100_000, 1_100_009
    mixed = (F.col("id") * 7919) % prime
    df = spark.range(n).select(F.lit("s").alias("s"), F.when(F.col("id") % 3 == 0, 500_000.0).otherwise(mixed.cast("double")).alias("x"))
    out = equal_weight_rollup(df.withColumn("description", F.lit("d")), "x", [("plan", ["s"])]).first()
    values = [500_000.0 if i % 3 == 0 else float(i * 7919 % prime) for i in range(n)]
    assert out.median_plan_price == _disc(values, 0.5) and out.source_row_count == n
    quarter = S.agg_with_quantiles(df, ["s"], [], {"q": ("x", 0.25)}).first().q
    assert quarter == _disc(values, 0.25)


def test_mart_is_brought_up_to_date_by_new_batches(spark, tmp_path):
    rows = spark.range(9000).select(
        (F.col("id") % 3).cast("string").alias("system"), (F.col("id") % 9).cast("string").alias("place"),
        F.col("id").cast("double").alias("x"), (F.col("id") % 700).alias("code"),
    ).unionByName(spark.createDataFrame([("0", "x", None, None)], "system string, place string, x double, code long"))
    mart = S.SummaryMart(spark, str(tmp_path / "mart"), ["system", "place"])
    for batch, part in [("a", "x < 4000 or x is null"), ("b", "x >= 4000"), ("b", "x >= 4000")]:  # b is loaded twice
        mart.load(batch, rows.filter(part), "x", {"codes": "code"})
    current = mart.current()
    assert {(r.system, r.place): r.rows for r in current.collect()} == {
        **{(str(i % 3), str(i)): 1000 for i in range(9)}, ("0", "x"): 1}
    told = S.told(S.levels(current, ["system", "place"]), {"median": 0.5}).collect()
    assert sorted((r.level for r in told)) == [0, *[1] * 3, *[2] * 10]
    for r in told:
        if r.place == "x":
            assert (r.low, r.high, r.median, r.codes) == (None, None, None, 0)
            continue
        assert abs(r.median - 4500) <= 9000 * S.RANK_ERROR + 9
        exact = 700 if r.level < 2 else 700  # 9 and 700 have no common factor
        assert abs(r.codes - exact) <= S.COUNT_ERROR * exact
    total = [r for r in told if r.level == 0][0]
    assert (total.rows, total.low, total.high, total.system, total.place) == (9001, 0.0, 8999.0, None, None)
    mart.load("b", rows.filter("x >= 8000"), "x", {"codes": "code"})  # the batch is replaced
    assert S.merge_summaries(mart.current(), []).first().rows == 5001
    with pytest.raises(ValueError):
        mart.load("../b", rows, "x")
