import random

import pytest
from pyspark.sql import functions as F

from ratebook.functions.similarity import dice, trigrams
from ratebook.operators import candidates as C
from ratebook.operators import joins as J
from ratebook.operators import matching as M
from ratebook.operators import quality as Q
from ratebook.operators import ranking as K
from ratebook.operators import reshape as S
from ratebook.operators import rollups as U
from ratebook.plans.normalize import column_groups
from ratebook.operators import zones as Z


def plan(df):
    return df._jdf.queryExecution().toString()


def test_column_groups(spark):
    columns = ["description", "standard_charge|[P]|[A]|negotiated_dollar", "count|[P]|[A]", "median_amount|[P ]|[B]"]
    table = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    assert column_groups(table) == {
        ("P", "A"): {"negotiated_dollar": columns[1], "count": columns[2]}, ("P", "B"): {"median_amount": columns[3]},
    }
    with pytest.raises(Exception, match="occurs twice"):
        column_groups(spark.createDataFrame([], "`count|[P]|[A]` string, `count|[P ]|[A]` string"))


def test_wide_to_long_round_trip(spark, rows):
    df = spark.createDataFrame([(1, "$5", "7"), (2, None, None)], "id int, `count|[P]|[A]` string, `count|[Q]|[A]` string")
    long = S.wide_to_long(df, column_groups(df))
    kept = S.drop_empty(long, ["negotiated_dollar", "negotiated_count"])
    assert rows(kept, "id", "payer", "negotiated_count") == [(1, "P", "$5"), (1, "Q", "7")]
    back = S.conditional_pivot(kept, ["id"], "payer", {"P": "p", "Q": "q"}, {"n": "negotiated_count"})
    assert rows(back) == [(1, "$5", "7")]
    assert "Python" not in plan(long)


def test_conform_keeps_filters_at_the_scan(spark, tmp_path):
    from ratebook.plans.warehouse import SystemTable, multisystem_fact

    spark.createDataFrame([("A", 5.0, 1.0)], "system_name string, negotiated_dollar double, drug_unit double").write.parquet(
        str(tmp_path / "a")
    )
    a = spark.read.parquet(str(tmp_path / "a"))
    union = multisystem_fact([SystemTable(a, {"source_format": "CSV"}), SystemTable(a, {"source_format": "JSON"})])
    assert len(union.columns) == 51 and union.first()["drug_unit"] == "1"
    one = union.filter("source_format = 'CSV' and negotiated_dollar > 3")
    text = one._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "GreaterThan(negotiated_dollar,3.0)" in text


def test_joins(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "n")], "k int, r string")
    assert rows(J.left_n_to_1(left, right, ["k"])) == sorted([(1, "a", "x"), (2, "b", None), (None, "c", None)], key=repr)
    with pytest.raises(Q.CheckFailed):
        J.left_n_to_1(left, right.union(right), ["k"])
    assert rows(J.join_with_flag(left, right, ["k"], "hit"), "l", "hit") == [("a", True), ("b", False), ("c", False)]
    dup = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k int, r string")
    assert rows(J.unique_lookup_join(left, dup, ["k"], "r"), "l", "r") == [("a", "x"), ("b", None), ("c", None)]
    assert rows(J.unique_lookup_join(left, dup, ["k"], "r", null_safe=True), "l", "r") == [("a", "x"), ("b", None), ("c", "n")]
    counted = J.join_back(left, ["k"], [F.count(F.lit(1)).alias("n")], null_safe=True)
    assert rows(counted, "l", "n") == [("a", 1), ("b", 1), ("c", 1)]
    diff = spark.createDataFrame([("1", "1"), ("1", None), (None, None)], "a string, b string")
    assert rows(J.compare_assignments(diff, "a", "b")) == [("1", None)]


def test_ranking_limits_groups_before_the_shuffle(spark, rows):
    df = spark.createDataFrame([("g", i % 5, i) for i in range(20)] + [("h", 1, 99)], "k string, s int, id int")
    top = K.top_n(df, ["k"], [F.col("s").desc(), F.col("id")], 3)
    assert rows(top, "k", "id") == [("g", 14), ("g", 4), ("g", 9), ("h", 99)]
    assert plan(top).count("WindowGroupLimit") >= 2
    best = K.best_and_gap(df, ["k"], "s", [F.col("id")])
    assert rows(best, "k", "id", "second_score", "score_gap") == [("g", 4, 4, 0), ("h", 99, None, None)]


def test_exact_quantiles_against_brute_force(spark):
    random.seed(5)
    # one group holds most rows, with many equal values
    data = [("hot", random.choice([1.0, 2.5, random.random() * 100])) for _ in range(3000)]
    data += [(None, float(i)) for i in range(7)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    ps = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p100": 1.0}
    got = {r["k"]: tuple(r)[1:] for r in U.exact_quantiles(df, ["k"], "v", ps, buckets=16).collect()}
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for k, values in groups.items():
        values.sort()
        assert got[k] == tuple(values[max(-(-int(p * 10000) * len(values) // 10000), 1) - 1] for p in ps.values())
    assert set(got) == set(groups)


def test_equal_weight_rollup_counts_add_up(spark):
    rows_ = [("s", f"l{i % 3}", f"p{i % 5}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows_, "s string, l string, p string, x double").withColumn("description", F.lit("d"))
    out = U.equal_weight_rollup(df, "x", [("plan", ["s", "l", "p"]), ("location", ["s", "l"]), ("system", ["s"])]).first()
    assert (out.source_row_count, out.plan_count, out.location_count) == (60, 15, 3)
    assert out.min_location_price <= out.median_system_price <= out.max_location_price


def test_coverage_on_rows_equals_coverage_by_group(spark, rows):
    data = [("k1", "A", "l1"), ("k1", "A", "l2"), ("k1", "B", "l2"), ("k1", "C", None), ("k2", "A", "l1"), ("k3", None, None)]
    df = spark.createDataFrame(data, "k string, s string, l string")
    cols = ["k", "system_count", "location_count", "is_cross_system_comparable", "is_all_systems"]
    by_group = U.coverage(df, ["k"], "s", F.col("l"), 3)
    on_rows = U.with_coverage(df, ["k"], "s", F.col("l"), 3)
    assert rows(on_rows.select(*cols).distinct()) == rows(by_group, *cols)
    assert on_rows.count() == len(data)


def test_checks(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, float("nan"))], "k int, v double")
    report = Q.validation_report([
        Q.check_unique(df, ["k"]), Q.check_row_count(df, 3), Q.check_no_nulls(df, ["k", "v"]), Q.check_finite(df, ["v"]),
        Q.check_columns(df, ["k", "z"]), Q.check_counts(df.withColumn("k", F.col("k").cast("string")), "k", {"1": 2, "9": 1}),
        Q.check_set(df, df.filter("k = 1"), ["k"]), Q.check_complete(df, df.filter("k = 1"), ["k"]),
        Q.check_same_count(df, df.filter("k = 1")),
    ])
    got = {r["name"]: (r["observed"], r["expected"], r["passed"]) for r in report.collect()}
    assert got == {
        "unique (k)": (1, 0, False), "rows": (3, 3, True), "no nulls in k": (0, 0, True), "no nulls in v": (1, 0, False),
        "finite v": (2, 0, False), "columns present (missing z)": (1, 2, False), "rows of 1": (2, 2, True),
        "rows of 2": (1, 0, False), "rows of 9": (0, 1, False), "same set": (1, 0, False), "complete": (1, 0, False),
        "rows kept": (2, 3, False),
    }
    with pytest.raises(Q.CheckFailed, match="unique"):
        Q.enforce(report)
    Q.enforce(report.filter("passed"))


def brute_force(spark, left, right, weights, n):
    """All pairs of the block, on a small fixture."""
    pairs = left.join(right, F.col("lb") == F.col("rb"))
    combined = None
    for f, w in weights.items():
        pairs = pairs.withColumn(f"{f}_score", dice(trigrams(f"l_{f}"), trigrams(f"r_{f}")))
        term = F.lit(w) * F.col(f"{f}_score")
        combined = term if combined is None else combined + term
    return K.top_n(pairs.withColumn("combined_score", combined), ["lid"], [F.col("combined_score").desc(), F.col("rid")], n)


@pytest.mark.parametrize("floors", [(0.0,), (75.0, 45.0, 20.0, 0.0)])
def test_candidates_equal_all_pairs(spark, rows, floors):
    random.seed(11)
    words = ["MERCY", "SAINT", "ROSE", "GENERAL", "VALLEY", "MERCI", "ST", "COUNTY", "X", "42ND", "HILLS"]

    def side(n, prefix):
        out = []
        for i in range(n):
            name = " ".join(random.choices(words, k=random.randint(0, 3)))
            # a third of the rows are copies in one block
            block, name, street = ("hot", "MERCY GENERAL", "1 MAIN ST") if i % 3 == 0 else (
                random.choice(["hot", "b", "c"]), name, f"{random.randint(1, 30)} {random.choice(words)} ST")
            out.append((i, block, name, street))
        return spark.createDataFrame(out, f"{prefix}id int, {prefix}b string, {prefix}_name string, {prefix}_street string")

    left, right = side(60, "l"), side(70, "r").filter("rb <> 'c'")
    weights = {"name": 0.7, "street": 0.3}
    got = C.top_candidates(
        left, right, left_id="lid", right_id="rid", block=[("lb", "rb")], weights=weights, floors=floors,
        fields={f: ([f"l_{f}"], [f"r_{f}"]) for f in weights},
    )
    want = brute_force(spark, left, right, weights, 3)
    cols = ["lid", "rid", "name_score", "street_score", "combined_score"]
    assert rows(got, *cols, "candidate_rank") == rows(want, *cols, "rank")
    text = plan(got)
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text

    strong = C.top_candidates(
        left, right, left_id="lid", right_id="rid", block=[("lb", "rb")], weights=weights, floors=floors, min_score=60.0,
        fields={f: ([f"l_{f}"], [f"r_{f}"]) for f in weights},
    )
    assert rows(strong, *cols, "candidate_rank") == rows(want.filter("combined_score >= 60"), *cols, "rank")


@pytest.mark.parametrize("digits", [None, 0])
def test_tiles_equal_the_join_of_trigrams(spark, rows, monkeypatch, digits):
    """Texts that all share trigrams, copies among them: no pair is written, and the best are the same."""
    random.seed(7)
    names = ["", "MERCY", "MERCY WEST", "MERCY EAST", "ROSE 11", "ROSE 12"]

    def side(n, prefix):
        out = [(i * 7 % 101, random.choice(["hot", "hot", "hot", "b"]), random.choice(names), random.choice(names), f"{i % 13} MAIN ST") for i in range(n)]
        return spark.createDataFrame(out, f"{prefix}id int, {prefix}b string, {prefix}_name string, {prefix}_other string, {prefix}_street string")

    left, right = side(70, "l"), side(90, "r")
    options = dict(
        left_id="lid", right_id="rid", block=[("lb", "rb")], weights={"name": 0.7, "street": 0.3}, digits=digits,
        fields={"name": (["l_name", "l_other"], ["r_name", "r_other"]), "street": (["l_street"], ["r_street"])},
    )
    want = rows(C.top_candidates(left, right, **options))
    low = rows(C.top_candidates(left, right, min_score=60.0, **options))
    assert len(want) == 210 and len(low) > 20
    joined = []
    pairs = C._pairs
    monkeypatch.setattr(C, "_pairs", lambda *a: joined.append(1) or pairs(*a))
    monkeypatch.setattr(C, "PAIRS_JOINED", 100)
    monkeypatch.setattr(C, "TILE", 16)
    monkeypatch.setattr(C, "CELLS", 200)
    assert rows(C.top_candidates(left, right, **options)) == want
    assert rows(C.top_candidates(left, right, min_score=60.0, **options)) == low
    assert not joined


def test_tiles_are_wide_and_get_texts(spark, monkeypatch):
    """What tiles write does not grow with each 16 right rows, and what they read has no sets of trigrams."""
    left = spark.createDataFrame([(i, f"Mercy {i}") for i in range(20)], "id int, name string")
    right = spark.createDataFrame([(i, f"Mercy West {i}") for i in range(100)], "rid int, name string")
    written, write = {}, C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: written.setdefault(name, df) and write(df, name))
    monkeypatch.setattr(C, "PAIRS_JOINED", 0)
    monkeypatch.setattr(C, "PART_OF_ALL", 0)
    monkeypatch.setattr(C, "TILE", 16)
    out = C.top_candidates(left, right, left_id="id", right_id="rid", fields={"name": (["name"], ["name"])}, weights={"name": 1.0}, n=3)
    assert out.count() == 60
    tiles = written["candidate-pairs"]
    assert tiles.count() == 60 and "_rid" not in tiles.columns and "ids" in tiles.columns


@pytest.mark.parametrize("tiles", [False, True])
def test_candidates_broadcast_nothing_that_grows(spark, monkeypatch, tiles):
    """However small the files of a table look, only tables whose rows were counted are broadcast."""
    left = spark.createDataFrame([(i, str(i % 3), f"Mercy {i}") for i in range(40)], "id int, zip string, name string")
    right = spark.createDataFrame([(i, str(i % 3), f"Mercy West {i}") for i in range(40)], "rid int, zip string, name string")
    monkeypatch.setattr("ratebook.operators.joins.FEW_ROWS", 0)
    if tiles:
        monkeypatch.setattr(C, "PAIRS_JOINED", 0)
        monkeypatch.setattr(C, "PART_OF_ALL", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = C.blocked_candidates(left, right, left_id="id", right_id="rid", blocks=[("zip", "zip", "zip")],
                                   fields={"name": (["name"], ["name"])}, weights={"name": 1.0}, n=1)
        assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)
        assert out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fallback_blocks(spark, rows):
    left = spark.createDataFrame([("a", "1", "X", "Mercy"), ("b", "9", "X", "Mercy"), ("c", None, "Q", "Rose")],
                                 "id string, zip string, city string, name string")
    right = spark.createDataFrame([("r1", "1", "X", "Mercy West"), ("r2", "2", "X", "Mercy"), ("r3", "3", "Y", "Rose")],
                                  "rid string, zip string, city string, name string")
    options = dict(left_id="id", right_id="rid", blocks=[("zip", "zip", "zip"), ("city", "city", "city")],
                   fields={"name": (["name"], ["name"])}, weights={"name": 1.0}, n=1)
    out = C.blocked_candidates(left, right, fallback="all", **options)
    assert rows(out, "id", "rid", "block_method") == [("a", "r1", "zip"), ("b", "r2", "city"), ("c", "r3", "all")]
    assert rows(C.blocked_candidates(left, right, **options), "id") == [("a",), ("b",)]


def test_point_in_zone_against_brute_force(spark, rows):
    random.seed(2)
    zones = [(f"z{i}", [(x, y), (x + s, y), (x + s / 2, y + s)]) for i, (x, y, s) in enumerate(
        [(random.uniform(-5, 5), random.uniform(-5, 5), random.choice([0.3, 1.0, 6.0])) for _ in range(30)])]
    points = [(i, random.uniform(-6, 6), random.uniform(-6, 6)) for i in range(300)] + [(300, None, 1.0)]

    def inside(x, y, ring):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                hit = not hit
        return hit

    zdf = Z.with_bounds(spark.createDataFrame(zones, "zone string, ring array<struct<x:double,y:double>>"))
    pdf = spark.createDataFrame(points, "id int, longitude double, latitude double")
    want = sorted(
        [(i, min([z for z, ring in zones if x is not None and inside(x, y, ring)], default=None)) for i, x, y in points],
        key=repr,
    )
    out = Z.point_in_zone(pdf, zdf, point_id="id")
    assert rows(out, "id", "zone") == want
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_duplicate_content_ignores_missing_hashes(spark, rows):
    df = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "i"), ("d", None), ("e", None)], "m string, h string")
    assert rows(M.duplicate_content(df, "m", "h")) == [("h", "a", 2, "a"), ("h", "b", 2, "a")]


def test_cascade_and_crosswalk(spark, rows):
    left = spark.createDataFrame([("1", "A", "s"), ("2", "B", "t"), ("3", "C", "u"), ("4", "D", "v")], "facility_id string, n string, a string")
    right = spark.createDataFrame([("r1", "A", "s"), ("r2", "Z", "t"), ("r3", "C", "q"), ("r4", "C", "q")], "hcai_id string, n string, a string")
    exact = M.exact_match_cascade(left, right, [("by_name", ["n"]), ("by_address", ["a"])], "hcai_id")
    fuzzy = spark.createDataFrame([("3", "r9", 88.0, True), ("2", "r8", 99.0, True), ("4", "r7", 90.0, False)],
                                  "facility_id string, hcai_id string, combined_score double, auto_accept boolean")
    manual = spark.createDataFrame([("4", "r5", "checked"), ("1", "r6", "late")], "cms_id string, hcai_id string, reason string")
    out = M.build_crosswalk(exact, fuzzy, manual)
    assert rows(out, "facility_id", "hcai_id", "match_method", "match_score", "manual_match_reason") == [
        ("1", "r1", "by_name", 100.0, "late"), ("2", "r2", "by_address", 100.0, None),
        ("3", "r9", "high_confidence_fuzzy", 88.0, None), ("4", "r5", "manual_verified", None, "checked"),
    ]
