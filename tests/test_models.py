import random

import numpy as np
import pytest

from ratebook.operators import models as L
from ratebook.operators import moments as M


@pytest.fixture(scope="module")
def frame(spark):
    random.seed(4)
    data = []
    for i in range(160):
        family, category = random.choice("ABC"), random.choice(["Commercial", "Medicare"])
        y = {"A": 0.1, "B": -0.8, "C": 0.5}[family] + (0.3 if category == "Medicare" else 0) + random.gauss(0, 0.2)
        data.append((f"g{i % 13}", family, category, y))
    return spark.createDataFrame(data, "g string, family string, category string, y double").persist()


def closed_form(rows, alpha=1.0):
    families, categories = sorted({r.family for r in rows})[1:], sorted({r.category for r in rows})[1:]
    x = np.array([[r.family == f for f in families] + [r.category == c for c in categories] for r in rows], float)
    y = np.array([r.y for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    return np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)


def test_ridge_equals_closed_form(frame):
    model = L.Ridge().fit(frame, ["family", "category"], "y")
    assert [n for n, _ in model.weights] == ["family_B", "family_C", "category_Medicare"]
    assert np.allclose([w for _, w in model.weights], closed_form(frame.collect()), atol=1e-8)
    table = L.coefficient_table(frame, model).collect()
    assert [r.coefficient for r in table] == sorted(r.coefficient for r in table)
    assert all(abs(r.pct_effect - 100 * (np.exp(r.coefficient) - 1)) < 1e-9 for r in table)


def test_folds_keep_groups_together_and_are_even(frame):
    split = L.grouped_folds(frame, "g", 5)
    per_group = split.groupBy("g").agg({"fold": "min", "*": "count"}).collect()
    assert split.select("g", "fold").distinct().count() == 13 and split.count() == frame.count()
    sizes = [r["count(1)"] for r in per_group]
    folds = [r["count"] for r in split.groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) - min(folds) <= max(sizes)


def test_folds_of_many_equal_groups_are_dealt(spark):
    frame = spark.range(30_000).selectExpr("id % 10000 as g")
    split = L.grouped_folds(frame.unionByName(spark.createDataFrame([(None,)], "g long")), "g", 5)
    assert [r["count"] for r in split.groupBy("fold").count().collect()] == [6_000] * 5
    seen = {r["g"]: r["fold"] for r in split.distinct().collect()}
    assert [seen[g] for g in range(12)] == [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 0, 1]


def test_unseen_category_is_all_zeros(spark, frame):
    model = L.Ridge().fit(frame, ["family"], "y")
    new = spark.createDataFrame([("A",), ("new",)], "family string")
    a, b = [r.prediction for r in model.predict(new).orderBy("family").collect()]
    assert a == b  # the dropped first category and an unknown one look alike


def test_cross_validation_and_segments(frame):
    r = L.cross_validate(frame, L.Ridge, features=["family", "category"], target="y", group="g").first()
    assert r["rows"] == 160 and r["r2"] > 0.7 and r["mae"] < 0.25
    out = L.segment_evaluate(
        frame, "category", ["Commercial", "Medicare", "absent"],
        {"ridge": L.Ridge, "forest": lambda: L.Forest(numTrees=5)}, features=["family"], target="y", group="g", folds=3,
    ).collect()
    assert {(x["category"], x["model"]) for x in out} == {
        (c, m) for c in ("Commercial", "Medicare") for m in ("ridge", "forest")
    }


def test_metrics_refuse_predictions_that_are_not_finite(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, 2.0)], "y double, prediction double")
    with pytest.raises(Exception, match="not finite"):
        L.regression_metrics(df, "y").collect()


def test_forest_importances_sum_to_one(frame):
    model = L.Forest(numTrees=5).fit(frame, ["family", "category"], "y")
    table = L.importance_table(frame, model).collect()
    assert len(table) == 5 and abs(sum(r.importance for r in table) - 1) < 1e-9


# --- additive moments ---------------------------------------------------------------------------------


def _predict(train, rows, features, target="y", alpha=1.0):
    """Ridge by the closed form with the categories of ``train``."""
    used = [(f, v) for f in features for v in sorted({r[f] for r in train})[1:]]
    design = lambda rs: np.array([[float(r[f] == v) for f, v in used] for r in rs]).reshape(len(rs), len(used))
    x, y = design(train), np.array([r[target] for r in train])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(used)), xc.T @ yc) if used else np.zeros(0)
    return y.mean() + (design(rows) - x.mean(0)) @ w


@pytest.mark.parametrize("segment", [[], ["category"]])
def test_all_folds_in_one_pass_equal_a_fit_each(spark, frame, segment):
    rare = spark.createDataFrame([("g1", "Z", "Commercial", 3.0), ("alone", "A", "Rare", 1.0), (None, "A", "Medicare", 1.0)], frame.schema)
    df = frame.unionByName(rare)
    split = M.segment_folds(df, segment, "g", 4).persist()
    got = M.out_of_fold(split, ["family", "category"] if not segment else ["family"], "y", segment=segment).collect()
    rows = split.collect()
    assert len(got) == len(rows)
    want = []
    for s in {tuple(r[c] for c in segment) for r in rows}:
        own = [r for r in rows if tuple(r[c] for c in segment) == s]
        for f in {r.fold for r in own}:
            held = [r for r in own if r.fold == f]
            made = _predict([r for r in own if r.fold != f], held, ["family", "category"] if not segment else ["family"])
            want += [(*[r[c] for c in df.columns], p) for r, p in zip(held, made, strict=True)]
    mine = sorted((*[r[c] for c in df.columns], r.prediction) for r in got)
    assert [x[:-1] for x in mine] == [x[:-1] for x in sorted(want)]
    assert np.allclose([x[-1] for x in mine], [x[-1] for x in sorted(want)], atol=1e-8)
    if segment:
        assert "Rare" not in {r.category for r in rows}  # one group only


def test_moments_equal_mllib(frame):
    features = ["family", "category"]
    table = {r.feature: r.coefficient for r in M.ridge_coefficients(frame, features, "y").collect()}
    model = L.Ridge().fit(frame, features, "y")
    assert sorted(table) == sorted(n for n, _ in model.weights)
    assert all(abs(table[n] - w) < 1e-8 for n, w in model.weights)


def test_moments_of_disjoint_tables_add_up(frame):
    features, key = ["family", "category"], ["a", "b"]
    whole = {(r.a, r.b): r.v for r in M.moments(frame, features, "y", []).collect()}
    halves = [M.moments(frame.filter(c), features, "y", []) for c in ("y > 0", "y <= 0")]
    both = halves[0].unionByName(halves[1]).groupBy(*key).sum("v").collect()
    assert {(r.a, r.b) for r in both} == set(whole)
    assert all(abs(r["sum(v)"] - whole[r.a, r.b]) < 1e-8 for r in both)


def test_segment_folds_equal_grouped_folds(frame):
    one = {r.g: r.fold for r in L.grouped_folds(frame, "g", 5).select("g", "fold").distinct().collect()}
    two = {r.g: r.fold for r in M.segment_folds(frame, [], "g", 5).select("g", "fold").distinct().collect()}
    assert one == two


def test_one_category_and_no_rows(spark, frame):
    same = frame.selectExpr("g", "'A' as family", "y")
    metrics = M.cross_validated_ridge(same, features=["family"], target="y", group="g").first()
    assert metrics["rows"] == 160 and metrics["groups"] == 13 and abs(metrics["r2"]) < 0.2
    assert M.ridge_coefficients(same, ["family"], "y").collect() == []
    assert M.out_of_fold(M.segment_folds(frame.limit(0), [], "g"), ["family"], "y").collect() == []
