"""Regression on the paired differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as L
from ..operators.moments import cross_validated_ridge, ridge_coefficients
from ..sources.sinks import staged
from . import adapters as A
from .core import register, to_digits
from .marts import PAIRED_SQL, paired

TARGET, GROUP = "log_price_ratio", "msdrg_code"
FEATURES = ["payer_family", "payer_category"]
SEGMENTS = ["Commercial", "Medicare"]


def _frame(spark, sf):
    """The modelling frame as a table: every fit reads it again."""
    frame = L.load_model_frame(
        paired(spark, sf), target=TARGET, features=FEATURES, group=GROUP,
        numeric=["europe_price", "asia_price", "europe_vs_asia_ratio"],
    )
    return staged(frame, "model-frame")


@register(
    "model_frame",
    f"""WITH {PAIRED_SQL} SELECT msdrg_code, payer_family, payer_category, europe_price, asia_price,
      europe_vs_asia_ratio, round(log_price_ratio, 9) AS log_price_ratio,
      payer_family || '__' || payer_category AS payer_family_category FROM paired""",
)
def model_frame(spark, sf):
    frame = L.load_model_frame(
        paired(spark, sf), target=TARGET, features=FEATURES, group=GROUP,
        numeric=["europe_price", "asia_price", "europe_vs_asia_ratio"],
    )
    return to_digits(L.interaction_feature(frame, FEATURES, "payer_family_category"), 9, TARGET)


@register(
    "grouped_folds",
    """WITH sizes AS (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1),
    dealt AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_suppkey) - 1 AS i FROM sizes)
    SELECT l_suppkey, n, CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS fold FROM dealt""",
)
def grouped_folds(spark, sf):
    split = L.grouped_folds(A.table(spark, sf, "lineitem").select("l_suppkey"), "l_suppkey", 5)
    return split.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("fold").alias("fold"))


# Normal equations in SQL: a model's matrix is a list of rows, its last column the right-hand side; one step of the
# recursion clears one column in all other rows.


def _moments_sql(rows: str, features: list[str], segment: str | None) -> str:
    """Coefficients of the models of each segment and held-out fold of ``rows`` (segment, fold, y and the features)."""
    names = " UNION ALL ".join(f"SELECT seg, held, id, {i} AS f, {c}::VARCHAR AS v, y FROM train" for i, c in enumerate(features))
    return f"""
    held AS (SELECT DISTINCT seg, fold AS held FROM {rows}),
    train AS (SELECT h.held, t.* FROM held h JOIN {rows} t ON t.seg = h.seg AND t.fold <> h.held),
    cells AS ({names}),
    used AS (SELECT seg, held, f, v, row_number() OVER (PARTITION BY seg, held ORDER BY f, v) AS i FROM
      (SELECT seg, held, f, v, row_number() OVER (PARTITION BY seg, held, f ORDER BY v) AS place FROM
        (SELECT DISTINCT seg, held, f, v FROM cells)) WHERE place > 1),
    totals AS (SELECT seg, held, COUNT(*)::DOUBLE AS n, AVG(y) AS my FROM train GROUP BY ALL),
    design AS (SELECT seg, held, id, i, y FROM cells JOIN used USING (seg, held, f, v)),
    sums AS (SELECT seg, held, i, COUNT(*)::DOUBLE AS c, SUM(y) AS sy FROM design GROUP BY ALL),
    meets AS (SELECT a.seg, a.held, a.i, b.i AS j, COUNT(*)::DOUBLE AS c FROM design a JOIN design b USING (seg, held, id) GROUP BY ALL),
    entries AS (SELECT a.seg, a.held, a.i, b.i AS j, coalesce(m.c, 0) - a.c * b.c / n + CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS x
      FROM sums a JOIN sums b USING (seg, held) JOIN totals USING (seg, held)
      LEFT JOIN meets m ON m.seg = a.seg AND m.held = a.held AND m.i = a.i AND m.j = b.i
      UNION ALL SELECT seg, held, i, 1000000, sy - c * my FROM sums JOIN totals USING (seg, held)),
    rows_ AS (SELECT seg, held, i, list(x ORDER BY j) AS r FROM entries GROUP BY ALL),
    steps AS (
      SELECT seg, held, 1 AS k, list(r ORDER BY i) AS m FROM rows_ GROUP BY seg, held
      UNION ALL
      SELECT seg, held, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k])
        ELSE list_transform(row, lambda x, j: x - row[k] / m[k][k] * m[k][j]) END)
      FROM steps WHERE k <= len(m)),
    solved AS (SELECT seg, held, m FROM steps WHERE k = len(m) + 1),
    weights AS (SELECT u.seg, u.held, f, v, m[u.i][len(m) + 1] AS w FROM used u JOIN solved s ON s.seg = u.seg AND s.held = u.held),
    intercepts AS (SELECT seg, held, my - coalesce(SUM(c / n * w), 0) AS w0 FROM totals LEFT JOIN sums USING (seg, held)
      LEFT JOIN (SELECT seg, held, i, w FROM weights JOIN used USING (seg, held, f, v)) USING (seg, held, i) GROUP BY seg, held, my)"""


def _folds_sql(segment: str) -> str:
    """Rows of ``frame`` with their fold, dealt out by group within each segment."""
    return f"""
    sizes AS (SELECT *, COUNT(*) OVER (PARTITION BY seg) AS groups FROM
      (SELECT {segment} AS seg, {GROUP} AS g, COUNT(*) AS n FROM frame GROUP BY ALL)),
    dealt AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY n DESC, g) - 1 AS i, least(5, groups) AS k FROM sizes WHERE groups > 1),
    split AS (SELECT f.*, {segment} AS seg, groups, CASE WHEN (i // k) % 2 = 0 THEN i % k ELSE k - 1 - i % k END AS fold
      FROM (SELECT *, row_number() OVER () AS id FROM frame) f JOIN dealt d ON d.seg IS NOT DISTINCT FROM {segment} AND d.g = {GROUP})"""


_FRAME_SQL = f"""{PAIRED_SQL},
    frame AS (SELECT msdrg_code, payer_family, payer_category, payer_family || '__' || payer_category AS payer_family_category,
      log_price_ratio AS y FROM paired)"""


def _cv_sql(features: list[str], segment: str = "1") -> str:
    lookups = " ".join(
        f"LEFT JOIN weights w{i} ON w{i}.seg = t.seg AND w{i}.held = t.fold AND w{i}.f = {i} AND w{i}.v = t.{c}" for i, c in enumerate(features)
    )
    prediction = " + ".join(["w0", *[f"coalesce(w{i}.w, 0)" for i in range(len(features))]])
    return f"""WITH RECURSIVE {_FRAME_SQL}, {_folds_sql(segment)}, {_moments_sql('split', features, segment)},
    predicted AS (SELECT t.seg, t.groups, t.y, {prediction} AS p FROM split t
      JOIN intercepts n ON n.seg = t.seg AND n.held = t.fold {lookups})
    SELECT {'' if segment == '1' else f'seg AS {segment}, '}COUNT(*) AS rows, MAX(groups) AS groups,
      round(1 - SUM((y - p) ** 2) / (var_pop(y) * COUNT(*)), 6) AS r2, round(AVG(abs(y - p)), 6) AS mae FROM predicted GROUP BY seg"""


def _cv(spark, sf, features, segment=()):
    frame = L.interaction_feature(_frame(spark, sf), FEATURES, "payer_family_category")
    return to_digits(cross_validated_ridge(frame, features=features, target=TARGET, group=GROUP, segment=segment), 6, "r2", "mae")


@register("ridge_cv", _cv_sql(FEATURES))
def ridge_cv(spark, sf):
    return _cv(spark, sf, FEATURES)


@register("interaction_ridge_cv", _cv_sql(["payer_family_category"]))
def interaction_ridge_cv(spark, sf):
    return _cv(spark, sf, ["payer_family_category"])


@register("segment_ridge_cv", _cv_sql(["payer_family"], "payer_category"))
def segment_ridge_cv(spark, sf):
    return _cv(spark, sf, ["payer_family"], ["payer_category"])


@register(
    "ridge_coefficients",
    f"""WITH RECURSIVE {_FRAME_SQL}, all_rows AS (SELECT *, 1 AS seg, 0 AS fold, row_number() OVER () AS id FROM frame
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 1, 1, 0),
    {_moments_sql('all_rows', FEATURES, None)}
    SELECT CASE f {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES))} END || '_' || v AS feature,
      round(w, 6) AS coefficient, round(exp(w), 6) AS multiplicative_effect, round(100 * (exp(w) - 1), 4) AS pct_effect
    FROM weights WHERE held = 1""",
)
def ridge_coefficients_query(spark, sf):
    table = to_digits(ridge_coefficients(_frame(spark, sf), FEATURES, TARGET), 6, "coefficient", "multiplicative_effect")
    return to_digits(table, 4, "pct_effect")


@register("forest_cv")
def forest_cv(spark, sf):
    return L.cross_validate(_frame(spark, sf), L.Forest, features=FEATURES, target=TARGET, group=GROUP)


@register("forest_importance")
def forest_importance(spark, sf):
    frame = _frame(spark, sf)
    return L.importance_table(frame, L.Forest().fit(frame, FEATURES, TARGET))


@register("segment_cv")
def segment_cv(spark, sf):
    return L.segment_evaluate(
        _frame(spark, sf), "payer_category", SEGMENTS, {"ridge": L.Ridge, "forest": L.Forest},
        features=["payer_family"], target=TARGET, group=GROUP,
    )
