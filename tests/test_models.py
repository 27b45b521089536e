"""Model operators: quality floors and attribution identities."""

from pyspark.sql import functions as F

from paths import SF01
from riskflow import bindings as B
from riskflow.operators import evaluate as EV
from riskflow.operators import models as M
from riskflow.plans.feature_build import build_features


def test_classifier_beats_chance(spark):
    f = build_features(B.transactions(spark, SF01))
    model = M.train_classifier(f, M.MODEL_FEATURES, kind="gbt", max_iter=10)
    scored = M.score(f, model, M.MODEL_FEATURES, keep=["txn_id", "is_fraud"])
    m = EV.ranking_metrics(scored, score="model_score").first()
    assert m["roc_auc"] > 0.75


def test_attribution_sums_to_log_odds(spark):
    f = build_features(B.transactions(spark, SF01))
    ex = M.fit_linear_explainer(f, M.MODEL_FEATURES)
    a = M.attribute(f, ex, k=8)
    fam_total = F.aggregate(F.map_values("by_family"), F.lit(0.0), lambda acc, x: acc + x)
    bad = a.filter(F.abs(fam_total - (F.col("total_positive_contribution")
                                      + F.col("total_negative_contribution"))) > 1e-9)
    assert bad.count() == 0
    assert a.filter(F.size("top_drivers") != 8).count() == 0


def test_format_value_matches_python_g(spark):
    vals = [123.456, 0.000123456, 1234567.0, 42.0, -0.5, 1e-12, 99999.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(M.format_value(F.col("v"))).collect()]
    want = ["missing" if v is None else ("0" if abs(v) < 1e-9 else f"{v:.4g}") for v in vals]
    assert got == want
