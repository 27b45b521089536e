"""Registered queries: models, attribution, sequences, case mining (ML-1..14,
PF-4, PF-5, PF-13..15, PF-19, PF-20, AG-17, AG-29, JN-3, WN-5..9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.functions import cases as C
from riskflow.operators import evaluate as EV
from riskflow.operators import models as M
from riskflow.operators import sequence as Q
from riskflow.operators.sampling import time_split
from riskflow.plans.feature_build import build_features
from riskflow.plans.registry import register
from riskflow.plans.sqlhelp import feat_query
from riskflow.session import materialize


def _feat(spark, sf):
    return build_features(B.transactions(spark, sf))


def _feat_table(spark, sf, cols):
    """``cols`` of the features, written once for jobs that read them many times."""
    return materialize(_feat(spark, sf).select(*dict.fromkeys(cols)), "model-features")


# ----------------------------------------------------------------------------- PF-4 / PF-5
@register("align_and_encode", ops=("PF-4", "PF-5", "S10", "S11"), sql=feat_query("""
SELECT f.txn_id, coalesce(CAST(f."D1" AS DOUBLE), -999.0) AS "D1", coalesce(CAST(f.addr AS DOUBLE), -999.0) AS addr,
       -999.0 AS device_type,
       coalesce(c.code, -1) AS channel_code, coalesce(p.code, -1) AS p_email_code, coalesce(r.code, -1) AS r_email_code
FROM feat f
LEFT JOIN d c ON c."column" = 'channel' AND c.value = f.channel
LEFT JOIN d p ON p."column" = 'p_email' AND p.value = f.p_email
LEFT JOIN d r ON r."column" = 'r_email' AND r.value = f.r_email""", ["D1", "addr", "device_type"], extra_ctes="""
d AS (SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS BIGINT) AS code
      FROM (SELECT DISTINCT 'channel' AS "column", channel AS value FROM feat WHERE channel IS NOT NULL
            UNION SELECT DISTINCT 'p_email', p_email FROM feat WHERE p_email IS NOT NULL
            UNION SELECT DISTINCT 'r_email', r_email FROM feat WHERE r_email IS NOT NULL))"""))
def q_align_encode(spark, sf):
    f = _feat(spark, sf)
    d = M.fit_dictionary(f, M.CATEGORICAL)
    enc = M.apply_dictionary(f, d, M.CATEGORICAL)
    return M.align_schema(enc, ["D1", "addr", "device_type"],
                          keep=["txn_id", "channel_code", "p_email_code", "r_email_code"])


# ----------------------------------------------------------------------------- ML-7 / ML-8 fixed weights
ATTR_FEATURES = ["amount", "card_txn_count_24h", "card_amt_zscore", "is_night", "emails_match",
                 "p_email_is_highrisk"]
# Fixed weights for the SQL-checkable form of the attribution (the fitted form is
# ``attribution_fitted``): contributions are w_i (x_i - mean_i) / std_i.
ATTR_WEIGHTS = [0.8, 0.5, 0.6, 0.3, -0.4, 0.7]


def _fixed_explainer(f):
    st = f.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(-999.0))).alias(f"m{i}")
                 for i, c in enumerate(ATTR_FEATURES)],
               *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(-999.0))).alias(f"s{i}")
                 for i, c in enumerate(ATTR_FEATURES)]).first()
    return M.LinearExplainer(ATTR_FEATURES, [st[f"m{i}"] for i in range(len(ATTR_FEATURES))],
                             [st[f"s{i}"] or 1.0 for i in range(len(ATTR_FEATURES))],
                             ATTR_WEIGHTS, -2.0)


def _attr_sql():
    unp = " UNION ALL ".join(
        f"SELECT txn_id, '{c}' AS feature, {w} * (CAST({c} AS DOUBLE) - m{i}) / "
        f"(CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0 ELSE s{i} END) AS shap FROM feat, st"
        for i, (c, w) in enumerate(zip(ATTR_FEATURES, ATTR_WEIGHTS)))
    stats = ", ".join([f"avg(CAST({c} AS DOUBLE)) AS m{i}" for i, c in enumerate(ATTR_FEATURES)]
                      + [f"stddev_pop(CAST({c} AS DOUBLE)) AS s{i}" for i, c in enumerate(ATTR_FEATURES)])
    body = """
SELECT txn_id, list(feature ORDER BY r) FILTER (WHERE r <= 3) AS top_features,
       sum(greatest(shap, 0.0)) AS total_positive_contribution,
       sum(least(shap, 0.0)) AS total_negative_contribution,
       sum(CASE WHEN feature IN ('amount', 'card_amt_zscore') THEN shap ELSE 0.0 END) AS amount_family,
       CASE WHEN abs(sum(greatest(shap, 0.0))) > 2 * abs(sum(least(shap, 0.0))) THEN 'fraud_signals_dominate'
            WHEN abs(sum(least(shap, 0.0))) > 2 * abs(sum(greatest(shap, 0.0))) THEN 'legit_signals_dominate'
            ELSE 'mixed' END AS signal_balance
FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(shap) DESC, feature) AS r FROM u)
GROUP BY txn_id"""
    return feat_query(body, ["total_positive_contribution", "total_negative_contribution", "amount_family"],
                      extra_ctes=f"st AS (SELECT {stats} FROM feat),\nu AS ({unp})")


@register("attribution_fixed_weights", ops=("ML-7", "ML-8", "PF-13"), sql=_attr_sql())
def q_attr_fixed(spark, sf):
    f = _feat(spark, sf)
    a = M.attribute(f, _fixed_explainer(f), k=3)
    return a.select("txn_id", F.transform("top_drivers", lambda s: s["feature"]).alias("top_features"),
                    "total_positive_contribution", "total_negative_contribution",
                    F.col("by_family")["amount"].alias("amount_family"), "signal_balance")


@register("attribution_fitted", ops=("ML-7", "ML-8", "PF-13", "PF-15"))
def q_attr_fitted(spark, sf):
    """Drivers from a logistic model fitted on the data (rows-only check)."""
    f = _feat_table(spark, sf, ["txn_id", "is_fraud", *M.MODEL_FEATURES])
    ex = M.fit_linear_explainer(f, M.MODEL_FEATURES)
    a = M.attribute(f, ex, k=8)
    d = a.select("txn_id", F.posexplode("top_drivers").alias("pos", "d")).select(
        "txn_id", "pos", F.col("d.feature").alias("feature"), F.col("d.shap").alias("shap"),
        F.col("d.direction").alias("direction"), F.col("d.family").alias("family"),
        M.format_value(F.col("d.value_raw")).alias("value"))
    return M.humanize(d)


# ----------------------------------------------------------------------------- AG-17 / JN-3 / PF-14
_IMP_FEATURES = ["amount", "card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d",
                 "card_amt_zscore", "card_amt_mean", "card_amt_std", "card_distinct_addr",
                 "txn_hour", "is_night", "p_email_is_highrisk", "emails_match", "card_total_txns"]


def _cat_sql(n):
    return f"""CASE
  WHEN contains(lower({n}), 'txn_count') OR contains(lower({n}), 'velocity') OR contains(lower({n}), 'freq') THEN 'Velocity'
  WHEN contains(lower({n}), 'amt') AND (contains(lower({n}), 'zscore') OR contains(lower({n}), 'ratio')
       OR contains(lower({n}), 'mean') OR contains(lower({n}), 'std')) THEN 'Amount anomaly'
  WHEN contains(lower({n}), 'transactionamt') OR lower({n}) = 'amt' OR lower({n}) = 'amount' THEN 'Amount'
  WHEN starts_with(lower({n}), 'card') THEN 'Card'
  WHEN contains(lower({n}), 'emaildomain') OR starts_with(lower({n}), 'p_email') OR starts_with(lower({n}), 'r_email') THEN 'Email'
  WHEN starts_with(lower({n}), 'addr') OR lower({n}) = 'dist1' OR lower({n}) = 'dist2' THEN 'Address / geo'
  WHEN starts_with(lower({n}), 'device') OR starts_with(lower({n}), 'id_') THEN 'Device / identity'
  WHEN contains(lower({n}), 'transactiondt') OR contains(lower({n}), 'hour') OR contains(lower({n}), 'dow')
       OR contains(lower({n}), 'day_of_week') THEN 'Time'
  WHEN starts_with(lower({n}), 'productcd') OR starts_with(lower({n}), 'product') THEN 'Channel'
  WHEN regexp_matches(lower({n}), '^[vcdm]([0-9]|[0-9][0-9])') THEN 'Anonymized (Vesta engineered)'
  ELSE 'Other' END"""


@register("importance_by_category", ops=("AG-17", "JN-3", "PF-14", "ML-6"), sql=feat_query(f"""
SELECT g.category, g.importance, g.importance / (SELECT sum(importance) FROM imp2) * 100 AS pct, t.top_features
FROM (SELECT category, sum(importance) AS importance FROM imp2 GROUP BY category) g
LEFT JOIN (SELECT category, string_agg(feature, ', ' ORDER BY r) AS top_features FROM (
             SELECT *, row_number() OVER (PARTITION BY category ORDER BY importance DESC, feature) AS r FROM imp2)
           WHERE r <= 3 GROUP BY category) t USING (category)""", ["importance", "pct"], extra_ctes=
    "imp AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), CAST(is_fraud AS DOUBLE))) AS importance FROM feat"
        for c in _IMP_FEATURES) + "),\n"
    f"imp2 AS (SELECT feature, importance, {_cat_sql('feature')} AS category FROM imp WHERE importance > 0)"))
def q_importance(spark, sf):
    """Label-correlation importance |corr(feature, label)| as the deterministic
    importance source (the fitted model's own importances: ``classifier_report``)."""
    f = _feat(spark, sf)
    row = f.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col("is_fraud").cast("double"))).alias(c)
                  for c in _IMP_FEATURES]).first()
    imp = spark.createDataFrame([(c, float(row[c]) if row[c] is not None else 0.0) for c in _IMP_FEATURES],
                                "feature string, importance double")
    return M.importance_by_category(imp)


# ----------------------------------------------------------------------------- ML-1/2/3/4/6 fitted
@register("classifier_report", ops=("ML-1", "ML-2", "ML-3", "ML-4", "ML-6", "ST-5", "S15"))
def q_classifier(spark, sf):
    """Boosted trees on the earlier 80% of time, scored on the later 20%;
    ranking metrics of the held-out scores (rows-only: a fitted model)."""
    f = time_split(_feat_table(spark, sf, ["txn_id", "t", "is_fraud", *M.MODEL_FEATURES]))
    train, test = f.filter(F.col("split") == "train"), f.filter(F.col("split") == "test")
    model = M.train_classifier(train, M.MODEL_FEATURES, kind="gbt", max_iter=20)
    scored = M.score(test, model, M.MODEL_FEATURES, keep=["txn_id", "is_fraud"])
    scored = materialize(scored.select("txn_id", "is_fraud", "model_score"), "scored")  # the trees run once a row
    return EV.ranking_metrics(scored, score="model_score")


@register("feature_importances", ops=("ML-1", "ML-6"))
def q_importances(spark, sf):
    f = _feat(spark, sf)
    model = M.train_classifier(f, M.MODEL_FEATURES, kind="gbt", max_iter=10)
    return M.importances(model, M.MODEL_FEATURES)


@register("model_tuning", ops=("ML-5",))
def q_tuning(spark, sf):
    return M.tune(_feat(spark, sf), M.MODEL_FEATURES, parallelism=4)


# ----------------------------------------------------------------------------- WN-5..7 / ML-9..14
@register("padded_windows", ops=("WN-5", "WN-6", "WN-7"), sql=feat_query("""
SELECT txn_id, seq, CAST(1 + len(list_filter(seq, lambda x: x > seq[10])) AS BIGINT) AS current_rank
FROM (SELECT txn_id, list_concat(list_transform(range(10 - len(s)), lambda i: s[1]), s) AS seq
      FROM (SELECT txn_id, list(amount) OVER (PARTITION BY card ORDER BY t, txn_id
                                              ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM feat))"""))
def q_padded(spark, sf):
    f = _feat(spark, sf)
    from riskflow.operators.windows import pad_sequence, rolling_lists
    # small row buckets so the test data exercises the context copies
    r = rolling_lists(f.select("txn_id", "card", "t", "amount"), "card", F.col("amount"), 10,
                      rows_per_bucket=16)
    s = r.select("txn_id", pad_sequence(F.col("seq"), 10).alias("seq"))
    return s.withColumn("current_rank", 1 + F.size(F.filter("seq", lambda x: x > F.element_at("seq", 10))))


@register("sequence_anomaly", ops=("ML-9", "ML-10", "ML-12", "WN-5", "WN-7", "AG-29", "S13", "S14"))
def q_sequence(spark, sf):
    """Linear-autoencoder window scores on the held-out time range (rows-only)."""
    m, win = Q.fit_sequence_model(_feat(spark, sf))
    s = Q.score_windows(win.filter(F.col("split") == "test"), m)
    return s.select("txn_id", "card", "anomaly_score", "normalized_score", "is_anomaly",
                    "current_step_rank", "verdict")


@register("sequence_param_sweep", ops=("ML-14", "ML-12"))
def q_seq_sweep(spark, sf):
    return Q.sweep_sequence_params(_feat(spark, sf))


@register("case_mining", ops=("ML-13", "WN-9", "PF-19", "PF-20"))
def q_case_mining(spark, sf):
    """k-means over fraud rows, the row nearest each centroid, its pattern and
    templated narrative (rows-only: k-means)."""
    f = _feat(spark, sf)
    fraud = f.filter(F.col("is_fraud") == 1)
    reps = M.cluster_nearest(fraud, Q.SEQ_FEATURES)
    rows = reps.join(fraud, "txn_id")
    return C.mined_cases(rows).select("cluster", "size", "txn_id", "pattern", "indicators", "narrative")
