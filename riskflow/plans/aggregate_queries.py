"""Registered queries: analytics aggregates and evaluation (AG-2..7, AG-11..16,
AG-18/19, AG-21, AG-25, AG-28/29, ML-3/4/12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.operators import aggregates as A
from riskflow.operators import evaluate as EV
from riskflow.plans.feature_build import build_features
from riskflow.plans.registry import register
from riskflow.plans.sqlhelp import feat_query, txn_query


def _feat(spark, sf):
    return build_features(B.transactions(spark, sf))


def _q(col, q, cond=None):
    x = col if cond is None else f"CASE WHEN {cond} THEN {col} END"
    return f"coalesce(quantile_cont({x}, {q}), 0.0)"


def _rate(cond):
    return (f"coalesce(sum(CASE WHEN {cond} THEN is_fraud ELSE 0 END) / "
            f"nullif(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0), 0.0)")


_RULE_AGG_COLS = {
    "fraud_rate": "coalesce(avg(CASE WHEN is_fraud = 1 THEN 1.0 ELSE 0.0 END), 0.0)",
    "velocity_1h_p50": _q("card_txn_count_1h", 0.5), "velocity_1h_p95": _q("card_txn_count_1h", 0.95),
    "velocity_24h_p50": _q("card_txn_count_24h", 0.5), "velocity_24h_p95": _q("card_txn_count_24h", 0.95),
    "velocity_7d_p50": _q("card_txn_count_7d", 0.5), "velocity_7d_p95": _q("card_txn_count_7d", 0.95),
    "velocity_24h_fraud_mean": "coalesce(avg(CASE WHEN is_fraud = 1 THEN card_txn_count_24h END), 0.0)",
    "velocity_24h_legit_mean": "coalesce(avg(CASE WHEN NOT (is_fraud = 1) THEN card_txn_count_24h END), 0.0)",
    "email_high_risk_fraud_rate": _rate("p_email_is_highrisk = 1"),
    "email_low_risk_fraud_rate": _rate("p_email_is_highrisk IS DISTINCT FROM 1"),
    "email_mismatch_fraud_rate": _rate("emails_match = 0"),
    "email_null_fraud_rate": _rate("p_email_isnull = 1"),
    "d1_zero_fraud_rate": _rate('"D1" = 0'),
    "d1_nonzero_fraud_rate": _rate('"D1" IS NOT NULL AND "D1" != 0'),
    "night_fraud_rate": _rate("is_night = 1"),
    "day_fraud_rate": _rate("is_night IS DISTINCT FROM 1"),
    "fraud_card_distinct_addr_p95": _q("card_distinct_addr", 0.95, "is_fraud = 1"),
    "legit_card_distinct_addr_p95": _q("card_distinct_addr", 0.95, "NOT (is_fraud = 1)"),
    "fraud_card_distinct_products_p95": _q("card_distinct_products", 0.95, "is_fraud = 1"),
    "legit_card_distinct_products_p95": _q("card_distinct_products", 0.95, "NOT (is_fraud = 1)"),
    "amount_p50": _q("amount", 0.5), "amount_p95": _q("amount", 0.95), "amount_p99": _q("amount", 0.99),
    "amount_zscore_fraud_p95": _q("card_amt_zscore", 0.95, "is_fraud = 1"),
    "amount_zscore_legit_p95": _q("card_amt_zscore", 0.95, "NOT (is_fraud = 1)"),
    "amount_sum_24h_fraud_p95": _q("card_amt_sum_24h", 0.95, "is_fraud = 1"),
    "amount_sum_24h_legit_p95": _q("card_amt_sum_24h", 0.95, "NOT (is_fraud = 1)"),
}
_RULE_AGG_SQL = ("SELECT count(*) AS n_transactions, "
                 "CAST(coalesce(sum(CASE WHEN is_fraud = 1 THEN 1 END), 0) AS BIGINT) AS n_fraud, "
                 "min(t) AS date_min, max(t) AS date_max,\n       "
                 + ",\n       ".join(f"{v} AS {k}" for k, v in _RULE_AGG_COLS.items()))


@register("rule_aggregates", ops=("AG-2", "AG-3", "AG-4", "AG-6", "AG-7"),
          sql=feat_query(_RULE_AGG_SQL + "\nFROM feat", list(_RULE_AGG_COLS)))
def q_rule_aggregates(spark, sf):
    return A.rule_aggregates(_feat(spark, sf))


@register("rule_aggregates_high_band", ops=("AG-2", "PF-8", "RU-6"),
          sql=feat_query(_RULE_AGG_SQL + "\nFROM feat WHERE score >= 0.6", list(_RULE_AGG_COLS)))
def q_rule_aggregates_band(spark, sf):
    f = _feat(spark, sf)
    return A.rule_aggregates(f.filter(F.col("score") >= 0.6))


def _top_sql(key, min_n, k):
    return feat_query(f"""
SELECT {key}, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
       sum(is_fraud) / count(*) AS fraud_rate
FROM feat WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) >= {min_n}
ORDER BY fraud_rate DESC, {key} LIMIT {k}""", ["fraud_rate"])


@register("top_email_domains", ops=("AG-5",), sql=_top_sql("p_email", 3, 5))
def q_top_email(spark, sf):
    return A.top_groups(_feat(spark, sf), "p_email", 3, 5)


@register("top_products", ops=("AG-5",), sql=_top_sql("channel", 1, 5))
def q_top_products(spark, sf):
    return A.top_groups(_feat(spark, sf), "channel", 1, 5)


@register("top_hour", ops=("AG-5",), sql=_top_sql("txn_hour", 5, 1))
def q_top_hour(spark, sf):
    return A.top_groups(_feat(spark, sf), "txn_hour", 5, 1)


@register("overview_kpis", ops=("AG-11",), sql=txn_query("""
SELECT count(*) AS total, CAST(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk,
       CAST(sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS critical,
       coalesce(sum(amount), 0.0) AS total_amount,
       coalesce(sum(CASE WHEN score >= 0.6 THEN amount END), 0.0) AS flagged_amount,
       coalesce((count(*) - sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END)) / nullif(count(*), 0), 0.0)
         AS approval_rate
FROM txn""", ["total_amount", "flagged_amount", "approval_rate"]))
def q_overview(spark, sf):
    return A.overview_kpis(B.transactions(spark, sf))


@register("recent_kpis_high", ops=("AG-12", "PF-8"), sql=txn_query("""
SELECT coalesce(sum(amount), 0.0) AS recent_volume, avg(amount) AS average_ticket,
       CAST(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
       sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) / greatest(count(*), 1) AS flagged_share,
       max(score) AS highest_score
FROM (SELECT * FROM txn WHERE score >= 0.3 ORDER BY t DESC, txn_id DESC LIMIT 100)""",
    ["recent_volume", "average_ticket", "flagged_share", "highest_score"]))
def q_recent(spark, sf):
    return A.recent_kpis(B.transactions(spark, sf), 100, 0.3)


@register("catch_rate", ops=("AG-13",), sql=txn_query("""
SELECT count(*) AS total, CAST(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
       CAST(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS confirmed,
       CAST(sum(CASE WHEN score >= 0.6 AND is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS caught,
       coalesce(sum(CASE WHEN score >= 0.6 AND is_fraud = 1 THEN 1 ELSE 0 END)
                / nullif(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END), 0), 0.0) AS catch_rate
FROM txn""", ["catch_rate"]))
def q_catch(spark, sf):
    return A.catch_rate(B.transactions(spark, sf))


@register("rate_by_hour", ops=("AG-14",), sql=txn_query("""
SELECT hour, total, fraud, fraud / total AS fraud_rate, o AS overall_rate,
       CASE WHEN fraud / total >= o * 1.3 THEN 'critical' WHEN fraud / total >= o THEN 'high'
            ELSE 'normal' END AS tier
FROM (SELECT CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour, count(is_fraud) AS total,
             CAST(sum(is_fraud) AS BIGINT) AS fraud
      FROM txn GROUP BY 1), (SELECT avg(is_fraud) AS o FROM txn)""", ["fraud_rate", "overall_rate"]))
def q_rate_by_hour(spark, sf):
    return A.rate_by_hour(B.transactions(spark, sf))


@register("amount_log_histogram", ops=("AG-15",), sql=txn_query("""
SELECT bin, label, n, n / sum(n) OVER (PARTITION BY label) * 100 AS share_pct
FROM (
  SELECT bin, is_fraud AS label, count(*) AS n FROM (
    SELECT is_fraud,
           CAST(CASE WHEN amount = power(10.0, hi) THEN 28
                ELSE floor((log10(amount) - lo) / (hi - lo) * 29) END AS BIGINT) AS bin
    FROM txn, (SELECT log10(greatest(min(amount), 0.1)) AS lo, log10(max(amount)) AS hi FROM txn)
    WHERE amount > 0)
  WHERE bin >= 0 AND bin < 29 GROUP BY 1, 2)""", ["share_pct"]))
def q_log_hist(spark, sf):
    return A.log_histogram(B.transactions(spark, sf))


@register("score_histogram", ops=("AG-16",), sql=txn_query("""
SELECT CAST(least(floor(score * 40), 39) AS BIGINT) AS bin, is_fraud AS label, count(*) AS n
FROM txn WHERE score IS NOT NULL GROUP BY 1, 2"""))
def q_score_hist(spark, sf):
    return A.score_histogram(B.transactions(spark, sf))


_DIST_QS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


@register("distribution_stats", ops=("AG-21",), sql=txn_query(
    "SELECT channel, count(amount) AS n, min(amount) AS min, max(amount) AS max, avg(amount) AS mean, "
    "quantile_cont(amount, 0.5) AS median, stddev_pop(amount) AS std, "
    + ", ".join(f"quantile_cont(amount, {q}) AS p{int(round(q * 100)):02d}" for q in _DIST_QS)
    + " FROM txn GROUP BY channel",
    ["min", "max", "mean", "median", "std"] + [f"p{int(round(q * 100)):02d}" for q in _DIST_QS]))
def q_dist(spark, sf):
    return A.distribution_stats(B.transactions(spark, sf), "amount", "channel", _DIST_QS)


@register("class_weight", ops=("AG-28",), sql=txn_query("""
SELECT CAST(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
       CAST(sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg,
       sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END), 1)
         AS scale_pos_weight
FROM txn""", ["scale_pos_weight"]))
def q_class_weight(spark, sf):
    return A.class_weight(B.transactions(spark, sf))


_SCALER_COLS = ["amount", "card_txn_count_24h", "card_amt_zscore"]


@register("fit_scaler", ops=("AG-29",), sql=feat_query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, "
    f"CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS std FROM feat"
    for c in _SCALER_COLS), ["mean", "std"]))
def q_fit_scaler(spark, sf):
    return A.fit_scaler(_feat(spark, sf), _SCALER_COLS)


@register("activity_summary", ops=("AG-25", "PF-11", "PF-12"), sql=txn_query("""
SELECT section, key, n, CAST(rank AS BIGINT) AS rank FROM (
  SELECT section, key, n, row_number() OVER (PARTITION BY section ORDER BY n DESC, key) AS rank
  FROM (
    SELECT 'bin' AS section, CAST(floor(card / 1000) AS BIGINT) || 'xxx' AS key, count(*) AS n FROM txn GROUP BY 2
    UNION ALL SELECT 'hour', lpad(CAST(CAST(floor((t % 86400) / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':00', count(*) FROM txn GROUP BY 2
    UNION ALL SELECT 'channel', channel, count(*) FROM txn GROUP BY 2
    UNION ALL SELECT 'amount_band', CASE WHEN amount < 5 THEN 'tiny_under_5' WHEN amount < 50 THEN 'small_5_to_50'
            WHEN amount < 500 THEN 'medium_50_to_500' WHEN amount >= 500 THEN 'large_500_plus' END, count(*) FROM txn GROUP BY 2
    UNION ALL SELECT 'email', p_email, count(*) FROM txn GROUP BY 2)
  WHERE key IS NOT NULL)
WHERE (section = 'bin' AND rank <= 10 AND n >= 2) OR (section = 'hour' AND n >= 3)
   OR section IN ('channel', 'amount_band') OR (section = 'email' AND rank <= 5)"""))
def q_activity(spark, sf):
    return A.activity_summary(B.transactions(spark, sf).filter(F.col("score") >= 0.0))


# ---------------------------------------------------------------- evaluation
@register("confusion_at_threshold", ops=("AG-18",), sql=txn_query("""
SELECT tp, fp, fn, tn, 0.5 AS threshold, tp / greatest(tp + fn, 1) AS catch_rate,
       fp / greatest(fp + tn, 1) AS fp_rate, tp / greatest(tp + fp, 1) AS precision
FROM (SELECT CAST(sum(CASE WHEN score >= 0.5 AND is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN score >= 0.5 AND is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN NOT (score >= 0.5) AND is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN NOT (score >= 0.5) AND is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
      FROM txn)""", ["threshold", "catch_rate", "fp_rate", "precision"]))
def q_confusion(spark, sf):
    return EV.confusion(B.transactions(spark, sf), 0.5)


def _grid_values_sql():
    return ", ".join(f"({i}, '{x!r}'::DOUBLE)" for i, x in enumerate(EV.sweep_grid()))


@register("threshold_sweep", ops=("AG-19",), sql=txn_query(f"""
SELECT CAST(g.i AS BIGINT) AS i, g.threshold,
       CAST(sum(CASE WHEN x.score >= g.threshold AND x.is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN x.score >= g.threshold AND x.is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       sum(CASE WHEN x.score >= g.threshold AND x.is_fraud = 1 THEN 1 ELSE 0 END)
         / greatest(sum(CASE WHEN x.is_fraud = 1 THEN 1 ELSE 0 END), 1) * 100 AS catch_pct,
       sum(CASE WHEN x.score >= g.threshold AND x.is_fraud = 0 THEN 1 ELSE 0 END)
         / greatest(sum(CASE WHEN x.is_fraud = 0 THEN 1 ELSE 0 END), 1) * 100 AS fp_pct
FROM (VALUES {_grid_values_sql()}) g(i, threshold), (SELECT * FROM txn WHERE score IS NOT NULL) x
GROUP BY g.i, g.threshold""", ["threshold", "catch_pct", "fp_pct"]))
def q_sweep(spark, sf):
    return EV.threshold_sweep(B.transactions(spark, sf))


_SCORE_TABLE_SQL = """
d AS (SELECT score AS s, CAST(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg
      FROM txn WHERE score IS NOT NULL GROUP BY score),
c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
             sum(pos) OVER () AS "P", sum(neg) OVER () AS "N" FROM d)"""


@register("ranking_metrics", ops=("ML-3", "ML-4", "H3"), sql=txn_query("""
SELECT sum(pos / "P" * tp / (tp + fp)) AS average_precision,
       sum(neg / "N" * (tp + tp - pos) / "P" / 2) AS roc_auc,
       CAST(max("P") AS BIGINT) AS positives, CAST(max("N") AS BIGINT) AS negatives,
       (SELECT tp / "P" FROM c WHERE fp / "N" >= 0.001 ORDER BY s DESC LIMIT 1) AS recall_at_fpr_0_001,
       (SELECT tp / "P" FROM c WHERE fp / "N" >= 0.01 ORDER BY s DESC LIMIT 1) AS recall_at_fpr_0_01
FROM c""", ["average_precision", "roc_auc", "recall_at_fpr_0_001", "recall_at_fpr_0_01"],
    extra_ctes=_SCORE_TABLE_SQL))
def q_ranking(spark, sf):
    return EV.ranking_metrics(B.transactions(spark, sf))


@register("recall_at_fpr_at_most", ops=("ML-4",), sql=txn_query("""
SELECT coalesce(max(CASE WHEN fp / "N" <= 0.05 THEN tp / "P" END), 0.0) AS recall FROM c""",
    ["recall"], extra_ctes=_SCORE_TABLE_SQL))
def q_recall_at_most(spark, sf):
    return EV.recall_at_fpr_at_most(B.transactions(spark, sf), 0.05)


@register("recall_at_legit_p95", ops=("ML-12",), sql=feat_query("""
SELECT thr AS threshold,
       coalesce(avg(CASE WHEN is_fraud = 1 THEN CAST(abs(card_amt_zscore) > thr AS DOUBLE) END), 0.0) AS recall
FROM feat, (SELECT quantile_cont(CASE WHEN is_fraud = 0 THEN abs(card_amt_zscore) END, 0.95) AS thr FROM feat)
GROUP BY thr""", ["threshold", "recall"]))
def q_recall_legit(spark, sf):
    f = _feat(spark, sf).withColumn("err", F.abs("card_amt_zscore"))
    return EV.recall_at_legit_quantile(f, "err")
