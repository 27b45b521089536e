"""Registered queries: feature build, windows, profiles, bands (PF-1..12, WN-1..4,
WN-11, AG-1, AG-8..10, JN-1/2/4/9, SL-1..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.functions import bands as BD
from riskflow.functions import features as FE
from riskflow.operators import profiles as P
from riskflow.operators import windows as W
from riskflow.plans.feature_build import build_features, flagged_report
from riskflow.plans.registry import register
from riskflow.plans.sqlhelp import rounded, txn_query

VEL_DOUBLES = [f"card_amt_{k}_{w}" for w in ("1h", "24h", "7d") for k in ("sum", "max")]

# ---------------------------------------------------------------- PF-1 / PF-2
@register("time_email_features", ops=("PF-1", "PF-2"), sql=txn_query("""
SELECT txn_id,
       CAST(floor(t / 3600) % 24 AS BIGINT) AS txn_hour,
       CAST(floor(t / 86400) AS BIGINT) AS txn_day,
       CAST(floor(t / 86400) % 7 AS BIGINT) AS txn_dayofweek,
       CAST((floor(t / 3600) % 24 >= 22 OR floor(t / 3600) % 24 <= 5) AS BIGINT) AS is_night,
       CAST((p_email IS NULL OR p_email = '') AS BIGINT) AS p_email_isnull,
       CAST(coalesce(p_email IN ('protonmail.com', 'mail.com', 'outlook.com'), false) AS BIGINT) AS p_email_is_highrisk,
       CAST((r_email IS NULL OR r_email = '') AS BIGINT) AS r_email_isnull,
       CAST(coalesce(r_email IN ('protonmail.com', 'mail.com', 'outlook.com'), false) AS BIGINT) AS r_email_is_highrisk,
       CAST(coalesce(NOT (p_email IS NULL OR p_email = '') AND p_email = r_email, false) AS BIGINT) AS emails_match
FROM txn"""))
def q_time_email(spark, sf):
    df = FE.email_features(FE.time_features(B.transactions(spark, sf)))
    return df.select("txn_id", "txn_hour", "txn_day", "txn_dayofweek", "is_night",
                     "p_email_isnull", "p_email_is_highrisk", "r_email_isnull",
                     "r_email_is_highrisk", "emails_match")


# ---------------------------------------------------------------- WN-1 / WN-2
@register("velocity", ops=("WN-1", "WN-2"), sql=txn_query(
    f"SELECT txn_id, card, t,\n       {W.velocity_sql()}\nFROM txn", VEL_DOUBLES))
def q_velocity(spark, sf):
    return W.velocity(B.transactions(spark, sf).select("txn_id", "card", "t", "amount")).drop("amount")


@register("velocity_split", ops=("WN-1", "WN-2", "H1"), sql=txn_query(
    f"SELECT txn_id, card, t,\n       {W.velocity_sql()}\nFROM txn", VEL_DOUBLES))
def q_velocity_split(spark, sf):
    """Skew-safe bucketed plan: must equal the plain plan row for row."""
    return W.velocity(B.transactions(spark, sf).select("txn_id", "card", "t", "amount"),
                      split_seconds=7 * 86400).drop("amount")


@register("velocity_split_daily", ops=("WN-1", "WN-2", "H1"), sql=txn_query(
    f"SELECT txn_id, card, t,\n       {W.velocity_sql()}\nFROM txn", VEL_DOUBLES))
def q_velocity_split_daily(spark, sf):
    """Day buckets, each row copied into the 7 following days: finer splitting
    of a hot card for the price of 8 narrow copies."""
    return W.velocity(B.transactions(spark, sf).select("txn_id", "card", "t", "amount"),
                      split_seconds=86400).drop("amount")


# ---------------------------------------------------------------- AG-1
@register("card_profile", ops=("AG-1",), sql=txn_query("""
SELECT card, avg(amount) AS card_amt_mean, stddev_samp(amount) AS card_amt_std,
       count(txn_id) AS card_total_txns, count(DISTINCT channel) AS card_distinct_products,
       count(DISTINCT addr) AS card_distinct_addr
FROM txn GROUP BY card""", ["card_amt_mean", "card_amt_std"]))
def q_card_profile(spark, sf):
    return P.card_profile(B.transactions(spark, sf))


# ---------------------------------------------------------------- full build (global scope)
_FEATURE_SQL_BODY = f"""
SELECT f.*, p.card_amt_mean, p.card_amt_std, p.card_total_txns, p.card_distinct_products,
       p.card_distinct_addr,
       CASE WHEN p.card_amt_std > 0 THEN (f.amount - p.card_amt_mean) / p.card_amt_std ELSE 0.0 END
         AS card_amt_zscore
FROM (SELECT txn_id, card, t, amount, score,
             {W.velocity_sql()}
      FROM txn) f
LEFT JOIN (SELECT card, avg(amount) AS card_amt_mean, stddev_samp(amount) AS card_amt_std,
                  count(txn_id) AS card_total_txns, count(DISTINCT channel) AS card_distinct_products,
                  count(DISTINCT addr) AS card_distinct_addr
           FROM txn GROUP BY card) p USING (card)"""

_FEATURE_COLS = ["txn_id", "card", "t", "amount", "score"] + [
    f"card_{k}_{w}" for w in ("1h", "24h", "7d") for k in ("txn_count", "amt_sum", "amt_max")] + [
    "card_seconds_since_last", "card_amt_mean", "card_amt_std", "card_total_txns",
    "card_distinct_products", "card_distinct_addr", "card_amt_zscore"]


@register("features_global", ops=("WN-1", "WN-2", "AG-1", "JN-2", "WN-3", "H1"), sql=txn_query(
    "SELECT " + ", ".join(_FEATURE_COLS) + " FROM (" + _FEATURE_SQL_BODY + ") x",
    VEL_DOUBLES + ["amount", "score", "card_amt_mean", "card_amt_std", "card_amt_zscore"]))
def q_features_global(spark, sf):
    """The default (skew-safe) feature build."""
    return build_features(B.transactions(spark, sf)).select(*_FEATURE_COLS)


@register("features_single_exchange", ops=("WN-1", "WN-2", "AG-1", "JN-2", "WN-3"), sql=txn_query(
    "SELECT " + ", ".join(_FEATURE_COLS) + " FROM (" + _FEATURE_SQL_BODY + ") x",
    VEL_DOUBLES + ["amount", "score", "card_amt_mean", "card_amt_std", "card_amt_zscore"]))
def q_features_single(spark, sf):
    """The one-shuffle plan (no hot keys assumed): windows and profile share
    one exchange and one sort."""
    return build_features(B.transactions(spark, sf), split_seconds=None).select(*_FEATURE_COLS)


# ---------------------------------------------------------------- WN-11 prior scope
_PRIOR_SQL = """
SELECT txn_id, card, t,
       CASE WHEN n > 0 THEN s / n ELSE amount END AS card_amt_mean,
       CASE WHEN n > 1 THEN sd ELSE 0.0 END AS card_amt_std,
       CASE WHEN n > 1 AND sd > 0 THEN (amount - s / n) / sd ELSE 0.0 END AS card_amt_zscore,
       n AS card_total_txns, dc AS card_distinct_channel, da AS card_distinct_addr
FROM (
  SELECT txn_id, card, t, amount,
         count(*) OVER w AS n, sum(amount) OVER w AS s, stddev_samp(amount) OVER w AS sd,
         count(DISTINCT channel) OVER w AS dc, count(DISTINCT addr) OVER w AS da
  FROM txn
  WINDOW w AS (PARTITION BY card ORDER BY t, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) z"""
_PRIOR_COLS = ["txn_id", "card", "t", "card_amt_mean", "card_amt_std", "card_amt_zscore",
               "card_total_txns", "card_distinct_channel", "card_distinct_addr"]


@register("prior_profile", ops=("WN-11", "S4"), sql=txn_query(
    _PRIOR_SQL, ["card_amt_mean", "card_amt_std", "card_amt_zscore"]))
def q_prior_profile(spark, sf):
    return W.prior_profile(B.transactions(spark, sf)).select(*_PRIOR_COLS)


@register("prior_profile_split", ops=("WN-11", "H1"), sql=txn_query(
    _PRIOR_SQL, ["card_amt_mean", "card_amt_std", "card_amt_zscore"]))
def q_prior_profile_split(spark, sf):
    return W.prior_profile(B.transactions(spark, sf), split_seconds=7 * 86400).select(*_PRIOR_COLS)


# ---------------------------------------------------------------- flagship report
@register("flagged_report", ops=("PF-6", "SL-1", "WN-1", "WN-3"), sql=txn_query(
    """SELECT txn_id, card, t, amount, score,
       CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH'
            WHEN score >= 0.3 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END AS risk_band,
       CASE WHEN score >= 0.85 THEN 'BLOCK' WHEN score >= 0.3 THEN 'REVIEW'
            WHEN score IS NOT NULL THEN 'APPROVE' END AS decision,
       card_txn_count_1h, card_txn_count_24h, card_txn_count_7d, card_amt_sum_24h,
       card_amt_max_24h, card_seconds_since_last, card_amt_mean, card_amt_zscore
FROM (""" + _FEATURE_SQL_BODY + """) x
WHERE score >= 0.6 ORDER BY score DESC, txn_id LIMIT 50""",
    ["amount", "score", "card_amt_sum_24h", "card_amt_max_24h", "card_amt_mean", "card_amt_zscore"]))
def q_flagged_report(spark, sf):
    return flagged_report(build_features(B.transactions(spark, sf)))


# ---------------------------------------------------------------- PF-6 / PF-7 / ML-11
@register("bands_decisions", ops=("PF-6", "PF-7", "ML-11"), sql=txn_query("""
SELECT txn_id, score,
       CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH'
            WHEN score >= 0.3 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END AS risk_band,
       CASE WHEN score >= 0.85 THEN 'BLOCK' WHEN score >= 0.3 THEN 'REVIEW'
            WHEN score IS NOT NULL THEN 'APPROVE' END AS decision,
       CASE WHEN score >= 0.85 THEN 'Decline' WHEN score >= 0.6 THEN 'Hold for review'
            WHEN score >= 0.3 THEN 'Approve with monitoring' WHEN score IS NOT NULL THEN 'Approve' END
         AS recommendation,
       CASE WHEN "D1" IS NULL THEN score ELSE 0.6 * score + 0.4 * ("D1" / 3.0) END AS combined
FROM txn""", ["score", "combined"]))
def q_bands(spark, sf):
    df = B.transactions(spark, sf)
    anomaly = F.col("D1") / 3.0  # a [0, 1] stand-in anomaly score with nulls
    return df.select("txn_id", "score", BD.risk_band("score").alias("risk_band"),
                     BD.decision("score").alias("decision"),
                     BD.recommendation("score").alias("recommendation"),
                     BD.combined_risk(F.col("score"), anomaly).alias("combined"))


# ---------------------------------------------------------------- PF-8 / PF-9
@register("band_last_days", ops=("PF-8", "PF-9"), sql=txn_query("""
SELECT txn_id, card, t, score FROM txn
WHERE score >= 0.6 AND score < 0.85 AND t >= (SELECT max(t) FROM txn) - 7 * 86400""", ["score"]))
def q_band_last_days(spark, sf):
    df = BD.last_n_days(B.transactions(spark, sf), 7)
    return BD.filter_band(df, "high").select("txn_id", "card", "t", "score")


# ---------------------------------------------------------------- PF-10 / PF-11 / PF-12
@register("time_buckets", ops=("PF-10", "PF-11", "PF-12"), sql=txn_query("""
SELECT txn_id,
       strftime(TIMESTAMP '2017-12-01 00:00:00' + to_seconds(t - 1704067200), '%Y-%m-%d %H:%M:%S') AS event_time,
       CAST(floor(card / 1000) AS BIGINT) AS bin_prefix,
       CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour_bucket,
       CASE WHEN amount < 5 THEN 'tiny_under_5' WHEN amount < 50 THEN 'small_5_to_50'
            WHEN amount < 500 THEN 'medium_50_to_500' WHEN amount >= 500 THEN 'large_500_plus' END
         AS amount_bucket
FROM txn"""))
def q_time_buckets(spark, sf):
    df = B.transactions(spark, sf)
    # seconds since the data's own origin (2024-01-01) placed on the reference origin
    rel = df.withColumn("t_rel", F.col("t") - F.lit(1704067200))
    return rel.select("txn_id",
                      F.date_format(FE.event_timestamp("t_rel"), "yyyy-MM-dd HH:mm:ss").alias("event_time"),
                      FE.bin_prefix("card").alias("bin_prefix"),
                      FE.hour_bucket("t").alias("hour_bucket"),
                      FE.amount_bucket("amount").alias("amount_bucket"))


# ---------------------------------------------------------------- AG-8 / AG-9 / AG-10 / WN-4
@register("merchant_profile", ops=("AG-8",), sql=txn_query("""
SELECT channel, count(*) AS n, avg(is_fraud) AS fraud_rate, avg(amount) AS amt_mean,
       quantile_cont(amount, 0.5) AS amt_median, quantile_cont(amount, 0.95) AS amt_p95
FROM txn WHERE channel IS NOT NULL GROUP BY channel""", ["fraud_rate", "amt_mean", "amt_median", "amt_p95"]))
def q_merchant(spark, sf):
    return P.merchant_profile(B.transactions(spark, sf))


@register("card_summary", ops=("AG-9", "WN-4"), sql=txn_query("""
SELECT card, count(*) AS transaction_count, avg(amount) AS amt_mean,
       coalesce(stddev_samp(amount), 0.0) AS amt_std, min(amount) AS amt_min, max(amount) AS amt_max,
       CAST(sum(is_fraud) AS BIGINT) AS fraud_count_in_history,
       list(txn_id ORDER BY rn DESC) FILTER (WHERE rn <= 5) AS recent_ids
FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY t DESC, txn_id DESC) AS rn FROM txn)
WHERE rn <= 20 GROUP BY card""", ["amt_mean", "amt_std", "amt_min", "amt_max"]))
def q_card_summary(spark, sf):
    s = P.card_summary(B.transactions(spark, sf))
    return s.withColumn("recent_ids", F.transform("recent_transactions", lambda x: x["txn_id"])) \
            .drop("recent_transactions")


@register("compare_to_pattern", ops=("AG-10",), sql=txn_query("""
SELECT txn_id, card, amount, historical_mean, historical_std, hist_n,
       CASE WHEN hist_n >= 2 THEN (amount - historical_mean) / greatest(coalesce(historical_std, 0.0), 1e-6) END AS z_score,
       CASE WHEN hist_n < 2 THEN 'insufficient_history'
            WHEN abs((amount - historical_mean) / greatest(coalesce(historical_std, 0.0), 1e-6)) > 4 THEN 'extreme_outlier'
            WHEN abs((amount - historical_mean) / greatest(coalesce(historical_std, 0.0), 1e-6)) > 2 THEN 'outlier'
            ELSE 'in_pattern' END AS verdict
FROM txn LEFT JOIN (SELECT card, avg(amount) AS historical_mean, stddev_samp(amount) AS historical_std,
                           count(*) AS hist_n FROM txn GROUP BY card) USING (card)""",
    ["amount", "historical_mean", "historical_std", "z_score"]))
def q_compare(spark, sf):
    return P.compare_to_pattern(B.transactions(spark, sf))


@register("latest_velocity", ops=("WN-4",), sql=txn_query(f"""
SELECT card, txn_id, t, card_txn_count_1h, card_amt_sum_1h, card_txn_count_24h, card_amt_sum_24h,
       card_txn_count_7d, card_amt_sum_7d, card_seconds_since_last
FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY t DESC, txn_id DESC) AS rn
      FROM (SELECT txn_id, card, t, {W.velocity_sql()} FROM txn))
WHERE rn = 1""", ["card_amt_sum_1h", "card_amt_sum_24h", "card_amt_sum_7d"]))
def q_latest_velocity(spark, sf):
    feats = W.velocity(B.transactions(spark, sf))
    return P.latest_velocity(feats)


# ---------------------------------------------------------------- JN-1 wide join
@register("orders_with_lines", ops=("JN-1",), sql=rounded("""
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, coalesce(l.n_lines, 0) AS n_lines, l.qty, l.revenue
FROM orders o LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         sum(l_extendedprice * (1 - l_discount)) AS revenue
  FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    ["o_totalprice", "qty", "revenue"]))
def q_orders_lines(spark, sf):
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    li = B.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    j = orders.join(li, orders.o_orderkey == li.l_orderkey, "left").drop("l_orderkey")
    return j.withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


# ---------------------------------------------------------------- JN-4 / JN-9
@register("history_for_flagged_cards", ops=("JN-4",), sql=txn_query("""
SELECT txn_id, card, t, amount FROM txn
WHERE card IN (SELECT card FROM txn WHERE score >= 0.85)""", ["amount"]))
def q_history_for(spark, sf):
    df = B.transactions(spark, sf)
    keys = df.filter(F.col("score") >= 0.85).select("card")
    return P.history_for(df, keys).select("txn_id", "card", "t", "amount")


@register("context_window", ops=("JN-9",), sql=txn_query("""
SELECT n.txn_id, n.card, n.t, n.rn, g.target_id, g._r - n.rn AS "offset"
FROM numbered n JOIN (SELECT txn_id AS target_id, card AS _k, rn AS _r FROM numbered WHERE score >= 0.85) g
  ON n.card = g._k AND n.rn BETWEEN g._r - 50 AND g._r""",
    extra_ctes="numbered AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY t, txn_id) AS rn FROM txn)"))
def q_context_window(spark, sf):
    df = B.transactions(spark, sf)
    targets = df.filter(F.col("score") >= 0.85).select("txn_id")
    return P.context_window(df, targets).select("txn_id", "card", "t", "rn", "target_id", "offset")


# ---------------------------------------------------------------- SL-1..4
@register("top_scores", ops=("SL-1",), sql=txn_query(
    "SELECT txn_id, card, score FROM txn ORDER BY score DESC, txn_id LIMIT 30", ["score"]))
def q_top_scores(spark, sf):
    return (B.transactions(spark, sf).select("txn_id", "card", "score")
             .orderBy(F.col("score").desc(), "txn_id").limit(30))


@register("tail_recent", ops=("SL-2", "WN-4"), sql=txn_query(
    "SELECT txn_id, t, amount FROM txn ORDER BY t DESC, txn_id DESC LIMIT 100", ["amount"]))
def q_tail(spark, sf):
    return W.last_n(B.transactions(spark, sf), None, 100).select("txn_id", "t", "amount")


@register("last_n_per_card", ops=("WN-4", "WN-8"), sql=txn_query("""
SELECT txn_id, card, t FROM (
  SELECT *, row_number() OVER (PARTITION BY card ORDER BY t DESC, txn_id DESC) AS rn FROM txn)
WHERE rn <= 3"""))
def q_last_n_per_card(spark, sf):
    return W.last_n(B.transactions(spark, sf), "card", 3).select("txn_id", "card", "t")


@register("top_terms_email", ops=("SL-4",), sql=txn_query("""
SELECT p_email, count(*) AS n FROM txn WHERE p_email IS NOT NULL
GROUP BY p_email ORDER BY n DESC, p_email LIMIT 5"""))
def q_top_terms(spark, sf):
    df = B.transactions(spark, sf).filter(F.col("p_email").isNotNull())
    return (df.groupBy("p_email").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), "p_email").limit(5))


# ---------------------------------------------------------------- SL-3 / ST-3 / PF-10
@register("sorted_demo_sample", ops=("SL-3", "ST-3", "PF-10"), sql=txn_query("""
SELECT txn_id, is_fraud, strftime(TIMESTAMP '2017-12-01 00:00:00' + to_seconds(t - 1704067200), '%Y-%m-%d %H:%M:%S') AS event_time
FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42:' || CAST(txn_id AS VARCHAR)), txn_id) AS rn
      FROM txn WHERE is_fraud IN (0, 1))
WHERE (is_fraud = 1 AND rn <= 250) OR (is_fraud = 0 AND rn <= 4750)"""))
def q_sorted_sample(spark, sf):
    """The demo sample: 5,000 rows at a 5% fraud rate, event timestamps on the
    reference origin, written globally sorted by time (range-partitioned sort,
    parallel write) and read back."""
    from riskflow.operators.sampling import sample_to_rate
    from riskflow.session import scratch_path
    s = sample_to_rate(B.transactions(spark, sf), 5000, 0.05)
    s = s.withColumn("t_rel", F.col("t") - F.lit(1704067200)).withColumn(
        "event_ts", FE.event_timestamp("t_rel"))
    path = scratch_path(spark, "demo-sample")
    s.orderBy("event_ts", "txn_id").write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select("txn_id", "is_fraud",
                       F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"))
