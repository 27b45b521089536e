"""Golden literals (the reference's smoke cases and SURVEY FIXTURES C) and
window properties."""

from pyspark.sql import functions as F

from paths import SF01, make_txn
from riskflow import bindings as B
from riskflow.functions.bands import decision, recommendation, risk_band
from riskflow.functions.features import email_features, time_features
from riskflow.operators.windows import prior_profile, velocity
from riskflow.plans.feature_build import build_features


def test_live_features_without_history(spark, txn_schema):
    # amount 100, card 12345, gmail, t = 86400 * 30, no history
    df = make_txn(spark, [dict(txn_id=1, card=12345, amount=100.0, t=86400 * 30,
                               p_email="gmail.com", r_email=None, is_fraud=0, score=0.1)], txn_schema)
    r = build_features(df, scope="prior").first()
    assert r["txn_hour"] == 0 and r["is_night"] == 1
    assert r["card_txn_count_1h"] == 0 and r["card_amt_sum_24h"] == 0.0
    assert r["card_seconds_since_last"] == -1
    assert r["emails_match"] == 0
    assert r["card_amt_mean"] == 100.0 and r["card_amt_std"] == 0.0 and r["card_amt_zscore"] == 0.0
    assert r["card_total_txns"] == 0 and r["card_distinct_channel"] == 0


def test_email_flags(spark, txn_schema):
    rows = [dict(txn_id=i, p_email=p, r_email=r) for i, (p, r) in enumerate([
        ("protonmail.com", None), (None, None), ("", ""), ("gmail.com", "gmail.com"),
        ("gmail.com", "yahoo.com"), ("outlook.com", "outlook.com")])]
    out = {r["txn_id"]: r for r in email_features(make_txn(spark, rows, txn_schema)).collect()}
    assert out[0]["p_email_is_highrisk"] == 1 and out[0]["p_email_isnull"] == 0
    assert out[1]["p_email_isnull"] == 1 and out[1]["emails_match"] == 0
    assert out[2]["p_email_isnull"] == 1 and out[2]["emails_match"] == 0   # '' is missing (S5)
    assert out[3]["emails_match"] == 1 and out[4]["emails_match"] == 0
    assert out[5]["p_email_is_highrisk"] == 1 and out[5]["r_email_is_highrisk"] == 1


def test_night_edges(spark, txn_schema):
    hours = [0, 5, 6, 21, 22, 23]
    df = make_txn(spark, [dict(txn_id=h, t=h * 3600) for h in hours], txn_schema)
    out = {r["txn_id"]: r["is_night"] for r in time_features(df).collect()}
    assert out == {0: 1, 5: 1, 6: 0, 21: 0, 22: 1, 23: 1}


def test_band_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.29,), (0.3,), (0.5,), (0.6,), (0.7,), (0.85,), (0.95,), (None,)],
                               "s double")
    got = [(r[0], r[1], r[2], r[3]) for r in df.select(
        "s", risk_band("s"), decision("s"), recommendation("s")).collect()]
    bands = [g[1] for g in got]
    assert bands == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", None]
    assert [g[2] for g in got][:8] == ["APPROVE", "APPROVE", "REVIEW", "REVIEW", "REVIEW", "REVIEW",
                                         "BLOCK", "BLOCK"]
    assert got[6][3] == "Decline" and got[4][3] == "Hold for review"


def test_same_second_and_window_edges(spark, txn_schema):
    W = 3600
    rows = [dict(txn_id=1, card=1, t=1000, amount=1.0), dict(txn_id=2, card=1, t=1000, amount=2.0),
            dict(txn_id=3, card=1, t=1000 + W, amount=4.0), dict(txn_id=4, card=1, t=1000 + 2 * W + 1, amount=8.0)]
    v = velocity(make_txn(spark, rows, txn_schema), windows={"1h": W})
    out = {r["txn_id"]: r for r in v.collect()}
    # same-second peers exclude each other
    assert out[1]["card_txn_count_1h"] == 0 and out[2]["card_txn_count_1h"] == 0
    # gap of exactly W: inclusive lower edge
    assert out[3]["card_txn_count_1h"] == 2 and out[3]["card_amt_sum_1h"] == 3.0
    # gap of W + 1 from row 3: outside
    assert out[4]["card_txn_count_1h"] == 0
    assert out[2]["card_seconds_since_last"] == 0 and out[1]["card_seconds_since_last"] == -1


def test_split_plan_equals_plain_and_properties(spark):
    txn = B.transactions(spark, SF01)
    plain = velocity(txn).select("txn_id", "card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d",
                                 "card_amt_max_7d", "card_seconds_since_last")
    split = velocity(txn, split_seconds=7 * 86400).select(*plain.columns)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    bad = plain.filter((F.col("card_txn_count_1h") > F.col("card_txn_count_24h"))
                       | (F.col("card_txn_count_24h") > F.col("card_txn_count_7d")))
    assert bad.count() == 0


def test_prior_profile_ignores_future(spark):
    txn = B.transactions(spark, SF01)
    cut = txn.agg(F.percentile("t", 0.5)).first()[0]
    full = prior_profile(txn).filter(F.col("t") < cut)
    early = prior_profile(txn.filter(F.col("t") < cut))
    cols = ["txn_id", "card_total_txns", "card_distinct_addr", "card_amt_mean"]
    a = full.select(*cols).withColumn("card_amt_mean", F.round("card_amt_mean", 9))
    b = early.select(*cols).withColumn("card_amt_mean", F.round("card_amt_mean", 9))
    assert a.exceptAll(b).count() == 0


def test_one_row_card_std(spark, txn_schema):
    rows = [dict(txn_id=1, card=7, t=10, amount=5.0, channel="a", addr=1),
            dict(txn_id=2, card=8, t=10, amount=5.0, channel="a", addr=1),
            dict(txn_id=3, card=8, t=20, amount=5.0, channel="a", addr=1)]
    f = {r["txn_id"]: r for r in build_features(make_txn(spark, rows, txn_schema)).collect()}
    assert f[1]["card_amt_std"] is None and f[1]["card_amt_zscore"] == 0.0
    assert f[2]["card_amt_std"] == 0.0 and f[3]["card_amt_zscore"] == 0.0


def test_daily_split_and_row_numbers(spark):
    from riskflow.operators.windows import row_numbers
    txn = B.transactions(spark, SF01)
    cols = ["txn_id", "card_txn_count_7d", "card_amt_sum_7d", "card_amt_max_24h", "card_seconds_since_last"]
    plain = velocity(txn).select(*cols)
    daily = velocity(txn, split_seconds=3 * 3600).select(*cols)   # 56 context copies per row
    assert plain.exceptAll(daily).count() == 0 and daily.exceptAll(plain).count() == 0
    a = row_numbers(txn, "card").select("txn_id", "rn")
    b = row_numbers(txn, "card", split_seconds=86400).select("txn_id", "rn")
    assert a.exceptAll(b).count() == 0
