"""Indicator texts as predicates: parsing, every status, every tier, refusals."""

import math

import pytest
from pyspark.sql import functions as F

from riskflow.operators import checks as CH

NUM, CAT = ["amount", "D1", "card_txn_count_1h"], ["channel"]

# text -> (type, feature, operator, value, values)
TEXTS = {
    "amount >= 500 in one go": ("numeric", "amount", ">=", 500.0, None),
    "  amount ≥ $1,250.50.": ("numeric", "amount", ">=", 1250.5, None),
    "D1 = 0": ("numeric", "D1", "==", 0.0, None),
    "D1 != -3, first seen": ("numeric", "D1", "!=", -3.0, None),
    "card_txn_count_1h<2": ("numeric", "card_txn_count_1h", "<", 2.0, None),
    "amount > 5x typical": ("manual", None, None, None, None),
    "amount > 30% of the limit": ("manual", None, None, None, None),
    "amount > 12,34": ("manual", None, None, None, None),
    "dist1 > 100 miles": ("manual", None, None, None, None),
    "amount is web": ("manual", None, None, None, None),
    "channel >= 3": ("manual", None, None, None, None),
    "channel in {web, 'pos' , \"atm\"}": ("categorical", "channel", None, None, ["web", "pos", "atm"]),
    "channel in (web)": ("categorical", "channel", None, None, ["web"]),
    "channel = web": ("categorical", "channel", None, None, ["web"]),
    "channel == 'web'": ("categorical", "channel", None, None, ["web"]),
    "channel is web, mostly": ("categorical", "channel", None, None, ["web"]),
    "channel isolated": ("manual", None, None, None, None),
    "the amount >= 500": ("manual", None, None, None, None),
    "": ("manual", None, None, None, None),
}


def _compiled(spark, texts):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "pattern_id long, check_id long, indicator string")
    return CH.compile_checks(df, NUM, CAT)


def test_indicator_texts(spark):
    got = {r["indicator"]: (r["check_type"], r["feature"], r["operator"], r["value"], r["values"])
           for r in _compiled(spark, [*TEXTS, None]).collect()}
    assert got.pop(None) == ("manual", None, None, None, None)
    assert got == TEXTS


def test_every_status(spark):
    checks = _compiled(spark, ["amount >= 10", "amount > 10", "amount <= 10", "amount < 10", "amount == 10", "amount != 10",
                               "channel in {web, pos}", "ask the cardholder"])
    rows = spark.createDataFrame([(1, 1, 10.0, "web"), (2, 1, 11.0, "atm"), (3, 1, None, None), (4, 1, math.nan, "Web"),
                                  (5, 2, 1.0, "web"), (6, None, 1.0, "web")], "txn_id long, pattern_id long, amount double, channel string")
    ev = CH.evaluate(rows, checks, NUM, CAT)
    got = {r["txn_id"]: [c["status"][0] for c in r["checks"]] for r in ev.collect()}  # present, absent, unknown, manual
    assert got == {1: list("papapapm"), 2: list("ppaaapam"), 3: list("uuuuuuum"), 4: list("uuuuuuam"), 5: [], 6: []}
    long = CH.check_rows(ev)
    assert long.count() == 32 and long.where("check_id = 6 and txn_id = 1").first()["actual_text"] == "web"
    # a feature that the rows do not carry is unknown
    assert {r["status"] for r in CH.check_rows(CH.evaluate(rows.drop("amount"), checks, NUM, CAT)).where("check_id = 0").collect()} == {"unknown"}


@pytest.mark.parametrize("statuses, tier", [
    ("", "no_signals"), ("mu", "insufficient"), ("ppp", "strong"), ("pppaa", "strong"), ("pppaaa", "defining"), ("appaa", "mixed"),
    ("pa", "defining"), ("p", "mixed"), ("mp", "mixed"), ("aa", "no_fit"), ("am", "inconclusive")])
def test_tiers(spark, statuses, tier):
    full = {"p": "present", "a": "absent", "m": "manual", "u": "unknown"}
    df = spark.createDataFrame([([(i, full[s]) for i, s in enumerate(statuses)],)], "checks array<struct<check_id: long, status: string>>")
    row = CH.check_summary(df).first()
    assert row["tier"] == tier
    assert [row[s] for s in CH.STATUSES] == [statuses.count(c) for c in "pamu"]


def test_rule_input_is_refused_below_five_rows(spark):
    day = 86400
    rows = [(i, 0.7 if i < 2 else 0.1, (100 - i) * day) for i in range(40)]
    df = spark.createDataFrame(rows, "txn_id long, score double, t long")
    assert CH.rule_input_set(df, days=200).count() == 12  # 2 flagged, 10 others
    assert CH.rule_input_set(df, days=8, band="all").count() == 9  # both edges count
    for kw in ({"days": 3}, {"days": 200, "band": "critical"}, {"days": 2, "band": "all"}):
        with pytest.raises(CH.TooFewRows):
            CH.rule_input_set(df, **kw)
    with pytest.raises(CH.TooFewRows):
        CH.rule_input_set(df.where(F.lit(False)))


def test_given_rows_reach_every_status(spark):
    from paths import SF001
    from riskflow.plans.registry import load_all
    got = {r["status"]: r["count"] for r in load_all()["pattern_checks"].fn(spark, SF001).groupBy("status").count().collect()}
    assert set(got) == set(CH.STATUSES) and min(got.values()) > 0


def test_case_files_refuse_a_handful(spark):
    from paths import SF001
    from riskflow import bindings as B
    from riskflow.plans.case_files import case_files
    from riskflow.plans.check_queries import CATEGORICAL, _channel_checks
    from riskflow.plans.feature_build import build_features
    from riskflow.plans.model_queries import _fixed_explainer
    from riskflow.operators import models as M
    txn = B.transactions(spark, SF001)
    f = build_features(txn).withColumn("pattern_id", F.col("channel")).withColumn("query_id", F.col("txn_id"))
    none = spark.createDataFrame([], "qid long, rank int, pid long, similarity double, match_band string")
    ids = [r["txn_id"] for r in f.where("score >= 0.6").limit(5).collect()]
    args = dict(numeric=M.MODEL_FEATURES, categorical=CATEGORICAL)
    full = case_files(f.where(F.col("txn_id").isin(ids)), _fixed_explainer(f), _channel_checks(txn), none, **args)
    assert full.count() == 5 and {r["matches"] == [] and len(r["checks"]) > 5 for r in full.collect()} == {True}
    with pytest.raises(CH.TooFewRows):
        case_files(f.where(F.col("txn_id").isin(ids[:4])), _fixed_explainer(f), _channel_checks(txn), none, **args)
