"""Registered queries: checks, their summary, the driver checklist, the rule
input set and the scored pattern rules (RU-6..RU-9, JN-8, AG-26, PF-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.functions import cases as C
from riskflow.operators import checks as CH
from riskflow.operators import models as M
from riskflow.operators import vectors as V
from riskflow.operators.quantiles import quantile_table
from riskflow.plans import incremental as INC
from riskflow.plans.case_files import case_files
from riskflow.plans.feature_build import build_features
from riskflow.plans.model_queries import ATTR_FEATURES, ATTR_WEIGHTS, _fixed_explainer
from riskflow.plans.registry import register
from riskflow.plans.rule_queries import _AUTO_FEATURES, _auto_sql
from riskflow.plans.sqlhelp import feat_query, txn_query
from riskflow.plans.vector_queries import _topk_sql
from riskflow.session import materialize

CATEGORICAL = ["channel", "p_email", "r_email"]


def _feat(spark, sf):
    return build_features(B.transactions(spark, sf))


# ----------------------------------------------------------------------------- RU-7 / RU-8 / JN-8 / AG-26
#: indicator texts of the pattern that each channel stands for; {hi}: the channel's upper amount quartile, {channel}: its name
INDICATORS = [
    "amount >= ${hi} for this channel",
    "card_txn_count_24h > 1 transactions in a day",
    "card_amt_zscore ≥ 1.5 deviations from the card's mean",
    "p_email in {{gmail.com, protonmail.com}}",
    "D1 <= 1 days since the device was first seen",
    "emails_match = 0",
    "channel is {channel}",
    "amount > 5x what the cardholder usually spends",
    "dist1 > 100 miles from the billing address",
    "The cardholder cannot be reached",
]
#: what each of them says, as SQL over ``feat`` (true, false, or null for no value); none: left to a person
_MEANT = ["amount >= hi", "card_txn_count_24h > 1", "card_amt_zscore >= 1.5", "p_email IN ('gmail.com', 'protonmail.com')",
          '"D1" <= 1', "emails_match = 0", "channel = channel", None, None, None]

_HI = "hi AS (SELECT channel, CAST(floor(quantile_cont(amount, 0.75)) AS BIGINT) AS hi FROM txn WHERE channel IS NOT NULL GROUP BY channel)"
_STATUS_ROWS = "\nUNION ALL ".join(
    f"SELECT txn_id, CAST({i} AS BIGINT) AS check_id, " + (
        f"CASE WHEN ({p}) IS NULL THEN 'unknown' WHEN {p} THEN 'present' ELSE 'absent' END" if p else "'manual'")
    + " AS status FROM feat JOIN hi USING (channel)" for i, p in enumerate(_MEANT))


def _channel_checks(txn):
    """The compiled checks of every channel's pattern."""
    hi = quantile_table(txn.where("channel is not null"), [("amount", {"hi": 0.75})], ["channel"]).select(
        F.col("channel").alias("pattern_id"), F.floor("hi").cast("string").alias("hi"))
    texts = F.array(*[F.concat(*[F.col({"hi": "hi", "channel": "pattern_id"}[p]) if p in ("hi", "channel") else F.lit(p)
                                 for p in _pieces(t)]) for t in INDICATORS])
    checks = hi.select("pattern_id", F.posexplode(texts).alias("check_id", "indicator"))
    return CH.compile_checks(checks, M.MODEL_FEATURES, CATEGORICAL)


def _evaluated(spark, sf):
    checks = _channel_checks(B.transactions(spark, sf))
    rows = _feat(spark, sf).withColumn("pattern_id", F.col("channel")).where("channel is not null")
    return CH.evaluate(rows, checks, M.MODEL_FEATURES, CATEGORICAL)


def _pieces(template: str) -> list[str]:
    """A template cut at its two names."""
    import re
    return [p for p in re.split(r"\{(hi|channel)\}", template.replace("{{", "{").replace("}}", "}")) if p]


@register("pattern_checks", ops=("RU-7", "RU-8", "JN-8"), sql=feat_query(_STATUS_ROWS, extra_ctes=_HI))
def q_pattern_checks(spark, sf):
    """Indicator texts with thresholds from the data, compiled to predicates and
    evaluated on every transaction of the pattern's channel."""
    return CH.check_rows(_evaluated(spark, sf)).select("txn_id", "check_id", "status")


@register("pattern_check_summary", ops=("AG-26", "JN-8"), sql=feat_query(f"""
SELECT txn_id, present, absent, manual, unknown,
       CASE WHEN present + absent = 0 THEN 'insufficient' WHEN present >= 3 AND present > absent THEN 'strong'
            WHEN first AND absent > 0 THEN 'defining' WHEN present > 0 THEN 'mixed'
            WHEN absent >= 2 THEN 'no_fit' ELSE 'inconclusive' END AS tier
FROM (SELECT txn_id, count(*) FILTER (WHERE status = 'present') AS present, count(*) FILTER (WHERE status = 'absent') AS absent,
             count(*) FILTER (WHERE status = 'manual') AS manual, count(*) FILTER (WHERE status = 'unknown') AS unknown,
             bool_or(check_id = 0 AND status = 'present') AS first
      FROM ({_STATUS_ROWS}) GROUP BY txn_id)""", extra_ctes=_HI))
def q_pattern_summary(spark, sf):
    return CH.check_summary(_evaluated(spark, sf)).select("txn_id", *CH.STATUSES, "tier")


# ----------------------------------------------------------------------------- RU-9
def _checklist_sql() -> str:
    stats = ", ".join([f"avg(coalesce(CAST({c} AS DOUBLE), -999.0)) AS m{i}, stddev_pop(coalesce(CAST({c} AS DOUBLE), -999.0)) AS s{i}"
                       for i, c in enumerate(ATTR_FEATURES)])
    each = "\nUNION ALL ".join(
        f"SELECT txn_id, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), -999.0) AS v, "
        f"{w} * (coalesce(CAST({c} AS DOUBLE), -999.0) - m{i}) / (CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0 ELSE s{i} END) AS shap "
        f"FROM feat, st WHERE score >= 0.6" for i, (c, w) in enumerate(zip(ATTR_FEATURES, ATTR_WEIGHTS)))
    asked = " ".join(f"WHEN '{f}' THEN '{q.replace(chr(39), chr(39) * 2)}'" for f, q in INC.FEATURE_QUESTIONS)
    base = "\nUNION ALL ".join(
        f"SELECT txn_id, CAST({100 + i} AS BIGINT), CAST(NULL AS VARCHAR), '{q}', 'asked for every flagged transaction', 'manual', "
        f"CAST(NULL AS DOUBLE), 'Baseline check' FROM feat WHERE score >= 0.6" for i, q in enumerate(INC.BASELINE_CHECKS))
    return feat_query(f"""
SELECT txn_id, rank, feature, CASE feature {asked} END AS question,
       CASE WHEN shap > 0 THEN 'raises the score' ELSE 'lowers the score' END AS rationale,
       {_auto_sql('feature', 'v')} AS status, v AS actual_value, 'Model-driven check' AS category
FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(shap) DESC, feature) AS rank
      FROM u WHERE abs(shap) >= {INC.MIN_POSITIVE_SHAP} AND shap >= {INC.MAX_NEGATIVE_SHAP}) WHERE rank <= 5
UNION ALL {base}""", ["actual_value"], extra_ctes=f"st AS (SELECT {stats} FROM feat),\nu AS ({each})")


@register("driver_checklist", ops=("RU-9", "RU-10", "S16", "S18"), sql=_checklist_sql())
def q_checklist(spark, sf):
    f = _feat(spark, sf)
    a = M.attribute(f.filter(F.col("score") >= 0.6), _fixed_explainer(f), k=8)
    return INC.driver_checklist(a)


# ----------------------------------------------------------------------------- the case file
def _case_sql() -> str:
    signal = " OR ".join("(" + _auto_sql(f"'{c}'", f"CAST({c} AS DOUBLE)") + ") = 'present'" for c in _AUTO_FEATURES[:-1])
    stats = ", ".join([f"avg(coalesce(CAST({c} AS DOUBLE), -999.0)) AS m{i}, stddev_pop(coalesce(CAST({c} AS DOUBLE), -999.0)) AS s{i}"
                       for i, c in enumerate(ATTR_FEATURES)])
    each = "\nUNION ALL ".join(
        f"SELECT txn_id, '{c}' AS feature, {w} * (coalesce(CAST({c} AS DOUBLE), -999.0) - m{i}) / "
        f"(CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0 ELSE s{i} END) AS shap FROM feat, st"
        for i, (c, w) in enumerate(zip(ATTR_FEATURES, ATTR_WEIGHTS)))
    ctes = f"""{_HI},
flagged AS (SELECT * FROM (SELECT *, {signal} AS sig FROM feat) WHERE risk_band IN ('HIGH', 'CRITICAL') OR risk_band = 'MEDIUM' AND sig),
st AS (SELECT {stats} FROM feat), u AS ({each}),
why AS (SELECT txn_id, array_to_string(list(feature ORDER BY abs(shap) DESC, feature)[1:3], ',') AS drivers FROM u GROUP BY txn_id),
past AS (SELECT txn_id, list(txn_id) OVER (PARTITION BY card ORDER BY t, txn_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM txn),
shop AS (SELECT channel, count(*) AS channel_n, avg(is_fraud) AS channel_fraud_rate FROM feat WHERE channel IS NOT NULL GROUP BY channel),
near AS ({_topk_sql(2, 0.25)}),
counted AS (
  SELECT txn_id, count(*) FILTER (WHERE status = 'present') AS present, count(*) FILTER (WHERE status = 'absent') AS absent,
         count(*) FILTER (WHERE status = 'manual') AS manual, count(*) FILTER (WHERE status = 'unknown') AS unknown,
         bool_or(check_id = 0 AND status = 'present') AS first FROM ({_STATUS_ROWS}) GROUP BY txn_id)"""
    return feat_query("""
SELECT f.txn_id, f.risk_band, why.drivers, f.card_total_txns, coalesce(array_to_string(past.history, ','), '') AS history,
       shop.channel_n, shop.channel_fraud_rate, n1.pid AS match_pid, n1.cos AS match_cos,
       c.present, c.absent, c.manual, c.unknown,
       CASE WHEN c.present + c.absent = 0 THEN 'insufficient' WHEN c.present >= 3 AND c.present > c.absent THEN 'strong'
            WHEN c.first AND c.absent > 0 THEN 'defining' WHEN c.present > 0 THEN 'mixed'
            WHEN c.absent >= 2 THEN 'no_fit' ELSE 'inconclusive' END AS tier
FROM flagged f JOIN why USING (txn_id) JOIN past USING (txn_id) JOIN shop ON shop.channel = f.channel JOIN counted c USING (txn_id)
LEFT JOIN (SELECT * FROM near WHERE rank = 1) n1 ON n1.qid = f.txn_id % (SELECT count(*) FROM embeddings)""",
                      ["channel_fraud_rate", "match_cos"], ctes)


@register("case_files", ops=("RU-14", "ML-7", "AG-8", "WN-4", "RT-3", "RU-8", "AG-26", "RU-6"), sql=_case_sql())
def q_case_files(spark, sf):
    """The case file of every flagged transaction; its query vector is the
    embedding whose number is the transaction's modulo their count."""
    vectors = B.table(spark, sf, "embeddings")
    hits = V.top_k_cosine(vectors, vectors.where("label <= 6"), 2, min_cos=0.25, exclude_self=True)
    hits = hits.select("qid", "rank", "pid", F.col("cos").alias("similarity"), V.similarity_band("cos").alias("match_band"))
    f = materialize(_feat(spark, sf).where("channel is not null"), "case-features")  # for the explainer and the files
    rows = f.withColumn("pattern_id", F.col("channel")).withColumn("query_id", F.pmod("txn_id", F.lit(vectors.count())))
    out = case_files(rows, _fixed_explainer(f), _channel_checks(B.transactions(spark, sf)), hits,
                     numeric=M.MODEL_FEATURES, categorical=CATEGORICAL)
    names = F.transform("attribution.top_drivers", lambda d: d["feature"])
    return out.select(
        "txn_id", "triage.risk_band", F.array_join(names, ",").alias("drivers"), F.col("profile.total_txns").alias("card_total_txns"),
        F.array_join(F.transform("profile.history", lambda x: x.cast("string")), ",").alias("history"),
        F.col("profile.channel_profile.n").alias("channel_n"), F.col("profile.channel_profile.fraud_rate").alias("channel_fraud_rate"),
        F.try_element_at("matches", F.lit(1))["pid"].alias("match_pid"), F.try_element_at("matches", F.lit(1))["similarity"].alias("match_cos"),
        *[F.col(f"verdict.{s}").alias(s) for s in CH.STATUSES], "verdict.tier")


# ----------------------------------------------------------------------------- RU-6
@register("rule_input_set", ops=("RU-6", "PF-8", "PF-9", "ST-4"), sql=txn_query("""
SELECT txn_id, score FROM recent WHERE score >= 0.6
UNION ALL
SELECT txn_id, score FROM (
  SELECT txn_id, score, row_number() OVER (ORDER BY md5('42:' || CAST(txn_id AS VARCHAR)), txn_id) AS rn
  FROM recent WHERE NOT (score >= 0.6) OR score IS NULL)
WHERE rn <= 5 * (SELECT count(*) FROM recent WHERE score >= 0.6)""", ["score"],
    extra_ctes="recent AS (SELECT * FROM txn WHERE t >= (SELECT max(t) FROM txn) - 10 * 86400)"))
def q_rule_input(spark, sf):
    return CH.rule_input_set(B.transactions(spark, sf), days=10).select("txn_id", "score")


# ----------------------------------------------------------------------------- PF-19
_RULES_SQL = [
    ("card_testing", "a < 10 AND h1 >= 2", "3 + h1", "['small_test_charge', 'rapid_followup']"),
    ("velocity_attack", "h24 >= 8 OR h1 >= 4", "h24 + h1 * 2",
     "CASE WHEN dp >= 3 THEN ['high_velocity', 'diverse_merchants'] ELSE ['high_velocity'] END"),
    ("account_takeover", "em = 0 AND z > 2.5", "5 + z", "['email_mismatch', 'post_change_large_purchase']"),
    ("synthetic_identity", "tt BETWEEN 10 AND 60 AND z > 3", "z + tt / 10", "['moderate_history_then_bustout', 'extreme_zscore']"),
    ("temporal_anomaly", "nt = 1 AND z > 1.5", "z + 2", "['off_hours', 'elevated_amount']"),
    ("email_risk", "pr = 1", "2 + greatest(z, 0.0)", "['high_risk_email_domain']"),
    ("bin_attack", "a < 5 AND h1 <= 1 AND tt < 10", "4", "['low_amount_test']"),
    ("subscription_probe", "a BETWEEN 0.99 AND 14.99 AND h24 <= 3", "3", "['subscription_amount']"),
]


def _categorize_sql() -> str:
    scores = ", ".join(f"CASE WHEN {cond} THEN CAST({s} AS DOUBLE) END AS s{i}" for i, (_, cond, s, _) in enumerate(_RULES_SQL))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(_RULES_SQL))) + ")"
    names = " ".join(f"WHEN s{i} = top THEN '{n}'" for i, (n, *_) in enumerate(_RULES_SQL))
    inds = " || ".join(f"(CASE WHEN s{i} IS NOT NULL THEN {x} ELSE CAST([] AS VARCHAR[]) END)" for i, (*_, x) in enumerate(_RULES_SQL))
    return feat_query(f"""
SELECT txn_id, CASE {names} ELSE 'friendly_fraud' END AS pattern,
       array_to_string(CASE WHEN top IS NULL THEN ['normal_looking_transaction'] ELSE ({inds})[1:5] END, ',') AS indicators
FROM (SELECT *, {top} AS top FROM (SELECT *, {scores} FROM (
  SELECT txn_id, coalesce(amount, 0.0) AS a, coalesce(card_amt_zscore, 0.0) AS z, coalesce(card_txn_count_1h, 0) AS h1,
         coalesce(card_txn_count_24h, 0) AS h24, is_night AS nt, p_email_is_highrisk AS pr, emails_match AS em,
         card_distinct_products AS dp, card_total_txns AS tt FROM feat)))""")


@register("categorize_rows", ops=("PF-19",), sql=_categorize_sql())
def q_categorize(spark, sf):
    """The scored pattern rules on every transaction (the tables hold no distance)."""
    pattern, indicators = C.categorize(dist=F.lit(None))
    return _feat(spark, sf).select("txn_id", pattern.alias("pattern"), F.concat_ws(",", indicators).alias("indicators"))
