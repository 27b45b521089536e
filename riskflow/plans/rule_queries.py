"""Registered queries: rules, checks, bursts, sampling (RU-1..5, RU-7/8/10..14,
JN-8, AG-26, ST-1..7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.operators import rules as R
from riskflow.operators import sampling as S
from riskflow.plans.feature_build import build_features
from riskflow.plans.registry import register
from riskflow.plans.sqlhelp import feat_query, txn_query


def _feat(spark, sf):
    return build_features(B.transactions(spark, sf))


# A fixed rule set, scaled to the sparse velocity of the driver data.
FIXED_RULES = [
    ("velocity-burst-24h", "card_txn_count_24h >= 3", "velocity"),
    ("velocity-burst-1h", "card_txn_count_1h >= 1", "velocity"),
    ("amount-outlier", "amount >= 150.0", "amount"),
    ("amount-zscore-2", "card_amt_zscore >= 2.0", "amount"),
    ("email-high-risk-domain", "p_email_is_highrisk = 1", "email"),
    ("email-mismatch", "emails_match = 0", "email"),
    ("device-first-pairing", "D1 = 0", "device"),
    ("night-activity", "is_night = 1", "timing"),
]

_METRICS_SQL = """
SELECT rule_name, family, predicate, tp, fp, tp + fp AS fired,
       coalesce(tp / nullif("P", 0), 0.0) AS catch_rate,
       coalesce(fp / nullif("N", 0), 0.0) AS fp_rate,
       coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
       coalesce(coalesce(tp / nullif(tp + fp, 0), 0.0) / nullif(coalesce("P" / nullif("P" + "N", 0), 0.0), 0.0), 0.0) AS lift,
       CASE WHEN coalesce(tp / nullif("P", 0), 0.0) > 0.3 AND coalesce(fp / nullif("N", 0), 0.0) < 0.01 THEN 'block'
            WHEN coalesce(coalesce(tp / nullif(tp + fp, 0), 0.0) / nullif(coalesce("P" / nullif("P" + "N", 0), 0.0), 0.0), 0.0) < 1.5 THEN 'monitor'
            ELSE 'review' END AS severity
FROM ({inner})"""
_RULE_DOUBLES = ["catch_rate", "fp_rate", "precision", "lift"]


def _rules_sql(rules, src="feat"):
    parts = []
    for n, p, f in rules:
        pe = p.replace("'", "''")
        parts.append(
            f"SELECT '{n}' AS rule_name, '{f}' AS family, '{pe}' AS predicate, "
            f"CAST(sum(CASE WHEN coalesce({p}, false) AND is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            f"CAST(sum(CASE WHEN coalesce({p}, false) AND is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            f"sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS \"P\", "
            f"sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) AS \"N\" FROM {src}")
    return _METRICS_SQL.format(inner="\nUNION ALL ".join(parts))


@register("evaluate_rules", ops=("RU-1",), sql=feat_query(_rules_sql(FIXED_RULES), _RULE_DOUBLES))
def q_evaluate_rules(spark, sf):
    return R.evaluate_rules(_feat(spark, sf), FIXED_RULES)


_RANK_SQL = """
SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY fp_rate, catch_rate DESC, rule_name) AS k
  FROM (
    SELECT e.*, regexp_extract(predicate, '^\\s*([A-Za-z_][A-Za-z0-9_]*)', 1) AS feature
    FROM ev e
    WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE (o.catch_rate > e.catch_rate AND o.fp_rate <= e.fp_rate)
                                         OR (o.catch_rate = e.catch_rate AND o.fp_rate < e.fp_rate))))
WHERE k = 1"""


@register("rank_rules", ops=("RU-3",), sql=feat_query(
    "SELECT *, CAST(row_number() OVER (ORDER BY catch_rate / greatest(fp_rate, 1e-6) DESC, catch_rate DESC, rule_name) AS BIGINT) AS rank FROM ("
    + _RANK_SQL + ") QUALIFY rank <= 8", _RULE_DOUBLES,
    extra_ctes="ev AS (" + _rules_sql(FIXED_RULES) + ")"))
def q_rank_rules(spark, sf):
    return R.rank_rules(R.evaluate_rules(_feat(spark, sf), FIXED_RULES))


_COMPOSITE = FIXED_RULES[:4]


def _pairs(rules):
    out = []
    for i in range(len(rules)):
        for j in range(i + 1, len(rules)):
            (n1, p1, f1), (n2, p2, f2) = rules[i], rules[j]
            out.append((f"{n1}+{n2}", f"({p1}) AND ({p2})", f"{f1}+{f2}"))
    return out


@register("composite_rules", ops=("RU-4",), sql=feat_query(_rules_sql(_pairs(_COMPOSITE)), _RULE_DOUBLES))
def q_composite(spark, sf):
    return R.composite_rules(_feat(spark, sf), _COMPOSITE)


@register("rule_coverage", ops=("RU-5",), sql=feat_query(
    "SELECT CAST(" + str(len(FIXED_RULES)) + " AS BIGINT) AS n_rules, "
    "CAST(sum(CASE WHEN a AND is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
    "CAST(sum(CASE WHEN a AND is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "coalesce(sum(CASE WHEN a AND is_fraud = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END), 0), 0.0) AS catch_rate, "
    "coalesce(sum(CASE WHEN a AND is_fraud = 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END), 0), 0.0) AS fp_rate "
    "FROM (SELECT *, (" + " OR ".join(f"coalesce({p}, false)" for _, p, _f in FIXED_RULES) + ") AS a FROM feat)",
    ["catch_rate", "fp_rate"]))
def q_coverage(spark, sf):
    return R.coverage(_feat(spark, sf), FIXED_RULES)


def _propose_sql():
    cols = [(fam, c) for fam, cs in R.NUMERIC_FAMILIES.items() for c in cs]
    qs = R.CANDIDATE_QUANTILES
    thr = ", ".join(f"quantile_cont(CASE WHEN is_fraud = 1 THEN {c} END, {q}) AS \"{c}_{int(q * 100)}\""
                    for _, c in cols for q in qs)
    parts = []
    for fam, c in cols:
        for k, q in enumerate(qs):
            tq = f'th."{c}_{int(q * 100)}"'
            prev = [f'th."{c}_{int(p * 100)}"' for p in qs[:k]]
            cond = " AND ".join([f"{tq} IS NOT NULL"] + [f"{tq} IS DISTINCT FROM {pp}" for pp in prev])
            parts.append(
                f"SELECT '{c}-ge-p{int(q * 100)}' AS rule_name, '{fam}' AS family, "
                f"CAST(sum(CASE WHEN coalesce({c} >= {tq}, false) AND is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
                f"CAST(sum(CASE WHEN coalesce({c} >= {tq}, false) AND is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
                f"sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) AS \"P\", sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) AS \"N\" "
                f"FROM feat, (SELECT * FROM th WHERE {cond}) th GROUP BY {tq}")
    for n, p, f in R.FLAG_RULES:
        parts.append(
            f"SELECT '{n}', '{f}', CAST(sum(CASE WHEN coalesce({p}, false) AND is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT), "
            f"CAST(sum(CASE WHEN coalesce({p}, false) AND is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT), "
            f"sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END), sum(CASE WHEN is_fraud = 0 THEN 1 ELSE 0 END) FROM feat")
    parts.append(
        "SELECT 'domain-' || d.p_email, 'email', "
        "CAST(sum(CASE WHEN f.p_email = d.p_email AND f.is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT), "
        "CAST(sum(CASE WHEN f.p_email = d.p_email AND f.is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT), "
        "sum(CASE WHEN f.is_fraud = 1 THEN 1 ELSE 0 END), sum(CASE WHEN f.is_fraud = 0 THEN 1 ELSE 0 END) "
        "FROM feat f, (SELECT p_email FROM feat WHERE p_email IS NOT NULL GROUP BY p_email HAVING count(*) >= 5 "
        "ORDER BY sum(is_fraud) / count(*) DESC, p_email LIMIT 3) d GROUP BY d.p_email")
    inner = "\nUNION ALL ".join(parts)
    body = _METRICS_SQL.replace("predicate, ", "").format(inner=inner)
    return feat_query(body, _RULE_DOUBLES, extra_ctes=f"th AS (SELECT {thr} FROM feat)")


@register("propose_rules", ops=("RU-2", "RU-6"), sql=_propose_sql())
def q_propose(spark, sf):
    return R.propose_rules(_feat(spark, sf)).drop("predicate")


# ----------------------------------------------------------------------------- RU-12 bursts
_ISLAND_SQL = """
SELECT kind, key, island_start, count(*) AS n, count(DISTINCT card) AS n_cards, min(t) AS t_first,
       max(t) AS t_last, sum(amount) AS amount_sum
FROM (
  SELECT kind, key, card, t, amount,
         max(CASE WHEN prev IS NULL OR t - prev > gap THEN t END)
           OVER (PARTITION BY kind, key ORDER BY t, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island_start
  FROM (
    SELECT *, lag(t) OVER (PARTITION BY kind, key ORDER BY t, txn_id) AS prev FROM (
      SELECT 'bin' AS kind, CAST(CAST(floor(card / 1000) AS BIGINT) AS VARCHAR) AS key, 3600 AS gap, * FROM flagged
      UNION ALL SELECT 'channel', channel, 600, * FROM flagged WHERE channel IS NOT NULL
      UNION ALL SELECT 'amount_band', CASE WHEN amount < 5 THEN 'tiny_under_5' WHEN amount < 50 THEN 'small_5_to_50'
            WHEN amount < 500 THEN 'medium_50_to_500' WHEN amount >= 500 THEN 'large_500_plus' END, 600, * FROM flagged)
    WHERE key IS NOT NULL))
GROUP BY kind, key, island_start HAVING count(*) >= 3
UNION ALL
SELECT 'hour', CAST(CAST(floor((t % 86400) / 3600) AS BIGINT) AS VARCHAR), -1, count(*), count(DISTINCT card),
       min(t), max(t), sum(amount)
FROM flagged GROUP BY 2 HAVING count(DISTINCT card) >= 3 AND count(*) >= 3"""


@register("coordinated_clusters", ops=("RU-12",), sql=txn_query(
    _ISLAND_SQL, ["amount_sum"], extra_ctes="flagged AS (SELECT * FROM txn WHERE score >= 0.3)"))
def q_clusters(spark, sf):
    return R.coordinated_clusters(B.transactions(spark, sf), min_score=0.3, split_seconds=None)


@register("coordinated_clusters_split", ops=("RU-12", "H1"), sql=txn_query(
    _ISLAND_SQL, ["amount_sum"], extra_ctes="flagged AS (SELECT * FROM txn WHERE score >= 0.3)"))
def q_clusters_split(spark, sf):
    return R.coordinated_clusters(B.transactions(spark, sf), min_score=0.3, split_seconds=86400)


# ----------------------------------------------------------------------------- RU-10/11/13/14
_AUTO_FEATURES = ["card_txn_count_1h", "card_txn_count_24h", "card_seconds_since_last",
                  "card_amt_zscore", "amount", "p_email_is_highrisk", "emails_match", "is_night", "txn_hour"]


def _auto_sql(f, v):
    return f"""CASE
  WHEN {f} LIKE '%txn_count_1h%' THEN CASE WHEN coalesce({v}, 0.0) >= 5 THEN 'present' ELSE 'absent' END
  WHEN {f} LIKE '%txn_count_24h%' THEN CASE WHEN coalesce({v}, 0.0) >= 20 THEN 'present' ELSE 'absent' END
  WHEN {f} LIKE '%seconds_since_last%' THEN CASE WHEN coalesce({v}, 99999.0) < 60 THEN 'present' ELSE 'absent' END
  WHEN {f} LIKE '%amt_zscore%' THEN CASE WHEN abs(coalesce({v}, 0.0)) >= 3.0 THEN 'present' ELSE 'absent' END
  WHEN {f} = 'amount' THEN CASE WHEN coalesce({v}, 0.0) >= 500 THEN 'present' ELSE 'absent' END
  WHEN {f} LIKE '%is_highrisk%' THEN CASE WHEN coalesce({v}, 0.0) = 1 THEN 'present' ELSE 'absent' END
  WHEN {f} LIKE '%emails_match%' THEN CASE WHEN coalesce({v}, 1.0) = 1 THEN 'absent' ELSE 'present' END
  WHEN {f} = 'is_night' THEN CASE WHEN coalesce({v}, 0.0) = 1 THEN 'present' ELSE 'absent' END
  WHEN {f} = 'txn_hour' THEN CASE WHEN coalesce({v}, -1.0) BETWEEN 0 AND 5 THEN 'present' ELSE 'absent' END
  ELSE 'manual' END"""


@register("auto_checks", ops=("RU-10",), sql=feat_query(
    "SELECT txn_id, feature, actual, " + _auto_sql("feature", "actual") + " AS status FROM (UNPIVOT (SELECT txn_id, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _AUTO_FEATURES)
    + " FROM feat) ON " + ", ".join(_AUTO_FEATURES) + " INTO NAME feature VALUE actual)", ["actual"]))
def q_auto_checks(spark, sf):
    f = build_features(B.transactions(spark, sf))
    longf = R.unpivot(f, "txn_id", _AUTO_FEATURES).filter(F.col("actual").isNotNull())
    return longf.withColumn("status", R.auto_check(F.col("feature"), F.col("actual")))


@register("elevation_levels", ops=("RU-11",), sql=feat_query("""
SELECT txn_id, feature, actual, elevated, extreme,
       CASE WHEN actual IS NULL THEN 'unknown' WHEN extreme IS NOT NULL AND actual > extreme THEN 'extreme'
            WHEN actual > elevated THEN 'elevated' ELSE 'normal' END AS level
FROM (UNPIVOT (SELECT txn_id, CAST(card_amt_zscore AS DOUBLE) AS card_amt_zscore,
                      CAST(card_txn_count_24h AS DOUBLE) AS card_txn_count_24h FROM feat)
      ON card_amt_zscore, card_txn_count_24h INTO NAME feature VALUE actual)
JOIN (VALUES ('card_amt_zscore', 1.5, 3.0), ('card_txn_count_24h', 10.0, 30.0)) a(feature, elevated, extreme)
USING (feature)""", ["actual", "elevated", "extreme"]))
def q_elevation(spark, sf):
    f = build_features(B.transactions(spark, sf))
    return R.elevation(R.unpivot(f, "txn_id", ["card_amt_zscore", "card_txn_count_24h"])) \
            .select("txn_id", "feature", "actual", "elevated", "extreme", "level")


@register("triage", ops=("RU-14", "RU-10", "PF-6"), sql=feat_query("""
SELECT txn_id, risk_band, CAST(sig AS BIGINT) AS suspicious_signal,
       CAST(CASE WHEN risk_band IN ('HIGH', 'CRITICAL') THEN true WHEN risk_band = 'MEDIUM' THEN sig ELSE false END AS BIGINT) AS investigate
FROM (SELECT txn_id, risk_band, (""" + " OR ".join(
    "(" + _auto_sql(f"'{c}'", f"CAST({c} AS DOUBLE)") + ") = 'present'" for c in _AUTO_FEATURES[:-1]) + """) AS sig FROM feat)"""))
def q_triage(spark, sf):
    return R.triage(build_features(B.transactions(spark, sf))).select(
        "txn_id", "risk_band", "suspicious_signal", "investigate")


@register("compact_rows", ops=("RU-13",), sql=feat_query("""
SELECT CAST(txn_id AS VARCHAR) AS "TransactionID", floor(amount * 100.0 + 0.5) / 100.0 AS amount,
       CAST(floor(card / 1000) AS BIGINT) AS card_bin, coalesce(channel, '?') AS channel,
       CAST(floor((t % 86400) / 3600) AS BIGINT) AS hour, floor(score * 1000.0 + 0.5) / 1000.0 AS score,
       CAST(coalesce(card_txn_count_24h, 0) AS BIGINT) AS velocity_24h
FROM feat WHERE score >= 0.6 ORDER BY t DESC, txn_id DESC LIMIT 30""", ["amount", "score"]))
def q_compact(spark, sf):
    f = build_features(B.transactions(spark, sf)).filter(F.col("score") >= 0.6)
    return R.compact_rows(f)


# ----------------------------------------------------------------------------- sampling
@register("sample_to_rate", ops=("ST-3", "H7"), sql=txn_query("""
SELECT txn_id, is_fraud FROM (
  SELECT txn_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42:' || CAST(txn_id AS VARCHAR)), txn_id) AS rn
  FROM txn WHERE is_fraud IN (0, 1))
WHERE (is_fraud = 1 AND rn <= 100) OR (is_fraud = 0 AND rn <= 1900)"""))
def q_sample_rate(spark, sf):
    return S.sample_to_rate(B.transactions(spark, sf), 2000, 0.05).select("txn_id", "is_fraud")


@register("baseline_sample", ops=("ST-4", "ST-1", "RU-6"), sql=txn_query("""
SELECT txn_id, score FROM txn WHERE score >= 0.6
UNION ALL
SELECT txn_id, score FROM (
  SELECT txn_id, score, row_number() OVER (ORDER BY md5('42:' || CAST(txn_id AS VARCHAR)), txn_id) AS rn
  FROM txn WHERE NOT (score >= 0.6) OR score IS NULL)
WHERE rn <= 5 * (SELECT count(*) FROM txn WHERE score >= 0.6)""", ["score"]))
def q_baseline(spark, sf):
    df = B.transactions(spark, sf)
    return S.baseline_sample(df, F.col("score") >= 0.6).select("txn_id", "score")


@register("stratified_split", ops=("ST-5",), sql=txn_query("""
SELECT txn_id, is_fraud, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT txn_id, is_fraud,
         row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42:' || CAST(txn_id AS VARCHAR)), txn_id) AS rn,
         count(*) OVER (PARTITION BY is_fraud) AS n
  FROM txn)"""))
def q_strat(spark, sf):
    return S.stratified_split(B.transactions(spark, sf)).select("txn_id", "is_fraud", "split")


@register("time_split", ops=("ST-5", "S15"), sql=txn_query("""
SELECT txn_id, CASE WHEN t >= (SELECT quantile_cont(t, 0.8) FROM txn) THEN 'test' ELSE 'train' END AS split
FROM txn"""))
def q_time_split(spark, sf):
    return S.time_split(B.transactions(spark, sf)).select("txn_id", "split")


@register("cap_rows", ops=("ST-6",), sql=txn_query("""
SELECT txn_id FROM (SELECT txn_id, row_number() OVER (ORDER BY md5('42:' || CAST(txn_id AS VARCHAR)), txn_id) AS rn
                    FROM txn WHERE is_fraud = 0) WHERE rn <= 3000"""))
def q_cap_rows(spark, sf):
    legit = B.transactions(spark, sf).filter(F.col("is_fraud") == 0)
    return S.cap_rows(legit, 3000, "txn_id").select("txn_id")


@register("split_half", ops=("ST-7",), sql="""
SELECT vec_id, CASE WHEN rn <= floor(n / 2) THEN 'fit' ELSE 'holdout' END AS half FROM (
  SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
         count(*) OVER () AS n FROM embeddings)""")
def q_split_half(spark, sf):
    return S.split_half(B.table(spark, sf, "embeddings").select("vec_id"), "vec_id")
