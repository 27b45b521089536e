"""Registered queries: case files, checks, logs, incremental runs, readers
(AG-20, AG-22, AG-23, AG-26, RU-7..9, JN-8, PF-3, PF-16..18, PF-23..25, O-1,
O-2, IO-1..4, IO-6, IO-9, RT-2, RT-6, WN-10)."""

from __future__ import annotations

import os

from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.functions import cases as C
from riskflow.operators import checks as CH
from riskflow.operators import evaluate as EV
from riskflow.operators import library as L
from riskflow.operators import models as M
from riskflow.operators import rules as R
from riskflow.operators import vectors as V
from riskflow.plans import incremental as INC
from riskflow.functions.features import time_features
from riskflow.operators.windows import ROWS, prior_profile
from riskflow.plans.feature_build import build_features
from riskflow.plans.feature_queries import _PRIOR_SQL
from riskflow.plans.library_queries import CASES_CTE, wc
from riskflow.plans.model_queries import _fixed_explainer
from riskflow.plans.registry import register
from riskflow.plans.sqlhelp import feat_query, rounded, txn_query
from riskflow.session import materialize, scratch_path
from riskflow.sources import io as IO


def _feat(spark, sf):
    return build_features(B.transactions(spark, sf))


# ----------------------------------------------------------------------------- AG-20
def _subgroup_sql():
    feats = INC.SUBGROUP_FEATURES
    unp = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in feats)
    body = f"""
SELECT subgroup, feature, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75,
       quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, avg(value) AS mean,
       count(CASE WHEN value <> 0 THEN 1 END) AS count_nonzero, count(value) AS n
FROM (UNPIVOT (SELECT subgroup, {unp} FROM (
        SELECT 'top_score' AS subgroup, * FROM (SELECT * FROM feat ORDER BY score DESC, txn_id LIMIT 300)
        UNION ALL SELECT 'confirmed_fraud', * FROM feat WHERE is_fraud = 1
        UNION ALL SELECT 'confirmed_legit', * FROM feat WHERE is_fraud = 0))
      ON {", ".join(f'"{c}"' for c in feats)} INTO NAME feature VALUE value)
GROUP BY subgroup, feature"""
    return feat_query(body, ["median", "p75", "p90", "p99", "mean"])


@register("subgroup_stats", ops=("AG-20",), sql=_subgroup_sql())
def q_subgroups(spark, sf):
    return INC.subgroup_stats(_feat(spark, sf))


# ----------------------------------------------------------------------------- AG-22 / AG-23 / PF-23
_LOG_CTE = """log AS (
  SELECT conv_id AS txn_id, turn, role AS stage, text, CAST(length(text) AS DOUBLE) AS duration_ms,
         CASE role WHEN 'user' THEN 'card_testing' WHEN 'assistant' THEN 'account_takeover' ELSE 'velocity_attack' END AS pattern
  FROM conversations)"""


@register("pattern_frequency", ops=("AG-22", "PF-16", "SL-4"), sql=f"""WITH {_LOG_CTE}
SELECT pattern, count(*) AS n, upper(substr(replace(pattern, '_', ' '), 1, 1)) || lower(substr(replace(pattern, '_', ' '), 2)) AS label0,
       (SELECT count(DISTINCT txn_id) FROM log) AS distinct_txn
FROM log GROUP BY pattern ORDER BY n DESC, pattern LIMIT 10""")
def q_pattern_freq(spark, sf):
    """Match log from conversations: turn role stands in for the matched pattern."""
    conv = B.table(spark, sf, "conversations")
    log = conv.select(F.col("conv_id").alias("txn_id"), F.when(F.col("role") == "user", "card_testing")
                      .when(F.col("role") == "assistant", "account_takeover").otherwise("velocity_attack")
                      .alias("pattern"))
    distinct = log.select(F.countDistinct("txn_id")).scalar()
    top = log.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "pattern").limit(10)
    # label0: first letter upper, rest lower (a SQL-portable spelling); the
    # dashboard title case is C.title_label, checked in tests
    lab = F.concat(F.upper(F.substring(F.replace("pattern", F.lit("_"), F.lit(" ")), 1, 1)),
                   F.lower(F.expr("substring(replace(pattern, '_', ' '), 2)")))
    return top.withColumn("label0", lab).withColumn("distinct_txn", distinct)


@register("run_latency", ops=("AG-23",), sql=f"""WITH {_LOG_CTE}
SELECT avg(total) AS avg_latency_ms, count(*) AS n_runs FROM (SELECT txn_id, sum(duration_ms) AS total FROM log GROUP BY txn_id)""")
def q_latency(spark, sf):
    conv = B.table(spark, sf, "conversations")
    per = conv.groupBy(F.col("conv_id").alias("txn_id")).agg(F.sum(F.length("text").cast("double")).alias("total"))
    return per.agg(F.avg("total").alias("avg_latency_ms"), F.count(F.lit(1)).alias("n_runs"))


@register("fit_verdicts", ops=("PF-23",), sql="""
SELECT conv_id, turn,
       CASE WHEN contains(lower(text), 'none actually fits') OR contains(lower(text), 'no pattern from the library matches')
                 OR contains(lower(text), 'none of the retrieved') THEN 'no_fit'
            WHEN contains(lower(text), 'matches the') AND NOT contains(lower(text), 'partially matches')
                 AND NOT contains(substr(lower(text), 1, 200), 'none') THEN 'strong'
            WHEN contains(lower(text), 'partially matches') THEN 'partial' ELSE 'no_fit' END AS verdict,
       length(text) AS n_chars
FROM conversations""")
def q_fit_verdicts(spark, sf):
    conv = B.table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", C.fit_verdict("text").alias("verdict"),
                       F.length("text").alias("n_chars"))


# ----------------------------------------------------------------------------- PF-17 / PF-18 / PF-3
@register("query_texts", ops=("PF-17", "PF-3"), sql=feat_query("""
SELECT txn_id, CASE WHEN q = '' THEN 'high risk fraud transaction with anomalous behavior' ELSE q END AS query
FROM (SELECT txn_id, concat_ws(' ',
        CASE WHEN amount IS NOT NULL THEN printf('transaction amount $%.2f', amount) END,
        CASE WHEN channel IS NOT NULL AND channel <> '' THEN 'on channel ' || channel END,
        CASE WHEN coalesce(card_txn_count_24h, 0) > 1 THEN printf('with %d transactions on this card in last 24 hours', card_txn_count_24h) END,
        CASE WHEN coalesce(card_txn_count_1h, 0) > 0 THEN printf('and %d in the last hour', card_txn_count_1h) END,
        CASE WHEN abs(coalesce(card_amt_zscore, 0.0)) >= 1.0 THEN printf('amount %s card''s typical pattern (z-score %+.1f)',
             CASE WHEN card_amt_zscore > 0 THEN 'above' ELSE 'below' END, card_amt_zscore) END,
        CASE WHEN is_night = 1 THEN 'at night-time' END,
        CASE WHEN score >= 0.6 THEN 'flagged as high risk' END) AS q FROM feat)"""))
def q_query_texts(spark, sf):
    f = _feat(spark, sf)
    keep = [c for c in ("txn_id", "amount", "channel", "card_txn_count_24h", "card_txn_count_1h",
                        "card_amt_zscore", "is_night", "score", "not_a_column") if c in f.columns]
    f = f.select(*keep)                                    # PF-3: projection tolerant of absent names
    return f.select("txn_id", C.query_text().alias("query"))


@register("surface_queries", ops=("PF-18", "ML-8", "S17"))
def q_surface(spark, sf):
    """Three-way retrieval queries from fixed-weight attributions (rows-only:
    text formatting of floats differs between engines at ties)."""
    f = _feat(spark, sf)
    a = M.attribute(f, _fixed_explainer(f), k=3)
    j = f.join(a.select("txn_id", "by_family"), "txn_id")
    return j.select("txn_id", C.surface_query().alias("query"))


# ----------------------------------------------------------------------------- RU-7 / RU-8 / JN-8 / AG-26
_IND = "lower(trim(x))"


@register("indicator_checks", ops=("RU-7", "RU-8", "JN-8", "AG-26", "X-6"))
def q_indicator_checks(spark, sf):
    """Case indicators parsed into checks; every transaction is assigned the
    case whose id is its card modulo the number of cases, and its
    checks are evaluated against the transaction's features; summary per
    transaction (rows-only: the assignment is an arbitrary binding; the given
    documents hold no clauses, ``pattern_checks`` reaches every status)."""
    cases = L.case_library(B.table(spark, sf, "documents"))
    checks = CH.compile_checks(L.pair_lists(cases).select(
        F.col("case_id").alias("pattern_id"), F.col("pos").alias("check_id"), "indicator"), M.MODEL_FEATURES, M.CATEGORICAL)
    # document ids are dense 0..n-1 in the driver tables
    rows = _feat(spark, sf).withColumn("pattern_id", F.pmod(F.col("card"), F.lit(cases.count())))
    st = CH.evaluate(rows, checks.where("indicator is not null"), M.MODEL_FEATURES, M.CATEGORICAL)
    return CH.check_summary(st).select("txn_id", *CH.STATUSES, F.col("tier").alias("verdict"))


@register("parse_indicators", ops=("RU-7",), sql=f"""WITH {CASES_CTE}
SELECT case_id, pos, check_type, feature, operator, value FROM (
  SELECT case_id, pos, ind,
         regexp_extract(ind, '{R.INDICATOR_RE}', 1) AS f, regexp_extract(ind, '{R.INDICATOR_RE}', 2) AS op,
         regexp_extract(ind, '{R.INDICATOR_RE}', 3) AS v
  FROM (SELECT case_id, CAST(pos AS BIGINT) AS pos, indicators[pos + 1] AS ind
        FROM (SELECT *, unnest(range(len(indicators))) AS pos FROM cases WHERE len(indicators) > 0)))
CROSS JOIN LATERAL (SELECT CASE WHEN f <> '' THEN 'numeric' ELSE 'manual' END AS check_type,
                           CASE WHEN f <> '' THEN f END AS feature,
                           CASE WHEN f <> '' THEN (CASE WHEN op = '=' THEN '==' ELSE op END) END AS operator,
                           CASE WHEN f <> '' THEN CAST(v AS DOUBLE) END AS value)""")
def q_parse_indicators(spark, sf):
    cases = L.case_library(B.table(spark, sf, "documents"))
    p = R.parse_indicators(L.pair_lists(cases).filter(F.col("indicator").isNotNull()))
    return p.select("case_id", "pos", "check_type", "feature", "operator", "value")


# ----------------------------------------------------------------------------- O-1 / O-2
@register("fingerprint_recompute", ops=("O-1", "JN-5"))
def q_fingerprint(spark, sf):
    """Cache built from the first build; the second build changes amounts of
    one channel; only rows whose fingerprint changed are recomputed, then the
    cache is upserted (rows-only: features of the global scope; the prior scope
    is ``incremental_refresh``)."""
    f1 = INC.feature_fingerprint(_feat(spark, sf)).withColumn("created_at", F.lit(1))
    changed = B.transactions(spark, sf).withColumn(
        "amount", F.when(F.col("channel") == "click", F.col("amount") + 1).otherwise(F.col("amount")))
    f2 = INC.feature_fingerprint(build_features(changed)).withColumn("created_at", F.lit(2))
    todo = INC.needs_recompute(f2, f1.select("cache_key"))
    new_cache = INC.upsert(f1.select("txn_id", "cache_key", "created_at"),
                           todo.select("txn_id", "cache_key", "created_at"))
    return new_cache.groupBy("created_at").agg(F.count(F.lit(1)).alias("n"))


_CHANGED = """changed AS (SELECT * REPLACE (CASE WHEN channel = 'click' AND txn_id % 50 = 0 THEN amount + 1 ELSE amount END AS amount) FROM txn),
firsts AS (SELECT card, min(struct_pack(t := t, i := txn_id)) AS f FROM txn WHERE channel = 'click' AND txn_id % 50 = 0 GROUP BY card)"""


@register("incremental_refresh", ops=("O-1", "O-2", "WN-11"), sql=txn_query(f"""
SELECT p.txn_id, p.card_amt_mean, p.card_amt_std, p.card_total_txns,
       CAST(CASE WHEN struct_pack(t := p.t, i := p.txn_id) >= f.f THEN 2 ELSE 1 END AS BIGINT) AS build
FROM ({_PRIOR_SQL.replace("FROM txn", "FROM changed")}) p LEFT JOIN firsts f USING (card)""",
    ["card_amt_mean", "card_amt_std"], _CHANGED))
def q_refresh(spark, sf):
    """A stored feature table brought up to date after some amounts changed: only
    the changed rows and later rows of their cards are computed again."""
    txn = B.transactions(spark, sf)
    path = scratch_path(spark, "refreshed")

    def build(number):
        return lambda rows: prior_profile(time_features(rows), split_seconds=ROWS).withColumn("build", F.lit(number))

    INC.refresh(txn, path, build(1), exists=False)
    hit = (F.col("channel") == "click") & (F.col("txn_id") % 50 == 0)
    INC.refresh(txn.withColumn("amount", F.when(hit, F.col("amount") + 1).otherwise(F.col("amount"))), path, build(2))
    return spark.read.parquet(path).select("txn_id", "card_amt_mean", "card_amt_std", "card_total_txns", "build")


@register("idempotent_chain", ops=("O-2", "IO-2", "IO-3"), sql=feat_query(
    "SELECT txn_day, count(*) AS n, sum(card_txn_count_24h) AS s24 FROM feat GROUP BY txn_day"))
def q_chain(spark, sf):
    """Feature build written partitioned by day twice (the second run replaces
    the same partitions), read back pruned to three columns."""
    path = scratch_path(spark, "features")
    stage = [("features", lambda: _feat(spark, sf), path, "txn_day")]
    INC.run_chain(spark, stage)
    INC.run_chain(spark, stage)
    back = IO.read_features(spark, path, ["txn_day", "card_txn_count_24h"])
    return back.groupBy(F.col("txn_day").cast("long").alias("txn_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("card_txn_count_24h").alias("s24"))


# ----------------------------------------------------------------------------- IO-1 / IO-4 / IO-6 / IO-9
@register("raw_csv_roundtrip", ops=("IO-1", "IO-4"), sql=rounded("""
SELECT event_type AS "ProductCD", count(*) AS n, sum(value) AS amount
FROM events GROUP BY event_type""", ["amount"]))
def q_csv(spark, sf):
    """Events written as a headed CSV in the raw layout, read back with the
    declared raw schema (no inference pass); also a 100-row preview."""
    ev = B.table(spark, sf, "events")
    raw = ev.select(F.col("event_id").alias("TransactionID"), F.lit(0).alias("isFraud"),
                    B.epoch_seconds(F.col("ts")).alias("TransactionDT"),
                    F.col("value").alias("TransactionAmt"), F.col("event_type").alias("ProductCD"),
                    F.col("user_id").cast("int").alias("card1"), F.lit(None).cast("double").alias("addr1"),
                    F.lit(None).cast("string").alias("P_emaildomain"),
                    F.lit(None).cast("string").alias("R_emaildomain"), F.lit(None).cast("double").alias("D1"))
    path = scratch_path(spark, "raw-csv")
    raw.write.mode("overwrite").option("header", True).csv(path)
    IO.write_csv_preview(raw, scratch_path(spark, "preview"), [F.col("TransactionDT")], 100)
    back = IO.read_raw_csv(spark, path)
    return back.groupBy("ProductCD").agg(F.count(F.lit(1)).alias("n"), F.sum("TransactionAmt").alias("amount"))


@register("nested_stats_json", ops=("IO-6", "IO-9"), sql="""
SELECT CAST(conv_id AS VARCHAR) AS pattern_id, 'conversation_' || conv_id AS pattern, count(*) AS n_queries
FROM conversations GROUP BY conv_id""")
def q_nested_json(spark, sf):
    """One nested record per conversation (a struct holding its texts as
    a query list - bounded by the conversation) written as JSON, read back
    with a declared schema and flattened (explode) to (pattern_id, pattern,
    query)."""
    conv = B.table(spark, sf, "conversations")
    per = conv.groupBy("conv_id").agg(F.collect_list("text").alias("queries"))
    rec = per.select(F.array(F.struct(F.col("conv_id").cast("string").alias("pattern_id"),
                                      F.concat(F.lit("conversation_"), F.col("conv_id")).alias("pattern"),
                                      "queries")).alias("queries"))
    path = scratch_path(spark, "stats-json")
    IO.write_stats_json(rec, path)
    back = spark.read.schema("queries array<struct<pattern_id string, pattern string, queries array<string>>>").json(path)
    flat = IO.flatten_queries(back)
    return flat.groupBy("pattern_id", "pattern").agg(F.count(F.lit(1)).alias("n_queries"))


# ----------------------------------------------------------------------------- RT-2 / RT-6
def _text_model(docs, id_col, text_col, dims=1 << 10):
    """RT-2 offline fallback: tokens -> hashed TF -> IDF (fitted on the library)
    -> L2 normalised, as sparse vectors; returns those of ``docs``, whose hashed TF
    is written once for the fit and the vectors, and a function that embeds any
    text column."""
    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims)
    idf = IDF(inputCol="_tf", outputCol="_idf")
    norm = Normalizer(inputCol="_idf", outputCol="_n")

    def counts(df, id_col, text_col):
        x = df.select(F.col(id_col).alias("vec_id"), F.col(text_col).alias("_text"))
        return tf.transform(tok.transform(x)).select("vec_id", "_tf")

    def weigh(x):
        return norm.transform(fitted.transform(x)).select("vec_id", F.col("_n").alias("embedding"))

    known = materialize(counts(docs, id_col, text_col), "text-counts")
    fitted = idf.fit(known)
    return weigh(known), lambda df, id_col, text_col: weigh(counts(df, id_col, text_col))


@register("text_embedding_search", ops=("RT-2", "RT-6", "PF-16", "PF-17", "RT-3"))
def q_text_search(spark, sf):
    """Offline embedding fallback (hashed TF-IDF fitted on the case documents,
    L2-normalised); each critical transaction's query text matched to its top
    pattern (k = 1) with its title label (rows-only: hashing is Spark's)."""
    cases = L.case_library(B.table(spark, sf, "documents"))
    docs = L.case_document(cases)
    lib, embed = _text_model(docs, "case_id", "document")
    f = _feat(spark, sf).filter(F.col("score") >= 0.85)
    qv = embed(f.select("txn_id", C.query_text().alias("q")), "txn_id", "q")
    hits = V.top_k_cosine(qv, lib, 1)
    return hits.join(cases.select(F.col("case_id").alias("pid"), "category"), "pid") \
               .withColumn("pattern_label", C.title_label(F.col("category")))


@register("cumulative_share", ops=("WN-10",), sql=txn_query("""
SELECT channel, n, CAST(sum(n) OVER (ORDER BY n DESC, channel) AS BIGINT) AS cumulative,
       sum(n) OVER (ORDER BY n DESC, channel) / (SELECT count(*) FROM txn) AS cumulative_share
FROM (SELECT channel, count(*) AS n FROM txn GROUP BY channel)""", ["cumulative_share"]))
def q_cum_share(spark, sf):
    g = B.transactions(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return EV.cumulative_share(g, "n", [F.col("n").desc(), F.col("channel")])


@register("keyword_exclude", ops=("PF-24", "X-8"), sql=f"""
SELECT conv_id, turn FROM conversations
WHERE NOT coalesce(regexp_matches(lower(text), 'fraud|scam|stolen card|phishing|chargeback'), false)""")
def q_keyword_exclude(spark, sf):
    conv = B.table(spark, sf, "conversations")
    return C.keyword_exclude(conv, "text", ["fraud", "scam", "stolen card", "phishing", "chargeback"]) \
            .select("conv_id", "turn")


@register("escape_dollars", ops=("PF-25",), sql=feat_query("""
SELECT txn_id, replace(printf('Amount $%.2f flagged', amount), '$', '\\$') AS text
FROM feat"""))
def q_escape(spark, sf):
    """(The oracle's plain replace equals the look-behind rule here: the texts
    hold no already-escaped dollar.)"""
    f = _feat(spark, sf)
    return f.select("txn_id", C.escape_dollars(F.format_string("Amount $%.2f flagged", F.col("amount"))).alias("text"))
