"""Registered queries: Structured Streaming jobs over the events table as a
file source (SS-1..SS-10, IO-7, IO-8).

Each query runs its streaming job with ``availableNow`` and returns what the
sink wrote.  The oracle SQL states the batch answer the stream must reach: all
rows of the per-card features (the end of the input is marked), else the rows and
windows that the watermark (latest time less the delay) has passed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskflow import bindings as B
from riskflow.operators.profiles import card_profile
from riskflow.operators.windows import DEFAULT_WINDOWS, velocity_sql
from riskflow.plans.feature_queries import _PRIOR_COLS, _PRIOR_SQL
from riskflow.plans.registry import register
from riskflow.plans.sqlhelp import txn_query
from riskflow.sources import io as IO
from riskflow.streaming import features as SF
from riskflow.session import materialize
from riskflow.streaming import jobs as J

VEL_COLS = [f"card_{k}_{w}" for w in ("1h", "24h", "7d") for k in ("txn_count", "amt_sum", "amt_max")]
VEL_DOUBLES = [c for c in VEL_COLS if "amt" in c]
#: features that the stream and the batch both have; counts and flags, so a split of a tree never falls on rounding
STREAM_MODEL_FEATURES = ["amount", "txn_hour", "txn_dayofweek", "is_night", "p_email_isnull", "p_email_is_highrisk",
                         "r_email_isnull", "r_email_is_highrisk", "emails_match", "card_txn_count_1h", "card_txn_count_24h",
                         "card_txn_count_7d", "card_amt_max_24h", "card_seconds_since_last", "card_total_txns",
                         "card_distinct_channel", "card_distinct_addr"]
DELAY = 3600
_SPAN = max(DEFAULT_WINDOWS.values())
#: rows that the watermark has passed
_PASSED = f"t < (SELECT max(t) FROM txn) - {DELAY}"


def _txn_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return J.transactions_stream(J.read_stream(spark, f"{sf}/events.parquet", J.EVENT_SCHEMA))


def _whole_stream(spark, sf):
    """All transactions with the end marked: every row leaves, also those of the last hour."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return J.transactions_stream(J.ended(spark, f"{sf}/events.parquet", DELAY))


@register("stream_velocity", ops=("SS-1", "WN-1"), sql=txn_query(
    f"SELECT txn_id, card, t,\n       {velocity_sql()}\nFROM txn", VEL_DOUBLES))
def q_stream_velocity(spark, sf):
    out = J.run_to_table(SF.stream_card_features(_whole_stream(spark, sf), forget_idle=False), "stream-velocity")
    return out.select("txn_id", "card", "t", *VEL_COLS, "card_seconds_since_last")


@register("stream_profile", ops=("SS-2", "WN-11"), sql=txn_query(
    _PRIOR_SQL, ["card_amt_mean", "card_amt_std", "card_amt_zscore"]))
def q_stream_profile(spark, sf):
    out = J.run_to_table(SF.stream_card_features(_whole_stream(spark, sf), forget_idle=False), "stream-profile")
    return out.select(*_PRIOR_COLS)


@register("stream_engineer", ops=("SS-3", "PF-1", "PF-2"), sql=txn_query(f"""
SELECT txn_id, CAST(floor(t / 3600) % 24 AS BIGINT) AS txn_hour,
       CAST((floor(t / 3600) % 24 >= 22 OR floor(t / 3600) % 24 <= 5) AS BIGINT) AS is_night,
       CAST(coalesce(NOT (p_email IS NULL OR p_email = '') AND p_email = r_email, false) AS BIGINT) AS emails_match,
       card_txn_count_24h, n AS card_total_txns
FROM (SELECT *, {velocity_sql()},
             count(*) OVER (PARTITION BY card ORDER BY t, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
      FROM txn)"""))
def q_stream_engineer(spark, sf):
    out = J.run_to_table(SF.stream_engineer(_whole_stream(spark, sf), forget_idle=False), "stream-engineer")
    return out.select("txn_id", "txn_hour", "is_night", "emails_match", "card_txn_count_24h", "card_total_txns")


@register("stream_tumbling_kpis", ops=("SS-5",), sql=txn_query("""
SELECT window_start, count(*) AS n, sum(amount) AS volume, avg(amount) AS average_ticket,
       CAST(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, max(score) AS highest_score
FROM (SELECT *, CAST(floor(t / 3600) * 3600 AS BIGINT) AS window_start FROM txn)
GROUP BY window_start
HAVING window_start + 3600 <= (SELECT max(t) FROM txn) - 3600""",
    ["volume", "average_ticket", "highest_score"]))
def q_stream_tumbling(spark, sf):
    return J.run_to_table(J.tumbling_kpis(_txn_stream(spark, sf)), "stream-tumbling")


@register("stream_sliding_rate", ops=("SS-6",), sql=txn_query("""
SELECT window_start, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud, sum(is_fraud) / count(*) AS fraud_rate
FROM (SELECT t, is_fraud, CAST(floor(t / 3600) * 3600 AS BIGINT) - 3600 * k AS window_start
      FROM txn, range(0, 24) r(k))
GROUP BY window_start
HAVING window_start + 86400 <= (SELECT max(t) FROM txn) - 3600""", ["fraud_rate"]))
def q_stream_sliding(spark, sf):
    return J.run_to_table(J.sliding_rate(_txn_stream(spark, sf)), "stream-sliding")


@register("stream_sessions", ops=("SS-7",), sql=txn_query("""
SELECT card, min(t) AS session_start, max(t) + 600 AS session_end, count(*) AS n, sum(amount) AS amount
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR t - prev > 600 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY card ORDER BY t, txn_id) AS sid
      FROM (SELECT *, lag(t) OVER (PARTITION BY card ORDER BY t, txn_id) AS prev FROM txn))
GROUP BY card, sid
HAVING max(t) + 600 <= (SELECT max(t) FROM txn) - 3600""", ["amount"]))
def q_stream_sessions(spark, sf):
    return J.run_to_table(J.burst_sessions(_txn_stream(spark, sf)), "stream-sessions")


@register("stream_dedup", ops=("SS-8",), sql="SELECT event_id AS txn_id FROM events")
def q_stream_dedup(spark, sf):
    """Every event is delivered twice (two sources); one of each id leaves."""
    twice = _txn_stream(spark, sf).unionByName(_txn_stream(spark, sf))
    return J.run_to_table(J.dedup(twice), "stream-dedup").select("txn_id")


#: deliveries: every seventh event arrives up to ten hours after its time, every fifth a second time 1 to 16 days later
_LAG = "CASE WHEN event_id % 7 = 0 THEN (event_id % 11) * 3600 ELSE event_id % 60 END"
_AGAIN = "(1 + event_id % 16) * 86400"
_TTL = 10 * 86400


@register("stream_late_routing", ops=("SS-8", "SS-9"), sql=f"""
WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
d AS (SELECT event_id AS txn_id, t, t + {_LAG} AS arrival FROM e
      UNION ALL SELECT event_id, t, t + {_LAG} + {_AGAIN} FROM e WHERE event_id % 5 = 0),
x AS (SELECT *, lag(arrival) OVER (PARTITION BY txn_id ORDER BY arrival, t) AS prev,
             max(t) OVER (ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM d),
y AS (SELECT *, CASE WHEN arrival - prev <= {_TTL} THEN prev END AS previous_arrival FROM x)
SELECT txn_id, t, arrival, previous_arrival,
       CASE WHEN previous_arrival IS NULL AND latest - t > {DELAY} THEN latest - t END AS behind,
       CASE WHEN previous_arrival IS NOT NULL THEN 'repeated' WHEN latest - t > {DELAY} THEN 'late' ELSE 'on_time' END AS route
FROM y""")
def q_stream_late(spark, sf):
    """Deliveries derived from the events (some late, some repeated) as rows with route and reason."""
    lag = F.expr(_LAG.replace("event_id", "txn_id"))
    again = F.when(F.col("txn_id") % 5 == 0, F.expr(_AGAIN.replace("event_id", "txn_id")))
    sent = _txn_stream(spark, sf).select("txn_id", "t", lag.cast("long").alias("lag"), again.cast("long").alias("again"))
    sent = sent.select("txn_id", "t", F.explode(F.filter(F.array(
        F.col("t") + F.col("lag"), F.col("t") + F.col("lag") + F.col("again")), lambda x: x.isNotNull())).alias("arrival"))
    return J.routed(spark, J.run_foreach(sent, "stream-late", J.arrival_router(DELAY, _TTL)))


@register("stream_enrich", ops=("SS-10", "JN-2"), sql=txn_query("""
SELECT t.txn_id, t.card, p.card_amt_mean, p.card_total_txns
FROM txn t LEFT JOIN (SELECT card, avg(amount) AS card_amt_mean, count(txn_id) AS card_total_txns
                      FROM txn GROUP BY card) p USING (card)""", ["card_amt_mean"]))
def q_stream_enrich(spark, sf):
    prof = card_profile(B.transactions(spark, sf)).select("card", "card_amt_mean", "card_total_txns")
    out = J.run_to_table(J.enrich(_txn_stream(spark, sf), prof), "stream-enrich")
    return out.select("txn_id", "card", "card_amt_mean", "card_total_txns")


@register("stream_alerts", ops=("SS-4", "PF-6"), sql=txn_query("""
SELECT txn_id, score,
       CASE WHEN score >= 0.85 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_band,
       CASE WHEN score >= 0.85 THEN 'BLOCK' ELSE 'REVIEW' END AS decision
FROM txn WHERE score >= 0.6""", ["score"]))
def q_stream_alerts(spark, sf):
    out = J.run_foreach(_txn_stream(spark, sf), "stream-alerts", J.alert_writer("HIGH"))
    return spark.read.parquet(out).select("txn_id", "score", "risk_band", "decision")


@register("stream_model_scores", ops=("SS-4", "ML-2"), sql=txn_query(f"""
SELECT count(*) AS n, count(*) AS equal_scores, count(*) AS equal_bands
FROM txn WHERE {_PASSED}"""))
def q_stream_model(spark, sf):
    """A classifier fitted on the batch features scores the stream inside its
    plan; every streamed score and band equals that of the batch."""
    from riskflow.functions.bands import risk_band
    from riskflow.functions.features import email_features, time_features
    from riskflow.operators.models import score, train_classifier
    from riskflow.operators.windows import prior_profile, velocity
    txn = email_features(time_features(B.transactions(spark, sf)))
    batch = materialize(velocity(prior_profile(txn, split_seconds=_SPAN), split_seconds=_SPAN), "model-batch")
    model = train_classifier(batch, STREAM_MODEL_FEATURES, max_iter=10)
    scored = J.score_stream(SF.stream_engineer(_txn_stream(spark, sf), ["amount"]), model, STREAM_MODEL_FEATURES,
                            keep=["txn_id"]).select("txn_id", "model_score")
    got = J.run_to_table(scored.withColumn("risk_band", risk_band("model_score")), "stream-scores")
    want = score(batch, model, STREAM_MODEL_FEATURES, keep=["txn_id"]).select(
        "txn_id", F.col("model_score").alias("batch_score"), risk_band("model_score").alias("batch_band"))
    both = got.join(want, "txn_id")
    same = lambda c: F.sum(c.cast("long"))
    return both.agg(F.count("*").alias("n"), same(F.col("model_score") == F.col("batch_score")).alias("equal_scores"),
                    same(F.col("risk_band") == F.col("batch_band")).alias("equal_bands"))


# ----------------------------------------------------------------------------- IO-7 / IO-8
_LOG_BASE = "2024-01-01 00:00:00"
_AS_OF = datetime(2024, 1, 1, 1, 0, 0)
_HOURS = 0.5


@register("run_log_window", ops=("IO-7", "IO-8", "AG-23"), sql=f"""
SELECT txn_id, stage, duration_ms FROM (
  SELECT CAST(conv_id AS VARCHAR) AS txn_id, role AS stage, CAST(length(text) AS DOUBLE) AS duration_ms,
         TIMESTAMP '{_LOG_BASE}' + to_minutes(conv_id) + to_seconds(turn) AS ts
  FROM conversations)
WHERE ts >= TIMESTAMP '{_AS_OF:%Y-%m-%d %H:%M:%S}' - INTERVAL 30 MINUTE AND ts <= TIMESTAMP '{_AS_OF:%Y-%m-%d %H:%M:%S}'""")
def q_run_log(spark, sf):
    """Run-log rows (conversation = transaction, turn = stage) appended in two
    writes, then read back for the half hour before a fixed ``as_of``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    conv = B.table(spark, sf, "conversations")
    log = conv.select(
        F.expr(f"timestampadd(SECOND, turn, timestampadd(MINUTE, conv_id, TIMESTAMP'{_LOG_BASE}'))").alias("ts"),
        F.col("conv_id").cast("string").alias("txn_id"), F.col("role").alias("stage"),
        F.length("text").cast("double").alias("duration_ms"), F.lit("ok").alias("status"),
        F.lit("rules").alias("model"), F.col("turn"))
    from riskflow.session import scratch_path
    path = scratch_path(spark, "run-log")
    IO.append_log(log.filter(F.col("turn") <= 1).drop("turn"), path)
    IO.append_log(log.filter(F.col("turn") > 1).drop("turn"), path)
    back = IO.read_log(spark, path, _HOURS, _AS_OF)
    return back.select("txn_id", "stage", "duration_ms")
