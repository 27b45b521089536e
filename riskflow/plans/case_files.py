"""Case files: one nested row per flagged transaction, from one plan.

triage (RU-14) -> attribution (ML-7/8) -> card and channel profile, history
(AG-8..10, WN-4) -> library search (RT-3/4) -> pattern checks and verdict
(RU-7/8, AG-26).  The parts join on the transaction, its channel or its query
vector; none is collected, none calls a model of language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators import checks as CH
from riskflow.operators.models import LinearExplainer, attribute
from riskflow.operators.profiles import merchant_profile
from riskflow.operators.rules import triage
from riskflow.operators.windows import rolling_lists
from riskflow.session import materialize


def case_files(features: DataFrame, explainer: LinearExplainer, checks: DataFrame, matches: DataFrame, *,
               numeric: list[str], categorical: list[str], history: int = 3, drivers: int = 3, min_rows: int = 5) -> DataFrame:
    """One row per transaction to investigate: ``triage``, ``attribution``,
    ``profile``, ``matches``, ``checks`` and ``verdict`` as nested columns.

    ``features`` carry ``pattern_id`` (whose ``checks`` apply) and ``query_id``
    (whose ``matches`` (qid, rank, pid, similarity, match_band) apply).  Fewer
    than ``min_rows`` flagged transactions are refused.  ``features`` are read
    several times: pass a written table."""
    flagged = materialize(triage(features).where("investigate"), "case-flagged")
    n = flagged.limit(min_rows).count()
    if n < min_rows:
        raise CH.TooFewRows(f"{n} of at least {min_rows} flagged transactions")
    why = attribute(flagged, explainer, k=drivers).select(
        "txn_id", F.struct("top_drivers", "by_family", "signal_balance", "log_odds").alias("attribution"))
    past = rolling_lists(features.select("txn_id", "card", "t"), "card", F.col("txn_id"), history + 1, name="past").select(
        "txn_id", F.slice("past", 1, F.size("past") - 1).alias("history"))
    shop = merchant_profile(features).select("channel", F.struct("n", "fraud_rate", "amt_median", "amt_p95").alias("channel_profile"))
    near = matches.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "pid", "similarity", "match_band"))).alias("matches"))
    judged = CH.check_summary(CH.evaluate(flagged, checks, numeric, categorical))
    out = (judged.join(why, "txn_id").join(past, "txn_id", "left").join(shop, "channel", "left")
           .join(near, F.col("query_id") == F.col("qid"), "left"))
    return out.select(
        "txn_id", F.struct("score", "risk_band", "suspicious_signal").alias("triage"), "attribution",
        F.struct("card", F.col("card_total_txns").alias("total_txns"), F.col("card_amt_mean").alias("amt_mean"),
                 F.coalesce("history", F.array().cast("array<bigint>")).alias("history"), "channel", "channel_profile").alias("profile"),
        F.coalesce("matches", F.array().cast("array<struct<rank:int,pid:bigint,similarity:double,match_band:string>>")).alias("matches"),
        "checks", F.struct(*CH.STATUSES, "tier").alias("verdict"))
